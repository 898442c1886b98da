"""Boosting in rungs: the built-in learner's trees, continued growth, the best prefix and halving trials."""

import pytest
from pyspark.ml.classification import GBTClassifier

from lapse.operators import classify
from lapse.operators.classify import Boosting
from lapse.sources.session import pin
from test_retention import churners

SMALL = {"maxDepth": 2, "minInstancesPerNode": 10}


@pytest.fixture(scope="module")
def prepared(spark):
    df = churners(spark)
    preprocessing = classify.fit_preprocessing(df.where("split = 'train'"))
    return pin(classify._prepared(df, "ChurnBool", "split", preprocessing))


def test_same_trees_as_the_built_in_learner(prepared):
    mine = Boosting(prepared, patience=100, **SMALL).grow(2).grow(10)
    learner = GBTClassifier(labelCol="_label", maxIter=10, **{**classify.PARAMETERS, **SMALL})
    theirs = learner.fit(prepared.where("NOT _is_val"))
    validation = prepared.where("_is_val")
    assert mine.losses == pytest.approx(theirs.evaluateEachIteration(validation), abs=1e-12)
    assert [t.numNodes for t in mine.trees] == [t.numNodes for t in theirs.trees]
    cut = mine.model(4)
    assert cut.getNumTrees == 4
    assert cut.evaluateEachIteration(validation) == pytest.approx(mine.losses[:4], abs=1e-12)


def test_growth_continues(prepared):
    at_once = Boosting(prepared, patience=100, **SMALL).grow(12)
    in_parts = Boosting(prepared, patience=100, **SMALL).grow(3).grow(12)
    assert in_parts.losses == pytest.approx(at_once.losses, abs=1e-12)


def test_stops_after_the_patience_and_keeps_the_best_rounds(prepared):
    found = Boosting(prepared, patience=1, stepSize=1.0, maxDepth=5, minInstancesPerNode=1).grow(40)
    assert found.stopped and len(found.losses) < 40
    assert found.best < len(found.losses)
    assert found.model().getNumTrees == found.best
    grown = len(found.trees)
    assert len(found.grow(40).trees) == grown


def test_no_validation_rows(prepared):
    found = Boosting(prepared.where("NOT _is_val"), **SMALL).grow(3)
    assert found.best == 1 and found.model().getNumTrees == 1


def test_halving_grows_only_the_better_half_to_the_end(spark):
    df = pin(churners(spark))
    grid = [{"maxDepth": d, "minInstancesPerNode": 10, "stepSize": s} for d in (1, 3) for s in (0.01, 0.2)]
    table, model = classify.trials(df, grid, max_rounds=8, first_rounds=2)
    rows = table.orderBy("trial").collect()
    assert [r["rounds"] for r in rows if not r["finished"]] == [2, 2]
    assert all(r["rounds"] > 2 for r in rows if r["finished"])
    best = [r for r in rows if r["best"]]
    assert len(best) == 1 and best[0]["finished"]
    assert best[0]["f1"] == max(r["f1"] for r in rows if r["finished"])
    assert {"prediction", "probability"} <= set(classify.batch_score(df, model).columns)


def test_a_round_evaluates_one_tree(prepared, monkeypatch):
    """Growing on does not evaluate the trees of a rung once more in each of its rounds."""
    from pyspark.ml.regression import DecisionTreeRegressionModel

    found = Boosting(prepared, patience=100, **SMALL).grow(2)
    evaluated, transform = [], DecisionTreeRegressionModel.transform
    monkeypatch.setattr(
        DecisionTreeRegressionModel, "transform", lambda self, *args: evaluated.append(1) or transform(self, *args)
    )
    found.grow(10)
    assert len(found.losses) == 10 and len(evaluated) == 8
