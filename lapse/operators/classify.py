"""Churn classifier: preprocessing, boosted trees, trials, storage and batch scoring.

Everything is a `pyspark.ml` pipeline, so training and scoring run on the
executors and a stored model scores a table without Python in the row path.
"""

from __future__ import annotations

import json
import math
import random
import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Imputer, ImputerModel, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapse.functions.scalars import log1p_exp
from lapse.operators.evaluate import binary_metrics
from lapse.operators.prep import moments
from lapse.sources.session import pin
from lapse.sources.tables import finished_versions, mark_finished

# The model's columns in imputation order, and the trial's parameters
# as far as the built-in learner has a counterpart. The learner takes step sizes
# up to 1, so its own default of 0.1 stands in for a rate of 3.285.
FEATURES = ("MonthlySpend", "Tenure", "TotalSpend")
MAX_ROUNDS = 2005
PATIENCE = 5
PARAMETERS = {
    "maxDepth": 6,
    "maxBins": 221,
    "minInstancesPerNode": 132,
    "subsamplingRate": 0.681817839127397,
    "featureSubsetStrategy": "0.7992803427991522",
    "stepSize": 0.1,
    "seed": 460409061,
}


def fit_preprocessing(train: DataFrame, features: Sequence[str] = FEATURES) -> PipelineModel:
    """Select and coerce, impute the training mean, standardise by the population
    standard deviation, assemble. All statistics come from `train`."""
    numbers = [f"num_{c}" for c in features]
    filled = [f"full_{c}" for c in features]
    scaled = [f"std_{c}" for c in features]
    coerce = SQLTransformer(
        statement="SELECT *, "
        + ", ".join(f"try_cast(`{c}` AS DOUBLE) AS `{n}`" for c, n in zip(features, numbers))
        + " FROM __THIS__"
    )
    coerced = coerce.transform(train)
    imputer = Imputer(strategy="mean", inputCols=numbers, outputCols=filled).fit(coerced)
    fitted = moments(imputer.transform(coerced), filled)
    standardise = SQLTransformer(
        statement="SELECT *, "
        + ", ".join(
            f"(`{c}` - {mean!r}D) / {(std or 1.0)!r}D AS `{s}`" for (c, (mean, std)), s in zip(fitted.items(), scaled)
        )
        + " FROM __THIS__"
    )
    return PipelineModel([coerce, imputer, standardise, VectorAssembler(inputCols=scaled, outputCol="features")])


class Boosting:
    """Boosted trees for logistic loss, grown round by round and continued at any time.

    A round fits one tree of the built-in learner to the gradients at the margin so far, with the seed of
    its number, so the first rounds are the same however far growing goes. The first rung comes from the built-in
    booster, whose trees are the same and which bins the rows once for all of them; it cannot go on, later rungs can.
    The margin is a column: pinned after a rung, held in the executors' storage in it, where a lost part comes again from the
    pinned one. So a round evaluates one tree, its own. The result is the built-in model, cut to as many rounds as are wanted.
    """

    def __init__(self, rows: DataFrame, patience: int = PATIENCE, **overrides):
        self.patience = patience
        parameters = {**PARAMETERS, **overrides}
        self.step, self.seed = parameters.pop("stepSize"), parameters.pop("seed")
        self.parameters = parameters
        self.rows = rows.select("features", "_label", "_is_val").withColumn("_margin", F.lit(0.0))
        self.trees, self.weights, self.losses = [], [], []
        self.stopped = False

    @property
    def best(self) -> int:
        return best_round(self.losses, self.patience)[0]

    def grow(self, rounds: int) -> Boosting:
        """Add rungs until there are `rounds` rounds or the patience is used up. The first rung has
        32 rounds, a later one 8 to 32, a fifth of those before it."""
        while len(self.trees) < rounds and not self.stopped:
            if self.trees:
                self._rung(min(max(8, len(self.trees) // 5), 32, rounds - len(self.trees)))
            else:
                self._first_rung(min(32, rounds))
            self.stopped = best_round(self.losses, self.patience)[1]
        return self

    def _first_rung(self, size: int) -> None:
        learner = GBTClassifier(labelCol="_label", maxIter=size, stepSize=self.step, seed=self.seed, **self.parameters)
        found = learner.fit(self.rows.where("NOT _is_val"))
        validation = self.rows.where("_is_val")
        self.trees, self.weights = list(found.trees), list(found.treeWeights)
        self.losses = [math.inf] * size if validation.isEmpty() else found.evaluateEachIteration(validation)
        margin = vector_to_array("rawPrediction")[1]
        self.rows = pin(found.transform(self.rows).select("features", "_label", "_is_val", margin.alias("_margin")))

    def _rung(self, size: int) -> None:
        sign = F.col("_label") * 2 - 1
        target = sign * 4 / (1 + F.exp(sign * F.col("_margin") * 2))
        loss = F.avg(F.when(F.col("_is_val"), 2 * log1p_exp(sign * F.col("_margin") * -2)))
        rows = self.rows
        for m in range(len(self.trees), len(self.trees) + size):
            points = rows.where("NOT _is_val").select("features", target.alias("_target"))
            fitted = RandomForestRegressor(
                labelCol="_target", numTrees=1, bootstrap=False, seed=self.seed + m, **self.parameters
            ).fit(points)
            self.trees.append(fitted.trees[0])
            self.weights.append(self.step)
            moved = self._moved(rows, m).persist()
            found = moved.agg(loss).first()[0]  # reads all rows, so the margin is held after it
            self.losses.append(math.inf if found is None else found)  # no validation rows
            if rows is not self.rows:
                rows.unpersist()
            rows = moved
        self.rows = pin(rows)
        rows.unpersist()

    def _moved(self, rows: DataFrame, m: int) -> DataFrame:
        """The rows with the margin moved by the tree of round `m` (from 0)."""
        scored = self.trees[m].setPredictionCol("_tree").transform(rows)
        margin = F.col("_margin") + F.col("_tree") * self.weights[m]
        return scored.select("features", "_label", "_is_val", margin.alias("_margin"))

    def model(self, rounds: int | None = None) -> GBTClassificationModel:
        """The model after `rounds` rounds, or after the best."""
        n = rounds or self.best
        context = SparkContext._active_spark_context
        kind = context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
        trees = context._gateway.new_array(kind, n)
        weights = context._gateway.new_array(context._jvm.double, n)
        for i in range(n):
            trees[i], weights[i] = self.trees[i]._java_obj, self.weights[i]
        found = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
            f"gbt_{self.seed}_{n}", trees, weights
        )
        found.set(found.getParam("labelCol"), "_label")
        return GBTClassificationModel(found)


def boosted(rows: DataFrame, max_rounds: int, patience: int = PATIENCE, **overrides) -> GBTClassificationModel:
    """The rounds with the least validation loss, found with `patience` rounds without a better one."""
    return Boosting(rows, patience, **overrides).grow(max_rounds).model()


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of the round (from 1) with the least loss before `patience` rounds in a row brought no
    better one, and whether that happened."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _prepared(df: DataFrame, label: str, split: str, preprocessing: PipelineModel) -> DataFrame:
    """Training and validation rows as the learner reads them."""
    return preprocessing.transform(df.where(F.col(split).isin("train", "val"))).select(
        "features", F.col(label).cast("double").alias("_label"), (F.col(split) == "val").alias("_is_val"), F.col(split)
    )


def train_gbt(
    df: DataFrame,
    label: str = "ChurnBool",
    split: str = "split",
    features: Sequence[str] = FEATURES,
    max_rounds: int = MAX_ROUNDS,
    **overrides,
) -> PipelineModel:
    """Boosted trees with early stopping on the validation split (see `boosted`)."""
    preprocessing = fit_preprocessing(df.where(F.col(split) == "train"), features)
    fitted = boosted(pin(_prepared(df, label, split, preprocessing)), max_rounds, **overrides)
    return PipelineModel([*preprocessing.stages, fitted])


def random_grid(space: Mapping[str, Sequence], n: int, seed: int = PARAMETERS["seed"]) -> list[dict]:
    """n parameter sets drawn from lists of choices, the same for the same seed."""
    draw = random.Random(seed)
    return [{name: draw.choice(list(choices)) for name, choices in sorted(space.items())} for _ in range(n)]


def trials(
    df: DataFrame,
    grid: Sequence[Mapping],
    label: str = "ChurnBool",
    split: str = "split",
    features: Sequence[str] = FEATURES,
    max_rounds: int = MAX_ROUNDS,
    parallelism: int = 4,
    first_rounds: int | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """Fit every parameter set, score the validation split, and return the trials
    (trial, parameters, rounds grown, metrics, finished, best) with the model of the highest F1.

    Preprocessing and its materialised table are shared; fits run side by side. With `first_rounds` the search halves:
    every set grows that many rounds, the half with the lower validation loss goes on from the trees
    it has to twice as many, and so on; the last two grow to the end. Only those can be the best; the
    others keep the metrics of the rounds that they have.
    """
    preprocessing = fit_preprocessing(df.where(F.col(split) == "train"), features)
    rows = pin(_prepared(df, label, split, preprocessing))
    validation = rows.where("_is_val")

    def score(found: Boosting):
        model = found.model()
        scored = model.transform(validation).withColumn("p", vector_to_array("probability")[1])
        return model, binary_metrics(scored, "_label", "p").first()

    searches = [Boosting(rows, **parameters) for parameters in grid]
    going = list(range(len(searches)))
    with ThreadPoolExecutor(parallelism) as pool:
        rounds = min(first_rounds or max_rounds, max_rounds)
        while first_rounds and len(going) > 2 and rounds < max_rounds:
            list(pool.map(lambda i: searches[i].grow(rounds), going))
            going = sorted(going, key=lambda i: (min(searches[i].losses), i))[: (len(going) + 1) // 2]
            rounds = min(2 * rounds, max_rounds)
        list(pool.map(lambda i: searches[i].grow(max_rounds), going))
        results = list(pool.map(score, searches))
    best = max(sorted(going), key=lambda i: results[i][1]["f1"])
    table = df.sparkSession.createDataFrame(
        [
            (
                i, json.dumps(dict(parameters), sort_keys=True), len(searches[i].losses), m["f1"], m["accuracy"],
                m["log_loss"], m["roc_auc"], i in going, i == best,
            )
            for i, (parameters, (_, m)) in enumerate(zip(grid, results))
        ],
        "trial int, parameters string, rounds int, f1 double, accuracy double, log_loss double, roc_auc double, "
        "finished boolean, best boolean",
    )
    return table, PipelineModel([*preprocessing.stages, results[best][0]])


def batch_score(table: DataFrame, model: Model, output: str = "Churn") -> DataFrame:
    """The table plus `prediction` (label), `probability` of churn, and the label again
    under the output name. Such columns from an earlier scoring are replaced. A feature that is
    missing in every row is reported, as all its values are then the training mean."""
    table = table.drop(output, "prediction", "probability")
    _report_missing(table, model)
    scored = model.transform(table)
    probability = F.col("probability")
    if scored.schema["probability"].dataType.typeName() != "double":
        probability = vector_to_array("probability")[1]
    return scored.select(
        *table.columns,
        F.col("prediction").cast("double").alias("prediction"),
        probability.alias("probability"),
        F.col("prediction").cast("double").alias(output),
    )


def _report_missing(table: DataFrame, model: Model) -> None:
    stages = getattr(model, "stages", [])
    at = next((i for i, stage in enumerate(stages) if isinstance(stage, ImputerModel)), None)
    if at is None:
        return
    names = stages[at].getInputCols()
    coerced = PipelineModel(stages[:at]).transform(table)
    held = coerced.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in names]).first()
    for c in names:
        if held["_rows"] and not held[c]:
            warnings.warn(f"{c.removeprefix('num_')} is missing in every row and is filled", stacklevel=3)


def score_with(table: DataFrame, predict: Callable, output: str = "Churn") -> DataFrame:
    """Score with a foreign model: `predict` maps a pandas frame of all columns to one
    number per row and is applied to Arrow batches on the executors."""
    def score(rows):
        return predict(rows).astype(float)

    import pandas as pd

    score.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return table.withColumn(output, F.pandas_udf(score, "double")(F.struct(*table.columns)))


def save_model(model: PipelineModel, base: str, name: str) -> int:
    """Store as the next version of `name` and return its number. The version counts
    as finished only once all of its stages are written."""
    spark = SparkSession.getActiveSession()
    version = max(finished_versions(spark, f"{base}/{name}"), default=0) + 1
    path = f"{base}/{name}/v={version}"
    model.write().overwrite().save(path)
    mark_finished(spark, path)
    return version


def load_model(base: str, name: str, version: int | None = None) -> PipelineModel:
    spark = SparkSession.getActiveSession()
    if version is None:
        version = max(finished_versions(spark, f"{base}/{name}"))
    return PipelineModel.load(f"{base}/{name}/v={version}")
