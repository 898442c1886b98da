import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import explain


def plain_shapley(x, background, model):
    """By the definition, over all coalitions."""
    p = len(x)

    def value(chosen):
        return np.mean([model([x[j] if j in chosen else b[j] for j in range(p)]) for b in background])

    found = []
    for j in range(p):
        others, total = [i for i in range(p) if i != j], 0.0
        for size in range(p):
            weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
            total += sum(weight * (value({*s, j}) - value(set(s))) for s in combinations(others, size))
        found.append(total)
    return found


def table(spark, rng, rows, p):
    found = [(i, *[round(float(v), 3) for v in rng.normal(0, 1, p)]) for i in range(rows)]
    return found, spark.createDataFrame(found, "id int, " + ", ".join(f"f{j} double" for j in range(p)))


@pytest.mark.parametrize("p", [2, 3, 6])
def test_all_coalitions_are_exact_for_any_model(spark, p):
    rng = np.random.default_rng(p)
    found, df = table(spark, rng, 12, p)
    names = [f"f{j}" for j in range(p)]
    expression = " + ".join(f"{j + 1} * {c}" for j, c in enumerate(names)) + f" + {' * '.join(names)} + if(f0 > 0 AND f1 > 0, 3, 0)"

    def model(v):
        return sum((j + 1) * a for j, a in enumerate(v)) + math.prod(v) + (3 if v[0] > 0 and v[1] > 0 else 0)

    predict = lambda d: d.withColumn("prediction", F.expr(expression))
    got = explain.kernel_shapley(df.where("id < 5"), df.where("id >= 5"), "id", names, predict, n_coalitions=2**p)
    values = {(r["id"], r["feature"]): (r["value"], r["shapley"]) for r in got.collect()}
    assert len(values) == 5 * p
    for i, *x in found[:5]:
        want = plain_shapley(x, [b[1:] for b in found[5:]], model)
        for j in range(p):
            assert values[i, f"f{j}"][0] == x[j] and math.isclose(values[i, f"f{j}"][1], want[j], abs_tol=1e-9)


def test_pairs_are_exact_from_few_coalitions(spark):
    """Thirty features with products of two: 100 of 2^30 coalitions."""
    p, rng = 30, np.random.default_rng(9)
    found, df = table(spark, rng, 20, p)
    names = [f"f{j}" for j in range(p)]
    predict = lambda d: d.withColumn("prediction", F.expr("2 * f0 - f29 + 5 * f3 * f4"))
    got = explain.kernel_shapley(df.where("id < 4"), df.where("id >= 4"), "id", names, predict, n_coalitions=100)
    values = {(r["id"], r["feature"]): r["shapley"] for r in got.collect()}
    background = np.array([b[1:] for b in found[4:]])
    for i, *x in found[:4]:
        want = np.zeros(p)
        want[0], want[29] = 2 * (x[0] - background[:, 0].mean()), -(x[29] - background[:, 29].mean())
        want[3] = 2.5 * np.mean((x[3] - background[:, 3]) * (x[4] + background[:, 4]))
        want[4] = 2.5 * np.mean((x[4] - background[:, 4]) * (x[3] + background[:, 3]))
        assert np.allclose([values[i, c] for c in names], want, atol=1e-8)


def test_sampled_values_are_near_and_add_up(spark):
    """Three-way interactions are estimated; the sum is the prediction's distance from the mean all the same."""
    p, rng = 14, np.random.default_rng(10)
    found, df = table(spark, rng, 12, p)
    names = [f"f{j}" for j in range(p)]
    predict = lambda d: d.withColumn("prediction", F.expr("f0 * f1 * f2 + f5 + tanh(f6 + f7 + f8)"))
    model = lambda v: v[0] * v[1] * v[2] + v[5] + math.tanh(v[6] + v[7] + v[8])
    got = explain.kernel_shapley(df.where("id < 2"), df.where("id >= 2"), "id", names, predict, n_coalitions=2000)
    values = {(r["id"], r["feature"]): r["shapley"] for r in got.collect()}
    mean = np.mean([model(b[1:]) for b in found[2:]])
    used = [0, 1, 2, 5, 6, 7, 8]
    for i, *x in found[:2]:
        assert math.isclose(sum(values[i, c] for c in names), model(x) - mean, abs_tol=1e-9)
        # features that the model does not read have no part in any coalition
        reduced = lambda v: v[0] * v[1] * v[2] + v[3] + math.tanh(v[4] + v[5] + v[6])
        want = plain_shapley([x[j] for j in used], [[b[1 + j] for j in used] for b in found[2:]], reduced)
        assert all(abs(values[i, f"f{j}"] - w) < 0.1 for j, w in zip(used, want))


def test_coalitions():
    for p, n in ((2, 2), (5, 30), (13, 500), (40, 200), (41, 2130)):
        masks, weights = explain.coalitions(p, n, 1)
        chosen = dict(zip(masks, weights))
        assert len(masks) <= n and all(0 < m < (1 << p) - 1 for m in masks)
        # every coalition with its complement, at the same weight
        assert all(math.isclose(chosen[(1 << p) - 1 - m], w) for m, w in chosen.items())
        assert (masks, list(weights)) == (lambda a, b: (a, list(b)))(*explain.coalitions(p, n, 1))
        total = sum((p - 1) / (s * (p - s)) for s in range(1, p))
        if len(masks) > 2 * p:
            assert math.isclose(weights.sum(), total, rel_tol=1e-9)
    assert len(explain.coalitions(6, 64, 1)[0]) == 62


def test_few_coalitions_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "id int, a double, b double, c double, d double")
    with pytest.raises(ValueError, match="ask for more"):
        explain.kernel_shapley(df, df, "id", ["a", "b", "c", "d"], lambda d: d, n_coalitions=3)


def test_missing_values_and_one_feature(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 2.0), (3, 3.0, 2.0), (4, None, 5.0)], "id int, a double, b double")
    predict = lambda d: d.withColumn("prediction", F.expr("a + 10 * b"))
    got = explain.kernel_shapley(df.where("id IN (1, 4)"), df.where("id IN (2, 3)"), "id", ["a", "b"], predict)
    values = {(r["id"], r["feature"]): (r["value"], r["shapley"]) for r in got.collect()}
    # the background is the mode's source: a 1 (the smaller of two as common), b 2
    assert values[1, "b"] == (2.0, 0.0) and values[4, "a"] == (1.0, -1.0) and values[4, "b"] == (5.0, 30.0)
    one = explain.kernel_shapley(df.where("id = 3"), df.where("id = 2"), "id", ["a"], lambda d: d.withColumn("prediction", F.expr("2 * a")))
    assert [tuple(r) for r in one.collect()] == [(3, "a", 3.0, 4.0)]
