import math
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.operators import aft, splines

SCHEMA = "start double, stop double, event int, x int, y double"


def people(seed, count, late=True):
    rng = random.Random(seed)
    found = []
    for _ in range(count):
        x, y = rng.randint(0, 1), rng.choice([-1.0, 0.0, 0.5, 3.0])
        life = rng.weibullvariate(20 * math.exp(-0.5 * x + 0.1 * y), 1.6) + 0.05
        start = rng.choice([0.0, 0.0, rng.uniform(0, 15)]) if late else 0.0
        end = rng.uniform(1, 50)
        if start < min(life, end):
            found.append((start, round(min(life, end), 2), int(life <= end), x, y))
    return [r for r in found if r[0] < r[1]]


def plain_basis(t, knots):
    y, low, high = math.log(t), knots[0], knots[-1]
    u, k = (y - low) / (high - low), [(v - low) / (high - low) for v in knots]
    cube = lambda v: max(v, 0.0) ** 3
    return np.array([1.0, u] + [cube(u - v) - (1 - v) * cube(u) - v * cube(u - 1) for v in k[1:-1]])


def plain_likelihood(found, knots, gamma, coef, means):
    """Log likelihood with the derivative of the spline by a difference."""
    total = 0.0
    for start, stop, event, *x in found:
        shift = np.dot(coef, np.array(x) - means)
        total -= math.exp(plain_basis(stop, knots) @ gamma + shift)
        if start > 0:
            total += math.exp(plain_basis(start, knots) @ gamma + shift)
        if event:
            h = 1e-5 * stop
            rise = (plain_basis(stop + h, knots) - plain_basis(stop - h, knots)) @ gamma / (2 * h)
            if rise <= 0:
                return -math.inf
            total += math.log(rise) + plain_basis(stop, knots) @ gamma + shift
    return total


@pytest.mark.parametrize("knots", [0, 1, 3, 5])
def test_fit_is_the_maximum(spark, knots):
    found = people(1, 500)
    odd = [(5.0, 5.0, 1, 1, 0.0), (7.0, 3.0, 1, 0, 0.0), (None, 3.0, 1, 0, 0.0), (0.0, 4.0, 1, 0, float("nan")), (0.0, None, 1, 0, 0.0)]
    table = spark.createDataFrame(found + odd, SCHEMA)
    model = splines.fit_spline(table, "stop", "event", ["x", "y"], knots, "start")
    assert len(model.gamma) == knots + 2 and model.observations == len(found) and model.events == sum(r[2] for r in found)
    plain = lambda g, c: plain_likelihood(found, model.knots, g, c, model.means)
    best = plain(model.gamma, model.coef)
    assert math.isclose(best, model.log_likelihood, rel_tol=1e-7)
    errors = np.sqrt(np.diag(model.covariance))
    for j in range(len(model.gamma) + 2):
        for sign in (-1, 1):
            at = np.concatenate([model.gamma, model.coef])
            at[j] += sign * 0.05 * errors[j]
            assert plain(at[:-2], at[-2:]) < best
    # curvature by second differences along one covariate
    step = 1e-3
    moved = [plain(model.gamma, model.coef + np.array([d, 0.0])) for d in (-step, 0.0, step)]
    information = np.linalg.inv(model.covariance)
    assert math.isclose(-(moved[0] - 2 * moved[1] + moved[2]) / step**2, information[-2, -2], rel_tol=1e-3)


def test_no_inner_knot_is_weibull(spark):
    table = spark.createDataFrame(people(2, 400, late=False), SCHEMA)
    model = splines.fit_spline(table, "stop", "event", ["x", "y"], 0)
    weibull = aft.fit_aft(table, "stop", "event", ["x", "y"], "weibull")
    shape = weibull.shape
    assert np.allclose(model.coef, -shape * weibull.coef[:2], atol=1e-5)
    assert math.isclose(model.gamma[1] / (model.knots[-1] - model.knots[0]), shape, rel_tol=1e-6)
    assert math.isclose(model.log_likelihood, weibull.log_likelihood, rel_tol=1e-8)


def test_splitting_rows_changes_nothing(spark):
    """A subject cut into episodes with the same covariates, and repeated rows against slices of one row."""
    rng = random.Random(3)
    whole = people(3, 250)
    cut = []
    for start, stop, event, x, y in whole:
        middle = start + (stop - start) * rng.uniform(0.2, 0.8)
        cut += [(start, middle, 0, x, y), (middle, stop, event, x, y)]
    a = splines.fit_spline(spark.createDataFrame(whole * 2, SCHEMA), "stop", "event", ["x"], 2, "start")
    b = splines.fit_spline(spark.createDataFrame(cut * 2, SCHEMA).repartition(5), "stop", "event", ["x"], 2, "start", rows_per_slice=7)
    assert a.knots == b.knots and a.events == b.events
    # means differ by how often a subject is counted, the constant with them
    assert np.allclose(a.gamma[1:], b.gamma[1:], rtol=1e-4, atol=1e-4) and np.allclose(a.coef, b.coef, atol=1e-5)
    assert math.isclose(a.log_likelihood, b.log_likelihood, rel_tol=1e-8)


def test_knots_are_event_quantiles(spark):
    found = people(4, 333)
    table = spark.createDataFrame(found, SCHEMA)
    times = sorted(r[1] for r in found if r[2])
    shares = [0.1, 0.25, 0.5, 0.9]
    want = [times[0], *[times[math.ceil(s * len(times)) - 1] for s in shares], times[-1]]
    for slices in (0, 10):
        assert splines.event_quantiles(table, "stop", "event", shares, slices) == want


def test_knots_of_weighted_rows(spark):
    found = [(float(t % 17 + 1), t % 3 % 2, t % 4 + 1) for t in range(90)]
    weighted = spark.createDataFrame(found, "stop double, event int, n int")
    repeated = spark.createDataFrame([r[:2] for r in found for _ in range(r[2])], "stop double, event int")
    shares = [0.1, 0.5, 0.8]
    want = splines.event_quantiles(repeated, "stop", "event", shares)
    assert splines.event_quantiles(weighted, "stop", "event", shares, weight="n") == want


def test_prediction(spark):
    found = people(5, 400)
    model = splines.fit_spline(spark.createDataFrame(found, SCHEMA), "stop", "event", ["x"], [5.0, 12.0, 12.0, 1e6], "start")
    assert len(model.knots) == 4 and splines.least_slope(model) > 0
    asked = [(t, x) for t in (0.01, 1.0, 5.0, 11.9, 12.1, 40.0, 1000.0) for x in (0, 1)]
    table = spark.createDataFrame(asked, "t double, x int")
    for row in splines.predict(table, "t", model).collect():
        shift = model.coef[0] * (row["x"] - model.means[0])
        level = lambda t: math.exp(plain_basis(t, model.knots) @ model.gamma + shift)
        assert math.isclose(row["cumulative_hazard"], level(row["t"]), rel_tol=1e-9)
        assert math.isclose(row["survival"], math.exp(-level(row["t"])), rel_tol=1e-9)
        h = 1e-5 * row["t"]
        assert math.isclose(row["hazard"], (level(row["t"] + h) - level(row["t"] - h)) / (2 * h), rel_tol=1e-5)
    odd = spark.createDataFrame([(0.0, 1), (-2.0, 0), (None, 1), (float("nan"), 1), (3.0, None)], "t double, x int")
    got = {(str(r["t"]), r["x"]): (r["hazard"], r["cumulative_hazard"], r["survival"]) for r in splines.predict(odd, "t", model).collect()}
    assert got[("0.0", 1)] == got[("-2.0", 0)] == (None, 0.0, 1.0)
    assert all(got[k] == (None, None, None) for k in [("None", 1), ("nan", 1), ("3.0", None)])
    at_means = splines.predict(table.select("t"), "t", model).where("t = 5.0").first()
    assert math.isclose(at_means["cumulative_hazard"], math.exp(plain_basis(5.0, model.knots) @ model.gamma), rel_tol=1e-9)


def test_least_slope(spark):
    rng = np.random.default_rng(6)
    for _ in range(50):
        knots = sorted(rng.uniform(0, 3, 5))
        model = splines.SplineModel([], list(knots), rng.normal(0, 3, 5), np.zeros(0), np.eye(5), np.zeros(0), 0.0, 1, 1, 0.05)
        us = np.linspace(knots[0], knots[-1], 4001)
        width = knots[-1] - knots[0]
        values = np.array([plain_basis(math.exp(u), knots) @ model.gamma for u in us])
        assert abs(np.min(np.diff(values) / np.diff(us) * width) - splines.least_slope(model)) < 0.05


def test_summary_and_refusals(spark):
    table = spark.createDataFrame(people(7, 300), SCHEMA)
    model = splines.fit_spline(table, "stop", "event", ["x"], 1, "start")
    rows = {r["covariate"]: r for r in splines.summary(spark, model).collect()}
    assert set(rows) == {"constant", "log_time", "knot_1", "x"}
    assert rows["x"]["lower"] < rows["x"]["coef"] < rows["x"]["upper"] and model.aic > -2 * model.log_likelihood
    with pytest.raises(ValueError, match="no event"):
        splines.fit_spline(table.where("event = 0"), "stop", "event")
    with pytest.raises(ValueError, match="no event"):
        splines.fit_spline(table.limit(0), "stop", "event", ["x"])
    with pytest.raises(ValueError, match="does not vary"):
        splines.fit_spline(table.withColumn("x", F.lit(1)), "stop", "event", ["x"])
    with pytest.raises(ValueError, match="one time"):
        splines.fit_spline(table.withColumn("stop", F.lit(20.0)), "stop", "event")
    with pytest.raises(ValueError, match="finite"):
        splines.fit_spline(table.withColumn("y", F.lit(float("inf"))), "stop", "event", ["y"])


def test_a_hazard_that_is_not_positive_is_reported(spark):
    """Two crowds of events with nobody at risk of one between them."""
    rng = random.Random(8)
    found = [(0.0, round(rng.uniform(1, 1.3), 3), 1, 0, 0.0) for _ in range(60)]
    found += [(0.0, round(rng.uniform(60, 70), 3), 1, 0, 0.0) for _ in range(60)]
    table = spark.createDataFrame(found, SCHEMA)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        model = splines.fit_spline(table, "stop", "event", (), 3)
    assert (splines.least_slope(model) <= 0) == any("not positive everywhere" in str(w.message) for w in said)
