import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapse.operators import cox, episodes, kaplan_meier as km, profile


def people(rng, count):
    """(id, stop, event, x, y)"""
    return [(i, rng.randint(1, 40), rng.randint(0, 1), rng.randint(0, 1), rng.choice([0.0, 0.5, 2.0])) for i in range(count)]


def plain_likelihood(found, beta):
    """Efron log partial likelihood of (start, stop, event, x..) rows by explicit risk sets."""
    total = 0.0
    for t in sorted({r[1] for r in found if r[2]}):
        risk = [math.exp(np.dot(beta, r[3:])) for r in found if r[0] < t <= r[1]]
        dead = [r for r in found if r[2] and r[1] == t]
        weights = [math.exp(np.dot(beta, r[3:])) for r in dead]
        total += sum(np.dot(beta, r[3:]) for r in dead)
        total -= sum(math.log(sum(risk) - k / len(dead) * sum(weights)) for k in range(len(dead)))
    return total


def test_cutting_subjects_changes_nothing(spark):
    """A covariate that stays the same gives the coefficients of a fit without episodes."""
    rng = random.Random(1)
    whole = people(rng, 300)
    cut = []
    for i, stop, event, x, y in whole:
        ends = sorted({rng.randint(1, stop) for _ in range(rng.randint(0, 4))} | {stop})
        cut += [(i, a, b, event if b == stop else 0, x, y) for a, b in zip([0, *ends], ends)]
    a = cox.fit_cox(spark.createDataFrame(whole, "id int, stop int, event int, x int, y double"), "stop", "event", ["x", "y"])
    table = spark.createDataFrame(cut, "id int, start int, stop int, event int, x int, y double")
    for slices in (0, 15):
        b = cox.fit_cox(table, "stop", "event", ["x", "y"], entry="start", rows_per_slice=slices)
        assert np.allclose(a.coef, b.coef) and np.allclose(a.covariance, b.covariance)
        assert math.isclose(a.log_likelihood, b.log_likelihood)
        assert b.events == a.events and b.observations == len(cut)
        steps = [r["cumulative_hazard"] for r in cox.baseline_hazard(b).where("cumulative_hazard > 0").orderBy("t").collect()]
        assert steps == sorted(steps)


@pytest.mark.parametrize("ties", ["efron"])
def test_time_varying_likelihood(spark, ties):
    """The fit is where the explicit likelihood is flat, with late entries, gaps, ties and changing covariates."""
    rng = random.Random(2)
    found = []
    for _ in range(150):
        start = rng.randint(0, 10)
        for _ in range(rng.randint(1, 4)):
            stop = start + rng.randint(1, 8)
            found.append((start, stop, int(rng.random() < 0.4), rng.randint(0, 1), rng.gauss(0, 1)))
            start = stop + rng.choice([0, 0, 3])
    odd = [(5, 5, 1, 1, 0.0), (7, 3, 1, 0, 0.0), (None, 3, 1, 0, 0.0), (0, 4, 1, 0, float("nan"))]
    table = spark.createDataFrame(found + odd, "start int, stop int, event int, x int, y double")
    model = cox.fit_cox(table, "stop", "event", ["x", "y"], entry="start")
    assert math.isclose(model.log_likelihood, plain_likelihood(found, model.coef), rel_tol=1e-9)
    for j in range(2):
        step = np.eye(2)[j] * 1e-4
        low, mid, high = (plain_likelihood(found, model.coef + k * step) for k in (-1, 0, 1))
        assert mid >= max(low, high)
    h = 1e-3
    second = [(plain_likelihood(found, model.coef + h * np.eye(2)[j]) - 2 * model.log_likelihood + plain_likelihood(found, model.coef - h * np.eye(2)[j])) / h**2 for j in range(2)]
    assert np.allclose(np.diag(np.linalg.inv(model.covariance)), [-s for s in second], rtol=1e-4)


def plain_episodes(spans, changes):
    out = []
    for key, start, stop, event in spans:
        times = sorted({at for k, at, *_ in changes if k == key and start < at < stop} | {start, stop})
        for a, b in zip(times, times[1:]):
            held = [None, None]
            for i in range(2):
                known = [(at, c[i]) for k, at, *c in changes if k == key and at is not None and at <= a and c[i] is not None]
                if known:
                    last = max(at for at, _ in known)
                    held[i] = max(v for at, v in known if at == last)
            out.append((key, float(a), float(b), event if b == stop else 0, *held))
    return sorted(out, key=lambda r: r[:3])


@pytest.mark.parametrize("rows_per_slice", [0, 40, 7])
def test_episodes(spark, rows_per_slice):
    """One subject has a third of all changes; subjects have none, early, late and repeated ones."""
    rng = random.Random(3)
    spans = [(i, rng.randint(0, 5), rng.randint(20, 60), rng.randint(0, 1)) for i in range(40)] + [(3, 70, 90, 1)]
    changes = [(rng.choice([7, *range(45)]), rng.randint(-5, 100), rng.choice([None, 1, 2]), rng.choice(["a", "b", None])) for _ in range(400)]
    changes += [(7, rng.randint(0, 70), rng.randint(0, 9), "c") for _ in range(200)]
    odd_spans, odd_changes = [(50, 9, 9, 1), (51, 9, 2, 1), (None, 0, 9, 1), (52, None, 9, 1)], [(1, None, 5, "z"), (None, 3, 5, "z")]
    left = spark.createDataFrame(spans + odd_spans, "k int, start int, stop int, event int")
    right = spark.createDataFrame(changes + odd_changes, "k int, at int, x int, y string")
    got = episodes.episodes(left, right, "k", ["x", "y"], rows_per_slice=rows_per_slice)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:3]) == plain_episodes(spans, changes)
    assert episodes.episodes(left.limit(0), right, "k", ["x"]).collect() == []
    none = episodes.episodes(left, right.limit(0), "k", ["x", "y"])
    assert sorted(map(tuple, none.collect()), key=lambda r: r[:3]) == plain_episodes(spans, [])


def test_piecewise(spark):
    """Exposure and events by interval, and the point where the explicit Poisson likelihood is highest."""
    rng = random.Random(4)
    found = []
    for _ in range(300):
        start = rng.choice([0, 0, rng.randint(0, 9)])
        found.append((start, start + rng.randint(1, 30), rng.randint(0, 1), rng.randint(0, 1), rng.gauss(0, 1)))
    knots = [5, 12, 20, 100]
    table = spark.createDataFrame(found, "start int, stop int, event int, x int, y double")
    model = episodes.fit_piecewise(table, "stop", "event", knots, ["x", "y"], "start")
    cuts = [0, *knots, math.inf]

    def spent(r, k):
        return max(0, min(r[1], cuts[k + 1]) - max(r[0], cuts[k]))

    def likelihood(beta, hazards):
        total = 0.0
        for r in found:
            risk = math.exp(np.dot(beta, np.array(r[3:]) - model.means))
            for k, h in enumerate(hazards):
                if spent(r, k):
                    total -= spent(r, k) * h * risk
                    if r[2] and cuts[k] < r[1] <= cuts[k + 1]:
                        total += math.log(h * risk)
        return total

    hazards = [h for *_, h in model.intervals]
    for k, (low, high, time, events, _) in enumerate(model.intervals):
        assert low == cuts[k] and time == sum(spent(r, k) for r in found)
        assert events == sum(r[2] for r in found if cuts[k] < r[1] <= cuts[k + 1])
    best = likelihood(model.coef, [h or 0 for h in hazards])
    for j in range(2):
        for sign in (-1, 1):
            assert likelihood(model.coef + sign * 1e-3 * np.eye(2)[j], [h or 0 for h in hazards]) < best
    for k, h in enumerate(hazards):
        if h:
            for scale in (0.99, 1.01):
                assert likelihood(model.coef, [scale * g if i == k else g or 0 for i, g in enumerate(hazards)]) < best
    plain = episodes.fit_piecewise(table, "stop", "event", [10])
    assert [r[3] for r in plain.intervals] == [sum(r[2] for r in found if r[1] <= 10), sum(r[2] for r in found if r[1] > 10)]
    with pytest.raises(ValueError):
        episodes.fit_piecewise(table, "stop", "event", [5, 5])


@pytest.mark.parametrize("rows_per_slice", [0, 9])
def test_curve_at_rows(spark, rows_per_slice):
    """A curve at each row's own time: before the first step, between steps, after the last, no group, no time."""
    rng = random.Random(5)
    table = spark.createDataFrame([(rng.choice("ab"), rng.randint(2, 40), rng.randint(0, 1)) for _ in range(200)], "g string, t int, e int")
    curve = km.km_curve(table, "t", "e", ["g"]).where("t > 0")
    asked = [(i, rng.choice("aaaaabc"), rng.choice([None, -1.0, 0.5, 1e9, float("nan"), *map(float, range(45))])) for i in range(300)]
    left = spark.createDataFrame(asked, "i int, g string, time double")
    got = {r["i"]: r["survival"] for r in km.at_rows(left, "time", curve, {"survival": 1.0}, ["g"], rows_per_slice=rows_per_slice).collect()}
    steps = [(r["g"], r["t"], r["survival"]) for r in curve.collect()]
    assert len(got) == len(asked)
    for i, g, time in asked:
        if time is None or math.isnan(time) or g == "c":
            assert got[i] is None
        else:
            known = [(t, s) for h, t, s in steps if h == g and t <= time]
            assert got[i] == (max(known)[1] if known else 1.0)


KINDS = {
    "numbers": "SELECT id AS a, id * id % 7 AS b, CAST(id AS DOUBLE) / 3 AS c FROM range(50)",
    "one number": "SELECT id AS a FROM range(50)",
    "text": "SELECT CAST(id % 3 AS STRING) AS s, CAST(id AS STRING) AS `t x` FROM range(50)",
    "one text": "SELECT CAST(id % 3 AS STRING) AS s FROM range(50)",
    "dates": "SELECT date_add(DATE'2024-01-01', CAST(id AS INT)) AS d FROM range(50)",
    "no rows": "SELECT id AS a, CAST(id AS DOUBLE) AS b, CAST(id AS STRING) AS s, current_date() AS d FROM range(50) WHERE id < 0",
    "odd": """SELECT CAST(sin(id * id) AS DOUBLE) AS a, IF(id = 3, double('NaN'), CAST(cos(id * 7) AS DOUBLE)) AS b,
        IF(id = 5, double('infinity'), CAST(sin(id * id * 3) AS DOUBLE)) AS c, CAST(1 AS DOUBLE) AS k, CAST(id AS STRING) AS s FROM range(200)""",
}


@pytest.mark.parametrize("kind", KINDS)
def test_profile_of_any_kind_of_table(spark, kind):
    report = profile.Profile(spark.sql(KINDS[kind]))
    sections = "overview numeric_stats quantiles categorical_stats common_values extremes histograms missing missing_correlation pearson spearman cramers_v interactions date_stats alerts".split()
    found = {name: getattr(report, name)().collect() for name in sections}
    if kind in ("text", "one text", "dates"):
        assert not any(found[s] for s in "numeric_stats quantiles extremes histograms pearson spearman interactions".split())
    if kind in ("numbers", "one number", "dates"):
        assert found["categorical_stats"] == [] and found["cramers_v"] == []
    alerts = {(r["column"], r["alert"]) for r in found["alerts"]}
    assert not {a for _, a in alerts} & {"highly correlated", "skewed"} or kind == "numbers"


def test_profile_counts_finite_values_only(spark):
    report = profile.Profile(spark.sql(KINDS["odd"]))
    stats = {r["column"]: r for r in report.numeric_stats().collect()}
    assert (stats["b"]["count"], stats["b"]["missing"], stats["b"]["infinite"]) == (199, 1, 0)
    assert (stats["c"]["count"], stats["c"]["missing"], stats["c"]["infinite"]) == (199, 0, 1)
    held = [math.cos(i * 7) for i in range(200) if i != 3]
    assert math.isclose(stats["b"]["mean"], sum(held) / 199, abs_tol=1e-12) and stats["b"]["max"] == max(held)
    pairs = {(r["a"], r["b"]): r["value"] for r in report.pearson().collect()}
    a, b = zip(*[(math.sin(i * i), math.cos(i * 7)) for i in range(200) if i != 3])
    assert math.isclose(pairs["a", "b"], np.corrcoef(a, b)[0, 1], abs_tol=1e-9)
    assert pairs["a", "k"] is None
