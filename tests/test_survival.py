"""Hand-worked survival cases, identities and invariances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapse.functions.tails import chi2_tail, normal_two_sided
from lapse.operators import aft, concordance as conc, cox, kaplan_meier as km
from lapse.operators.logrank import logrank
from lapse.operators.running import running_totals, sliced
from lapse.sources.session import pin

K1 = [(1, 1), (2, 0), (2, 1), (3, 1), (4, 0)]


def table(spark, data, columns="t int, e int"):
    return spark.createDataFrame(data, columns)


def simulated(spark, n=1500, seed=3, coef=(0.7, -0.4)):
    """Exponential lifetimes in whole days with two covariates and random censoring."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        x, y = rng.randint(0, 1), round(rng.gauss(0, 1), 3)
        life = rng.expovariate(0.02 * math.exp(coef[0] * x + coef[1] * y))
        end = rng.uniform(5, 120)
        data.append((i, int(min(life, end)) + 1, int(life <= end), x, y, "ABC"[i % 3]))
    return spark.createDataFrame(data, "id int, t int, e int, x int, y double, g string"), data


def test_event_table_and_curve(spark):
    df = table(spark, K1)
    assert rows(km.event_table(df, "t", "e")) == [(1, 1, 1, 0, 5), (2, 2, 1, 1, 4), (3, 1, 1, 0, 2), (4, 1, 0, 1, 1)]
    curve = {r["t"]: r for r in km.km_curve(df, "t", "e").collect()}
    assert [round(curve[t]["survival"], 12) for t in (0, 1, 2, 3, 4)] == [1.0, 0.8, 0.6, 0.3, 0.3]
    assert curve[0]["at_risk"] == 5 and curve[0]["lower"] == curve[0]["upper"] == 1.0
    # Greenwood at t = 1: 1 / (5 * 4); log-log band
    s, se = 0.8, math.sqrt(1 / 20)
    half = 1.959963984540054 * se / math.log(s)
    assert curve[1]["lower"] == pytest.approx(math.exp(-math.exp(math.log(-math.log(s)) - half)))
    assert curve[1]["upper"] == pytest.approx(math.exp(-math.exp(math.log(-math.log(s)) + half)))
    assert km.km_quantile(km.km_curve(df, "t", "e")).first()["median"] == 3


def test_all_censored_never_reaches_median(spark):
    curve = km.km_curve(table(spark, [(1, 0), (2, 0)]), "t", "e")
    assert {r["survival"] for r in curve.collect()} == {1.0}
    assert km.km_quantile(curve).first()["median"] is None


def test_last_death_gives_zero(spark):
    curve = {r["t"]: r for r in km.km_curve(table(spark, [(1, 1), (2, 1), (2, 1)]), "t", "e").collect()}
    assert curve[2]["survival"] == 0.0 and curve[2]["lower"] == 0.0 and curve[2]["upper"] == 0.0


def test_event_at_zero_and_missing_rows(spark):
    df = table(spark, [(0, 1), (1, 1), (2, 0), (None, 1), (3, None)])
    curve = {r["t"]: r["survival"] for r in km.km_curve(df, "t", "e").collect()}
    assert curve == {0: pytest.approx(2 / 3), 1: pytest.approx(1 / 3), 2: pytest.approx(1 / 3)}


def test_no_censoring_is_the_empirical_distribution(spark):
    values = [random.Random(1).randint(1, 40) for _ in range(300)]
    curve = km.km_curve(table(spark, [(v, 1) for v in values]), "t", "e")
    for r in curve.collect():
        assert r["survival"] == pytest.approx(sum(v > r["t"] for v in values) / 300, abs=1e-12)


def test_slices_and_partitions_do_not_change_the_curve(spark):
    df, _ = simulated(spark, 600)
    want = rows(km.km_curve(df, "t", "e", ["g"]))
    for parts, per_slice in ((1, 7), (4, 50), (64, 1)):
        got = rows(km.km_curve(df.repartition(parts), "t", "e", ["g"], rows_per_slice=per_slice))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-12)


def test_running_totals_by_slice(spark):
    data = [(k, v, v % 5) for k in "abc" for v in range(50)]
    df = pin(spark.createDataFrame(data, "k string, v int, n int"))
    cut = sliced(df, "v", 20)
    assert cut.select("_slice").distinct().count() > 3
    for descending in (False, True):
        got = {(r["k"], r["v"]): r["s"] for r in running_totals(cut, "v", {"s": "n"}, ["k"], descending).collect()}
        for k, v, _ in data:
            span = range(v, 50) if descending else range(v + 1)
            assert got[k, v] == sum(x % 5 for x in span)


def test_short_groups_need_no_slices(spark):
    """A long table of short groups stays whole; one long group is reason enough to slice."""
    df = pin(spark.createDataFrame([(k, v) for k in range(30) for v in range(5)], "k int, v int"))
    assert "_slice" not in sliced(df, "v", 20, ["k"]).columns
    longer = pin(df.unionByName(spark.createDataFrame([(0, v) for v in range(5, 30)], df.schema)))
    assert "_slice" in sliced(longer, "v", 20, ["k"]).columns


def test_step_lookup(spark):
    curve = km.km_curve(table(spark, K1), "t", "e")
    got = rows(km.at_times(curve, [0, 0.5, 2, 10], {"survival": 1.0}))
    assert [(t, round(s, 12)) for t, s in got] == [(0.0, 1.0), (0.5, 1.0), (2.0, 0.6), (10.0, 0.3)]


def test_logrank_by_hand(spark):
    data = [(1, 1, "A"), (3, 1, "A"), (5, 0, "A"), (2, 1, "B"), (4, 1, "B"), (6, 1, "B")]
    df = table(spark, data, "t int, e int, g string")
    excess = variance = 0.0
    for t in (1, 2, 3, 4, 6):
        at = [r for r in data if r[0] >= t]
        n, na = len(at), sum(r[2] == "A" for r in at)
        da = sum(r[0] == t and r[2] == "A" for r in data)
        excess += da - na / n
        variance += na * (n - na) / n**2
    got = logrank(df, "t", "e", ["g"]).first()
    assert (got["level_a"], got["level_b"]) == ("A", "B")
    assert got["statistic"] == pytest.approx(excess**2 / variance)
    assert got["p"] == pytest.approx(chi2_tail(got["statistic"], 1))
    assert got["neg_log2_p"] == pytest.approx(-math.log2(got["p"]))


def test_logrank_carries_levels_that_lose_nobody(spark):
    df, data = simulated(spark, 400)
    tests = {(r["variable"], r["level_a"], r["level_b"]): r["statistic"] for r in logrank(df, "t", "e", ["g", "x"]).collect()}
    assert len(tests) == 4

    def brute(a, b, column):
        excess = variance = 0.0
        pair = [r for r in data if str(r[column]) in (a, b)]
        for t in sorted({r[1] for r in pair if r[2]}):
            at = [r for r in pair if r[1] >= t]
            n, na = len(at), sum(str(r[column]) == a for r in at)
            d = sum(r[1] == t and r[2] for r in pair)
            da = sum(r[1] == t and r[2] and str(r[column]) == a for r in pair)
            excess += da - na * d / n
            if n > 1:
                variance += na * (n - na) * d * (n - d) / (n * n * (n - 1))
        return excess**2 / variance

    assert tests["g", "A", "C"] == pytest.approx(brute("A", "C", 5))
    assert tests["x", "0", "1"] == pytest.approx(brute("0", "1", 3))


# --- Cox --------------------------------------------------------------------------


def brute_cox(data, ties="efron"):
    """Newton-Raphson over explicit risk sets: (beta, log likelihood, information)."""
    times = sorted({r[1] for r in data if r[2]})
    x = np.array([[r[3], r[4]] for r in data], dtype=float)
    t, e = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    beta = np.zeros(2)
    for _ in range(30):
        ll, g, info = 0.0, np.zeros(2), np.zeros((2, 2))
        w = np.exp(x @ beta)
        for s in times:
            risk, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            ll += (x[dead] @ beta).sum()
            g += x[dead].sum(0)
            for l in range(d):
                share = l / d if ties == "efron" else 0.0
                wt = w * risk - share * w * dead
                s0, s1 = wt.sum(), wt @ x
                ll -= math.log(s0)
                g -= s1 / s0
                info += (x.T * wt) @ x / s0 - np.outer(s1, s1) / s0**2
        step = np.linalg.solve(info, g)
        beta = beta + step
        if abs(step).max() < 1e-12:
            break
    return beta, ll, info


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_matches_explicit_risk_sets(spark, ties):
    df, data = simulated(spark, 500)
    beta, ll, info = brute_cox(data, ties)
    model = cox.fit_cox(df, "t", "e", ["x", "y"], ties=ties)
    assert model.coef == pytest.approx(beta, abs=1e-6)
    assert model.log_likelihood == pytest.approx(ll, abs=1e-6)
    assert model.covariance == pytest.approx(np.linalg.inv(info), abs=1e-8)
    split = cox.fit_cox(df.repartition(16), "t", "e", ["x", "y"], ties=ties, rows_per_slice=40)
    assert split.coef == pytest.approx(beta, abs=1e-6)


def test_cox_recovers_known_coefficients(spark):
    df, _ = simulated(spark, 3000)
    model = cox.fit_cox(df, "t", "e", ["x", "y"])
    for got, want, se in zip(model.coef, (0.7, -0.4), model.standard_errors):
        assert abs(got - want) < 4 * se
    summary = {r["covariate"]: r for r in cox.summary(spark, model).collect()}
    assert summary["x"]["exp_coef"] == pytest.approx(math.exp(model.coef[0]))
    assert summary["x"]["p"] == pytest.approx(normal_two_sided(summary["x"]["z"]))
    metrics = cox.metrics(spark, model).first()
    assert metrics["observations"] == 3000 and metrics["lr_df"] == 2
    assert metrics["partial_aic"] == pytest.approx(-2 * model.log_likelihood + 4)


def test_efron_with_very_many_ties(spark):
    rng = random.Random(8)
    # hundreds of deaths at each of three times, and everyone dies at the last one
    data = [(i, t, int(t == 3 or rng.random() < 0.8), rng.randint(0, 1), round(rng.gauss(0, 1), 1)) for i in range(900) for t in [rng.randint(1, 3)]]
    df = spark.createDataFrame(data, "id int, t int, e int, x int, y double")
    beta, ll, info = brute_cox(data)
    model = cox.fit_cox(df, "t", "e", ["x", "y"])
    assert model.coef == pytest.approx(beta, abs=1e-9)
    assert model.log_likelihood == pytest.approx(ll, abs=1e-8)
    assert model.covariance == pytest.approx(np.linalg.inv(info), abs=1e-10)


def test_score_test_is_the_logrank_without_ties(spark):
    data = [(i + 1, (i * 7 % 5) > 0, (i * 3 % 4) < 2) for i in range(40)]
    df = table(spark, [(t, int(e), int(g)) for t, e, g in data], "t int, e int, x int")
    rt = cox.risk_table(df, "t", "e", ["x"])
    _, gradient, information = cox._evaluate(rt, np.zeros(1), [0.0], [1.0], [], "efron")
    score = float(gradient[0] ** 2 / information[0, 0])
    assert score == pytest.approx(logrank(df, "t", "e", ["x"]).first()["statistic"])


def test_schoenfeld_sums_to_zero_at_the_fit(spark):
    df, _ = simulated(spark, 600)
    model = cox.fit_cox(df, "t", "e", ["x", "y"])
    sums = cox.schoenfeld(model).groupBy("covariate").agg(F.sum(F.col("n") * F.col("residual")).alias("s")).collect()
    assert all(abs(r["s"]) < 1e-6 for r in sums)
    tests = cox.ph_test(model).collect()
    assert len(tests) == 4 and all(0 <= r["p"] <= 1 for r in tests)
    report = cox.ph_report(model, 0.05).collect()
    assert all(r["violates"] == (r["p"] < 0.05) for r in report)


def test_baseline_and_prediction(spark):
    df, data = simulated(spark, 300)
    model = cox.fit_cox(df, "t", "e", ["x", "y"])
    mean = model.means
    w = {r[0]: math.exp(float(model.coef @ (np.array([r[3], r[4]]) - mean))) for r in data}
    hazard, want = 0.0, {}
    for t in sorted({r[1] for r in data}):
        hazard += sum(r[1] == t and r[2] for r in data) / sum(w[r[0]] for r in data if r[1] >= t)
        want[t] = hazard
    got = {r["t"]: r["cumulative_hazard"] for r in cox.baseline_hazard(model).collect()}
    assert got == pytest.approx(want)
    curve = cox.predict_survival(model, [{"x": 1, "y": 0.5}]).collect()
    risk = math.exp(float(model.coef @ (np.array([1, 0.5]) - mean)))
    assert all(r["survival"] == pytest.approx(math.exp(-want[r["t"]] * risk)) for r in curve)


def test_stratified_cox_separates_baselines(spark):
    df, data = simulated(spark, 600)
    # per-stratum time scales leave a stratified fit unchanged
    warped = df.withColumn("t", F.when(F.col("g") == "A", F.col("t") * 3).otherwise(F.col("t")))
    plain = cox.fit_cox(df, "t", "e", ["x", "y"], strata=["g"])
    other = cox.fit_cox(warped, "t", "e", ["x", "y"], strata=["g"])
    assert plain.coef == pytest.approx(other.coef, abs=1e-6)


def test_cox_refuses_what_cannot_be_fitted(spark):
    df, _ = simulated(spark, 200)
    with pytest.raises(ValueError, match="does not vary"):
        cox.fit_cox(df.withColumn("c", F.lit(1)), "t", "e", ["x", "c"])
    with pytest.raises(ValueError, match="singular"):
        cox.fit_cox(df.withColumn("z", 1 - F.col("x")), "t", "e", ["x", "z"])
    with pytest.raises(ValueError, match="no event"):
        cox.fit_cox(df.withColumn("e", F.lit(0)), "t", "e", ["x"])
    apart = table(spark, [(i, 1, 1) for i in range(1, 6)] + [(i, 1, 0) for i in range(6, 11)], "t int, e int, x int")
    with pytest.raises(ValueError, match="monotone|singular"):
        cox.fit_cox(apart, "t", "e", ["x"])


def test_concordance_counts_pairs(spark):
    rng = random.Random(5)
    data = [(rng.randint(1, 15), rng.randint(0, 1), rng.randint(0, 9) / 2) for _ in range(150)]
    df = table(spark, data, "t int, e int, s double")
    pairs = concordant = tied = 0
    for t, e, s in data:
        for u, f, v in data:
            if e and (u > t or (u == t and not f)):
                pairs += 1
                concordant += v > s
                tied += v == s
    for per_slice in (0, 20):
        got = conc.concordance(df, "t", "e", "s", rows_per_slice=per_slice).first()
        assert (int(got["pairs"]), int(got["concordant"]), int(got["tied"])) == (pairs, concordant, tied)
        assert got["concordance"] == pytest.approx((concordant + tied / 2) / pairs)
    assert conc.concordance(table(spark, [(1, 0, 1.0)], "t int, e int, s double"), "t", "e", "s").first()["concordance"] is None


# --- accelerated failure time --------------------------------------------------------


def loglik(family, data, b, c):
    total, k = 0.0, math.exp(c)
    for _, t, e, x, y, _ in data:
        z = (math.log(t) - (b[0] * x + b[1] * y + b[2])) * k
        if family == "loglogistic":
            total += (c - math.log(t) + z) * e - (1 + e) * math.log1p(math.exp(z))
        elif family == "weibull":
            total += (c - math.log(t) + z) * e - math.exp(z)
        elif e:
            total += c - math.log(t) - z * z / 2 - math.log(2 * math.pi) / 2
        else:
            total += math.log(math.erfc(z / math.sqrt(2)) / 2)
    return total


@pytest.mark.parametrize("family", ["loglogistic", "weibull", "lognormal"])
def test_aft_is_a_maximum(spark, family):
    df, data = simulated(spark, 400)
    model = aft.fit_aft(df, "t", "e", ["x", "y"], family)
    at = [*model.coef, model.log_shape]
    best = loglik(family, data, at[:3], at[3])
    assert model.log_likelihood == pytest.approx(best, abs=1e-6)
    hessian = np.zeros((4, 4))
    h = 1e-4

    def moved(*shifts):
        p = list(at)
        for i, s in shifts:
            p[i] += s
        return loglik(family, data, p[:3], p[3])

    for i in range(4):
        assert abs(moved((i, h)) - moved((i, -h))) / (2 * h) < 1e-2
        for j in range(4):
            hessian[i, j] = (
                moved((i, h), (j, h)) - moved((i, h), (j, -h)) - moved((i, -h), (j, h)) + moved((i, -h), (j, -h))
            ) / (4 * h * h)
    assert np.allclose(model.covariance, np.linalg.inv(-hessian), rtol=2e-2, atol=1e-5)
    table_ = aft.summary(spark, model).collect()
    assert len(table_) == 4 and all(r["se"] > 0 for r in table_)
    assert aft.median(spark, model).first()["median"] > 0


def test_weibull_agrees_with_the_built_in_learner(spark):
    df, _ = simulated(spark, 800)
    ours = aft.fit_aft(df, "t", "e", ["x", "y"], "weibull")
    library = {(r["parameter"], r["covariate"]): r["coef"] for r in aft.fit_weibull_library(df, "t", "e", ["x", "y"]).collect()}
    assert library["lambda_", "x"] == pytest.approx(ours.coef[0], abs=1e-3)
    assert library["lambda_", "Intercept"] == pytest.approx(ours.coef[2], abs=1e-3)
    assert library["rho_", "Intercept"] == pytest.approx(ours.log_shape, abs=1e-3)


def test_aft_rejects_zero_durations(spark):
    df = table(spark, [(0, 1, 1), (2, 1, 0), (3, 0, 1), (5, 1, 0)], "t int, e int, x int")
    with pytest.raises(ValueError, match="positive"):
        aft.fit_aft(df, "t", "e", ["x"])
    assert aft.fit_aft(df, "t", "e", ["x"], shift=1.0).observations == 4


def test_chi2_tail_closed_forms():
    # known 95 % points
    for df, point in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (9, 16.918978)):
        assert chi2_tail(point, df) == pytest.approx(0.05, abs=1e-6)
