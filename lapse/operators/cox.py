"""Cox proportional hazards: fit, summary, baseline, prediction and diagnostics.

Subjects are collapsed to (strata, time, event, covariates) with a count and
materialised. A Newton step is one aggregation of that table by time, a
running total over the distinct times, and a sum to one row; the driver
solves a p x p system. Risk sets are never enumerated.

Ties follow Efron. For `d` deaths at one time with risk-set total S0 and
death total E0 the l-th term uses phi_l = S0 - l/d * E0, l = 0..d-1. All that
is needed are the sums over l of 1/phi, 1/phi^2 and ln phi. The last terms are
added one by one and the others by the Euler-Maclaurin formula, which is exact
to rounding there, so a time with millions of deaths costs no more than one
with twenty.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapse.functions.tails import chi2_tail, normal_quantile, normal_two_sided, surprise
from lapse.operators.running import SLICE, lookup_join, present, running_totals, sliced
from lapse.sources.session import pin

# deaths at one time whose terms are added one by one
EFRON_TERMS = 16
# rows of a risk table that count as observations: entries have a negative count
_EXITS = "greatest(n, 0L)"
# a log hazard per standard deviation beyond this is a likelihood without a maximum
RUNAWAY = 15.0


@dataclass
class CoxModel:
    """Fitted parameters; `table` is the collapsed, materialised training table."""

    covariates: list[str]
    coef: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    observations: int
    events: int
    ties: str
    alpha: float
    strata: list[str]
    means: np.ndarray
    iterations: int
    table: DataFrame = field(repr=False)

    @property
    def keys(self) -> list[str]:
        return _stratum_keys(self.strata)

    def named(self, df: DataFrame) -> DataFrame:
        """Give the strata their own names again."""
        return df.withColumnsRenamed(dict(zip(self.keys, self.strata)))

    @property
    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    def linear_predictor(self) -> str:
        """SQL text of the centred x * beta."""
        return _dot(self.covariates, self.coef, self.means)


# --- the collapsed risk table -------------------------------------------------------


def risk_table(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str],
    strata: Sequence[str] = (),
    rows_per_slice: int = 0,
    entry: str | None = None,
) -> DataFrame:
    """(_stratum0.., t, e, x0.., n), materialised and sliced along t. Rows with a missing
    duration, event or covariate are left out.

    With `entry` a row is at risk after that time and up to its duration; rows in which the entry
    is not before the duration are left out. An entry is a row of its own with a negative count: summed
    from the last time down, exits less entries are those at risk.
    """
    df = df.where(present(df, duration, event, *covariates, *([entry] if entry else [])))
    if entry:
        df = df.where(F.col(entry) < F.col(duration))

    def collapsed(time: str, happened, weight: int) -> DataFrame:
        rows = df.groupBy(
            *[F.col(f"`{s}`").alias(key) for s, key in zip(strata, _stratum_keys(strata))],
            F.col(time).alias("t"),
            happened.cast("int").alias("e"),
            *[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(covariates)],
        )
        return rows.agg((F.count(F.lit(1)) * weight).alias("n"))

    table = collapsed(duration, F.col(event), 1)
    if entry:
        table = table.union(collapsed(entry, F.lit(0), -1))
    return sliced(pin(table), "t", rows_per_slice)


def _stratum_keys(strata: Sequence[str]) -> list[str]:
    """Internal names of the strata, which no column of a step can collide with."""
    return [f"_stratum{i}" for i in range(len(strata))]


def _scales(table: DataFrame, means: Sequence[float]) -> list[float]:
    deviations = [f"sqrt(sum({_EXITS} * pow(x{j} - {m!r}D, 2)) / sum({_EXITS}))" for j, m in enumerate(means)]
    row = table.agg(*[F.expr(d).alias(f"s{j}") for j, d in enumerate(deviations)]).first() if means else ()
    return [float(s) for s in row]


def _dot(names: Sequence[str], weights: Sequence[float], centers: Sequence[float]) -> str:
    terms = [f"({float(w)!r}D * (`{x}` - {float(m)!r}D))" for x, w, m in zip(names, weights, centers)]
    return " + ".join(terms) or "0.0D"


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(j, k) for j in range(p) for k in range(j, p)]


def _per_time(table, beta, means, scales, strata, second_order: bool = True) -> DataFrame:
    """Risk-set sums S* and death sums E* at every distinct time.

    Covariates enter as z = (x - mean) / scale.
    """
    p = len(beta)
    z = [f"((x{j} - {means[j]!r}D) / {scales[j]!r}D)" for j in range(p)]
    theta = "n * exp(" + (" + ".join(f"{float(b)!r}D * {zj}" for b, zj in zip(beta, z)) or "0.0D") + ")"
    rows = table.selectExpr(
        *strata, "t", "e", "n", *([SLICE] if SLICE in table.columns else []),
        f"{theta} AS w", *[f"{zj} AS z{j}" for j, zj in enumerate(z)],
    )
    sums = {"s0": "w"}
    sums |= {f"s1_{j}": f"w * z{j}" for j in range(p)}
    if second_order:
        sums |= {f"s2_{j}_{k}": f"w * z{j} * z{k}" for j, k in _pairs(p)}
    aggregates = ["sum(n * e) AS d", "sum(n) AS leaving"]
    aggregates += [f"sum(n * e * z{j}) AS ex_{j}" for j in range(p)]
    for name, term in sums.items():
        aggregates += [f"sum({term}) AS own_{name}", f"sum(e * {term}) AS {name.replace('s', 'e', 1)}"]
    keys = [*strata, "t", *([SLICE] if SLICE in table.columns else [])]
    per_time = rows.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])
    return running_totals(
        per_time, "t", {name: f"own_{name}" for name in sums} | {"at_risk": "leaving"}, strata, descending=True
    ).drop(*[f"own_{name}" for name in sums])


def _tie_sums(per_time: DataFrame, ties: str) -> DataFrame:
    """Times with deaths, with the sums over l of 1/phi and so on.

    a, b: sum of 1/phi, (l/d)/phi;  c, f, g: sum of 1, l/d, (l/d)^2 over phi^2;
    h: sum of ln phi. As l/d = (s0 - phi) / e0, b, f and g follow from a and c.
    """
    deaths = per_time.where("d > 0")
    if ties == "breslow":
        return deaths.selectExpr(
            "*", "d / s0 AS a", "0.0D AS b", "d / (s0 * s0) AS c", "0.0D AS f", "0.0D AS g", "d * ln(s0) AS h"
        )
    phi = "(s0 - l * _u)"
    one_by_one = (
        f"aggregate(sequence(_m, d - 1), named_struct('a', 0.0D, 'c', 0.0D, 'h', 0.0D), (acc, l) -> named_struct("
        f"'a', acc.a + 1 / {phi}, 'c', acc.c + 1 / ({phi} * {phi}), 'h', acc.h + ln({phi})))"
    )
    # the first _m terms run from s0 down to just above _low, in steps of _u
    span = "-log1p(-_m * _u / s0)"
    smooth = {
        "a": f"{span} / _u + " + _euler_maclaurin(lambda x: f"1 / {x}", [(1, -1), (3, -6), (5, -120), (7, -5040)], 1),
        "c": "(1 / _low - 1 / s0) / _u + "
        + _euler_maclaurin(lambda x: f"1 / ({x} * {x})", [(1, -2), (3, -24), (5, -720), (7, -40320)], 2),
        "h": f"(s0 * {span} / _u + _m * ln(_low) - _m) + "
        + _euler_maclaurin(lambda x: f"ln({x})", [(1, 1), (3, 2), (5, 24), (7, 720)], 0),
    }
    prepared = deaths.selectExpr("*", "e0 / d AS _u", f"greatest(d - {EFRON_TERMS}, 0L) AS _m").selectExpr(
        "*", "s0 - _m * _u AS _low", f"{one_by_one} AS _last"
    )
    sums = prepared.selectExpr(
        "* EXCEPT (_u, _m, _low, _last)",
        *[f"_last.{name} + if(_m = 0, 0.0D, {term}) AS {name}" for name, term in smooth.items()],
    )
    return sums.selectExpr(
        "*",
        "(s0 * a - d) / e0 AS b",
        "(s0 * c - a) / e0 AS f",
        "(s0 * s0 * c - 2 * s0 * a + d) / (e0 * e0) AS g",
    )


def _euler_maclaurin(term, derivatives, power: int) -> str:
    """Corrections for the sum of term(x) over x = _low + _u, ..., s0 beyond its integral.

    `derivatives` lists (order, factor): that derivative is factor / x^(order + power).
    """
    # B_2k / (2k)! for k = 1..4.
    weights = {1: 1 / 12, 3: -1 / 720, 5: 1 / 30240, 7: -1 / 1209600}
    parts = [f"({term('s0')} - {term('_low')}) / 2"]
    for order, factor in derivatives:
        parts.append(
            f"{weights[order] * factor!r}D * pow(_u, {order}) * (pow(s0, -{order + power}) - pow(_low, -{order + power}))"
        )
    return " + ".join(parts)


def _evaluate(table, beta, means, scales, strata, ties) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient and information in z units: one job, one row."""
    p = len(beta)
    terms = _tie_sums(_per_time(table, beta, means, scales, strata), ties)
    score_x = " + ".join(f"{float(b)!r}D * ex_{j}" for j, b in enumerate(beta)) or "0.0D"
    wanted = [f"sum({score_x} - h) AS value"]
    wanted += [f"sum(ex_{j} - (a * s1_{j} - b * e1_{j})) AS g{j}" for j in range(p)]
    wanted += [
        f"sum(a * s2_{j}_{k} - b * e2_{j}_{k} - (c * s1_{j} * s1_{k} - f * (s1_{j} * e1_{k} + e1_{j} * s1_{k}) "
        f"+ g * e1_{j} * e1_{k})) AS i{j}_{k}"
        for j, k in _pairs(p)
    ]
    row = terms.agg(*[F.expr(w) for w in wanted]).first()
    gradient = np.array([row[f"g{j}"] for j in range(p)], dtype=float)
    information = np.zeros((p, p))
    for j, k in _pairs(p):
        information[j, k] = information[k, j] = row[f"i{j}_{k}"]
    return row["value"], gradient, information


# --- fit ----------------------------------------------------------------------------


def fit_cox(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str],
    strata: Sequence[str] = (),
    ties: str = "efron",
    alpha: float = 0.05,
    max_iter: int = 50,
    precision: float = 1e-7,
    rows_per_slice: int = 0,
    runaway: float = RUNAWAY,
    entry: str | None = None,
) -> CoxModel:
    """Newton-Raphson with step halving from beta = 0; no penalty.

    With `entry` the rows are episodes (entry, duration] and the covariates may differ between the
    episodes of a subject (see `episodes`); a subject whose covariates stay the same may be cut anywhere
    without a change in the coefficients. `baseline_hazard` holds for such a fit, `ph_test` does not.

    A covariate that does not vary, or covariates that determine each other,
    make the information singular and are refused; so is a likelihood that
    keeps rising as a coefficient runs away (beyond `runaway` per standard deviation).
    """
    covariates, strata = list(covariates), list(strata)
    p = len(covariates)
    table = risk_table(df, duration, event, covariates, strata, rows_per_slice, entry)
    sizes = table.agg(
        F.expr(f"sum({_EXITS}) AS n"),
        F.expr("sum(n * e) AS events"),
        *[F.expr(f"sum({_EXITS} * x{j}) / sum({_EXITS}) AS m{j}") for j in range(p)],
    ).first()
    if not sizes["events"]:
        raise ValueError("no event was observed")
    means = [float(sizes[f"m{j}"]) for j in range(p)]
    for name, mean in zip(covariates, means):
        if not math.isfinite(mean):
            raise ValueError(f"{name} has an infinite value")
    scales = _scales(table, means)
    for name, scale in zip(covariates, scales):
        if scale == 0:
            raise ValueError(f"{name} does not vary")

    beta = np.zeros(p)
    keys = _stratum_keys(strata)
    value, gradient, information = _evaluate(table, beta, means, scales, keys, ties)
    null_value, iterations = value, 0
    for iterations in range(1, max_iter + 1):
        step = _solve(information, gradient)
        newton_gain = float(gradient @ step)
        while True:
            tried = _evaluate(table, beta + step, means, scales, keys, ties)
            if tried[0] >= value - 1e-9 * abs(value) or np.max(np.abs(step)) < precision:
                break
            step = step / 2
        beta = beta + step
        value, gradient, information = tried
        if np.max(np.abs(beta)) > runaway:
            raise ValueError("the likelihood is monotone: a covariate separates the events")
        if np.max(np.abs(step)) < precision or newton_gain < precision**2:
            break
    else:
        raise ValueError(f"no convergence in {max_iter} steps")

    unscale = 1 / np.array(scales)
    return CoxModel(
        covariates=covariates,
        coef=beta * unscale,
        covariance=_solve(information, np.eye(p)) * np.outer(unscale, unscale),
        log_likelihood=float(value),
        null_log_likelihood=float(null_value),
        observations=int(sizes["n"]),
        events=int(sizes["events"]),
        ties=ties,
        alpha=alpha,
        strata=strata,
        means=np.array(means),
        iterations=iterations,
        table=table,
    )


def _solve(information: np.ndarray, right: np.ndarray) -> np.ndarray:
    if np.linalg.cond(information) > 1e12:
        raise ValueError("the information matrix is singular: covariates are collinear")
    return np.linalg.solve(information, right)


# --- results as tables --------------------------------------------------------------


def _exp(x: float) -> float:
    return math.exp(x) if x < 709 else math.inf


def coefficient_rows(names, coef, errors, alpha) -> list[tuple]:
    z_alpha = normal_quantile(1 - alpha / 2)
    rows = []
    for name, b, se in zip(names, coef, errors):
        b, se = float(b), float(se)
        z, p = b / se, normal_two_sided(b / se)
        low, high = b - z_alpha * se, b + z_alpha * se
        rows.append(
            (*((name,) if isinstance(name, str) else name), b, _exp(b), se, low, high, _exp(low), _exp(high),
             z, p, surprise(p))
        )
    return rows


COEFFICIENT_SCHEMA = (
    "covariate string, coef double, exp_coef double, se double, lower double, upper double, "
    "exp_lower double, exp_upper double, z double, p double, neg_log2_p double"
)


def summary(spark: SparkSession, model: CoxModel) -> DataFrame:
    """One row per covariate: coef, hazard ratio, standard error, interval, z, p, -log2 p."""
    rows = coefficient_rows(model.covariates, model.coef, model.standard_errors, model.alpha)
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def hazard_ratios(spark: SparkSession, model: CoxModel) -> DataFrame:
    """Interval data for a forest plot, largest ratio first."""
    table = summary(spark, model)
    return table.select("covariate", "exp_coef", "exp_lower", "exp_upper").orderBy(F.desc("exp_coef"))


def metrics(spark: SparkSession, model: CoxModel, concordance: float | None = None) -> DataFrame:
    p = len(model.covariates)
    ratio = 2 * (model.log_likelihood - model.null_log_likelihood)
    tail = chi2_tail(ratio, p)
    row = (
        model.observations, model.events, model.log_likelihood, concordance,
        -2 * model.log_likelihood + 2 * p, ratio, p, tail, surprise(tail),
    )
    return spark.createDataFrame(
        [row],
        "observations long, events long, partial_log_likelihood double, concordance double, partial_aic double, "
        "lr_statistic double, lr_df int, lr_p double, lr_neg_log2_p double",
    )


# --- baseline and prediction --------------------------------------------------------


def at_fixed(
    df: DataFrame,
    duration: str,
    event: str,
    coef: Mapping[str, float],
    strata: Sequence[str] = (),
    ties: str = "efron",
    rows_per_slice: int = 0,
) -> CoxModel:
    """A model whose coefficients are given instead of fitted (covariance from the data)."""
    covariates, strata = list(coef), list(strata)
    table = risk_table(df, duration, event, covariates, strata, rows_per_slice)
    p = len(covariates)
    sizes = table.agg(
        F.expr(f"sum({_EXITS}) AS n"), F.expr("sum(n * e) AS events"),
        *[F.expr(f"sum({_EXITS} * x{j}) / sum({_EXITS}) AS m{j}") for j in range(p)],
    ).first()
    means, ones = [float(sizes[f"m{j}"]) for j in range(p)], [1.0] * p
    beta = np.array([float(coef[c]) for c in covariates])
    keys = _stratum_keys(strata)
    value, _, information = _evaluate(table, beta, means, ones, keys, ties)
    null_value, _, _ = _evaluate(table, np.zeros(p), means, ones, keys, ties)
    return CoxModel(
        covariates, beta, np.linalg.inv(information), float(value), float(null_value), int(sizes["n"]),
        int(sizes["events"]), ties, 0.05, strata, np.array(means), 0, table,
    )


def baseline_hazard(model: CoxModel) -> DataFrame:
    """Breslow baseline at the mean covariates: strata, t, cumulative_hazard, survival."""
    means = [float(m) for m in model.means]
    per_time = _per_time(
        model.table, model.coef, means, [1.0] * len(means), model.keys, second_order=False
    )
    steps = per_time.select(
        *model.keys, "t", *([SLICE] if SLICE in per_time.columns else []), (F.col("d") / F.col("s0")).alias("hazard")
    )
    curve = running_totals(steps, "t", {"cumulative_hazard": "hazard"}, model.keys)
    return model.named(
        curve.select(*model.keys, "t", "cumulative_hazard", F.exp(-F.col("cumulative_hazard")).alias("survival"))
    )


def relative_risk(model: CoxModel):
    """exp of the centred linear predictor, as a column over the covariates."""
    return F.exp(F.expr(model.linear_predictor()))


def predict_survival(
    model: CoxModel, rows: Sequence[Mapping[str, float]], baseline: DataFrame | None = None
) -> DataFrame:
    """Survival curve of each covariate row at every time of the baseline: row, t, survival.

    The rows are a short list of profiles and travel as literals; the baseline
    stays distributed.
    """
    risks = [
        (i, math.exp(sum(b * (float(row[c]) - m) for c, b, m in zip(model.covariates, model.coef, model.means))))
        for i, row in enumerate(rows)
    ]
    profiles = ", ".join(f"named_struct('row', {i}, 'risk', {risk!r}D)" for i, risk in risks)
    steps = baseline_hazard(model) if baseline is None else baseline
    return steps.select(*model.strata, "t", "cumulative_hazard", F.expr(f"inline(array({profiles}))")).select(
        *model.strata, "row", "t", F.exp(-F.col("cumulative_hazard") * F.col("risk")).alias("survival")
    )


# --- diagnostics --------------------------------------------------------------------


def schoenfeld(model: CoxModel) -> DataFrame:
    """Schoenfeld residuals, one row per (strata, event time, covariate pattern, covariate).

    `n` events share the residual, `scaled` is the residual times covariance
    and number of events. Subjects with the same time and covariates have the
    same residual, so they stay collapsed.
    """
    return model.named(_schoenfeld(model))


def _schoenfeld(model: CoxModel) -> DataFrame:
    p = len(model.covariates)
    means = [float(m) for m in model.means]
    per_time = _per_time(model.table, model.coef, means, [1.0] * p, model.keys, second_order=False)
    centre = _tie_sums(per_time, model.ties).selectExpr(
        *model.keys, "t", *[f"(a * s1_{j} - b * e1_{j}) / d AS c{j}" for j in range(p)]
    )
    events = model.table.where("e = 1").drop(SLICE)
    residuals = lookup_join(events, centre, [*model.keys, "t"]).selectExpr(
        *model.keys, "t", *[f"x{j}" for j in range(p)], "n",
        *[f"x{j} - {means[j]!r}D - c{j} AS r{j}" for j in range(p)],
    )
    cells = []
    for j, name in enumerate(model.covariates):
        weights = [float(v) * model.events for v in model.covariance[j]]
        scaled = " + ".join(f"{w!r}D * r{k}" for k, w in enumerate(weights))
        label = name.replace("'", "\\'")
        cells.append(f"named_struct('covariate', '{label}', 'x', x{j}, 'residual', r{j}, 'scaled', {scaled})")
    pattern = ", ".join(f"x{j}" for j in range(p))
    return residuals.selectExpr(
        *model.keys, "t", "n", f"array({pattern}) AS pattern", f"inline(array({', '.join(cells)}))"
    )


def _time_transforms(model: CoxModel) -> DataFrame:
    """Per (strata, t): average rank over all subjects, and 1 - Kaplan-Meier."""
    per_time = model.table.groupBy(*model.keys, "t", *([SLICE] if SLICE in model.table.columns else [])).agg(
        F.expr("sum(n * e) AS d"), F.expr("sum(n) AS m")
    )
    up = running_totals(per_time, "t", {"upto": "m"}, model.keys)
    down = running_totals(up, "t", {"at_risk": "m"}, model.keys, descending=True)
    logs = down.withColumn("ln", F.expr("CASE WHEN d = at_risk THEN -1e300D ELSE log1p(-d / at_risk) END"))
    steps = running_totals(logs, "t", {"cum": "ln"}, model.keys)
    return steps.selectExpr(*model.keys, "t", "upto - (m - 1) / 2 AS rank", "1 - exp(cum) AS km")


def ph_test(model: CoxModel) -> DataFrame:
    """Grambsch-Therneau test of proportional hazards per covariate, for rank- and
    Kaplan-Meier-transformed time: covariate, transform, statistic, p, -log2 p."""
    residuals = _schoenfeld(model)
    times = _time_transforms(model)
    joined = lookup_join(residuals, times, [*model.keys, "t"])
    long = joined.selectExpr(
        "covariate", "n", "scaled",
        "inline(array(named_struct('transform', 'km', 'g', km), named_struct('transform', 'rank', 'g', rank)))",
    )
    sums = (
        long.groupBy("covariate", "transform")
        .agg(
            F.expr("sum(n * g) AS g"), F.expr("sum(n * g * g) AS gg"), F.expr("sum(n * scaled) AS r"),
            F.expr("sum(n * g * scaled) AS gr"), F.expr("sum(n) AS events"),
        )
        .collect()
    )
    variance = dict(zip(model.covariates, np.diag(model.covariance)))
    rows = []
    for s in sorted(sums):
        mean = s["g"] / s["events"]
        top = (s["gr"] - mean * s["r"]) ** 2
        statistic = top / (s["events"] * float(variance[s["covariate"]]) * (s["gg"] - mean * s["g"]))
        tail = chi2_tail(statistic, 1)
        rows.append((s["covariate"], s["transform"], statistic, tail, surprise(tail)))
    return model.table.sparkSession.createDataFrame(
        rows, "covariate string, transform string, statistic double, p double, neg_log2_p double"
    )


def smoothed_residuals(model: CoxModel, transform: str = "rank", bins: int = 100, reach: float = 0.2) -> DataFrame:
    """The line through a plot of scaled Schoenfeld residuals: (covariate, g, residual, effect), a point per bin of `transform`
    ("km", "rank" or "t") at its centre; `effect` adds the coefficient, so it estimates the effect at that time.

    One aggregate gives the moments of every bin; each point is a local linear fit to the bins closer than
    `reach` of the range, with tricube weights of their distance, so what follows is bins squared, not rows.
    """
    if transform not in ("km", "rank", "t"):
        raise ValueError(f"unknown transform {transform}")
    keys = [*model.keys, "t"]
    rows = lookup_join(_schoenfeld(model), _time_transforms(model), keys).selectExpr(
        "covariate", "n", "scaled AS r", f"double(`{transform}`) AS g"
    )
    rows = pin(rows)
    ends = rows.agg(F.min("g").alias("lo"), F.max("g").alias("hi")).first()
    span = (ends["hi"] - ends["lo"]) or 1.0 if ends["lo"] is not None else 1.0
    lo = ends["lo"] or 0.0
    binned = (
        rows.selectExpr("covariate", "n", "r", f"(g - {lo!r}D) / {span!r}D AS u")
        .groupBy("covariate", F.expr(f"least({bins - 1}, int(floor(u * {bins})))").alias("bin"))
        .agg(*[F.expr(f"sum(n * {x})").alias(name) for name, x in
               {"s0": "1", "s1": "u", "s2": "u * u", "r0": "r", "r1": "u * r"}.items()])
    )
    wide = max(1, math.ceil(reach * bins))
    near = binned.withColumn(
        "point", F.expr(f"explode(sequence(greatest(0, bin - {wide - 1}), least({bins - 1}, bin + {wide - 1})))")
    ).selectExpr("*", f"(point + 0.5D) / {bins} AS x", f"pow(1 - pow(abs(bin - point) / {float(wide)!r}D, 3), 3) AS w")
    sums = near.groupBy("covariate", "point", "x").agg(
        F.expr("sum(w * s0) AS a0"), F.expr("sum(w * (s1 - x * s0)) AS a1"),
        F.expr("sum(w * (s2 - 2 * x * s1 + x * x * s0)) AS a2"),
        F.expr("sum(w * r0) AS b0"), F.expr("sum(w * (r1 - x * r0)) AS b1"),
    )
    # one value of g in reach has no slope: the weighted mean
    level = "if(a0 * a2 - a1 * a1 > 1e-12D * a0 * a0, (a2 * b0 - a1 * b1) / (a0 * a2 - a1 * a1), b0 / a0)"
    coef = F.create_map(*[F.lit(v) for name, b in zip(model.covariates, model.coef) for v in (name, float(b))])
    return sums.select(
        "covariate", F.expr(f"{lo!r}D + {span!r}D * x").alias("g"), F.expr(level).alias("residual")
    ).withColumn("effect", F.col("residual") + coef[F.col("covariate")])


def ph_report(model: CoxModel, p_value_threshold: float = 0.05) -> DataFrame:
    """Covariates with their smallest p over both transforms, and what to do about a violation."""
    tests = ph_test(model).groupBy("covariate").agg(F.min("p").alias("p"))
    violated = F.col("p") < p_value_threshold
    return tests.select(
        "covariate",
        "p",
        violated.alias("violates"),
        F.when(violated, "stratify on it, bin it, or let its effect vary with time")
        .otherwise("keep")
        .alias("advice"),
    )
