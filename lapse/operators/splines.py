"""Hazards that are smooth in time: the log cumulative hazard as a restricted cubic spline of log time.

ln H(t | x) = s(ln t) + x * b. The knots of s are quantiles of the event times, s is linear beyond the outermost,
and with no inner knot this is the Weibull model. Subjects are collapsed to (entry, end, event, covariates) with a
count; the basis is column arithmetic, and each Newton step is one aggregate to a single row.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapse.operators.cox import COEFFICIENT_SCHEMA, RUNAWAY, coefficient_rows
from lapse.operators.running import present, running_totals, sliced
from lapse.sources.session import pin


@dataclass
class SplineModel:
    """`gamma` belongs to 1, u and one term per inner knot, where u is log time on a scale from 0 at the first knot to 1
    at the last; it is the spline of a subject with the mean covariates. `knots` are log times."""

    covariates: list[str]
    knots: list[float]
    gamma: np.ndarray
    coef: np.ndarray
    covariance: np.ndarray
    means: np.ndarray
    log_likelihood: float
    observations: int
    events: int
    alpha: float

    @property
    def aic(self) -> float:
        return 2 * (len(self.gamma) + len(self.coef)) - 2 * self.log_likelihood


def _basis(log_time: str, knots: Sequence[float]) -> tuple[list[str], list[str]]:
    """SQL of the basis at a log time, and of its derivative by log time."""
    low, high = knots[0], knots[-1]
    width = high - low
    u = f"(({log_time} - {low!r}D) / {width!r}D)"

    def above(at: float, power: int) -> str:
        return f"power(greatest({u} - {at!r}D, 0D), {power})"

    values, slopes = ["1D", u], ["0D", f"{1 / width!r}D"]
    for knot in knots[1:-1]:
        at = (knot - low) / width
        share = 1 - at
        values.append(f"({above(at, 3)} - {share!r}D * {above(0.0, 3)} - {at!r}D * {above(1.0, 3)})")
        slopes.append(f"({3 / width!r}D * ({above(at, 2)} - {share!r}D * {above(0.0, 2)} - {at!r}D * {above(1.0, 2)}))")
    return values, slopes


def event_quantiles(
    df: DataFrame, duration: str, event: str, shares: Sequence[float], rows_per_slice: int = 0, weight: str | None = None
) -> list[float]:
    """The least event time, for each share the least time by which that share of the events has happened, and the
    greatest event time. Exact: events are collapsed to distinct times, and running counts go by slices. A row stands
    for as many as its `weight=` says."""
    events = df.where(present(df, duration, event) & (F.col(event) == 1))
    number = F.sum(weight) if weight else F.count(F.lit(1))
    counts = pin(events.groupBy(F.col(duration).cast("double").alias("t")).agg(number.alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no event was observed")
    run = running_totals(sliced(counts, "t", rows_per_slice), "t", {"c": "n"})
    asked = [F.min(F.when(F.col("c") >= math.ceil(share * total), F.col("t"))) for share in shares]
    return [float(v) for v in run.agg(F.min("t"), *asked, F.max("t")).first()]


def fit_spline(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str] = (),
    knots: int | Sequence[float] = 3,
    entry: str | None = None,
    alpha: float = 0.05,
    rows_per_slice: int = 0,
    max_iter: int = 100,
    precision: float = 1e-8,
) -> SplineModel:
    """Maximum likelihood fit with `knots` inner knots at equally spaced quantiles of the event times, or at given times.

    `entry=` takes rows that are followed from an entry time on, such as episodes with changing covariates. Rows with a
    missing value, or that do not end after they start, are left out. Knots that coincide, or that do not lie between the
    first and the last event, count once or not at all. A step after which the hazard is not positive at an event is
    halved; a fitted hazard that is not positive somewhere between events is reported with a warning.
    """
    covariates = list(covariates)
    begin = F.col(entry).cast("double") if entry else F.lit(0.0)
    end = F.col(duration).cast("double")
    df = df.where(present(df, duration, event, *covariates, *([entry] if entry else [])) & (begin < end) & (begin >= 0))
    xs = [f"x{j}" for j in range(len(covariates))]
    rows = df.select(
        begin.alias("a"), end.alias("b"), (F.col(event) == 1).cast("int").alias("e"),
        *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(covariates, xs)],
    )
    table = pin(rows.groupBy("a", "b", "e", *xs).agg(F.count(F.lit(1)).alias("n")))

    sizes = table.agg(
        F.expr("sum(n) AS n"), F.expr("sum(n * e) AS events"), F.expr("sum(n * (b - a)) AS time"), F.expr("max(b) AS last"),
        *[F.expr(f"sum(n * {x}) / sum(n) AS m_{x}") for x in xs],
    ).first()
    if not sizes["events"]:
        raise ValueError("no event was observed")
    means = [float(sizes[f"m_{x}"]) for x in xs]
    if not all(math.isfinite(v) for v in [*means, sizes["last"]]):
        raise ValueError("times and covariates must be finite")
    scales = []
    if xs:
        spread = table.agg(*[F.expr(f"sqrt(sum(n * pow({x} - {m!r}D, 2)) / sum(n))") for x, m in zip(xs, means)]).first()
        scales = [float(s) for s in spread]
    for name, scale in zip(covariates, scales):
        if scale == 0:
            raise ValueError(f"{name} does not vary")

    shares = [i / (knots + 1) for i in range(1, knots + 1)] if isinstance(knots, int) else []
    first, *inner, last = event_quantiles(table, "b", "e", shares, rows_per_slice, "n")
    inner = inner if isinstance(knots, int) else [float(k) for k in knots]
    if first == last:
        raise ValueError("all events happened at one time")
    places = [math.log(first), *[math.log(k) for k in sorted(set(inner)) if first < k < last], math.log(last)]

    g, p = len(places), len(xs)
    z = [f"(({x} - {m!r}D) / {s!r}D)" for x, m, s in zip(xs, means, scales)]
    at_end, slope = _basis("ln(b)", places)
    at_entry, _ = _basis("ln(a)", places)
    q = g + p
    terms = table.selectExpr(
        "n", "e", "ln(b) AS y", "a > 0 AS late",
        *[f"{v} AS b{i}" for i, v in enumerate([*at_end, *z])],
        *[f"if(e = 1, {v}, 0D) AS d{i}" for i, v in enumerate(slope)],
        *[f"if(a > 0, {v}, 0D) AS a{i}" for i, v in enumerate([*at_entry, *z])],
    )

    def evaluate(theta):
        def dot(name, count):
            return " + ".join(f"{float(theta[i])!r}D * {name}{i}" for i in range(count))

        risen = terms.selectExpr("*", f"exp({dot('b', q)}) AS h", f"if(late, exp({dot('a', q)}), 0D) AS h0", f"{dot('d', g)} AS sd")
        risen = risen.selectExpr("*", f"if(e = 1, ln(if(sd > 0, sd, NULL)) - y + {dot('b', q)}, 0D) AS l")
        wanted = {"bad": "count_if(l IS NULL)", "value": "sum(n * (l - h + h0))"}
        for i in range(q):
            rise = f" + d{i} / nullif(sd, 0D)" if i < g else ""
            wanted[f"g{i}"] = f"sum(n * (if(e = 1, b{i}{rise}, 0D) - h * b{i} + h0 * a{i}))"
            for j in range(i, q):
                both = f"if(e = 1, d{i} * d{j} / nullif(sd * sd, 0D), 0D) + " if j < g else ""
                wanted[f"i{i}_{j}"] = f"sum(n * ({both}h * b{i} * b{j} - h0 * a{i} * a{j}))"
        row = risen.agg(*[F.expr(s).alias(name) for name, s in wanted.items()]).first()
        value = float(row["value"]) if not row["bad"] and row["value"] is not None else -math.inf
        information = np.array([[row[f"i{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(q)] for i in range(q)], float)
        return value, np.array([row[f"g{i}"] or 0.0 for i in range(q)], float), information

    # a constant hazard to start with
    theta = np.zeros(q)
    theta[0], theta[1] = math.log(sizes["events"] / sizes["time"]) + places[0], places[-1] - places[0]
    value, gradient, information = evaluate(theta)
    for _ in range(max_iter):
        # neighbouring terms are nearly collinear: judge curvature on the scale of each
        size = np.sqrt(np.abs(np.diag(information)))
        scaled = information / np.outer(size, size)
        lowest = np.linalg.eigvalsh(scaled)[0]
        if lowest <= 1e-12:
            scaled = scaled + (1e-3 - lowest) * np.eye(q)
        step = np.linalg.solve(scaled, gradient / size) / size
        while True:
            tried = evaluate(theta + step)
            if tried[0] >= value - 1e-9 * abs(value) or _small(step, theta, precision):
                break
            step = step / 2
        if math.isinf(tried[0]):
            raise ValueError("no step keeps the hazard positive at the events: use fewer knots")
        theta = theta + step
        value, gradient, information = tried
        if np.max(np.abs(theta[g:]), initial=0.0) > RUNAWAY:
            raise ValueError("the likelihood is monotone: a covariate separates the events")
        if _small(step, theta, precision):
            break
    else:
        raise ValueError(f"no convergence in {max_iter} steps")

    unscale = np.array([1.0] * g + [1 / s for s in scales])
    model = SplineModel(
        covariates, places, theta[:g], theta[g:] * unscale[g:], np.linalg.inv(information) * np.outer(unscale, unscale),
        np.array(means), value, int(sizes["n"]), int(sizes["events"]), alpha,
    )
    if least_slope(model) <= 0:
        warnings.warn("the fitted hazard is not positive everywhere between the knots: use fewer knots", stacklevel=2)
    return model


def _small(step: np.ndarray, theta: np.ndarray, precision: float) -> bool:
    return bool(np.all(np.abs(step) < precision * np.maximum(1.0, np.abs(theta))))


def least_slope(model: SplineModel) -> float:
    """Least derivative of the spline by u. Between two knots it is a parabola, so its ends and its vertex decide."""
    low, width = model.knots[0], model.knots[-1] - model.knots[0]
    at = [(k - low) / width for k in model.knots]
    inner = list(zip(at[1:-1], model.gamma[2:]))
    found = []
    for left, right in zip(at, at[1:]):
        on = [(k, c) for k, c in inner if k <= left]
        square = 3 * (sum(c for _, c in on) - sum((1 - k) * c for k, c in inner))
        line, flat = -6 * sum(k * c for k, c in on), model.gamma[1] + 3 * sum(k * k * c for k, c in on)
        places = [left, right]
        if square and left < -line / (2 * square) < right:
            places.append(-line / (2 * square))
        found += [square * u * u + line * u + flat for u in places]
    return float(min(found))


def predict(df: DataFrame, time: str, model: SplineModel) -> DataFrame:
    """Add `hazard`, `cumulative_hazard` and `survival` at each row's own time and covariates (the means where the
    table has none of the model's columns).

    At time 0 and before nobody has died and the hazard is NULL; a missing time or covariate gives NULL.
    """
    absent = [c for c in model.covariates if c not in df.columns]
    if absent and len(absent) < len(model.covariates):
        raise ValueError(f"missing covariates: {absent}")
    t = F.col(f"`{time}`").cast("double")
    shift = F.lit(0.0)
    for c, b, m in zip(model.covariates, model.coef, model.means):
        if not absent:
            shift = shift + F.lit(float(b)) * (F.col(f"`{c}`").cast("double") - F.lit(float(m)))
    values, slopes = _basis("ln(_t)", model.knots)
    level = " + ".join(f"{float(c)!r}D * {v}" for c, v in zip(model.gamma, values))
    rise = " + ".join(f"{float(c)!r}D * {v}" for c, v in zip(model.gamma, slopes))
    known = "_t IS NOT NULL AND NOT isnan(_t) AND _shift IS NOT NULL AND NOT isnan(_shift)"
    found = df.withColumns({"_t": t, "_shift": shift}).withColumns({
        "cumulative_hazard": F.expr(f"CASE WHEN NOT ({known}) THEN NULL WHEN _t <= 0 THEN 0D ELSE exp({level} + _shift) END"),
        "_rise": F.expr(f"CASE WHEN {known} AND _t > 0 THEN {rise} END"),
    })
    return found.withColumns({
        "hazard": F.col("_rise") * F.col("cumulative_hazard") / F.col("_t"), "survival": F.exp(-F.col("cumulative_hazard")),
    }).select(*df.columns, "hazard", "cumulative_hazard", "survival")


def summary(spark: SparkSession, model: SplineModel) -> DataFrame:
    """One row per parameter: coef, its exponential, standard error, interval, z, p, -log2 p. The spline's are called
    `constant`, `log_time` and `knot_1`, ...; those of the covariates are log hazard ratios."""
    names = ["constant", "log_time", *[f"knot_{i}" for i in range(1, len(model.gamma) - 1)], *model.covariates]
    errors = np.sqrt(np.diag(model.covariance))
    rows = coefficient_rows(names, [*model.gamma, *model.coef], errors, model.alpha)
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)
