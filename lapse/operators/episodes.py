"""Episodes of subjects whose covariates change, and hazards that are constant between knots.

A subject is followed over (start, stop]. Changes of its covariates cut that span
into episodes, each with the values in force. Subjects and changes lie on one time
axis per subject; what was last known is carried along it, by slices where a subject
has many changes, so that it is not one task, and no interval is compared with another.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapse.operators.cox import COEFFICIENT_SCHEMA, RUNAWAY, _solve, coefficient_rows
from lapse.operators.running import carried, following, present, sliced
from lapse.sources.session import pin


def episodes(
    subjects: DataFrame,
    changes: DataFrame,
    key: str,
    values: Sequence[str],
    start: str = "start",
    stop: str = "stop",
    event: str = "event",
    at: str = "at",
    rows_per_slice: int = 0,
) -> DataFrame:
    """(key, start, stop, event, values): the spans of `subjects` (key, start, stop, event), cut where `changes`
    (key, at, values) has a change of the subject.

    A change holds after its time and until the next; before the first one the values are NULL. Changes before a
    span are in force at its start, those at or after its end do not matter. The event belongs to the last
    episode of its span. Of changes of a subject at one time the largest value of each column counts; a NULL value
    changes nothing. Rows without a key, time or event, and spans that do not end after they start, are left out. A
    subject may have several spans that do not overlap.
    """
    values = list(values)
    spans = subjects.where(present(subjects, key, start, stop, event) & (F.col(start) < F.col(stop)))
    span = F.struct(F.col(stop).cast("double").alias("stop"), F.col(event).cast("int").alias("event"))
    spans = spans.select(F.col(key).alias("_key"), F.col(start).cast("double").alias("_t"), span.alias("_span"))
    marks = changes.where(present(changes, key, at)).select(
        F.col(key).alias("_key"), F.col(at).cast("double").alias("_t"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]
    )
    both = spans.unionByName(marks, allowMissingColumns=True).groupBy("_key", "_t").agg(
        F.max("_span").alias("_span"), *[F.max(f"_v{i}").alias(f"_v{i}") for i in range(len(values))]
    )
    axis = sliced(pin(both), "_t", rows_per_slice, ["_key"])
    held = carried(axis, "_t", {"_in": "_span"} | {f"_h{i}": f"_v{i}" for i in range(len(values))}, ["_key"])
    held = following(held, "_t", "_next", ["_key"]).where(F.col("_t") < F.col("_in.stop"))
    end = F.least(F.coalesce("_next", "_in.stop"), F.col("_in.stop"))
    return held.select(
        F.col("_key").alias(key), F.col("_t").alias(start), end.alias(stop),
        F.when(end == F.col("_in.stop"), F.col("_in.event")).otherwise(0).alias(event),
        *[F.col(f"_h{i}").alias(v) for i, v in enumerate(values)],
    )


@dataclass
class PiecewiseModel:
    """Hazards constant between knots, times exp(x * coef); `intervals` holds (lower, upper, exposure, events, hazard)."""

    covariates: list[str]
    coef: np.ndarray
    covariance: np.ndarray
    means: np.ndarray
    intervals: list[tuple[float, float | None, float, int, float]]
    log_likelihood: float
    alpha: float


def exposure(
    df: DataFrame, duration: str, event: str, knots: Sequence[float], covariates: Sequence[str] = (), entry: str | None = None
) -> DataFrame:
    """(x0.., time, events) per pattern of covariates, materialised: arrays with the time spent in each interval
    between `knots` (the first begins at 0, the last has no end) and the events in it.

    The share of a row in an interval is a difference of clipped times; rows are not multiplied by intervals.
    An interval has its upper end. Rows with a missing value, or that do not end after they start, are left out.
    """
    cuts = [0.0, *sorted(float(k) for k in knots)]
    if len(set(cuts)) < len(cuts) or not all(math.isfinite(c) for c in cuts):
        raise ValueError("knots are distinct, finite and positive")
    begin = F.col(entry).cast("double") if entry else F.lit(0.0)
    end = F.col(duration).cast("double")
    df = df.where(present(df, duration, event, *covariates, *([entry] if entry else [])) & (begin < end) & (begin >= 0))
    rows = df.select(
        *[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(covariates)],
        begin.alias("a"), end.alias("b"), F.col(event).cast("int").alias("e"),
    )
    spent, died = [], []
    for low, high in zip(cuts, [*cuts[1:], None]):
        upper = "b" if high is None else f"least(b, {high!r}D)"
        spent.append(f"sum(greatest({upper} - greatest(a, {low!r}D), 0D))")
        inside = f"b > {low!r}D" + ("" if high is None else f" AND b <= {high!r}D")
        died.append(f"sum(if({inside}, e, 0))")
    keys = [f"x{j}" for j in range(len(covariates))]
    sums = rows.groupBy(*keys).agg(F.expr(f"array({', '.join(spent)})").alias("time"), F.expr(f"array({', '.join(died)})").alias("events"))
    return pin(sums)


def fit_piecewise(
    df: DataFrame,
    duration: str,
    event: str,
    knots: Sequence[float],
    covariates: Sequence[str] = (),
    entry: str | None = None,
    alpha: float = 0.05,
    max_iter: int = 50,
    precision: float = 1e-9,
) -> PiecewiseModel:
    """Poisson regression of events on covariates with the time at risk as offset, one baseline per interval.

    The baselines are solved out: at given coefficients an interval's is its events over its weighted time, which
    leaves Newton steps of as many columns as covariates, one aggregate each. Intervals without time or events have hazard
    NULL or 0 and say nothing about the coefficients.
    """
    covariates = list(covariates)
    p = len(covariates)
    table = exposure(df, duration, event, knots, covariates, entry)
    cells = table.select(*[f"x{j}" for j in range(p)], F.posexplode(F.arrays_zip("time", "events")).alias("k", "s"))
    cells = cells.select(*[f"x{j}" for j in range(p)], "k", F.col("s.time").alias("time"), F.col("s.events").alias("d"))
    mean = [F.expr(f"sum(time * x{j}) / sum(time) AS m{j}") for j in range(p)]
    sizes = cells.agg(F.sum("d").alias("d"), *mean, *[F.expr(f"stddev_pop(x{j}) AS s{j}") for j in range(p)]).first()
    if not sizes["d"]:
        raise ValueError("no event was observed")
    means, scales = [float(sizes[f"m{j}"]) for j in range(p)], [float(sizes[f"s{j}"]) for j in range(p)]
    for name, scale in zip(covariates, scales):
        if scale == 0:
            raise ValueError(f"{name} does not vary")
    z = [f"((x{j} - {m!r}D) / {s!r}D)" for j, (m, s) in enumerate(zip(means, scales))]
    beta = np.zeros(p)

    def evaluate(beta):
        weight = "time * exp(" + (" + ".join(f"{float(b)!r}D * {zj}" for b, zj in zip(beta, z)) or "0D") + ")"
        sums = ["sum(time) AS plain", "sum(d) AS d", f"sum({weight}) AS r"]
        sums += [f"sum(d * {zj}) AS d{j}" for j, zj in enumerate(z)] + [f"sum({weight} * {zj}) AS r{j}" for j, zj in enumerate(z)]
        sums += [f"sum({weight} * {z[i]} * {z[j]}) AS r{i}_{j}" for i in range(p) for j in range(p)]
        # one row per interval
        found = cells.groupBy("k").agg(*[F.expr(e) for e in sums]).orderBy("k").collect()
        value, gradient, information = 0.0, np.zeros(p), np.zeros((p, p))
        for row in found:
            d, r = float(row["d"]), float(row["r"])
            if d:
                centre = np.array([row[f"r{j}"] for j in range(p)], float) / r
                deaths = np.array([row[f"d{j}"] for j in range(p)], float)
                second = np.array([[row[f"r{i}_{j}"] for j in range(p)] for i in range(p)], float).reshape(p, p) / r
                value += float(beta @ deaths) + d * math.log(d / r) - d
                gradient += deaths - d * centre
                information += d * (second - np.outer(centre, centre))
        return value, gradient, information, found

    value, gradient, information, found = evaluate(beta)
    for _ in range(max_iter if p else 0):
        step = _solve(information, gradient)
        while True:
            tried = evaluate(beta + step)
            if tried[0] >= value - 1e-9 * abs(value) or np.max(np.abs(step)) < precision:
                break
            step = step / 2
        beta = beta + step
        value, gradient, information, found = tried
        if np.max(np.abs(beta)) > RUNAWAY:
            raise ValueError("the likelihood is monotone: a covariate separates the events")
        if np.max(np.abs(step)) < precision:
            break
    else:
        if p:
            raise ValueError(f"no convergence in {max_iter} steps")
    cuts = [0.0, *sorted(float(k) for k in knots), None]
    intervals = []
    for row in found:
        k, d = row["k"], int(row["d"])
        hazard = d / row["r"] if row["r"] else None
        intervals.append((cuts[k], cuts[k + 1], float(row["plain"]), d, hazard))
    unscale = 1 / np.array(scales)
    covariance = _solve(information, np.eye(p)) * np.outer(unscale, unscale) if p else np.zeros((0, 0))
    return PiecewiseModel(covariates, beta * unscale, covariance, np.array(means), intervals, value, alpha)


def piecewise_summary(spark: SparkSession, model: PiecewiseModel) -> DataFrame:
    """One row per covariate: coef, hazard ratio, standard error, interval, z, p, -log2 p."""
    rows = coefficient_rows(model.covariates, model.coef, np.sqrt(np.diag(model.covariance)), model.alpha)
    return spark.createDataFrame(rows, COEFFICIENT_SCHEMA)


def piecewise_hazards(spark: SparkSession, model: PiecewiseModel) -> DataFrame:
    """(lower, upper, exposure, events, hazard) of each interval, the hazard at the means of the covariates."""
    return spark.createDataFrame(model.intervals, "lower double, upper double, exposure double, events long, hazard double")
