"""Kaplan-Meier estimation on the table of distinct times.

Input contract: one row per subject with a duration (>= 0) and an event flag
(1 = churned, 0 = censored). Rows are collapsed to distinct times by one
aggregation with map-side combine, and that small table is materialised;
everything after that runs on it. Rows with a NULL duration or event carry no information and
are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapse.functions.tails import normal_quantile
from lapse.operators.running import SLICE, carried, present, running_totals, same_keys_join, sliced
from lapse.sources.session import pin


def _collapsed(df: DataFrame, duration: str, event: str, groups: Sequence[str]) -> DataFrame:
    return (
        df.where(present(df, duration, event))
        .groupBy(*groups, F.col(duration).alias("t"))
        .agg(F.sum(F.col(event).cast("long")).alias("observed"), F.count(F.lit(1)).alias("removed"))
    )


def _event_table(df, duration, event, groups, rows_per_slice) -> DataFrame:
    times = sliced(pin(_collapsed(df, duration, event, groups)), "t", rows_per_slice)
    return running_totals(times, "t", {"at_risk": "removed"}, groups, descending=True)


def event_table(
    df: DataFrame, duration: str, event: str, groups: Sequence[str] = (), rows_per_slice: int = 0
) -> DataFrame:
    """Per distinct time: removed, observed, censored and at risk."""
    return _event_table(df, duration, event, groups, rows_per_slice).select(
        *groups,
        "t",
        "removed",
        "observed",
        (F.col("removed") - F.col("observed")).alias("censored"),
        "at_risk",
    )


def km_curve(
    df: DataFrame,
    duration: str,
    event: str,
    groups: Sequence[str] = (),
    alpha: float = 0.05,
    rows_per_slice: int = 0,
) -> DataFrame:
    """Survival curve with Greenwood variance and log-log confidence band.

    Columns: groups, t, at_risk, observed, censored, survival, lower, upper.
    Each curve starts with (0, 1.0) unless a subject left at time 0.
    """
    table = _event_table(df, duration, event, groups, rows_per_slice)
    d, n = F.col("observed"), F.col("at_risk")
    last_death = d == n
    steps = table.withColumns(
        {
            "_ln": F.when(last_death, 0.0).otherwise(F.log1p(-d / n)),
            "_var": F.when(last_death, 0.0).otherwise(d / (n * (n - d).cast("double"))),
        }
    )
    steps = running_totals(
        steps, "t", {"_cum_ln": "_ln", "_greenwood": "_var", "_seen": "removed"}, groups
    )
    curve = steps.select(
        *groups,
        "t",
        "at_risk",
        "observed",
        (F.col("removed") - F.col("observed")).alias("censored"),
        F.when(last_death, 0.0).otherwise(F.exp("_cum_ln")).alias("survival"),
        "_greenwood",
        (F.col("_seen") == F.col("removed")).alias("_is_first"),
    )
    curve = _with_origin(curve, groups)
    band = F.lit(normal_quantile(1 - alpha / 2)) * F.sqrt("_greenwood")
    return curve.withColumns(
        {"lower": _log_log_band(band, 1.0), "upper": _log_log_band(band, -1.0)}
    ).drop("_greenwood")


def _with_origin(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Prepend S(0) = 1 to every curve that has no row at time 0 (its first row emits it)."""
    columns = ["t", "at_risk", "observed", "censored", "survival", "_greenwood"]
    origin = F.struct(
        F.lit(0).cast(curve.schema["t"].dataType).alias("t"),
        F.col("at_risk"),
        F.lit(0).cast("long").alias("observed"),
        F.lit(0).cast("long").alias("censored"),
        F.lit(1.0).alias("survival"),
        F.lit(0.0).alias("_greenwood"),
    )
    opens = F.col("_is_first") & (F.col("t") > 0)
    rows = F.when(opens, F.array(origin, F.struct(*columns))).otherwise(F.array(F.struct(*columns)))
    return curve.select(*groups, F.inline(rows))


def _log_log_band(half_width: Column, sign: float) -> Column:
    s = F.col("survival")
    return (
        F.when(s >= 1.0, 1.0)
        .when(s <= 0.0, 0.0)
        .otherwise(F.exp(-F.exp(F.log(-F.log(s)) - F.lit(sign) * half_width / F.log(s))))
    )


def km_quantile(curve: DataFrame, groups: Sequence[str] = (), p: float = 0.5) -> DataFrame:
    """Smallest time at which survival is at most `p` (p = 0.5: the median), with the
    same rule applied to both bands. NULL means the curve never gets there."""
    def reached(column: str) -> Column:
        return F.min(F.when(F.col(column) <= p, F.col("t")))

    return curve.groupBy(*groups).agg(
        reached("survival").alias("median" if p == 0.5 else "quantile"),
        reached("lower").alias("earliest"),
        reached("upper").alias("latest"),
    )


def at_times(
    curve: DataFrame,
    times: Sequence[float],
    values: dict[str, float],
    keys: Sequence[str] = (),
    t: str = "t",
) -> DataFrame:
    """Step-function lookup: value of a curve at the given times.

    `values` maps each value column to what holds before the first step. Every
    step is handed to the first requested time at or after it, the latest step
    per requested time is kept, and gaps carry the previous value forward. The
    windows see at most `len(times)` rows per key.
    """
    wanted = sorted(set(times))
    asked = F.array(*[F.lit(float(x)) for x in wanted])
    slot = F.array_min(F.filter(asked, lambda x: x >= F.col(t)))
    latest = (
        curve.withColumn("_slot", slot)
        .where(F.col("_slot").isNotNull())
        .groupBy(*keys, "_slot")
        .agg(F.max_by(F.struct(*values), t).alias("_v"))
    )
    grid = curve.select(*keys).distinct() if keys else curve.sparkSession.range(1).select()
    grid = grid.select(*keys, F.explode(asked).alias("_slot"))
    carried = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    found = same_keys_join(grid, latest, [*keys, "_slot"], "left")
    return found.select(
        *keys,
        F.col("_slot").alias("time"),
        *[
            F.coalesce(F.last(f"_v.{name}", ignorenulls=True).over(carried), F.lit(start)).alias(name)
            for name, start in values.items()
        ],
    )


def at_rows(
    rows: DataFrame,
    time: str,
    curve: DataFrame,
    values: dict[str, float],
    keys: Sequence[str] = (),
    t: str = "t",
    rows_per_slice: int = 0,
) -> DataFrame:
    """`rows` with the value of a curve at each row's own `time` (a clashing column is replaced).

    `values` maps each value column to what holds before the first step. The distinct (keys, time) of the rows
    and the steps of the curve are put on one axis, and the last step is carried along it by slices, so neither a
    long curve nor a group with most of the rows is one task. A row whose time is missing, or whose keys no
    curve has, gets NULL.
    """
    rows = rows.drop(*values)
    kind = rows.schema[time].dataType.simpleString()
    asked = rows.where(present(rows, time)).select(*keys, F.col(time).cast("double").alias("_t"), F.lit(True).alias("_asked"))
    steps = curve.select(*keys, F.col(t).cast("double").alias("_t"), F.struct(*values).alias("_v"))
    both = asked.unionByName(steps, allowMissingColumns=True).groupBy(*keys, "_t")
    axis = sliced(pin(both.agg(F.max("_asked").alias("_asked"), F.first("_v", ignorenulls=True).alias("_v"))), "_t", rows_per_slice)
    found = carried(axis, "_t", {"_held": "_v"}, keys).where("_asked").drop(SLICE, "_asked", "_v")
    known = curve.select(*keys).distinct().withColumn("_known", F.lit(True))
    found = same_keys_join(found, known, keys) if keys else found.withColumn("_known", F.lit(True))
    found = found.select(*keys, F.col("_t").cast(kind).alias(time), *[
        F.coalesce(F.col(f"_held.{name}"), F.lit(start)).alias(name) for name, start in values.items()
    ])
    return same_keys_join(rows, found, [*keys, time], "left")


def _inside(curve: DataFrame) -> DataFrame:
    """Steps where both ln t and the transforms of S are finite."""
    return curve.where((F.col("t") > 0) & (F.col("survival") > 0) & (F.col("survival") < 1))


def km_log_log(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ln(-ln S) against ln t: parallel lines support proportional hazards."""
    return _inside(curve).select(
        *groups,
        "t",
        F.log("t").alias("log_time"),
        F.log(-F.log("survival")).alias("log_log_survival"),
    )


def km_log_odds(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Failure odds against ln t: straight lines support a log-logistic model.

    `failure_odds_ref` is ln(1 - S) / S, `log_odds` is ln((1 - S) / S).
    """
    s = F.col("survival")
    return _inside(curve).select(
        *groups,
        "t",
        F.log("t").alias("log_time"),
        (F.log(1 - s) / s).alias("failure_odds_ref"),
        F.log((1 - s) / s).alias("log_odds"),
    )
