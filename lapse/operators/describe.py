"""Descriptive tables: exact quantiles, grouped summaries, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapse.operators.running import ROWS_PER_SLICE, SLICE, lookup_join, same_keys_join, sliced
from lapse.sources.session import pin

#: Distinct (key, value) rows up to which the built-in percentile is used; the answer is the same.
ONE_PASS_ROWS = 1_000_000


def quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    weight: str | None = None,
    rows_per_slice: int = 0,
    interpolate: bool = True,
    rows: int | None = None,
    one_pass_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per key as columns q0, q1, ..., linear between neighbouring
    ranks or, without interpolation, the value at the lower rank.

    Values are collapsed to (key, value, count). Up to `ONE_PASS_ROWS` of them
    are handed to the built-in exact percentile; more are cut into slices along
    the value. Slice counts tell which slices hold the wanted ranks; only those are
    sorted, each in its own task, so neither a long column nor a hot key is
    ever sorted as a whole. `weight` names the count column of an input that is
    already collapsed, and materialised or cheap to derive: it is read a few times.
    `rows` is its length, if known; `one_pass_rows` replaces `ONE_PASS_ROWS`.
    """
    x = F.col(column).cast("double")
    present = df.where(x.isNotNull() & ~F.isnan(x)).select(
        *keys, x.alias("_x"), F.lit(1).alias("_n") if weight is None else F.col(weight).alias("_n")
    )
    if weight is None:
        present = pin(present.groupBy(*keys, "_x").agg(F.sum("_n").alias("_n")))
    if rows is None:
        rows = present.count()
    if interpolate and not rows_per_slice and rows <= (ONE_PASS_ROWS if one_pass_rows is None else one_pass_rows):
        shares = ", ".join(f"{float(p)!r}D" for p in probabilities)
        found = present.groupBy(*keys).agg(F.expr(f"percentile(_x, array({shares}), _n)").alias("_q"))
        return found.select(*keys, *[F.col("_q")[i].alias(f"q{i}") for i in range(len(probabilities))])

    # shorter slices than a running total needs: most of them are never sorted
    placed = sliced(present, "_x", rows_per_slice or ROWS_PER_SLICE // 8)
    if SLICE not in placed.columns:
        placed = placed.withColumn(SLICE, F.lit(0.0))

    whole = Window.partitionBy(*keys)
    lower = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    slices = placed.groupBy(*keys, SLICE).agg(F.sum("_n").alias("_in")).select(
        *keys,
        SLICE,
        (F.sum("_in").over(lower) - F.col("_in")).alias("_before"),
        F.sum("_in").over(lower).alias("_through"),
        F.sum("_in").over(whole).alias("_size"),
    )
    positions = [f"((_size - 1) * {float(p)!r}D)" for p in probabilities]
    ranks = [f"floor({at})" for at in positions] + [f"ceil({at})" for at in positions if interpolate]
    wanted = " OR ".join(f"(_before <= {rank} AND {rank} < _through)" for rank in ranks)
    rows = lookup_join(placed, slices.where(wanted), [*keys, SLICE])
    inside = Window.partitionBy(*keys, SLICE).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def value_at(rank: str) -> Column:
        # ranks count from 0: the value whose run (upto - n, upto] covers it
        return F.expr(f"max(CASE WHEN _upto - _n <= {rank} AND {rank} < _upto THEN _x END)")

    picks = []
    for i, at in enumerate(positions):
        picks.append(value_at(f"floor({at})").alias(f"_lo{i}" if interpolate else f"q{i}"))
        if interpolate:
            picks += [value_at(f"ceil({at})").alias(f"_hi{i}"), F.expr(f"max({at} - floor({at}))").alias(f"_part{i}")]
    found = ranked.groupBy(*keys).agg(*picks)
    if not interpolate:
        return found
    return found.select(
        *keys,
        *[
            F.expr(f"_lo{i} + (_hi{i} - _lo{i}) * _part{i}").alias(f"q{i}")
            for i in range(len(probabilities))
        ],
    )


def describe(df: DataFrame, column: str, keys: Sequence[str] = (), rows_per_slice: int = 0) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per key."""
    basics = df.groupBy(*keys).agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quarters = quantiles(df, column, (0.25, 0.5, 0.75), keys, rows_per_slice=rows_per_slice)
    if keys:
        joined = same_keys_join(basics, quarters, keys)
    else:
        joined = basics.withColumn("_q", quarters.select(F.struct("q0", "q1", "q2")).scalar())
        joined = joined.withColumns({q: F.col(f"_q.{q}") for q in ("q0", "q1", "q2")})
    return joined.select(
        *keys, "count", "mean", "std", "min",
        F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max",
    )


def nice_step(low: Column, high: Column, at_most: int = 10) -> Column:
    """Smallest 1, 2 or 5 times a power of ten whose grid (bins start at its multiples) covers
    the span in `at_most` bins."""
    span = high - low
    power = F.pow(F.lit(10.0), F.floor(F.log10(span / at_most)))
    step = F.lit(20.0) * power
    for multiple in (10.0, 5.0, 2.0, 1.0):
        tried = F.lit(multiple) * power
        fits = bin_number(high, tried) - bin_number(low, tried) < at_most
        step = F.when(fits, tried).otherwise(step)
    return F.when(span > 0, step).otherwise(1.0)


def bin_number(x: Column, step: Column) -> Column:
    """Multiple of `step` at or below x; a quotient that is whole but for rounding counts as whole."""
    return F.floor(x / step + F.lit(1e-9)).cast("long")


def histogram(
    df: DataFrame, column: str, keys: Sequence[str] = (), at_most: int = 10, weight: str | None = None
) -> DataFrame:
    """Bin counts on a readable grid: keys, bin_start, bin_end, count (empty bins omitted). Missing
    and infinite values are left out."""
    x = F.col(column).cast("double")
    present = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    bounds = present.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    bounds = bounds.select(*keys, "_low", nice_step(F.col("_low"), F.col("_high"), at_most).alias("_step"))
    if keys:
        placed = lookup_join(present, bounds, keys)
    else:
        packed = bounds.select(F.struct("_low", "_step")).scalar()
        placed = present.withColumn("_grid", packed).withColumns(
            {"_low": F.col("_grid._low"), "_step": F.col("_grid._step")}
        )
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        placed.groupBy(*keys, bin_number(x, F.col("_step")).alias("_bin"), "_step")
        .agg(count.alias("count"))
        .select(
            *keys,
            (F.col("_bin") * F.col("_step")).alias("bin_start"),
            ((F.col("_bin") + 1) * F.col("_step")).alias("bin_end"),
            "count",
        )
    )
