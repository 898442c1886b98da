"""Running totals over an ordered column without an unbounded single-task window.

A window ordered by time and partitioned only by a group key sends the whole
group to one task. The tables here are first collapsed to distinct values and
materialised, so their size is known. Up to `ROWS_PER_SLICE` rows a plain
window is the best plan. Beyond that the ordered column is cut at approximate
quantiles into slices: totals run inside (group, slice), the slice totals run
in a second, tiny window, and the two are added. The cuts are literals, so a
retried task lands every row in the same slice.

Input must already be collapsed: one row per (keys, order).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

SLICE = "_slice"
ROWS_PER_SLICE = 250_000


def present(df: DataFrame, *columns: str) -> Column:
    """True where none of the columns is missing: neither NULL nor, in a floating-point column, NaN."""
    held = F.lit(True)
    for c in columns:
        held = held & F.col(f"`{c}`").isNotNull()
        if df.schema[c].dataType.typeName() in ("float", "double"):
            held = held & ~F.isnan(f"`{c}`")
    return held


def _position(df: DataFrame, column: str) -> Column:
    """Number by which a column of numbers, dates or timestamps sorts; NULL is before all, NaN after all."""
    kind, x = df.schema[column].dataType.typeName(), F.col(f"`{column}`")
    if kind == "date":
        x = F.unix_date(x)
    elif kind.startswith("timestamp"):
        x = F.unix_micros(x.cast("timestamp"))
    return F.coalesce(x.cast("double"), F.lit(float("-inf")))


def sliced(df: DataFrame, order: str, rows_per_slice: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Add a slice number along `order` if the table is too long for one window.

    `df` must be materialised (see `pin`): it is counted, and read again for
    the cuts only when it is long. Rows without a value along `order` take the
    place that sorting gives them, however many slices there are. With `keys`, by which the
    windows will go, a long table is left whole if none of its groups is too long.
    """
    most = rows_per_slice or ROWS_PER_SLICE
    slices = -(-df.count() // most)
    if slices <= 1:
        return df
    if keys and df.groupBy(*keys).count().agg(F.max("count")).first()[0] <= most:
        return df
    shares = [i / slices for i in range(1, slices)]
    df = df.withColumn("_order", _position(df, order))
    cuts = sorted({c for c in df.approxQuantile("_order", shares, 0.1 / slices) if math.isfinite(c)})
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol="_order", outputCol=SLICE, handleInvalid="keep").transform(df).drop("_order")


def running_totals(
    df: DataFrame,
    order: str,
    totals: Mapping[str, str | Column],
    keys: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running totals `{new column: summed column}` to a `sliced` table."""
    sums = {name: F.col(c) if isinstance(c, str) else c for name, c in totals.items()}
    by = F.col(order).desc() if descending else F.col(order).asc()
    so_far = (Window.unboundedPreceding, 0)
    if SLICE not in df.columns:
        window = Window.partitionBy(*keys).orderBy(by).rowsBetween(*so_far)
        return df.withColumns({name: F.sum(c).over(window) for name, c in sums.items()})

    slice_by = F.col(SLICE).desc() if descending else F.col(SLICE).asc()
    inside = Window.partitionBy(*keys, SLICE).orderBy(by).rowsBetween(*so_far)
    before = Window.partitionBy(*keys).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    lead_in = (
        df.groupBy(*keys, SLICE)
        .agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
        .select(
            *keys,
            SLICE,
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        )
    )
    local = df.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    joined = lookup_join(local, lead_in, [*keys, SLICE])
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop(
        *[f"_before_{n}" for n in sums]
    )


def carried(df: DataFrame, order: str, columns: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Add `{new column: column}`: the last value that is not NULL at or before a row of a `sliced` table with one
    row per (keys, order)."""
    before = (Window.unboundedPreceding, 0)
    if SLICE not in df.columns:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)
        return df.withColumns({name: F.last(c, ignorenulls=True).over(window) for name, c in columns.items()})
    inside = Window.partitionBy(*keys, SLICE).orderBy(order).rowsBetween(*before)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, SLICE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{name}") for name, c in columns.items()]
    )
    lead_in = ends.select(
        *keys, SLICE, *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_before_{n}") for n in columns]
    )
    local = df.withColumns({name: F.last(c, ignorenulls=True).over(inside) for name, c in columns.items()})
    joined = lookup_join(local, lead_in, [*keys, SLICE])
    return joined.withColumns({n: F.coalesce(n, f"_before_{n}") for n in columns}).drop(*[f"_before_{n}" for n in columns])


def following(df: DataFrame, order: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add `name`: the place along `order` of the next row of a `sliced` table with one row per (keys, order)."""
    if SLICE not in df.columns:
        return df.withColumn(name, F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))
    later = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    starts = df.groupBy(*keys, SLICE).agg(F.min(order).alias("_start"))
    starts = starts.select(*keys, SLICE, F.min("_start").over(later).alias("_later"))
    local = df.withColumn(name, F.lead(order).over(Window.partitionBy(*keys, SLICE).orderBy(order)))
    return lookup_join(local, starts, [*keys, SLICE]).withColumn(name, F.coalesce(name, "_later")).drop("_later")


def lookup_join(left: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a long table with a table of one row per key.

    Adaptive execution sends the lookup table to every task if its bytes allow it;
    otherwise both are shuffled, and partitions of a hot key are split.
    """
    return same_keys_join(left, table, keys, how)


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; `right` contributes its other columns."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matches = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, matches, how).drop(*[f"_right_{k}" for k in keys])
