"""Harrell's concordance index without enumerating pairs.

A pair is comparable when the earlier subject had the event: later time, or
the same time but censored. It is concordant when the later subject has the
higher score. Pairs are counted from running totals over collapsed rows:
write the dense rank of the score in binary; two different ranks agree on the
leading bits down to exactly one position where the lower rank has 0 and the
higher has 1. So for each bit position, rows with the same leading bits form
one group, and "events with bit 0 now, subjects with bit 1 later" is one
running total. Work is rows x bits, spread by (bit, leading bits, time slice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lapse.operators.running import ROWS_PER_SLICE, SLICE, lookup_join, present, running_totals, sliced
from lapse.sources.session import pin


def dense_ranks(values: DataFrame, column: str, rows_per_slice: int = 0) -> tuple[DataFrame, int]:
    """Rank 0, 1, ... of each distinct value, and how many there are."""
    distinct = pin(values.select(column).distinct().withColumn("_one", F.lit(1).cast("long")))
    ranks = running_totals(sliced(distinct, column, rows_per_slice), column, {"_rank": "_one"})
    return ranks.select(column, (F.col("_rank") - 1).alias("_rank")), distinct.count()


def concordance(
    df: DataFrame, duration: str, event: str, score: str, rows_per_slice: int = 0
) -> DataFrame:
    """One row: comparable pairs, concordant, tied in score, and the index
    (concordant + tied / 2) / pairs. A high score predicts long survival."""
    weighted = df.where(present(df, duration, event, score)).groupBy(
        F.col(score).alias("score"), F.col(duration).alias("t")
    )
    rows = weighted.agg(F.sum(F.col(event).cast("long")).alias("d"), F.count(F.lit(1)).alias("n"))
    return count_pairs(pin(rows), rows_per_slice)


def count_pairs(rows: DataFrame, rows_per_slice: int = 0) -> DataFrame:
    """`concordance` for materialised (score, t, d deaths, n subjects) rows."""
    ranks, levels = dense_ranks(rows, "score", rows_per_slice)
    cells = [
        "named_struct('bit', -2, 'prefix', 0L, 'early', d, 'late', n, 'late_deaths', d)",
        "named_struct('bit', -1, 'prefix', _rank, 'early', d, 'late', n, 'late_deaths', d)",
    ]
    bits = max(levels - 1, 0).bit_length()
    for b in range(bits):
        zero = f"(shiftright(_rank, {b}) & 1L) = 0"
        cells.append(
            f"named_struct('bit', {b}, 'prefix', shiftright(_rank, {b + 1}), 'early', if({zero}, d, 0L), "
            f"'late', if({zero}, 0L, n), 'late_deaths', if({zero}, 0L, d))"
        )
    # the slices are cut before the rows multiply, for the length they will have
    placed = sliced(rows, "t", max((rows_per_slice or ROWS_PER_SLICE) // (bits + 2), 1))
    own_slice = [SLICE] if SLICE in placed.columns else []
    groups = (
        lookup_join(placed, ranks, ["score"])
        .select("t", *own_slice, F.expr(f"inline(array({', '.join(cells)}))"))
        .where("early > 0 OR late > 0")
        .groupBy("bit", "prefix", "t", *own_slice)
        .agg(F.sum("early").alias("early"), F.sum("late").alias("late"), F.sum("late_deaths").alias("late_deaths"))
    )
    totals = running_totals(groups, "t", {"since": "late"}, ["bit", "prefix"], descending=True)
    # at the same time only the censored count as later
    found = "CAST(early AS DECIMAL(38, 0)) * (since - late_deaths)"
    counts = totals.agg(
        F.expr(f"coalesce(sum({found}) FILTER (WHERE bit = -2), 0)").alias("pairs"),
        F.expr(f"coalesce(sum({found}) FILTER (WHERE bit >= 0), 0)").alias("concordant"),
        F.expr(f"coalesce(sum({found}) FILTER (WHERE bit = -1), 0)").alias("tied"),
    )
    return counts.withColumn(
        "concordance",
        F.expr("try_divide(CAST(concordant AS DOUBLE) + CAST(tied AS DOUBLE) / 2, CAST(pairs AS DOUBLE))"),
    )
