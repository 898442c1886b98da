"""Pairwise log-rank tests for any number of covariates in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapse.functions.tails import chi2_tail_1df
from lapse.operators.running import ROWS_PER_SLICE, SLICE, present, running_totals, same_keys_join, sliced
from lapse.sources.session import pin


def logrank(
    df: DataFrame,
    duration: str,
    event: str,
    variables: Sequence[str],
    rows_per_slice: int = 0,
    most_levels: int = 500,
) -> DataFrame:
    """For every variable and every pair of its levels (level_a < level_b): test
    statistic (1 degree of freedom), p and -log2 p; NULL for a pair in which nobody died.

    All variables are unpivoted to (variable, level) and collapsed to distinct
    times before the shuffle, so the sweep over many covariates is one job. The
    levels of a variable are held in one row, so a variable with more than
    `most_levels` of them (an identifier, say) is refused.
    """
    counts = _collapsed(df, duration, event, variables, rows_per_slice)
    held = counts.groupBy("variable").agg(F.count_distinct("level").alias("n")).collect()
    for row in held:
        if row["n"] > most_levels:
            raise ValueError(f"{row['variable']} has {row['n']} levels, more than {most_levels}")
    # one row per variable, of at most `most_levels` levels
    levels = counts.groupBy("variable").agg(F.sort_array(F.collect_set("level")).alias("levels"))
    result = _every_pair(levels, _pair_statistic(_at_risk_grid(counts, levels)))
    result = result.withColumn("p", chi2_tail_1df(F.col("statistic")))
    return result.withColumn("neg_log2_p", -F.log2("p"))


def _collapsed(df, duration, event, variables, rows_per_slice) -> DataFrame:
    """(variable, level, t): deaths and subjects that leave; rows without a duration or event are left out."""
    arms = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("level")) for v in variables]
    )
    counts = (
        df.where(present(df, duration, event))
        .select(F.col(duration).alias("t"), F.col(event).cast("long").alias("e"), F.inline(arms))
        .where(F.col("level").isNotNull())
        .groupBy("variable", "level", "t")
        .agg(F.sum("e").alias("d"), F.count(F.lit(1)).alias("removed"))
    )
    # the grid is longer than the counts, so the slices are cut finer
    return sliced(pin(counts), "t", rows_per_slice or ROWS_PER_SLICE // 8)


def _at_risk_grid(counts: DataFrame, levels: DataFrame) -> DataFrame:
    """(variable, level, t) for all levels at every time any level loses someone."""
    own_slice = [SLICE] if SLICE in counts.columns else []
    per_time = (
        counts.groupBy("variable", "t", *own_slice)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("level", F.struct("d", "removed")))).alias("seen"),
            F.sum("d").alias("d_any"),
        )
        .join(F.broadcast(levels), "variable")
        .select("variable", "t", *own_slice, "d_any", "seen", F.explode("levels").alias("level"))
    )
    here = F.col("seen")[F.col("level")]
    grid = per_time.select(
        "variable",
        "level",
        "t",
        *own_slice,
        "d_any",
        F.coalesce(here["d"], F.lit(0)).alias("d"),
        F.coalesce(here["removed"], F.lit(0)).alias("removed"),
    )
    return running_totals(grid, "t", {"n": "removed"}, ["variable", "level"], descending=True)


def _every_pair(levels: DataFrame, tests: DataFrame) -> DataFrame:
    """Every pair of levels, with its test if there is one."""
    firsts = levels.select("variable", "levels", F.posexplode("levels").alias("_i", "level_a"))
    later = F.slice("levels", F.col("_i") + 2, F.size("levels"))
    pairs = firsts.select("variable", "level_a", F.explode(later).alias("level_b"))
    return same_keys_join(pairs, tests, ["variable", "level_a", "level_b"], "left")


def _pair_statistic(grid: DataFrame) -> DataFrame:
    """Sum observed minus expected, and its variance, over times for each pair of levels.

    The levels present at one time sit in one short array; pairs are read off
    it row by row and pre-aggregated before they are shuffled.
    """
    at_time = (
        grid.where(F.col("d_any") > 0)
        .groupBy("variable", "t")
        .agg(F.sort_array(F.collect_list(F.struct("level", "d", "n"))).alias("arms"))
    )
    firsts = at_time.select("variable", "arms", F.posexplode("arms").alias("i", "a"))
    pairs = firsts.select(
        "variable", "a", F.explode(F.slice("arms", F.col("i") + 2, F.size("arms"))).alias("b")
    )
    d, n = F.col("a.d") + F.col("b.d"), (F.col("a.n") + F.col("b.n")).cast("double")
    na, nb = F.col("a.n"), F.col("b.n")
    spread = F.when(n > 1, na * nb * d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    return (
        pairs.where((d > 0) & (n > 0))
        .groupBy("variable", F.col("a.level").alias("level_a"), F.col("b.level").alias("level_b"))
        .agg(F.sum(F.col("a.d") - na * d / n).alias("excess"), F.sum(spread).alias("variance"))
        .select(
            "variable",
            "level_a",
            "level_b",
            F.when(F.col("variance") > 0, F.pow("excess", 2) / F.col("variance")).otherwise(0.0).alias("statistic"),
        )
    )
