"""Profiles that grow with the data: one scan of a new partition gives a row of mergeable sketches per column.

The rows are kept as a table; a profile of all partitions, or of any of them, merges their rows and never reads
the data again. Counts, moments and extremes are exact. Estimated are the number of different values (standard error
1.04 / 2^(bits / 2): 0.8 % at 14 bits), quantiles (the rank is off by about 0.7 % at k = 400) and frequent values (exact while
a column has at most `tracked` different ones; beyond, a count is off by at most 3.5 / `tracked` of the rows). The exact
sections of `profile.Profile` stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapse.operators.profile import Profile, _finite, _quoted
from lapse.operators.running import lookup_join

QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
# A longer text is told apart by its digest, so a sketch stays small whatever the texts are.
LONGEST = 200


def sketch(df: DataFrame, by: Sequence[str] = (), distinct_bits: int = 14, rank_k: int = 400, tracked: int = 4096) -> DataFrame:
    """(*by, column, kind, rows, count, infinite, mean, m2, min, max, ranks, values, frequent) for every column of
    numbers or text but those in `by`, in one scan and one aggregate.

    Only finite numbers count, NULL and NaN are missing. No rows: no sketches with `by`, empty ones without.
    """
    found = Profile(df, drop=list(by))
    cells = []
    for column in [*found.numeric, *found.categorical]:
        number = column in found.numeric
        x = _finite(column) if number else "CAST(NULL AS DOUBLE)"
        text = f"CAST({x if number else _quoted(column)} AS STRING)"
        item = text if number else f"if(length({text}) <= {LONGEST}, {text}, concat('sha256:', sha2({text}, 256)))"
        measures = {
            "rows": "count(1)",
            "count": f"count({x if number else text})",
            "infinite": f"count_if(abs(double({_quoted(column)})) = double('infinity'))" if number else "CAST(0 AS BIGINT)",
            "mean": f"avg({x})",
            "m2": f"var_pop({x}) * count({x})",
            "min": f"min({x})",
            "max": f"max({x})",
            "ranks": f"kll_sketch_agg_double({x}, {rank_k})",
            "values": f"hll_sketch_agg({text}, {distinct_bits})",
            "frequent": f"approx_top_k_accumulate({item}, {tracked}) FILTER (WHERE {text} IS NOT NULL)",
        }
        cells.append(F.struct(
            F.lit(column).alias("column"), F.lit("number" if number else "text").alias("kind"),
            *[F.expr(e).alias(name) for name, e in measures.items()],
        ).alias(f"_{len(cells)}"))
    if not cells:
        raise ValueError("no column of numbers or text to sketch")
    wide = df.groupBy(*by).agg(*cells)
    return wide.select(*by, F.inline(F.array(*[f"_{i}" for i in range(len(cells))])))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of the union of the rows, per value of `by`; the sizes must be those of one call of `sketch`."""
    keys = [*by, "column", "kind"]
    whole = sketches.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.sum("infinite").alias("infinite"),
        F.expr("sum(mean * count) / sum(if(mean IS NULL, 0, count))").alias("mean"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.expr("kll_merge_agg_double(ranks) AS ranks"), F.expr("hll_union_agg(values) AS values"),
        F.expr("approx_top_k_combine(frequent) AS frequent"),
    )
    # squared distances from the mean of all, so a large mean costs no digits
    centres = whole.select(*keys, F.col("mean").alias("_centre"))
    spread = lookup_join(sketches, centres, keys).groupBy(*keys).agg(
        F.expr("sum(m2 + count * (mean - _centre) * (mean - _centre))").alias("m2")
    )
    ordered = [*keys, "rows", "count", "infinite", "mean", "m2", "min", "max", "ranks", "values", "frequent"]
    return lookup_join(whole, spread, keys).select(*ordered)


def report(sketches: DataFrame, by: Sequence[str] = (), top: int = 10) -> DataFrame:
    """What merged sketches say, one row per column: exact counts, moments and extremes; estimated distinct values,
    quantiles and the `top` frequent values with their counts (more frequent first, then by value)."""
    points = ", ".join(f"{p}D" for p in QUANTILES.values())
    read = sketches.withColumns({
        "_q": F.expr(f"if(kind = 'number' AND count > 0, kll_sketch_get_quantile_double(ranks, array({points})), NULL)"),
        "_top": F.expr(f"transform(approx_top_k_estimate(frequent, {top}), c -> struct(-c.count AS n, c.item AS value))"),
    })
    return read.select(
        *by, "column", "kind", "rows", "count", (F.col("rows") - F.col("count")).alias("missing"), "infinite",
        F.expr("hll_sketch_estimate(values)").alias("distinct"), "mean",
        F.expr("if(count > 1, sqrt(m2 / (count - 1)), NULL)").alias("std"), "min", "max",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILES)],
        F.expr("transform(array_sort(_top), c -> struct(c.value AS value, -c.n AS count))").alias("frequent"),
    )
