"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.sources.session import pin


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (long columns `a`, `b`): the least node it reaches.

    Large-star and small-star steps alternate: each hangs neighbours on the least
    node around them and keeps connectivity, so the edges turn into one star per
    component in about log(diameter) rounds. Every round is one written table; the
    minima are pre-aggregated before they are shuffled. No edges: no rows.
    """
    edges = pin(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while state != (state := _state(edges)):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pin(large.where("a <> b").distinct())
        down = _least(large)
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = pin(small.union(down.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


def _least(edges: DataFrame) -> DataFrame:
    """The least of a node and its neighbours."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())
