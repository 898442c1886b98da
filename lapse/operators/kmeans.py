"""One-dimensional k-means on value counts.

Several measures and several k are fitted together: each Lloyd step is one
aggregation over the collapsed (measure, value, count) table, and only the
centroids (sum of all k doubles) travel to the driver.

The result is defined by the procedure: start at the (2i+1)/2k quantiles,
duplicates removed; a value on a midpoint belongs to the lower cluster; an
empty cluster keeps its centroid; stop when the squared centroid shift is at
most `tol` times the variance of the measure, or, with a warning, after `max_iter` steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from lapse.functions.scalars import text_literal
from lapse.operators.describe import quantiles
from lapse.sources.session import pin

Centroids = dict[tuple[str, int], list[float]]


def value_counts(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(measure, x, n): how often each value of each measure occurs."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])
    return (
        df.select(F.inline(cells))
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
        .groupBy("measure", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_kmeans(
    counts: DataFrame, ks: Sequence[int], max_iter: int = 300, tol: float = 1e-4
) -> Centroids:
    """Centroids per (measure, k) for a `value_counts` table that is cheap to reread."""
    spread = _variances(counts)
    centroids = _seeds(counts, ks)
    moving = dict(centroids)
    held = counts.persist()
    try:
        for _ in range(max_iter):
            if not moving:
                break
            moved = _lloyd_step(held, moving)
            shifts = {key: sum((a - b) ** 2 for a, b in zip(moving[key], moved[key])) for key in moved}
            centroids.update(moved)
            moving = {key: moved[key] for key in moved if shifts[key] > tol * spread[key[0]]}
    finally:
        held.unpersist()
    if moving:
        warnings.warn(f"{len(moving)} of {len(centroids)} fits still moved after {max_iter} steps", stacklevel=2)
    return centroids


def _variances(counts: DataFrame) -> dict[str, float]:
    """Population variance per measure, about the mean: a large mean costs no digits."""
    means = counts.groupBy("measure").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    means = {row["measure"]: row["mean"] for row in means.collect()}
    if not means:
        return {}
    about = ", ".join(f"{text_literal(m)}, {mean!r}D" for m, mean in means.items())
    gaps = counts.selectExpr("measure", "n", f"x - map({about})[measure] AS gap").groupBy("measure")
    rows = gaps.agg((F.sum(F.col("gap") * F.col("gap") * F.col("n")) / F.sum("n")).alias("v")).collect()
    return {row["measure"]: row["v"] for row in rows}


def _seeds(counts: DataFrame, ks: Sequence[int]) -> Centroids:
    shares = sorted({(2 * i + 1) / (2 * k) for k in ks for i in range(k)})
    rows = quantiles(counts, "x", shares, ["measure"], weight="n", interpolate=False).collect()
    return {
        (row["measure"], k): sorted({row[f"q{shares.index((2 * i + 1) / (2 * k))}"] for i in range(k)})
        for row in rows
        for k in ks
    }


def midpoints(centers: Sequence[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centers, centers[1:])]


def _assigned(counts: DataFrame, centroids: Centroids) -> DataFrame:
    """Every value once per fit of its measure: measure, x, n, k, centers, cluster.

    The fits (at most measures x values of k) travel as one literal, so a step
    needs neither a join nor new generated code.
    """
    fits: dict[str, list[str]] = {}
    for (measure, k), c in centroids.items():
        fits.setdefault(measure, []).append(
            f"named_struct('k', {k}, 'centers', {_doubles(c)}, 'cuts', {_doubles(midpoints(c))})"
        )
    by_measure = ", ".join(f"{text_literal(measure)}, array({', '.join(own)})" for measure, own in fits.items())
    return counts.selectExpr("measure", "x", "n", f"inline(map({by_measure})[measure])").selectExpr(
        "*", "size(filter(cuts, cut -> cut < x)) AS cluster"
    )


def _lloyd_step(counts: DataFrame, centroids: Centroids) -> Centroids:
    """All fits of a measure cut one line: values are summed once per interval between neighbouring
    cuts of any fit, and each fit adds up its own intervals."""
    cuts: dict[str, list[float]] = {}
    for (measure, _), c in centroids.items():
        cuts[measure] = sorted({*cuts.get(measure, []), *midpoints(c)})
    lines = ", ".join(f"{text_literal(measure)}, {_doubles(own)}" for measure, own in cuts.items())
    sums = (
        counts.selectExpr("measure", "x", "n", f"map({lines})[measure] AS cuts")
        .where("cuts IS NOT NULL")
        .selectExpr("measure", "size(filter(cuts, cut -> cut < x)) AS interval", "n", "x * n AS total")
        .groupBy("measure", "interval")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .collect()
    )
    moved = {}
    for (measure, k), c in centroids.items():
        own, held = midpoints(c), {}
        for row in sums:
            if row["measure"] == measure:
                # values of interval i lie above cut i - 1
                below = cuts[measure][row["interval"] - 1] if row["interval"] else float("-inf")
                n, total = held.get(at := sum(cut <= below for cut in own), (0, 0.0))
                held[at] = n + row["n"], total + row["total"]
        moved[measure, k] = [held[i][1] / held[i][0] if i in held else old for i, old in enumerate(c)]
    return moved


def _doubles(values: Sequence[float]) -> str:
    return "cast(array(" + ", ".join(f"{v!r}D" for v in values) + ") as array<double>)"


def inertia(counts: DataFrame, centroids: Centroids) -> DataFrame:
    """Sum of squared distances to the own centroid: measure, k, inertia."""
    gap = F.col("x") - F.element_at("centers", F.col("cluster") + 1)
    return (
        _assigned(counts, centroids)
        .groupBy("measure", "k")
        .agg(F.sum(gap * gap * F.col("n")).alias("inertia"))
    )


def elbow(
    df: DataFrame, measures: Sequence[str], ks: Sequence[int] = range(1, 10), max_iter: int = 1000
) -> DataFrame:
    """Inertia for each measure and each k, all fitted side by side."""
    counts = pin(value_counts(df, measures))
    return inertia(counts, fit_kmeans(counts, ks, max_iter))


def occupied(counts: DataFrame, centroids: Centroids) -> dict[str, list[float]]:
    """Centroids of the clusters that hold at least one value, per measure."""
    used = _assigned(counts, centroids).select("measure", "k", "cluster").distinct()
    kept: dict[str, list[float]] = {}
    for row in sorted(used.collect()):
        kept.setdefault(row["measure"], []).append(centroids[row["measure"], row["k"]][row["cluster"]])
    return kept


def with_clusters(
    df: DataFrame, centers: Mapping[str, Sequence[float]], descending: Sequence[str] = ()
) -> DataFrame:
    """Add `<measure>Cluster`, numbered from 0 along the centroids; NULL stays NULL."""
    def cluster(measure: str):
        # a measure with one cluster is all zeros, but NULL where the measure is
        name = "`" + measure.replace("`", "``") + "`"
        above = [f"int({name} > {cut!r}D)" for cut in midpoints(centers[measure])]
        number = " + ".join(above or [f"int({name} <> {name})"])
        return F.expr(f"{len(above)} - ({number})" if measure in descending else number)

    return df.withColumns({f"{m}Cluster": cluster(m) for m in centers})


def kmeans_library(df: DataFrame, measure: str, k: int = 4, seed: int = 1, max_iter: int = 300) -> DataFrame:
    """The same clustering by the built-in learner (k-means||, weighted by count).

    Returns one row per cluster; starting points are random, so it can stop at
    another local optimum than `fit_kmeans`.
    """
    counts = value_counts(df, [measure])
    points = VectorAssembler(inputCols=["x"], outputCol="features").transform(counts)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, weightCol="n").fit(points)
    return (
        model.transform(points)
        .groupBy(F.col("prediction").alias("cluster"))
        .agg(F.sum("n").alias("customers"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
