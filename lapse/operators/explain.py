"""Shapley values of a model on a small sample of rows.

The value of a coalition is the mean prediction when the coalition's features
come from the example and the others from a background row. With p features
there are 2^p coalitions: `shapley_values` takes all of them and is exact,
`kernel_shapley` takes a number that does not grow with 2^p and solves the
kernel regression. Examples, background and coalitions are bounded by arguments.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lapse.operators.prep import fill_mode, sample_n
from lapse.sources.session import pin

MOST_FEATURES = 12


def shapley_values(
    examples: DataFrame,
    background: DataFrame,
    key: str,
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    prediction: str = "prediction",
    n_examples: int = 100,
    n_background: int = 100,
    seed: int = 460409061,
    most_features: int = MOST_FEATURES,
) -> DataFrame:
    """One row per example and feature: key, feature, value, shapley.

    `predict` adds a prediction column to a frame that holds the features.
    Missing values are first filled with the mode of the background's source.
    """
    p = len(features)
    if p > most_features:
        raise ValueError(f"exact values need 2^{p} coalitions; at most {most_features} features, or kernel_shapley")
    asked = fill_mode(sample_n(examples, key, n_examples, seed), features, background).select(key, *features)
    reference = fill_mode(sample_n(background, key, n_background, seed), features, background)
    # n_background rows by construction
    drawn = reference.agg(F.collect_list(F.struct(*features))).scalar()
    crossed = (
        asked.withColumn("_drawn", drawn)
        .withColumn("_b", F.explode("_drawn"))
        .withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(2**p - 1))))
    )
    mixed = crossed.select(
        F.col(key),
        "_mask",
        F.struct(*features).alias("_x"),
        *[
            F.expr(f"if((_mask & {1 << j}) <> 0, `{c}`, _b.`{c}`)").alias(c)
            for j, c in enumerate(features)
        ],
    )
    values = predict(mixed).groupBy(key, "_x", "_mask").agg(F.avg(prediction).alias("_v"))
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"_x.{c}").cast("double").alias("value"),
            F.col(f"_s{j}").alias("shapley"),
        )
        for j, c in enumerate(features)
    ]
    totals = values.groupBy(key, "_x").agg(
        *[F.sum(F.element_at(_weights(j, p), F.col("_mask") + 1) * F.col("_v")).alias(f"_s{j}") for j in range(p)]
    )
    return totals.select(key, F.inline(F.array(*cells)))


def _weights(j: int, p: int):
    """Weight of each coalition's value in feature j's Shapley value."""
    weights = []
    for mask in range(2**p):
        size = mask.bit_count()
        if mask >> j & 1:
            weights.append(math.factorial(size - 1) * math.factorial(p - size) / math.factorial(p))
        else:
            weights.append(-math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p))
    return F.array(*[F.lit(float(w)) for w in weights])


def coalitions(p: int, n: int, seed: int) -> tuple[list[int], np.ndarray]:
    """At most `n` coalitions of p features as bit masks, neither empty nor full, with their weights in the kernel regression.

    Sizes s and p - s are taken whole, the outermost first, as long as they fit. The rest are drawn by the kernel's
    share of each size, every one with its complement; repeated draws add to a weight.
    """
    kernel = {s: (p - 1) / (s * (p - s)) for s in range(1, p)}
    weights: dict[int, float] = {}
    left = n
    sizes = [(s, p - s) for s in range(1, p // 2 + 1)]
    while sizes and sum(math.comb(p, s) for s in set(sizes[0])) <= left:
        for s in sorted(set(sizes.pop(0))):
            for chosen in combinations(range(p), s):
                weights[sum(1 << j for j in chosen)] = kernel[s] / math.comb(p, s)
            left -= math.comb(p, s)
    if sizes and left >= 2:
        draw = random.Random(seed)
        lower = [s for s, _ in sizes]
        mass = [sum(kernel[s] for s in set(pair)) for pair in sizes]
        drawn: dict[int, int] = {}
        times = 0
        # draws are repeated until the budget is used; repeats become rare only in large sets, so they are bounded
        while len(drawn) + 2 <= left and times < 20 * n:
            mask = sum(1 << j for j in draw.sample(range(p), draw.choices(lower, mass)[0]))
            for each in (mask, (1 << p) - 1 - mask):
                drawn[each] = drawn.get(each, 0) + 1
            times += 1
        for mask, count in drawn.items():
            weights[mask] = sum(mass) * count / (2 * times)
    masks = sorted(weights)
    return masks, np.array([weights[m] for m in masks])


def kernel_weights(p: int, masks: Sequence[int], weights: np.ndarray) -> np.ndarray:
    """(p, coalitions): what the value of each coalition adds to each Shapley value. The first column is the empty
    coalition's, the last the full one's.

    The kernel regression under the constraint that the values add up to the prediction's distance from the mean is
    linear in the coalitions' values, and its normal matrix is the same for every example.
    """
    z = np.array([[m >> j & 1 for j in range(p)] for m in masks], float).reshape(len(masks), p)
    normal = z.T @ (weights[:, None] * z)
    if not masks or np.linalg.cond(normal) > 1e12:
        raise ValueError(f"{len(masks)} coalitions do not determine {p} values: ask for more")
    inverse = np.linalg.inv(normal)
    even = inverse.sum(axis=1) / inverse.sum()
    free = inverse @ (z.T * weights)
    inner = free - np.outer(even, free.sum(axis=0))
    return np.column_stack([-inner.sum(axis=1) - even, inner, even])


def kernel_shapley(
    examples: DataFrame,
    background: DataFrame,
    key: str,
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    prediction: str = "prediction",
    n_examples: int = 100,
    n_background: int = 100,
    n_coalitions: int | None = None,
    seed: int = 460409061,
) -> DataFrame:
    """One row per example and feature: key, feature, value, shapley, for any number of features.

    The kernel regression over `n_coalitions` coalitions (2 p + 2048 where none is given), the same ones for every
    example. They come in complementary pairs, so the values are exact for models whose interactions are between at most
    two features, and for any model once all 2^p - 2 are taken. Missing values are filled as in `shapley_values`.
    """
    p = len(features)
    if p < 2:
        return shapley_values(examples, background, key, features, predict, prediction, n_examples, n_background, seed)
    masks, weights = coalitions(p, n_coalitions or 2 * p + 2048, seed)
    matrix = kernel_weights(p, masks, weights)
    masks = [0, *masks, (1 << p) - 1]
    # one text of p characters per coalition, so a wide model is not a wide plan
    bits = F.lit("".join("".join(str(m >> j & 1) for j in range(p)) for m in masks))
    # both have as many rows as asked for: written once, so the plan of the predictions does not hold that of their source
    asked = pin(fill_mode(sample_n(examples, key, n_examples, seed), features, background).select(key, *features))
    reference = pin(fill_mode(sample_n(background, key, n_background, seed), features, background).select(*features))
    drawn = reference.agg(F.collect_list(F.struct(*[F.col(c).alias(f"f{j}") for j, c in enumerate(features)]))).scalar()
    asked = asked.select(
        F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_key"),
        F.struct(*[F.col(c).alias(f"f{j}") for j, c in enumerate(features)]).alias("_x"),
    )
    each = asked.select("_id", "_x", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("_i"))
    # the rows so far are few and lie in few partitions; the predictions are the work
    each = each.repartition("_id", "_i").withColumn("_bits", F.substr(bits, F.col("_i") * p + 1, F.lit(p)))
    crossed = each.select("_id", "_x", "_i", "_bits", F.explode(drawn).alias("_b"))
    mixed = crossed.select(
        "_id", "_i", *[F.expr(f"if(substr(_bits, {j + 1}, 1) = '1', _x.f{j}, _b.f{j})").alias(c) for j, c in enumerate(features)]
    )
    values = predict(mixed).groupBy("_id", "_i").agg(F.avg(prediction).alias("_v"))
    table = examples.sparkSession.createDataFrame(
        [(i, [float(w) for w in matrix[:, i]]) for i in range(len(masks))], "_i int, _w array<double>"
    )
    # coalitions times features numbers, both arguments
    weighted = values.join(F.broadcast(table), "_i")
    totals = weighted.groupBy("_id").agg(*[F.expr(f"sum(_v * _w[{j}])").alias(f"_s{j}") for j in range(p)])
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(f"_x.f{j}").cast("double").alias("value"), F.col(f"_s{j}").alias("shapley"))
        for j, c in enumerate(features)
    ]
    return asked.join(totals, "_id").select(F.col("_key").alias(key), F.inline(F.array(*cells)))


def shapley_summary(values: DataFrame) -> DataFrame:
    """Features by mean absolute Shapley value, largest first."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("shapley")).alias("mean_abs_shapley"))
        .orderBy(F.desc("mean_abs_shapley"), "feature")
    )
