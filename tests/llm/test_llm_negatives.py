import random

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from lapse.llm import negatives


def plain(rows, anchor, positives=5, count=3, low=50, high=95):
    """{id: (label, vector)} to the rows of `mine`."""
    out = []
    for a in rows:
        if not anchor(a):
            continue
        dot = {i: sum(x * y for x, y in zip(rows[a][1], rows[i][1])) for i in rows if i != a}
        best = sorted((-s, i) for i, s in dot.items() if rows[i][0] == rows[a][0])[:positives]
        other = sorted((-s, i) for i, s in dot.items() if rows[i][0] != rows[a][0])
        for ps, p in best:
            fits = [(i, -s) for s, i in other if low * -ps <= 100 * -s <= high * -ps][:count]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, anchor, **how):
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()], "vec_id long, label int, v array<bigint>")
    return sorted(map(tuple, negatives.mine(df, anchor, **how).collect()))


@pytest.mark.parametrize("block,spread", [((8192, 2048), 40), ((7, 3), 40), ((50, 9), 2)])
def test_against_plain(spark, block, spread):
    """With a small spread most scores tie."""
    rng = random.Random(block[0])
    rows = {i: (rng.choice([1, 1, 1, 2, 3]), [rng.randint(-spread, spread) for _ in range(5)]) for i in range(0, 400, 2)}
    rows |= {i: rows[20] for i in range(1, 120, 2)}  # a very common vector
    got = run(spark, rows, F.col("vec_id") % 5 == 0, block_rows=block[0], block_anchors=block[1])
    assert got and got == plain(rows, lambda i: i % 5 == 0)


@pytest.mark.parametrize("positives,count,low,high", [(1, 1, 0, 100), (9, 6, 10, 99), (3, 50, 90, 91)])
def test_other_limits(spark, positives, count, low, high):
    rng = random.Random(positives)
    rows = {i: (i % 3, [rng.randint(-9, 20) for _ in range(4)]) for i in range(150)}
    got = run(spark, rows, F.col("vec_id") < 30, positives=positives, negatives=count, low=low, high=high)
    assert got == plain(rows, lambda i: i < 30, positives, count, low, high)


def test_negative_and_zero_scores(spark):
    rows = {0: (1, [10]), 1: (1, [-4]), 2: (1, [0]), 3: (2, [-3]), 4: (2, [0]), 5: (2, [7])}
    assert run(spark, rows, F.col("vec_id") == 0) == [(0, 2, 1, 4, 0, 0)]


def test_products_are_exact():
    a, b = np.array([[2**30, 3]]), np.array([[2**30, 7], [1, -1]])
    assert negatives.products(a, b).tolist() == [[2**60 + 21, 2**30 - 3]]
    with pytest.raises(ValueError):
        negatives.products(a * 2, b * 2)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    rows = [
        (0, [0.5, 1.0], 1), (50, [0.5, 1.0], 1), (1, None, 1), (2, [0.1, None], 1), (3, [0.1, float("nan")], 1),
        (4, [0.1, float("inf")], 2), (5, [0.3, 0.9], None), (None, [0.5, 1.0], 1), (6, [0.4, 0.9], 1), (6, [0.4, 0.9], 1),
        (8, [0.4, 0.8], 2), (9, [0.7], 2), (10, [], 2), (11, [-0.0039, 0.9, 0.1], 3),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumn("v", negatives.scaled(F.col("embedding"), 256))
    if extra:
        df = df.withColumns({c: F.lit(-1) for c in ("id", "a", "r", "anchor", "score", "slot", "s", "rank", "uppers")})
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 50 == 0).collect()))
    pad = lambda v: [*v, 0, 0, 0][:3]
    held = {r["vec_id"]: (r["label"], pad(r["v"])) for r in df.collect() if None not in (r["vec_id"], r["v"], r["label"])}
    assert held[11][1] == [-1, 230, 25] and set(held) == {0, 50, 6, 8, 9, 10, 11}
    assert got and got == plain(held, lambda i: i % 50 == 0)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op12_hard_negatives

    rows = {}
    for r in edge.small(spark, "embeddings").collect():
        if r["label"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"]):
            label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
            rows[r["vec_id"]] = label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in r["embedding"]]
    assert sorted(map(tuple, op12_hard_negatives(spark, edge.SMALL).collect())) == plain(rows, lambda i: i % 50 == 0)
