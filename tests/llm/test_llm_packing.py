import itertools
import random
from collections import Counter, defaultdict

import edge
import pytest

from lapse.llm import packing


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        histogram = {x: rng.randint(1, 30) for x in rng.sample(range(0, 60), rng.randint(1, 9))}
        lengths = sorted(histogram)
        for k in range(1, 5):
            got = packing.bucket_bounds(histogram, k)
            assert len(got) <= k and got[-1] == lengths[-1] and got == sorted(set(got))
            best = min(
                padding(histogram, [*c, lengths[-1]])
                for m in range(min(k, len(lengths)))
                for c in itertools.combinations(lengths[:-1], m)
            )
            assert padding(histogram, got) == best
    assert packing.bucket_bounds({}, 4) == []


def check(docs, rows, key, max_length, budget):
    by = defaultdict(list)
    for r in rows:
        by[r[key]].append(r)
    want = Counter()
    for key_, text in docs:
        n = len((text or "").split())
        want.update((key_, p, p * max_length, min(max_length, n - p * max_length)) for p in range(max(1, -(-n // max_length))))
    assert Counter((r[key], r["piece"], r["start"], r["n_tokens"]) for r in rows) == want
    batches = defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["padded"]
        batches[r["batch_id"]].append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = Counter()
    for rows_ in batches.values():
        assert len({(r["bucket"], r["padded"]) for r in rows_}) == 1
        size = max(1, budget // max(1, rows_[0]["padded"]))
        assert sorted(r["slot"] for r in rows_) == list(range(len(rows_))) and len(rows_) <= size
        short[rows_[0]["bucket"]] += len(rows_) < size
    assert all(n <= 1 for n in short.values())


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = edge.documents(spark, extra)
    rows = packing.pack(docs, max_length=64, buckets=5, budget=300).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], rows, "doc_id", 64, 300)


def test_cells_do_not_show(spark, monkeypatch):
    from lapse.llm import common

    monkeypatch.setattr(common, "ROWS_PER_CELL", 7)
    docs = edge.documents(spark)
    rows = packing.pack(docs, max_length=50, buckets=3, budget=200).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], rows, "doc_id", 50, 200)


def test_empty_and_blank(spark):
    assert packing.pack(edge.empty(spark)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert len(packing.pack(blank).collect()) == 2


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op10_packing

    rows = op10_packing(spark, edge.SMALL).collect()
    docs = [(r["doc_id"], r["text"]) for r in edge.small(spark).collect()]
    check(docs, rows, "doc_id", 2048, 16_384)
    histogram = Counter(r["n_tokens"] for r in rows)
    assert sum(r["padded"] - r["n_tokens"] for r in rows) == padding(histogram, sorted({r["padded"] for r in rows}))
