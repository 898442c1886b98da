import random
import re

import edge
import numpy as np
import pytest
import xxhash

from lapse.llm import simhash
from lapse.llm.components import components


def plain_fingerprint(text, size=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    parts = [words] if len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    """{fingerprint: least fingerprint reachable}."""
    kinds = sorted(set(prints))
    root = {x: x for x in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(kinds):
        for y in kinds[:i]:
            if (x ^ y).bit_count() <= distance:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in kinds}


def check(found, key="doc_id", distance=3):
    rows = [(r[key], r["fp"] & (2**64 - 1), r["component"]) for r in found.collect()]
    roots = plain_components([fp for _, fp, _ in rows], distance)
    least = {}
    for doc, fp, _ in rows:
        if doc is not None:
            least[roots[fp]] = min(doc, least.get(roots[fp], doc))
    assert all(component == least.get(roots[fp]) for _, fp, component in rows)
    return rows


def test_fingerprints_match_the_definition():
    for text in [*edge.texts(), "Ä É  x", "A\x0bB\x0cC\x1cD", "x " * 300]:
        assert int(simhash.fingerprint_texts([text], 3)[0]) == plain_fingerprint(text)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    want = simhash.fingerprint_texts([edge.LONG, "a b c d"], 3)
    monkeypatch.setattr(simhash, "CHUNK", 512)
    assert (simhash.fingerprint_texts([edge.LONG, "a b c d"], 3) == want).all()


def test_every_near_pair_shares_a_variant():
    rng = random.Random(1)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        a, b = ({(block, int(v[0])) for block, _, v in simhash.variants(np.array([z], np.uint64))} for z in (x, y))
        assert a & b


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = edge.documents(spark, extra)
    rows = check(simhash.near_duplicates(docs))
    assert len(rows) == docs.count()
    by = dict((d, c) for d, _, c in rows)
    assert by[1] == by[0] == by[2] == 0 and by[11] == 7


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket", [2, 1024])
def test_clusters_of_fingerprints(spark, distance, bucket):
    """Many near fingerprints around few centres, so that buckets are crowded."""
    rng = random.Random(distance)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << bit
            prints.add(x)
    signed = [(x - 2**64 if x >> 63 else x,) for x in prints]
    tree = components(simhash.links(spark.createDataFrame(signed, "fp long"), distance, bucket))
    root = {r["node"]: r["root"] for r in tree.collect()}
    got, want = {}, {}
    for x in prints:
        s = x - 2**64 if x >> 63 else x
        got.setdefault(root.get(s, s), set()).add(x)
    for x, r in plain_components(prints, distance).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(50)}


def test_empty(spark):
    assert simhash.near_duplicates(edge.empty(spark)).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op1_simhash_dedup

    rows = op1_simhash_dedup(spark, edge.SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in edge.small(spark).collect()}
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(texts[r["doc_id"]]) for r in rows)
    roots = plain_components([int(r["fingerprint"], 16) for r in rows], 3)
    least = {}
    for r in rows:
        root = roots[int(r["fingerprint"], 16)]
        least[root] = min(r["doc_id"], least.get(root, r["doc_id"]))
    assert all(r["component_id"] == least[roots[int(r["fingerprint"], 16)]] for r in rows)
