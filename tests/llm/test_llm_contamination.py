import random
import re

import edge
import pytest

from lapse.llm import contamination

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain(docs, items, span=10):
    """[(key, text)], [(item, text)] to (key, n_words, n_hit, items), window by window."""
    windows = {}
    for item, text in items:
        words = cut(text)
        size = min(span, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    out = []
    for key, text in docs:
        words, hit, found = cut(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(words[i : i + size])]
        out.append((key, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, contamination.contaminated(left, right, **how).collect()), key=str)


def sentence(rng, n, size=4):
    return " ".join("".join(rng.choices("abé", k=rng.randint(1, size))) for _ in range(n))


@pytest.mark.parametrize("span,k,bits", [(10, 5, 1 << 16), (10, 10, 64), (4, 1, 1 << 10), (6, 3, 64)])
def test_against_plain(spark, span, k, bits):
    """Few distinct words: many ties, repeats and overlaps."""
    rng = random.Random(span + k)
    items = [(i, sentence(rng, rng.choice([0, 1, 2, 5, 9, 10, 11, 30]), 2 + i % 3)) for i in range(25)]
    items += [(3, items[4][1]), (None, items[20][1]), (99, None)]
    docs = []
    for i in range(60):
        shared = items[rng.randrange(25)][1].split()
        at = rng.randint(0, max(0, len(shared) - 1))
        part = " ".join(shared[at : at + rng.randint(1, 25)]).upper().replace(" ", rng.choice([" ", ", ", "\n", "--"]))
        docs.append((i, f"{sentence(rng, rng.randint(0, 30))} {part} {sentence(rng, 12)}"))
    got = run(spark, docs, items, span=span, k=k, filter_bits=bits)
    assert got == plain(docs, items, span) and any(r[2] for r in got)


def test_every_shared_span_holds_a_fingerprint(spark):
    """A span of exactly ten words between foreign words is always found; nine are not."""
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(40))) for i in range(100)]
    docs, short = [], []
    for i, text in items:
        at = rng.randint(0, 30)
        words = text.split()
        docs.append((i, f"before {' '.join(words[at : at + 10])} after"))
        short.append((i, f"before {' '.join(words[at : at + 9])} after"))
    got = run(spark, docs, items)
    assert got == plain(docs, items) and all(r[2] >= 10 and str(r[0]) in r[3] for r in got)
    assert run(spark, short, items) == plain(short, items)


def test_a_passage_in_many_documents_and_items(spark):
    rng = random.Random(2)
    passage = sentence(rng, 60)
    docs = [(i, f"{sentence(rng, 9)} {passage} {passage[:40]}") for i in range(300)] + [(1, passage)] * 2
    items = [(i, f"{passage} {i}") for i in range(30)]
    assert run(spark, docs, items) == plain(docs, items)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = edge.documents(spark, extra)
    items = docs.selectExpr("doc_id as item_id", "text", *(["size", "lo", "hi", "at"] if extra else []))
    items = items.where("length(text) < 2000 or text is null")
    got = sorted(map(tuple, contamination.contaminated(docs, items).collect()), key=str)
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got == want
    none = contamination.contaminated(docs, items.limit(0)).collect()
    assert sorted((r[1] for r in want)) == sorted(r["n_words"] for r in none) and not any(r["n_hit"] or r["items"] for r in none)
    assert contamination.contaminated(edge.empty(spark), items).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    import hashlib

    from lapse.llm.queries import op13_decontamination

    docs = [(r["doc_id"], r["text"]) for r in edge.small(spark).collect()]
    items = [(r["item_id"], r["text"]) for r in edge.small(spark, "benchmark").collect()]
    want = [
        (k, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)
        for k, n, hit, found in plain(docs, items)
    ]
    assert sorted(map(tuple, op13_decontamination(spark, edge.SMALL).collect()), key=str) == sorted(want, key=str)
