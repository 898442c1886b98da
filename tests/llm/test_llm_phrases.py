import random
import re
from collections import Counter

import edge
import pytest

from lapse.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_words=3, support=10, inside=50, top=2000):
    """[(lang, text)] to the collocations, counted phrase by phrase."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    often = {p: f for p, f in counts.items() if len(p[1]) > 1 and f >= support}
    out = {}
    for (lang, words), a in often.items():
        longer = [f for (other, p), f in often.items() if other == lang and len(p) > len(words)
                  and any(p[i : i + len(words)] == words for i in range(len(p)))]
        if any(100 * f >= inside * a for f in longer):
            continue
        cut = min(
            (1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))
        )
        part = counts[lang, words[: cut[1]]], counts[lang, words[cut[1] :]]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), *part))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    )


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(map(tuple, phrases.collocations(docs, **how).collect()))


def text(rng, words):
    vocabulary = ["The", "a", "b", "é", "ÀB", "x.", "y,", "z\n", "\t", "q", "of", "\x1f", "東京", "r"]
    return " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=words))


@pytest.mark.parametrize("max_words,support,shards,bits", [(3, 10, 4, 1 << 20), (2, 3, 9, 64), (5, 4, 1, 1 << 12), (4, 7, 50, 64)])
def test_against_plain(spark, max_words, support, shards, bits):
    rng = random.Random(max_words)
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng, rng.choice([0, 1, 2, 40, 300]))) for _ in range(40)]
    got = run(spark, rows, max_words=max_words, support=support, shards=shards, filter_bits=bits, top=60)
    assert got and got == plain(rows, max_words, support, top=60)


def test_overlaps_and_borders(spark):
    rows = [("en", "ha " * 30), ("en", "one two. one two, one two\none two"), ("en", "one\ttwo " * 8)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert {(p, a) for _, _, p, a, *_ in got} >= {("ha ha ha", 28), ("one two", 12)}


def test_local_support_is_never_too_high():
    """A phrase with the global support reaches the local one in some shard, however it is spread."""
    for support in range(1, 40):
        for shards in range(1, 60):
            assert shards * (-(-support // shards) - 1) < support


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    sql = "(cast(1000000 as decimal(7,0)) * (cast(f as decimal(16,0)) * cast(f as decimal(16,0)))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    f, l, r = 999_999_999_999, 1_000_000_000_003, 999_999_999_999_989
    got = spark.sql(f"select cast({sql} as long) from values ({f}L, {l}L, {r}L) as t(f, l, r)").first()[0]
    assert got == 1000000 * f * f // (l * r)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = edge.documents(spark, extra)
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got == plain([(r["lang"], r["text"]) for r in docs.collect()])
    assert phrases.collocations(edge.empty(spark)).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op11_collocations

    want = plain([(r["lang"], r["text"]) for r in edge.small(spark).collect()])
    assert sorted(map(tuple, op11_collocations(spark, edge.SMALL).collect())) == want
