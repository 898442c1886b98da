import random
import re

import edge
import pytest
from pyspark.sql import functions as F

from lapse.llm import quality

SPACE = "\x20\x09-\x0d"


def plain(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{SPACE}]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def texts():
    rng = random.Random(12)
    found = [*edge.texts(), "a\n\na\n \na \na", "## ** | <x>\x0b&%$\x1c#", "x " * 8, "x " * 9, "é😀 ß" * 5, "\x85a\xa0b", "a\rb\r\nb\r\n"]
    for _ in range(60):
        found.append(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))))
    run = [f"w{i}" for i in range(20)]
    found += [" ".join(run + ["x"] + run[3:15] + run[:9]), " ".join(run[:8] * 3), " ".join(run[:7] * 2)]
    return found


@pytest.mark.parametrize("extra", [False, True])
def test_statistics(spark, extra):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        docs = docs.withColumns({c: F.lit(0) for c in edge.CLASHING})
    got = {r["doc_id"]: tuple(r[c] for c in quality.BASE) for r in quality.statistics(docs).collect()}
    assert got == {i: plain(t) for i, t in rows}


def labelled(spark, n=600):
    """Bad rows have many symbols, or many repeats in a long text."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        kind = i % 4
        symbol, repeat, words = rng.random() * 0.05, rng.random() * 0.1, rng.randint(20, 900)
        if kind == 0:
            symbol = 0.2 + rng.random() / 2
        if kind == 1:
            repeat, words = 0.6 + rng.random() / 4, rng.randint(500, 900)
        rows.append((i, symbol, 0.1, repeat, 0.0, 5.0, 0.7, words, int(kind > 1)))
    columns = ", ".join(f"{f} double" for f in quality.FEATURES[:-1])
    return spark.createDataFrame(rows, f"doc_id long, {columns}, n_words long, quality int")


def test_rules_recover_the_labels(spark):
    df = labelled(spark)
    rules = quality.learn(df.drop("quality"), df.select("doc_id", "quality"))
    assert 2 <= len(rules) <= 4
    judged = df.withColumn("kept", quality.verdict(rules))
    assert judged.where((F.col("quality") == 1) & ~F.col("kept")).count() == 0
    assert judged.where((F.col("quality") == 0) & F.col("kept")).count() <= 6


def test_first_condition_is_the_best_of_all(spark):
    """The step that reads binned counts finds what trying every threshold finds."""
    import math

    df = labelled(spark, 90)
    rows = df.collect()
    cuts = {f: sorted({float(r[f]) for r in rows}) for f in quality.FEATURES}
    binned = df.withColumn("_bad", F.col("quality") == 0)
    for f in quality.FEATURES:
        binned = binned.withColumn(f"_{f}", sum((F.col(f) > c).cast("int") for c in cuts[f]))
    (rule,) = quality._grow(binned, cuts, 1)
    bad, n = sum(r["quality"] == 0 for r in rows), len(rows)

    def gain(c):
        hit = [r for r in rows if (r[c.feature] > c.threshold) == c.above]
        p = sum(r["quality"] == 0 for r in hit)
        return p * (math.log2(p / len(hit)) - math.log2(bad / n)) if p else 0

    best = max(gain(quality.Condition(f, a, t)) for f in cuts for t in cuts[f] for a in (True, False))
    assert gain(rule) == pytest.approx(best)


def test_noise_gives_no_rules(spark):
    df = labelled(spark).withColumn("quality", (F.xxhash64("doc_id") % 2 == 0).cast("int"))
    assert quality.learn(df.drop("quality"), df.select("doc_id", "quality")) == []


def test_no_labels_and_awkward_labels(spark):
    stats = quality.statistics(edge.documents(spark))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(stats, none) == []
    odd = spark.createDataFrame([(None, 0), (3, None), (4, 7), (5, 0), (5, 1)], "doc_id long, quality int")
    assert quality.learn(stats, odd) == []
    assert quality.statistics(edge.empty(spark)).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op9_quality_rules

    sf = edge.SMALL.replace("0.001", "0.1")
    found = op9_quality_rules(spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = {r["doc_id"]: r for r in found.collect()}
    texts_ = {r["doc_id"]: r["text"] for r in edge.small(spark, sf=sf).collect()}
    assert rows.keys() == texts_.keys()
    for d, r in rows.items():
        want = plain(texts_[d])
        assert tuple(r[c] for c in quality.BASE) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    labels = edge.small(spark, "labels", sf).collect()
    good = [rows[x["doc_id"]] for x in labels if x["quality"] == 1]
    bad = [rows[x["doc_id"]] for x in labels if x["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * sum(not r["base_failed"] for r in good)
    assert sum(r["kept"] for r in bad) <= 0.2 * len(bad)
