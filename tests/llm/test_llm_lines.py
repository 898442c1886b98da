import random

import edge
import pytest
import xxhash
from pyspark.sql import functions as F

from lapse.llm import lines
from lapse.llm.lines import Chunking


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


def hashes(body):
    return [xxhash.xxh3_64_intdigest(x) for x in body]


def plain(rows, rule=None):
    """[(key, text hash, text)] to [(key, text, lines removed)], by the texts of the lines."""
    rule = rule or Chunking()
    order = lambda d: (d[0] is not None, d[0] or 0, d[1])
    docs = {(k, h): t.encode().split(b"\n") for k, h, t in rows if t is not None}
    first = {}
    for d in sorted(docs, key=order):
        for a, b in lines.chunks(docs[d], hashes(docs[d]), rule):
            first.setdefault(b"\n".join(docs[d][a:b]), (d, a))
    runs = {}
    for d, body in docs.items():
        spans = []
        for a, b in lines.chunks(body, hashes(body), rule):
            ref, at = first[b"\n".join(body[a:b])]
            if (ref, at) == (d, a):
                continue
            other, shift, low, high = docs[ref], at - a, a, b
            while low > 0 and a - low < rule.reach and low + shift > 0 and body[low - 1] == other[low - 1 + shift]:
                low -= 1
            while high < len(body) and high - b < rule.reach and high + shift < len(other) and body[high] == other[high + shift]:
                high += 1
            spans.append(((order(ref), ref, shift), low, high))
        counts = [len(x.split()) for x in body]
        runs[d] = [(w[1], w[2], a, b) for w, a, b in lines.joined(spans) if lines.enough(counts[a:b], rule)]
    out = []
    for k, h, t in rows:
        if t is None:
            out.append((k, None, 0))
            continue
        body, gone = docs[k, h], set()
        counts = [len(x.split()) for x in body]
        for ref, shift, a, b in runs[k, h]:
            stays = [True if not any(c <= i + shift < e for *_, c, e in runs[ref]) else False for i in range(a, b)]
            i = a
            while i < b:
                j = i
                while j < b and stays[j - a]:
                    j += 1
                if j > i and lines.enough(counts[i:j], rule):
                    gone |= set(range(i, j))
                i = max(j, i + 1)
        kept = [x for i, x in enumerate(body) if i not in gone]
        if gone and not any(x.split() for x in kept):
            out.append((k, "", len(body)))
        else:
            out.append((k, b"\n".join(kept).decode(), len(gone)))
    return sorted(out, key=str)


def hashed(docs):
    """Rows of a table for `plain`."""
    return [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]


def run(spark, rows, rule=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lines.deduplicate(docs, rule=rule).collect()), key=str)
    assert got == plain(hashed(docs), rule)
    return {k: (t, n) for k, t, n in got}


def test_chunks_cover_all_but_short_rests():
    rng = random.Random(2)
    rule = Chunking(seed_words=0)
    for _ in range(200):
        body = [sentence(rng, rng.choice([0, 1, 3, 5, 40])).encode() for _ in range(rng.randint(1, 30))]
        spans = lines.chunks(body, hashes(body), rule)
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == len(body)


def test_boundaries_resist_shifts():
    rng = random.Random(4)
    body = [sentence(rng, 2).encode() for _ in range(400)]

    def cut(own):
        return {b"\n".join(own[a:b]) for a, b in lines.chunks(own, hashes(own), Chunking())}

    assert max(b - a for a, b in lines.chunks(body, hashes(body), Chunking())) > 4
    shared = cut(body) & cut([sentence(rng, 2).encode() for _ in range(3)] + body)
    assert len(shared) > 0.9 * len(cut(body))


def planted(rng, count, words, lines_, copies=2):
    """Documents that share passages of `lines_` lines of `words` words between other lines."""
    rows, wanted = [], []
    for i in range(count):
        passage = [sentence(rng, words) for _ in range(lines_)]
        wanted.append(passage)
        for j in range(copies):
            body = [*(sentence(rng, 10) for _ in range(rng.randint(1, 3))), *passage, sentence(rng, 12)]
            rows.append((copies * i + j, "\n".join(body)))
    return rows, wanted


@pytest.mark.parametrize("words,lines_", [(26, 2), (20, 3), (15, 4), (12, 5), (10, 6), (9, 40), (2, 30), (1, 60), (55, 1)])
def test_whole_passages_go(spark, words, lines_):
    """Passages of 52 words and more: all, whatever the length of their lines; of lines of a word or two, nine lines in ten."""
    rows, wanted = planted(random.Random(words), 20, words, lines_)
    got = run(spark, rows)
    lines_gone = 0
    for i, passage in enumerate(wanted):
        before = rows[2 * i + 1][1].split("\n")
        assert got[2 * i] == (rows[2 * i][1], 0)
        lines_gone += got[2 * i + 1][1]
        if words > 8:
            assert got[2 * i + 1] == ("\n".join(x for x in before if x not in passage), lines_)
    assert lines_gone >= 0.9 * lines_ * len(wanted)


def test_passages_between_lines_that_stand_elsewhere(spark):
    """Some lines of a passage were first seen by themselves, in other documents."""
    rng = random.Random(12)
    rows, wanted = planted(rng, 30, 10, 6, copies=3)
    rows = [(k + 1000, t) for k, t in rows]
    rows += [(i, f"{sentence(rng, 9)}\n{rng.choice(p)}\n{sentence(rng, 9)}") for i, p in enumerate(wanted)]
    got = run(spark, rows)
    for i, passage in enumerate(wanted):
        assert got[1000 + 3 * i][1] == 0
        for j in (1, 2):
            assert got[1000 + 3 * i + j][1] == 6 and not set(passage) & set(got[1000 + 3 * i + j][0].split("\n"))


def test_a_run_stands_whole_in_one_place(spark):
    """Lines that stand elsewhere, but not one after the other, are no passage."""
    rng = random.Random(5)
    a, b, c = (sentence(rng, 6) for _ in range(3))
    own = lambda: sentence(rng, 9)
    rows = [(1, f"{own()}\n{a}\n{b}\n{own()}"), (2, f"{own()}\n{b}\n{c}\n{own()}"), (4, f"{own()}\n{a}\n{b}\n{c}\n{own()}")]
    assert run(spark, rows)[4] == (rows[2][1], 0)


def test_the_last_whole_copy_stays(spark):
    rng = random.Random(6)
    l0, l1, l2 = (sentence(rng, 9) for _ in range(3))
    own = lambda: sentence(rng, 9)
    rows = [(1, f"{own()}\n{l0}\n{l1}\n{own()}"), (2, f"{own()}\n{l0}\n{l1}\n{l2}\n{own()}"), (3, f"{own()}\n{l1}\n{l2}\n{own()}")]
    got = run(spark, rows)
    assert got[2][1] == 2 and any(f"{l1}\n{l2}" in t for t, _ in got.values())
    assert any(f"{l0}\n{l1}" in t for t, _ in got.values())


def test_short_repeats_and_copies(spark):
    rng = random.Random(3)
    a, b, c, d = (sentence(rng, 7) for _ in range(4))
    own = lambda: sentence(rng, 9)
    long = sentence(rng, 40)
    rows = [
        (1, f"{own()}\n{a}\n{b}\n{own()}"), (2, f"{own()}\n{a}\n{b}\n{own()}"),  # 14 words in two lines
        (3, f"{c}\n\n{own()}"), (4, f"{own()}\n\n{c}\n\n{own()}"),  # a single short line
        (5, f"\n{a}\n\n{d}\n{c}\n"), (6, f"\n{a}\n\n{d}\n{c}\n"),  # a copy with blank lines
        (7, f"{long}\n{own()}"), (8, f"{own()}\n{long}"),
        (9, "\n".join([a + b] * 4)), (10, "\n".join([long + a] * 4)),
    ]
    got = run(spark, rows)
    for k in (1, 2, 3, 4, 5, 7, 9):
        assert got[k] == (rows[k - 1][1], 0)
    assert got[6] == ("", 6) and got[8] == (rows[7][1].split("\n")[0], 1) and got[10] == (long + a, 3)


def test_clean_documents_stay(spark):
    rng = random.Random(8)
    licence = "Licensed under the Apache License, Version 2.0."
    rows = [(i, "\n".join([*(sentence(rng, 20) for _ in range(6)), licence])) for i in range(30)]
    assert all(n == 0 for _, n in run(spark, rows).values())


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(spark, seed):
    """Few distinct lines: overlapping passages, repeats within a text, rows that repeat and ids that do."""
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice([0, 1, 3, 8, 12, 20, 40])) for _ in range(rng.choice([6, 40, 200]))]
    passages = [rng.choices(pool, k=rng.randint(2, 25)) for _ in range(8)]
    rows = []
    for _ in range(60):
        body = []
        for _ in range(rng.randint(1, 5)):
            body += rng.choice(passages) if rng.random() < 0.5 else rng.choices(pool, k=rng.randint(1, 3))
        rows.append((rng.choice([None, *range(50)]), "\n".join(body)))
    rule = Chunking(reach=rng.choice([0, 2, 8]), filter_bits=rng.choice([64, 1 << 20]), window=rng.choice([1, 2, 4]))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    got = sorted(map(tuple, lines.deduplicate(docs, rule=rule).collect()), key=str)
    assert got == plain(hashed(docs), rule) and any(r[2] for r in got)


def test_same_hash_is_not_same_text(spark, monkeypatch):
    """Bodies are compared whole: lines that only look alike by their hashes stay."""
    rng = random.Random(9)
    texts = [sentence(rng, 40).encode(), sentence(rng, 41).encode()]
    import pyarrow as pa

    doc = pa.array([{"key": 1, "th": 2}])
    spans = pa.array([[{"ref": {"key": 0, "th": 0}, "first": 0, "end": 1, "shift": 0}]])
    batch = pa.RecordBatch.from_arrays([doc, pa.array([texts[1].decode()]), spans], names=["doc", "text", "spans"])
    (judged,) = lines._judge(Chunking())([batch])
    asked = pa.RecordBatch.from_arrays(
        [doc, pa.array([texts[0].decode()]), pa.array([[{"a": 0, "b": 1}]]), pa.array([None], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
        names=["doc", "text", "asked", "taken"],
    )
    (bodies,) = lines._bodies([asked])
    assert judged.column("body").to_pylist() == [texts[1]] and bodies.column("body").to_pylist() == [texts[0]]


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = edge.documents(spark, extra)
    if extra:
        docs = docs.withColumns({c: F.lit(-1) for c in ("doc", "_doc", "_h", "_gone", "_gone_doc")})
    done = lines.deduplicate(docs)
    got = sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in done.collect()), key=str)
    assert got == plain(hashed(docs))
    assert set(docs.columns) <= set(done.columns)
    assert lines.deduplicate(edge.empty(spark)).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op8_line_dedup

    got = sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in op8_line_dedup(spark, edge.SMALL).collect()), key=str)
    rows = hashed(edge.small(spark))
    assert got == plain(rows) and sum(n for *_, n in got) > 0
    # a line that goes stays somewhere
    kept = {x for _, t, _ in got for x in (t or "").split("\n")}
    assert all(x in kept for *_, t in rows for x in (t or "").split("\n") if x.split())
