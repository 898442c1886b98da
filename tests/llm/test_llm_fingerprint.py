import hashlib
import random

import edge
import numpy as np
import pytest

from lapse.llm import fingerprint as fp


def test_order_does_not_count_and_content_does():
    lines = [f"Line {i} says {i * i}." for i in range(40)]
    mixed = random.Random(3).sample(lines, len(lines))
    assert (fp.fingerprint("\n".join(lines)) == fp.fingerprint("\n".join(mixed))).all()
    assert (fp.fingerprint("\n".join(lines)) != fp.fingerprint("\n".join(lines[1:]))).any()
    assert (fp.fingerprint("a\na") != fp.fingerprint("a")).any()


def test_insertion_and_deletion():
    own = fp.fingerprint("one\ntwo\nthree")
    assert (own - fp.vector("two") == fp.fingerprint("one\nthree")).all()
    assert (own + fp.vector("four") == fp.fingerprint("four\none\ntwo\nthree")).all()


def test_incremental_edit_equals_a_new_fingerprint():
    rng = random.Random(5)
    parts = ["word " * 30, "End. ", "\n", "x" * 70, "! ", "\n\n", "é" * 210, ". ", " "]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        tail = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        cut = rng.randint(0, len(text))
        edited, got = fp.replace_tail(text, fp.fingerprint(text), cut, tail)
        assert edited == text[:cut] + tail
        assert (got == fp.fingerprint(edited)).all()


def test_likeness_follows_what_is_shared():
    rng = random.Random(1)
    lines = ["".join(rng.choices("abcdefgh ", k=100)) for _ in range(200)]
    whole = fp.fingerprint("\n".join(lines))
    for kept in (180, 100, 20):
        other = lines[:kept] + ["".join(rng.choices("ijkl ", k=100)) for _ in range(200 - kept)]
        assert abs(fp.likeness(whole, fp.fingerprint("\n".join(other))) - kept / 200) < 0.3
    assert fp.likeness(whole, whole) == 1.0
    assert fp.likeness(whole, fp.fingerprint("")) == 0.0 and fp.likeness(fp.fingerprint(""), fp.fingerprint("\n")) == 1.0


def test_hex_round_trip():
    own = fp.fingerprint("a\nb")
    assert (fp.from_hex(fp.to_hex(own)) == own).all()


def plain(rows):
    """[(key, text)] to expected results, in order."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    found = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        own, new, other = (fp.fingerprint(t) for t in (text, edited, after))
        found.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), fp.to_hex(own), fp.to_hex(new),
                      fp.likeness(own, new), fp.likeness(own, other)))
    return found


ORDER = lambda r: tuple((v is not None, v) for v in r)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edited_with_next(spark, parts):
    docs = edge.documents(spark, extra=parts == 3)
    got = [tuple(r) for r in fp.edited_with_next(docs, parts=parts).collect()]
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(got, key=ORDER) == sorted(want, key=ORDER)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert [tuple(r) for r in fp.edited_with_next(one).collect()] == plain([(5, "abcdefgh")])
    assert fp.edited_with_next(edge.empty(spark)).collect() == []


def test_column(spark):
    docs = edge.documents(spark, extra=True)
    for r in fp.fingerprints(docs).collect():
        assert r["fingerprint"] == fp.to_hex(fp.fingerprint(r["text"] or ""))


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op4_fingerprints

    found = op4_fingerprints(spark, edge.SMALL)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(plain([(r["doc_id"], r["text"]) for r in edge.small(spark).collect()]))
    assert np.mean([r[5] for r in got]) > 0.5 + np.mean([r[6] for r in got])
