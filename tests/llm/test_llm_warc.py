import base64
import gzip
import hashlib
import uuid

import edge
import pytest
from pyspark.sql import functions as F

from lapse.llm import warc

PAGES = "page_id long, url string, html string"
AWKWARD = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "", ""),
    (5, "http://c/\r\nX: y", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\nContent-Length: 5\r\n\r\n"),
    (6, "http://d/é", "é😀\x00\n" * 10), (7, "http://e/", "x" * 300_000), (1, "http://a/", "<p>one</p>"),
    (None, "http://f/", "<p>two</p>"), (9, "http://g/", "<p>two</p>"), (None, None, None), (-8, "u", "<p>three</p>"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(AWKWARD, PAGES).withColumns({c: F.lit(0) for c in ("page", "digest", "number", "_key")})
    at = folder(tmp_path)
    warc.write(pages, at)
    records = warc.read(spark, at).collect()
    assert len(records) == 3 * len(AWKWARD) and len({r["record_id"] for r in records}) == len(records)
    assert all(r["digest_ok"] for r in records if r["record_type"] == "response")
    payloads = {r["payload_digest"]: bytes(r["payload"]) for r in records if r["record_type"] == "response"}
    assert payloads == {digest(h): (h or "").encode() for _, _, h in AWKWARD}
    found = warc.assemble(warc.read(spark, at)).collect()
    assert len(found) == len(AWKWARD)
    by_id = {r["capture_id"]: r for r in found}
    page = lambda r: dict((f["key"], f["value"]) for f in r["metadata"]["fields"])["page-id"]
    got = sorted((page(r), r["response"]["payload_digest"], r["response"]["payload_bytes"]) for r in found)
    assert got == sorted(("" if p is None else str(p), digest(h), len((h or "").encode())) for p, _, h in AWKWARD)
    for r in found:
        assert r["request"]["record_id"] == r["capture_id"] + ":request"
        if r["response"]["record_type"] == "revisit":
            origin = by_id[r["response"]["refers_to"]]
            assert origin["response"]["record_type"] == "response"
            same = [p for p, _, h in AWKWARD if digest(h) == r["response"]["payload_digest"] and p is not None]
            assert page(origin) == str(min(same))


def test_empty_table(spark, tmp_path):
    at = folder(tmp_path)
    warc.write(spark.createDataFrame([], PAGES), at)
    assert warc.assemble(warc.read(spark, at)).collect() == []


def archive(*blocks):
    return b"".join(
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode()
        + b + b"\r\n\r\n"
        for i, b in enumerate(blocks)
    )


def test_plain_gzipped_and_member_per_record():
    blocks = [b"", b"a" * 5000, b"\r\n\r\n\r\n", b"z" * 3_000_000]
    data = archive(*blocks)
    members = b"".join(gzip.compress(archive(b)) for b in blocks)
    for content in (data, gzip.compress(data), members):
        assert [r[1] for r in warc.parse(content)] == ["warcinfo"] * 4


@pytest.mark.parametrize("broken", [archive(b"abc")[:-5], b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nX", gzip.compress(archive(b"x" * 9999))[:-40]])
def test_broken_archives_are_reported(broken):
    with pytest.raises((ValueError, KeyError)):
        list(warc.parse(broken))


def test_stray_records_and_missing_partners(spark):
    rows = [("a", "response", None), ("r", "request", "a"), ("m", "metadata", "zz"), ("b", "revisit", None),
            ("r2", "request", "a")]
    df = spark.createDataFrame(rows, "record_id string, record_type string, concurrent_to string").withColumns(
        {"target_uri": F.lit("u"), "fields": F.create_map(F.lit("k"), F.lit("v"))}
    )
    found = {r["capture_id"]: r for r in warc.assemble(df).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"]["request"]["record_id"] == "r" and found["a"]["metadata"] is None and found["b"]["request"] is None


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op7_warc

    pages = edge.small(spark, "pages").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        first.setdefault(digest(p["html"]), p["page_id"])
    want = []
    for p in pages:
        d = digest(p["html"])
        again = first[d] != p["page_id"]
        want.append((p["page_id"], len((p["html"] or "").encode()), d, "revisit" if again else "response", first[d] if again else None))
    assert sorted(map(tuple, op7_warc(spark, edge.SMALL).collect())) == sorted(want)


def test_damaged_payloads_are_an_error(spark):
    schema = "record_id string, digest_ok boolean, payload_digest string"
    whole = spark.createDataFrame([("a", True, "X"), ("b", None, "Y"), ("c", True, None)], schema)
    assert sorted(map(tuple, warc.sound(whole).collect())) == [("a", True, "X"), ("b", None, "Y"), ("c", True, None)]
    with pytest.raises(Exception, match="damaged payload in record d"):
        warc.sound(whole.union(spark.createDataFrame([("d", False, "Z")], schema))).collect()
