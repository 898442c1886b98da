"""WARC archives: write captures, read them back, assemble transactions.

Each page becomes three records: a request, a response (or, if an earlier page has
the same payload, a revisit that refers to that response) and metadata. Request and
metadata name the response or revisit in WARC-Concurrent-To. Reading parses records
by their Content-Length, and `assemble` joins the three through that field into one
nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapse.sources.session import pin

VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed, so that an archive depends on its pages only.
DATE = "2020-01-01T00:00:00Z"

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>, payload binary"
)


def sha1_base32(data: Column) -> Column:
    """RFC 4648 base32 of the SHA-1 of a binary column: 160 bits are 32 letters without padding."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Rows to write: (page, url, payload, digest, record, refers).

    Of pages with equal payloads the one with the least key (null last, rows with the same key
    numbered) is the response; the others revisit it. A page's record id is its key and number.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("string").alias("page"), F.col(key).alias("_key"), F.col(url).alias("url"),
                        body.alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.encode("payload", "UTF-8")))
    known = pages.select(F.col(key).alias("_key"), sha1_base32(F.encode(body, "UTF-8")).alias("_digest"))
    known = pin(known.groupBy("_key", "_digest").agg(F.count(F.lit(1)).alias("_n")))
    # repeated rows are numbered, so that each has an identifier of its own; without any, payloads stay in place
    number = F.lit(1)
    if not known.where("_n > 1").isEmpty():
        number = F.row_number().over(Window.partitionBy("_key", "digest").orderBy("url"))
    rows = rows.withColumn("number", number)
    rows = rows.withColumn("record", _urn(F.col("page"), F.col("digest"), F.col("number")))
    repeated = known.groupBy("_digest").agg(F.min("_key").alias("_first"), F.sum("_n").alias("_n"))
    repeated = repeated.where("_n > 1").drop("_n")
    rows = rows.join(repeated, F.col("digest") == F.col("_digest"), "left")
    first = _urn(F.col("_first").cast("string"), F.col("digest"), F.lit(1))
    return rows.withColumn("refers", F.when(F.col("_digest").isNotNull() & (first != F.col("record")), first))


def _urn(page: Column, digest: Column, number: Column) -> Column:
    """A UUID made of what identifies a capture."""
    h = F.sha2(F.concat_ws("/", F.coalesce(page, F.lit("")), digest, number.cast("string")), 256)
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 3), (16, 3), (19, 12))]
    return F.concat(F.lit("urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-8"), parts[2], F.lit("-a"), parts[3],
                    F.lit("-"), parts[4])


def _record(kind: str, record: Column, block: Column, content: str, extra: list[tuple[str, Column]]) -> Column:
    """A record without the two line ends after its block."""
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), record, F.lit(">"))]
    lines += [F.lit(f"WARC-Date: {DATE}"), F.lit(f"Content-Type: {content}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in extra]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def records(rows: DataFrame) -> DataFrame:
    """One string column, three rows per capture."""
    # a line end in a header would end it
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")
    target = [("WARC-Target-URI", F.when(uri != "", uri))]
    size = F.octet_length("payload").cast("string")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size,
        F.lit(CRLF + CRLF),
    )
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record(
        "response", F.col("record"), F.concat(head, "payload"), "application/http; msgtype=response", [*target, digest]
    )
    bracketed = F.concat(F.lit("<"), F.col("refers"), F.lit(">"))
    revisit = _record(
        "revisit", F.col("record"), head, "application/http; msgtype=response",
        [*target, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", bracketed)],
    )
    beside = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("record"), F.lit(">")))
    request = _record(
        "request", F.concat(F.col("record"), F.lit(":request")),
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}{CRLF}")), "application/http; msgtype=request",
        [*target, beside],
    )
    about = F.concat(F.lit("page-id: "), F.coalesce("page", F.lit("")), F.lit(CRLF))
    metadata = _record(
        "metadata", F.concat(F.col("record"), F.lit(":metadata")), about, "application/warc-fields", [*target, beside]
    )
    main = F.when(F.col("refers").isNull(), response).otherwise(revisit)
    return rows.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the pages as gzipped WARC files of bounded size into `folder` (as a data source names it).

    Null payloads are empty, null URLs are left out. The text sink puts the two line ends after each record."""
    rows = records(captures(pages, key, url, payload))
    sink = rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    sink.option("maxRecordsPerFile", 3_000).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in `folder` (columns of `RECORD`). `payload_bytes` and `digest_ok` of a
    response come from its payload; a revisit has the length its HTTP head tells, and no payload.
    A broken record raises ValueError."""
    files = spark.read.format("binaryFile").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for content in batch.column("content"):
                held = []
                for record in parse(content.as_buffer()):
                    held.append(record)
                    if len(held) >= 256:
                        yield _batch(held)
                        held = []
                yield _batch(held)
        return schema

    return files.mapInArrow(run, RECORD)


_TYPES = (
    [(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], names=[n for n, _ in _TYPES]
    )


def parse(content) -> Iterator[tuple]:
    """Rows of `RECORD` from the bytes of an archive, gzipped (any number of members) or not."""
    data = bytearray()
    source = _inflated(content)
    ended = False

    def fill(size: int) -> bool:
        nonlocal ended
        while len(data) < size and not ended:
            piece = next(source, None)
            if piece is None:
                ended = True
            else:
                data.extend(piece)
        return len(data) >= size

    while fill(1):
        size = 1 << 12
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not fill(size := max(size, len(data)) * 2) and data.find(b"\r\n\r\n") < 0:
                raise ValueError("a record's header does not end")
        version, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, int(header["content-length"])
        if not fill(start + length + 4):
            raise ValueError("a record's block is cut off")
        yield _row(header, bytes(data[start : start + length]))
        del data[: start + length + 4]


def _inflated(content) -> Iterator[bytes]:
    if bytes(content[:2]) != b"\x1f\x8b":
        yield bytes(content)
        return
    rest = bytes(content)
    while rest:
        inflater = zlib.decompressobj(31)
        while True:
            piece = inflater.decompress(rest, 1 << 20)
            if piece:
                yield piece
            if inflater.eof:
                rest = inflater.unused_data
                break
            rest = inflater.unconsumed_tail
            if not rest and not piece:
                raise ValueError("the archive is cut off")


def _row(header: dict[str, str], block: bytes) -> tuple:
    kind, digest = header["warc-type"], header.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = right = payload = None
    fields: list[tuple[str, str]] = []
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            payload, size = body, len(body)
            right = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
        else:
            named = dict(x.partition(": ")[::2] for x in head.decode("latin-1").lower().split("\r\n"))
            size = int(named["content-length"]) if "content-length" in named else None
    elif kind == "metadata":
        lines = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
        fields = list({k.strip(): v.strip() for k, _, v in lines}.items())
    bare = lambda name: header[name].strip("<>") if name in header else None
    return (bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"),
            header.get("warc-target-uri"), digest, size, right, fields, payload)


def sound(records: DataFrame) -> DataFrame:
    """`records` of `read`; a response whose payload does not have the digest that its record states is an error."""
    damaged = F.raise_error(F.concat(F.lit("damaged payload in record "), F.col("record_id")))
    return records.withColumn("payload_digest", F.when(F.col("digest_ok") == F.lit(False), damaged).otherwise(F.col("payload_digest")))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, request, response, metadata).

    Requests and metadata join the response or revisit they are concurrent to; of several the one
    with the least record id counts. A capture without one has null there; a request or metadata
    record whose capture is missing gives no row.
    """
    main = records.where("record_type in ('response', 'revisit')")
    main = main.select(F.col("record_id").alias("capture_id"), F.struct("*").alias("response"))

    def beside(kind: str) -> DataFrame:
        own = records.where(F.col("record_type") == kind).select(
            F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields")).alias(kind)
        )
        return own.groupBy("capture_id").agg(F.min(kind).alias(kind))

    joined = main.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")
    return joined.select("capture_id", "request", "response", "metadata")


def field(metadata: Column, name: str) -> Column:
    """Value of a field of an assembled metadata record."""
    return F.filter(metadata["fields"], lambda f: f["key"] == name)[0]["value"]
