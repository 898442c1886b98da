"""Document fingerprints by a homomorphic multiset hash.

Every paragraph is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, lane by lane, modulo 2^16. Sums do not depend on order,
and a paragraph is inserted or deleted by adding or subtracting its vector. The
vector has two parts:

* `EXACT` lanes of uniform 16-bit numbers decide equality (512 bits);
* `SIGNED` lanes of plus or minus the paragraph's weight, read as signed numbers.
  For two documents the dot product of these lanes estimates the weight they
  share, so the same sums also tell likeness.

Paragraphs are the \\n-separated lines; a line longer than `PIECE` characters counts
as several paragraphs, cut after every sentence end that makes them long enough.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from lapse.llm.common import by_bytes

EXACT = 32
SIGNED = 128
LANES = EXACT + SIGNED
#: Characters after which a long paragraph is cut at the next sentence end.
PIECE = 200
_PARAGRAPH = re.compile(r"[^\n]{%d,}?[.!?](?=\s)|[^\n]+" % PIECE)


def paragraphs(text: str, first: int = 0) -> Iterator[tuple[int, int]]:
    """Offsets of the paragraphs that start at `first` (itself the start of one) or later."""
    for m in _PARAGRAPH.finditer(text, first):
        yield m.span()


def vector(paragraph: str) -> np.ndarray:
    """Lanes of one paragraph. Its weight is the square root of its length: what two texts share is
    then counted in characters."""
    data = hashlib.shake_128(paragraph.encode("utf-8", "surrogatepass")).digest(2 * EXACT + SIGNED // 8)
    lanes = np.empty(LANES, np.uint16)
    lanes[:EXACT] = np.frombuffer(data, "<u2", EXACT)
    signs = np.unpackbits(np.frombuffer(data, np.uint8, SIGNED // 8, 2 * EXACT)).astype(np.int64)
    weight = max(1, round(min(len(paragraph), 10_000) ** 0.5))
    lanes[EXACT:] = ((2 * signs - 1) * weight).astype(np.uint16)
    return lanes


def fingerprint(text: str, first: int = 0) -> np.ndarray:
    """Sum of the vectors of the paragraphs from offset `first` on; zero for none."""
    total = np.zeros(LANES, np.uint16)
    for start, end in paragraphs(text, first):
        total += vector(text[start:end])
    return total


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of the signed lanes, 0 where it is negative."""
    if (a == b).all():
        return 1.0
    x, y = (v[EXACT:].view(np.int16).astype(float) for v in (a, b))
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def replace_tail(text: str, own: np.ndarray, cut: int, tail: str) -> tuple[str, np.ndarray]:
    """The text with everything from offset `cut` on replaced, and its fingerprint from the old one:
    paragraphs that end before the cut keep their share, the others are deleted and inserted anew."""
    edited = text[:cut] + tail
    # a paragraph is settled if text beyond its end was already seen when it was cut
    safe, total = 0, own.copy()
    for start, end in paragraphs(text):
        if end + 1 < cut:
            safe = end
            continue
        total -= vector(text[start:end])
    return edited, total + fingerprint(edited, safe)


def to_hex(v: np.ndarray) -> str:
    return v.astype(">u2").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `fingerprint string` (hex), every column kept (a clashing one is replaced). Null text: as empty."""
    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            found = pa.array([to_hex(fingerprint(t or "")) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("fingerprint string").fields]))


def edited_with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The edited text is the text with its last quarter (code points, rounded down) replaced by the
    first as many of the next document, by ascending key (null first; ties by text); after the last
    comes the first. A single document is its own next one. Null text: as empty.

    Keys are cut into four ranges per task (of `parts` tasks) at their quantiles. Rows go to their
    range and are read in order, each with the next; the first rows of a range also go to the range
    before it. So a text is shuffled once and a task holds two at a time, however long the table.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = 4 * parts
    cuts = docs.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    cuts = sorted({int(c) for c in cuts})
    part = F.when(F.col("key").isNull(), F.lit(0))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # the cuts are literals, so a retried task deals its rows alike
    part = part.otherwise(F.size(F.filter(bounds, lambda c: c <= F.col("key")))).cast("int")
    docs = docs.withColumn("part", part)
    lows = docs.groupBy("part").agg(
        F.min("key").alias("low"), F.max(F.col("key").isNull()).alias("no_key")
    ).orderBy("part").collect()
    if not lows:
        return docs.sparkSession.createDataFrame([], _schema(key, docs.schema["key"].dataType))
    # (range, its least key, the range before it); the last range is before the first
    firsts = [(r["part"], None if r["no_key"] else r["low"], lows[i - 1]["part"]) for i, r in enumerate(lows)]
    kind = docs.schema["key"].dataType.simpleString()
    edges = spark.createDataFrame(firsts, f"_part int, _low {kind}, _before int")
    guests = docs.join(F.broadcast(edges), (F.col("part") == F.col("_part")) & F.col("key").eqNullSafe(F.col("_low")))
    guests = guests.select("key", "text", F.col("_before").alias("part"), F.lit(True).alias("guest"))
    dealt = docs.withColumn("guest", F.lit(False)).unionByName(guests).repartition(parts, "part")
    dealt = dealt.sortWithinPartitions("part", "guest", F.col("key").asc_nulls_first(), "text")
    return dealt.mapInArrow(_paired(key), _schema(key, docs.schema["key"].dataType))


def _schema(key: str, kind: DataType) -> StructType:
    rest = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return StructType([StructField(key, kind), *StructType.fromDDL(rest).fields])


def _paired(key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in by_bytes(batches, "text"):
            keys, rows = [], []
            for i, (part, guest, text) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "text")), strict=True)
            ):
                if guest and (held is None or held[0] != part):
                    continue  # a further guest
                own = fingerprint(text)
                if held is not None:
                    _, held_key, held_text, held_own = held
                    keys.append(held_key)
                    rows.append(_row(held_text, held_own, text, own))
                held = None if guest else (part, batch.column("key")[i], text, own)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k.as_py() for k in keys], batch.schema.field("key").type),
                    *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                ],
                names=names,
            )

    return run


def _row(text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    gone = len(text) // 4
    edited, print_ = replace_tail(text, own, len(text) - gone, following[:gone])
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, to_hex(own), to_hex(print_), likeness(own, print_), likeness(own, next_own)
