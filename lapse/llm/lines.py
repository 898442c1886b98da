"""Removal of repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of the last `window` lines decides where a chunk
ends: after a line of w words with a chance of w / `target_words`. So the cuts
depend on the lines around them and not on where a passage stands in its document.

Chunks that stand more than once in the corpus are seeds. A seed names one
occurrence, the first of its chunk, and is extended line by line along it in both
directions. Extended seeds that name the same occurrence line for line and touch
are one run; a run with enough words goes if its whole text equals, byte by byte,
the lines it names. Lines that may go themselves are no reference: a run is
shortened to the lines whose named lines stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lapse.llm.common import bitmap, by_bytes, free_name, held, utf8
from lapse.sources.session import pin

_MASK = 2**64 - 1
_BASE = 0x9E3779B97F4A7C15
Span = tuple[int, int]


@dataclass(frozen=True)
class Chunking:
    """A run goes that has `min_words` words in two lines or more, or a line of `long_words` words."""

    window: int = 2
    target_words: int = 8
    #: A chunk of fewer words is no seed.
    seed_words: int = 4
    long_words: int = 32
    min_words: int = 16
    #: Lines that one seed is extended by on either side; a longer passage holds further seeds.
    reach: int = 16
    #: Bits of the filters that spare chunks and texts a shuffle; their size does not grow with the input.
    filter_bits: int = 1 << 25


def chunks(lines: list[bytes], hashes: list[int], rule: Chunking) -> list[Span]:
    """(first line, line after the last) of the chunks that are seeds."""
    out = pow(_BASE, rule.window, 1 << 64)
    found: list[Span] = []
    start = words = rolled = 0
    for i, line in enumerate(lines):
        n = len(line.split())
        rolled = (rolled * _BASE + hashes[i]) & _MASK
        if i >= rule.window:
            rolled = (rolled - hashes[i - rule.window] * out) & _MASK
        words += n
        if (rolled >> 32) % rule.target_words < n:
            if words >= rule.seed_words:
                found.append((start, i + 1))
            start, words = i + 1, 0
    if words >= rule.seed_words:
        found.append((start, len(lines)))
    return found


def joined(spans: list[tuple]) -> list[tuple]:
    """(occurrence, first, end) spans that touch along the same occurrence, joined."""
    found: list[tuple] = []
    for where, first, end in sorted(spans):
        if found and found[-1][0] == where and first <= found[-1][2]:
            found[-1] = (where, found[-1][1], max(found[-1][2], end))
        else:
            found.append((where, first, end))
    return found


def enough(words: list[int], rule: Chunking) -> bool:
    """Whether lines of so many words are worth removing."""
    return sum(words) >= (rule.min_words if sum(n > 0 for n in words) > 1 else rule.long_words)


def staying(first: int, end: int, taken: list[Span]) -> list[Span]:
    """The parts of first..end outside the spans `taken`."""
    found: list[Span] = []
    for a, b in sorted(taken):
        if a > first:
            found.append((first, min(a, end)))
        first = max(first, b)
    found.append((first, end))
    return [(a, b) for a, b in found if a < b]


def _digest(lines: list[bytes]) -> int:
    return xxhash.xxh3_128_intdigest(b"\n".join(lines) if len(lines) > 1 else lines[0])


def _seeds(text: bytes, rule: Chunking) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Hashes of the lines, and (first line, line after the last, 128-bit hash) of the seeds."""
    lines = text.split(b"\n")
    hashes = list(map(xxhash.xxh3_64_intdigest, lines))
    return hashes, [(a, b, _digest(lines[a:b])) for a, b in chunks(lines, hashes, rule)]


def _long(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _counter(rule: Chunking) -> Callable:
    """Counts of the seeds of a batch by half of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8 << 20):
            found = [h & _MASK for text in utf8(batch, "text") for _, _, h in _seeds(text, rule)[1]]
            lo, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lo.view(np.int64)), pa.array(n)], names=["lo", "n"])

    return run


def _occurrences(rule: Chunking, bits) -> Callable:
    """Seeds that may be repeated, with the hashes of the lines before and after them, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            rows, found = [], []
            for i, text in enumerate(utf8(batch, "text")):
                hashes, seeds = _seeds(text, rule)
                if not seeds:
                    continue
                passed = held(bits.value, np.array([h & _MASK for _, _, h in seeds], np.uint64))
                for (a, b, h), repeated in zip(seeds, passed, strict=True):
                    if repeated:
                        rows.append(i)
                        before = hashes[max(0, a - rule.reach) : a][::-1]
                        found.append((a, b, h & _MASK, h >> 64, before, hashes[b : b + rule.reach]))
            a, b, lo, hi, before, after = zip(*found, strict=True) if found else ((),) * 6
            lists = [pa.array([[x - 2**64 if x >> 63 else x for x in xs] for xs in side], pa.list_(pa.int64())) for side in (before, after)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _long(lo), _long(hi), *lists],
                names=["doc", "first", "end", "lo", "hi", "before", "after"],
            )

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A seed and the occurrence it names to the lines on which both agree."""

    def same(a: list[int], b: list[int]) -> int:
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    for batch in batches:
        before, after, r_before, r_after = (batch.column(c).to_pylist() for c in ("before", "after", "r_before", "r_after"))
        first, end, r_first = (batch.column(c).to_numpy() for c in ("first", "end", "r_first"))
        back = np.array([same(a, b) for a, b in zip(before, r_before, strict=True)], np.int64)
        on = np.array([same(a, b) for a, b in zip(after, r_after, strict=True)], np.int64)
        made = [pa.array(first - back), pa.array(end + on), pa.array(r_first - first)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("ref"), *made], names=["doc", "ref", "first", "end", "shift"]
        )


def _judge(rule: Chunking) -> Callable:
    """Runs of a text that have enough words, with their bodies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, None, 4 << 20):
            rows, found = [], []
            for i, (text, spans) in enumerate(zip(utf8(batch, "text"), batch.column("spans").to_pylist(), strict=True)):
                lines = text.split(b"\n")
                words = [len(x.split()) for x in lines]
                refs = {}
                for s in spans or ():
                    refs.setdefault((str(s["ref"]), s["shift"]), s["ref"])
                for (name, shift), a, b in joined([((str(s["ref"]), s["shift"]), s["first"], s["end"]) for s in spans or ()]):
                    if enough(words[a:b], rule):
                        rows.append(i)
                        found.append((a, b, refs[name, shift], shift, b"\n".join(lines[a:b])))
            a, b, ref, shift, body = zip(*found, strict=True) if found else ((),) * 5
            whole = [pa.array(x, pa.int64()) for x in (a, b, shift)]
            kind = batch.schema.field("doc").type
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(ref, kind), *whole, pa.array(body, pa.binary())],
                names=["doc", "ref", "first", "end", "shift", "body"],
            )

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines asked for of a text, and which of them stay."""
    for batch in by_bytes(batches, None, 4 << 20):
        rows, found = [], []
        columns = (utf8(batch, "text"), batch.column("asked").to_pylist(), batch.column("taken").to_pylist())
        for i, (text, asked, taken) in enumerate(zip(*columns, strict=True)):
            if asked:
                lines = text.split(b"\n")
                for s in asked:
                    a, b = s["a"], s["b"]
                    rows.append(i)
                    stay = staying(a, b, [(t["first"], t["end"]) for t in taken or ()])
                    found.append((a, b, b"\n".join(lines[a:b]), [{"a": x, "b": y} for x, y in stay]))
        a, b, body, stay = zip(*found, strict=True) if found else ((),) * 4
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(body, pa.binary()), pa.array(stay, kind)],
            names=["ref", "a", "b", "body", "stay"],
        )


def _told(wanted: DataFrame, column: str, rule: Chunking):
    """Broadcast bitmap of the documents in a column."""
    bits = bitmap(wanted.select(F.xxhash64(column).alias("h")), "h", rule.filter_bits)
    return wanted.sparkSession.sparkContext.broadcast(bits)


def _among(bits, mark: str, inside: bool) -> Callable:
    """Rows whose hash `mark` may be in the bitmap, or those whose hash is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = held(bits.value, batch.column(mark).to_numpy().view(np.uint64)) == inside
            yield batch.filter(pa.array(chosen))

    return run


def removals(docs: DataFrame, rule: Chunking) -> DataFrame:
    """(doc, gone): the spans of lines that each of the documents (doc, text, _h) loses."""
    doc = docs.schema["doc"].dataType
    kind = doc.simpleString()
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_counter(rule), "lo long, n long").groupBy("lo").agg(F.sum("n").alias("n"))
    repeated = context.broadcast(bitmap(counted.where("n > 1").select("lo"), "lo", rule.filter_bits))
    schema = f"doc {kind}, first long, end long, lo long, hi long, before array<long>, after array<long>"
    seeds = pin(docs.select("doc", "text").mapInArrow(_occurrences(rule, repeated), schema))
    place = F.struct("doc", "first", "before", "after").alias("place")
    named = seeds.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")).where("n > 1")
    named = named.select(
        "lo", "hi", F.col("place.doc").alias("ref"), F.col("place.first").alias("r_first"),
        F.col("place.before").alias("r_before"), F.col("place.after").alias("r_after"),
    )
    # written, so that both sides of the join are dealt for it and the partition of a hot chunk can be split
    pairs = seeds.join(pin(named), ["lo", "hi"]).where((F.col("doc") != F.col("ref")) | (F.col("first") != F.col("r_first")))
    schema = f"doc {kind}, ref {kind}, first long, end long, shift long"
    spans = pairs.select("doc", "ref", "first", "end", "r_first", "before", "after", "r_before", "r_after").mapInArrow(_extended, schema)
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("ref", "first", "end", "shift")).alias("spans"))
    spans = pin(spans.select(F.col("doc").alias("_doc"), "spans"))

    touched = docs.mapInArrow(_among(_told(spans, "_doc", rule), "_h", True), docs.schema).dropDuplicates(["doc"])
    touched = touched.join(spans, (F.col("doc") == F.col("_doc"))).select("doc", "text", "spans")
    runs = pin(touched.mapInArrow(_judge(rule), f"doc {kind}, ref {kind}, first long, end long, shift long, body binary"))

    taken = runs.groupBy(F.col("doc").alias("t_doc")).agg(F.collect_set(F.struct("first", "end")).alias("taken"))
    asked = runs.select("ref", (F.col("first") + F.col("shift")).alias("a"), (F.col("end") + F.col("shift")).alias("b")).distinct()
    asked = asked.groupBy(F.col("ref").alias("a_doc")).agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    asked = pin(asked.join(taken, (F.col("a_doc") == F.col("t_doc")), "left").drop("t_doc"))
    sources = docs.mapInArrow(_among(_told(asked, "a_doc", rule), "_h", True), docs.schema).dropDuplicates(["doc"])
    sources = sources.join(asked, (F.col("doc") == F.col("a_doc"))).select("doc", "text", "asked", "taken")
    bodies = sources.mapInArrow(_bodies, f"ref {kind}, a long, b long, body binary, stay array<struct<a:long,b:long>>")
    bodies = pin(bodies.where("size(stay) > 0").withColumnRenamed("ref", "b_ref").withColumnRenamed("body", "b_body"))

    # the whole run, byte by byte, against the one occurrence it names
    same = (
        (F.col("ref") == F.col("b_ref")) & (F.col("first") + F.col("shift") == F.col("a"))
        & (F.col("end") + F.col("shift") == F.col("b")) & (F.col("body") == F.col("b_body"))
    )
    sure = runs.join(bodies, same).select("doc", "shift", F.explode("stay").alias("s"))
    span = F.struct((F.col("s.a") - F.col("shift")).alias("a"), (F.col("s.b") - F.col("shift")).alias("b"))
    return sure.groupBy("doc").agg(F.collect_set(span).alias("gone"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Chunking | None = None) -> DataFrame:
    """`docs` without repeated runs of lines: `text` shortened, `lines_removed` added (a clashing column is replaced).

    Documents stand in the order of their keys (a null key comes first; rows that share a key in the order of a hash of
    their texts), and a run that goes still stands, whole, in an earlier document or earlier in its own. Rows that
    repeat key and text count as one document and lose the same lines. Null text stays null, empty text stays empty;
    a text with no line left that is not blank becomes empty. Documents without repeated runs are unchanged; an empty
    table gives no rows.
    """
    rule = rule or Chunking()
    docs = docs.drop("lines_removed")
    doc = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("th"))
    plain = docs.where(F.col(text).isNotNull()).select(doc.alias("doc"), F.col(text).alias("text"))
    gone = pin(removals(plain.withColumn("_h", F.xxhash64("doc")), rule))
    own, mark, found = free_name(docs, "_doc"), free_name(docs, "_h"), free_name(docs, "_gone")
    bits = _told(gone, "doc", rule)
    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]
    schema = StructType([*fields, StructField("lines_removed", LongType())])

    def chosen(inside: bool) -> DataFrame:
        hashed = docs.withColumn(mark, F.xxhash64(doc))
        return hashed.mapInArrow(_among(bits, mark, inside), hashed.schema).drop(mark)

    cut = chosen(True).withColumn(own, doc)
    cut = cut.join(gone.select(F.col("doc").alias(found + "_doc"), F.col("gone").alias(found)), F.col(own) == F.col(found + "_doc"), "left")
    cut = cut.drop(own, found + "_doc").mapInArrow(_cutter(rule, text, found), schema)
    return cut.union(chosen(False).withColumn("lines_removed", F.lit(0).cast("long")).select(schema.names))


def without(text: str, gone: list[Span], rule: Chunking) -> tuple[str, int]:
    """The text without those of the spans that have enough words, and the number of lines that went."""
    lines: list[str | None] = list(text.split("\n"))
    words = [len(x.encode("utf-8", "surrogatepass").split()) for x in lines]
    out = {i for a, b in gone if enough(words[a:b], rule) for i in range(a, b)}
    if out and not any(n for i, n in enumerate(words) if i not in out):
        return "", len(lines)
    return "\n".join(x for i, x in enumerate(lines) if i not in out), len(out)


def _cutter(rule: Chunking, column: str, gone: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, None, 4 << 20):
            texts, spans = batch.column(column).to_pylist(), batch.column(gone).to_pylist()
            done = [
                (t, 0) if t is None or not s else without(t, [(x["a"], x["b"]) for x in s], rule)
                for t, s in zip(texts, spans, strict=True)
            ]
            names = [n for n in batch.schema.names if n != gone]
            columns = [pa.array([t for t, _ in done], pa.string()) if n == column else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([n for _, n in done], pa.int64())], names=[*names, "lines_removed"]
            )

    return run
