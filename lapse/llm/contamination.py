"""Benchmark decontamination by winnowing.

Of every `window` successive k-grams the one with the least hash (the last, in a
tie) is a fingerprint. The same choice is made wherever the same words stand, so a
span of window + k - 1 words that a document shares with an item holds a
fingerprint of both. A document's fingerprints are looked up among the items', and
a hit is extended to all spans around it, which are joined with the items' spans
by 128-bit hashes. An item shorter than a span is one span of its own length: its
fingerprint is its only k-gram, k being its length, and every such k-gram of a
document is looked up.

Look-ups use bitmaps of a fixed size, so text that no item has costs no shuffle; a
full bitmap lets more through to the join and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lapse.llm.common import bitmap, by_bytes, held, utf8
from lapse.sources.session import pin

_BATCH = 4 << 20
#: Word characters are 0-9, a-z and all beyond ASCII; upper case folds, the others separate.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Spans:
    """Hashes of the word spans of some texts, laid end to end."""

    def __init__(self, texts: list[bytes]):
        found = [words(t) for t in texts]
        self.counts = np.array([len(w) for w in found], np.int64)
        flat = [w for ws in found for w in ws]
        number = dict.fromkeys(flat)
        both = [xxhash.xxh3_128_intdigest(w) for w in number]
        halves = [
            np.fromiter((x >> shift & 0xFFFFFFFFFFFFFFFF for x in both), np.uint64, len(both)) for shift in (0, 64)
        ]
        number = dict(zip(number, range(len(number)), strict=True))
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        self.hashes = [h[ids] for h in halves]
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.start = np.concatenate([[0], np.cumsum(self.counts)])

    def of(self, size: int, half: int) -> np.ndarray:
        """Hash of the span of `size` words at each word; spans that leave their text are not told apart."""
        h, n = self.hashes[half], max(0, len(self.text) - size + 1)
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out = out * np.uint64(_BASES[half]) + h[j : n + j]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(_BASES[1 - half])
        return out ^ (out >> np.uint64(29))

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which spans of `size` words at the words `at` lie in one text."""
        return at + size <= self.start[self.text[at] + 1]


def fingerprints(hashes: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Words at which a fingerprint begins: the last least hash of each window (`whole`: it counts)."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[whole]
    at = np.flatnonzero(whole) + window - 1 - views[:, ::-1].argmin(1)
    return np.unique(at)


def _marks(spans: Spans, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the fingerprints of all texts of at least `span` words."""
    hashes = spans.of(k, 0)
    windows = max(0, len(hashes) - (span - k))
    at = fingerprints(hashes, spans.inside(np.arange(windows), span), span - k + 1)
    return at, hashes[at]


def _item_spans(span: int, k: int) -> Callable:
    """Of each item: its fingerprints (size 0) and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            spans = Spans(utf8(batch, "text"))
            _, marks = _marks(spans, span, k)
            made = [(np.zeros(len(marks), np.int64), np.full(len(marks), -1), marks, marks)]
            for size in sorted({min(span, int(n)) for n in spans.counts if n}):
                at = np.arange(max(0, len(spans.text) - size + 1))
                own = spans.counts[spans.text[at]]
                at = at[spans.inside(at, size) & ((own >= span) if size == span else (own == size))]
                made.append((np.full(len(at), size), spans.text[at], spans.of(size, 0)[at], spans.of(size, 1)[at]))
            size, text, lo, hi = (np.concatenate(c) for c in zip(*made, strict=True))
            item = batch.column("item").take(pa.array(text, mask=text < 0))
            hashes = [pa.array(h.view(np.int64)) for h in (lo, hi)]
            yield pa.RecordBatch.from_arrays([item, pa.array(size.astype(np.int32)), *hashes], names=["item", "size", "lo", "hi"])

    return run


def _candidates(key: str, span: int, k: int, sizes: list[int], marks, whole) -> Callable:
    """Per text its number of words and the spans that items may hold, with the words they begin at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            spans, made = Spans(utf8(batch, "text")), []
            if span in sizes and len(spans.text) >= span:
                at, hashes = _marks(spans, span, k)
                at = at[held(marks.value, hashes)]
                # a hit extends to every span around it
                near = np.unique(np.concatenate([at - d for d in range(span - k + 1)]))
                near = near[near >= 0]
                made.append((near[spans.inside(near, span)], span))
            for size in sizes:
                if size < span and len(spans.text) >= size:
                    at = np.arange(len(spans.text) - size + 1)
                    made.append((at[spans.inside(at, size)], size))
            yield _listed(batch, key, spans, made, whole.value)

    return run


def _listed(batch: pa.RecordBatch, key: str, spans: Spans, made: list, filled: np.ndarray) -> pa.RecordBatch:
    columns = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
    for at, size in made:
        lo = spans.of(size, 0)[at]
        passed = held(filled, lo)
        at, lo = at[passed], lo[passed]
        for column, part in zip(columns, (at, np.full(len(at), size), lo, spans.of(size, 1)[at]), strict=True):
            column.append(part)
    at, size, lo, hi = (np.concatenate(c) for c in columns)
    text = spans.text[at]
    order = np.lexsort((at, hi, lo, size, text))
    at, size, lo, hi, text = (c[order] for c in (at, size, lo, hi, text))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (size[1:] != size[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    first = np.flatnonzero(fresh)
    starts = pa.array(np.append(first, len(at)).astype(np.int32))
    places = pa.ListArray.from_arrays(starts, pa.array((at - spans.start[text]).astype(np.int32)))
    found = pa.StructArray.from_arrays(
        [pa.array(size[first].astype(np.int32)), pa.array(lo[first].view(np.int64)), pa.array(hi[first].view(np.int64)), places],
        names=["size", "lo", "hi", "at"],
    )
    ends = np.searchsorted(text[first], np.arange(batch.num_rows + 1))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), found)
    return pa.RecordBatch.from_arrays(
        [batch.column(key), pa.array(spans.counts), lists], names=[key, "n_words", "found"]
    )


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item: str = "item_id", span: int = 10, k: int = 5, salts: int = 8, filter_bits: int = 1 << 24,
) -> DataFrame:
    """(key, n_words, n_hit, items) of every row of `docs`: its words, those in any occurrence of an item's
    span of `span` words (or of a whole shorter item), and the ids of the items with such a span, sorted as strings.

    Words are runs of 0-9, a-z (A-Z folded) and characters beyond ASCII. Null and wordless texts hit nothing,
    null and wordless items are never hit; an item without an id marks words but is not listed, and ids that repeat
    are listed once. Rows of `docs` that repeat each get their own result. Empty tables give no rows or no hits;
    other columns are ignored. A span that many documents share is dealt over `salts` keys.
    """
    if not 1 <= k <= span:
        raise ValueError("a k-gram is not longer than a span")
    context = docs.sparkSession.sparkContext
    items = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    spans = pin(items.mapInArrow(_item_spans(span, k), f"item {kind}, size int, lo long, hi long").distinct())
    sizes = sorted(r["size"] for r in spans.where("size > 0").select("size").distinct().collect())
    marks = context.broadcast(bitmap(spans.where("size = 0"), "lo", filter_bits))
    spans = spans.where("size > 0")
    whole = context.broadcast(bitmap(spans, "lo", filter_bits))
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([
        StructField("key", docs.schema["key"].dataType),
        *StructType.fromDDL("n_words long, found array<struct<size:int,lo:long,hi:long,at:array<int>>>").fields,
    ])
    # numbered before it is written, so that every later job sees the same numbers
    listed = docs.mapInArrow(_candidates("key", span, k, sizes, marks, whole), schema)
    listed = pin(listed.withColumn("row", F.monotonically_increasing_id()))
    each = listed.where("size(found) > 0").select("row", "key", "n_words", F.explode("found").alias("s"))
    each = each.select("row", "key", "n_words", "s.*", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    owners = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("owned", F.lit(True))
    hits = each.join(owners, ["size", "lo", "hi", "salt"], "left")
    places = F.transform("at", lambda x: F.struct(x.alias("at"), (x + F.col("size")).alias("end")))
    summed = hits.groupBy("row", "key", "n_words").agg(
        F.flatten(F.collect_set(F.when(F.col("owned"), places))).alias("places"),
        F.array_sort(F.collect_set(F.when(F.col("owned"), F.col("item").cast("string")))).alias("items"),
    )
    summed = summed.select("key", "n_words", _covered(F.col("places")).alias("n_hit"), "items")
    none = listed.where("size(found) = 0").select(
        "key", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")
    )
    return summed.union(none).withColumnRenamed("key", key)


def _covered(places: Column) -> Column:
    """Words in any of the (at, end) intervals."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.array_sort(places),
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda done, x: F.struct(
            (done["n"] + F.greatest(zero, x["end"] - F.greatest(done["end"], x["at"].cast("long")))).alias("n"),
            F.greatest(done["end"], x["end"].cast("long")).alias("end"),
        ),
        lambda done: done["n"],
    )
