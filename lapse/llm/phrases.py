"""Phrase collocations by SON partitioning.

Documents are dealt over `shards`. A phrase with `support` occurrences has
ceil(support / shards) in some shard, so each shard is mined completely at that
lower support, the locally frequent phrases are united, and one more pass counts
the united candidates exactly. Within a shard mining is level-wise: a phrase is
looked at only if the two phrases one word shorter are candidates themselves.

A shard is as large as the cluster, not as a task: tasks count whole batches of
texts, and the counts of a shard meet in a shuffle by phrase hash. Candidates are
told to the tasks by bitmaps of a fixed size; what they let through by chance is
counted and then dropped by its exact count, so a full bitmap costs time only.
Texts are counted by their words, never by their hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import bitmap, by_bytes, held, utf8
from lapse.sources.session import pin

#: Characters that end a piece (a fixed value); among bytes, all become this one.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_BORDER = b"."
_FOLD = bytes.maketrans(
    SEPARATORS + bytes(range(ord("A"), ord("Z") + 1)),
    _BORDER * len(SEPARATORS) + bytes(range(ord("a"), ord("z") + 1)),
)
_BATCH = 8 << 20
#: Bits of a phrase's hash that are shuffled; phrases that share them are candidates together.
_HASH = np.uint64(2**48 - 1)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with a border token where a piece ends."""
    return text.translate(_FOLD).replace(_BORDER, b" . ").split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _groups(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, list[bytes]]]:
    """Texts of a batch by the values of the columns `by`."""
    found: dict[tuple, list[bytes]] = {}
    keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
    for key, text in zip(keys, utf8(batch, "text"), strict=True):
        found.setdefault(key, []).append(text)
    yield from found.items()


class Phrases:
    """The phrases that stand in some texts of one language: of one word at first, then longer ones."""

    def __init__(self, lang: str, texts: list[bytes]):
        found: list[bytes] = [_BORDER]
        for text in texts:
            found += tokens(text)
            found.append(_BORDER)
        number = dict.fromkeys(found)
        number = dict(zip(number, range(len(number)), strict=True))
        self.words = list(number)
        self.ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        hashes = _mix(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words)))
        self.size = 1
        #: By token: the hash of the phrase that begins there, and whether one does.
        self.first = self.hashes = hashes[self.ids]
        self.stands = self.ids != number[_BORDER]

    def keep(self, bits: np.ndarray) -> None:
        """Only phrases that may be in the bitmap."""
        at = np.flatnonzero(self.stands)
        self.stands[at] = held(bits, self.hashes[at])

    def longer(self) -> None:
        """One word more; both shorter parts have to stand."""
        self.stands = self.stands[:-1] & self.stands[1:]
        self.hashes = _mix(self.hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.first[self.size :])
        self.size += 1

    def counted(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct phrases by their words, and how often each stands."""
        at = np.flatnonzero(self.stands)
        parts = [self.ids[at + j] for j in range(self.size)]
        bits = max(1, len(self.words).bit_length())
        if bits * self.size < 64:
            key = parts[0]
            for part in parts[1:]:
                key = key << bits | part
            key, counts = np.unique(key, return_counts=True)
            parts = [key >> bits * (self.size - 1 - j) & (1 << bits) - 1 for j in range(self.size)]
        else:
            rows, counts = np.unique(np.stack(parts), axis=1, return_counts=True)
            parts = list(rows)
        names = [[self.words[i] for i in part.tolist()] for part in parts]
        return list(map(b" ".join, zip(*names, strict=True))), counts


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", _BATCH):
        for (lang,), texts in _groups(batch, ["lang"]):
            counts: Counter = Counter()
            for text in texts:
                counts.update(tokens(text))
            counts.pop(_BORDER, None)
            yield _counted(lang, list(counts), list(counts.values()))


def _counted(lang: str, phrases: list[bytes], counts) -> pa.RecordBatch:
    names = pa.array(phrases, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(phrases), pa.string()), names, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"]
    )


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds: dict[str, int] = {}
    for batch in batches:
        langs, found = batch.column("lang").to_pylist(), []
        for lang, word in zip(langs, utf8(batch, "phrase"), strict=True):
            if lang not in seeds:
                seeds[lang] = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
            found.append(xxhash.xxh3_64_intdigest(word, seeds[lang]))
        hashes = _mix(np.array(found, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])


def _miner(filters: list) -> Callable:
    """Counts of the phrases in a batch that are a word longer than the last filter's; a key is the shard and 48 bits of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            for (lang, shard), texts in _groups(batch, ["lang", "shard"]):
                found = Phrases(lang, texts)
                for bits in filters:
                    found.keep(bits.value)
                    found.longer()
                keys = (found.hashes[found.stands] & _HASH) | np.uint64(shard << 48)
                keys, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], names=["h", "n"]
                )

    return run


def _phrase_counter(filters: list) -> Callable:
    """Counts of the candidates of a batch, by language and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _BATCH):
            for (lang,), texts in _groups(batch, ["lang"]):
                found = Phrases(lang, texts)
                found.keep(filters[0].value)
                for bits in filters[1:]:
                    found.longer()
                    found.keep(bits.value)
                    yield _counted(lang, *found.counted())

    return run


def frequent(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, support: int = 10, shards: int = 3,
    filter_bits: int = 1 << 26,
) -> tuple[DataFrame, DataFrame]:
    """Two tables: (lang, phrase, f) of every phrase of 1 to `max_words` words with f >= `support`, and
    (lang, n), all word occurrences. A null `lang` is `und`; null texts have no words."""
    named = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    if not 1 <= shards < 1 << 15:
        raise ValueError("a shard's number has 15 bits")
    docs = docs.select(named.alias("lang"), F.col(text).alias("text")).where("text <> ''")
    context = docs.sparkSession.sparkContext
    counted = "lang string, phrase string, f long"
    words = docs.mapInArrow(_word_counter, counted).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = pin(words)
    often = words.where(F.col("f") >= support)
    filters = [context.broadcast(bitmap(often.mapInArrow(_word_hashes, "h long"), "h", filter_bits))]
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    local = -(-support // shards)
    while len(filters) < max_words:
        mined = dealt.mapInArrow(_miner(list(filters)), "h long, n int").groupBy("h")
        found = mined.agg(F.sum("n").alias("n")).where(F.col("n") >= local).select("h")
        filters.append(context.broadcast(bitmap(found, "h", filter_bits)))
    phrases = docs.mapInArrow(_phrase_counter(filters), counted).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    phrases = phrases.where(F.col("f") >= support)
    return pin(often.union(phrases)), words.groupBy("lang").agg(F.sum("f").alias("n"))


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, support: int = 10, shards: int = 3,
    inside: int = 50, top: int = 2000, filter_bits: int = 1 << 26,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `max_words` words.

    Texts are lower-cased (A-Z), cut into pieces at `SEPARATORS` and those into words at spaces and tabs.
    a is a phrase's number of occurrences, overlaps included; cut after its first k words, l and r are those
    of its two parts, and floor(1000000 a a / (l r)) of the lowest-scoring cut (ties: the smallest k) is its
    score, in exact decimals. A phrase goes that lies inside a longer frequent one with at least `inside`
    percent of its occurrences. Ties in score fall to the larger a, then to the smaller phrase in UTF-8.
    Null languages are `und`; null, empty and wordless texts count nothing; rows that repeat count as often
    as they do; an empty table gives no rows; other columns are ignored.
    """
    counts, totals = frequent(docs, text, lang, max_words, support, shards, filter_bits)
    phrases = counts.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))
    phrases = phrases.where("size > 1")
    counted = lambda name: counts.select(
        F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(name)
    )
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("first", _part(F.col("words"), 1, F.col("k")))
    cuts = cuts.withColumn("rest", _part(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")))
    for name, column in (("l", "first"), ("r", "rest")):
        same = (F.col("lang") == F.col(f"{name}_lang")) & (F.col(column) == F.col(f"{name}_phrase"))
        cuts = cuts.join(counted(name), same)
    # a <= l, r < 10^16: products have at most 38 digits
    exact = "(cast(1000000 as decimal(7,0)) * (cast(f as decimal(16,0)) * cast(f as decimal(16,0))))"
    score = F.expr(f"{exact} div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))").cast("long")
    best = cuts.select("lang", "phrase", F.col("f").alias("a"), F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    longer = phrases.where("size > 2").select(
        "lang", "f", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"), "size"
    )
    longer = longer.select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    around = longer.groupBy(F.col("lang").alias("o_lang"), _part(F.col("words"), F.col("at"), F.col("m")).alias("o_phrase"))
    around = around.agg(F.max("f").alias("outer"))
    kept = best.join(around, (F.col("lang") == F.col("o_lang")) & (F.col("phrase") == F.col("o_phrase")), "left")
    kept = kept.where(F.col("outer").isNull() | (100 * F.col("outer") < inside * F.col("a")))
    order = F.desc("score"), F.desc("a"), "phrase"
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # the best of each of 16 parts first: one task sees at most 16 * top rows of a language
    part = F.pmod(F.xxhash64("phrase"), F.lit(16)).alias("part")
    ranked = ranked.select("*", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)).alias("rank"))
    ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
