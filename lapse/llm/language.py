"""Language identification with language-bitmask n-gram filters.

Training keeps, per language, the commonest letter n-grams, as many as cover most
of what was seen of the language, and sets their bits in
a bit-sliced Bloom filter: one table of `slots` bit masks, of as many words as
there are 64 languages, in which bit l belongs to language l. Looking up an n-gram reads `HASHES` masks and ANDs them, which
gives every language that contains it at once. Per document the set bits are
counted by language; each count is corrected for that language's false-positive
rate, and the largest corrected share decides. Labelled rows that a first fit has
not seen tell how low the share of a language's own documents can be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lapse.llm.common import by_bytes
from lapse.sources.session import pin

ORDERS = (3, 4)
HASHES = 3
#: Bits of one word of a mask; a mask has as many words as the languages need.
WORD = 64
UNKNOWN = "und"
#: An n-gram list holds so much of a language's sampled occurrences, whatever its length.
COVERAGE = 0.9
#: A document in none of the learned languages has less than half its n-grams in any of their filters.
LEAST_SCORE = 0.5
#: Rows the first fit does not see are one in `FOLDS`; their 5 % point times `LEAST_SHARE` is a language's limit.
FOLDS = 5
LEAST_SHARE = 0.6
#: Code points worked on at a time: arrays take some hundred bytes for each, whatever the length of a text.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Model:
    """`languages`, commonest first; the masks; each language's false-positive rate and the
    least score of its own documents, `LEAST_SCORE` or less."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false_rate: tuple[float, ...]
    least: tuple[float, ...] = ()


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Texts, long ones in pieces, a chunk at a time: (index of the text, piece)."""
    index, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHUNK):
            pieces.append(text[at : at + CHUNK])
            index.append(i)
            size += len(pieces[-1])
            if size >= CHUNK:
                yield np.array(index), pieces
                index, pieces, size = [], [], 0
    if pieces:
        yield np.array(index), pieces


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower case, each run of other characters one space;
    the first position of each text, and whether it has a letter."""
    joined = "".join(f" {t.lower()} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    letter = _letters()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), lengths)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    has = np.bincount(doc, letter, len(texts)) > 0
    starts = np.searchsorted(doc[keep], np.arange(len(texts)))
    return points[keep], starts, has


def _ngrams(points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash of each n-gram, its text), one pair of arrays per order; none crosses two texts."""
    doc = np.zeros(len(points), np.int64)
    doc[starts[1:]] = 1
    doc = np.cumsum(doc)
    for n in ORDERS:
        if len(points) < n:
            continue
        size = len(points) - n + 1
        h = np.full(size, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + size]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        whole = doc[:size] == doc[n - 1 :]
        yield h[whole], doc[:size][whole]


def _slots(h: np.ndarray, slots: int) -> list[np.ndarray]:
    turned = [h] + [h >> np.uint64(21 * k) | h << np.uint64(64 - 21 * k) for k in range(1, HASHES)]
    return [(t % np.uint64(slots)).astype(np.int64) for t in turned]


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = 2_000,
    ngrams_per_language: int = 20_000,
    slots: int = 1 << 20,
) -> Model:
    """Fit the filters to a bounded sample: about `rows_per_language` rows of each language,
    picked by a hash of `key`. Rows without text or language teach nothing; an empty
    table gives a model without languages. A language keeps its `ngrams_per_language` commonest
    n-grams, and more until `COVERAGE` of its occurrences are held; beyond that number the filter
    has more than `slots` masks, 16 for each n-gram of the longest list."""
    docs = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"))
    docs = docs.where("text is not null and lang is not null")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = tuple(r["lang"] for r in counts)
    if not languages:
        return Model((), np.zeros((slots, 1), np.uint64), ())
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    picked = F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            names = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), strict=True))
            of = {name: i for i, name in enumerate(sorted(set(names)))}
            number = np.array([of[name] for name in names])
            for index, pieces in _chunks(batch.column("text").to_pylist()):
                points, starts, _ = _folded(pieces)
                for h, doc in _ngrams(points, starts):
                    for (name, fold), i in of.items():
                        grams, n = np.unique(h[number[index[doc]] == i], return_counts=True)
                        columns = [pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)]
                        columns.append(pa.array(np.full(len(grams), fold)))
                        yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n", "fold"])

    sample = docs.where(picked).withColumn("fold", (F.xxhash64("h") % FOLDS == 0)).select("lang", "text", "fold")
    grams = sample.mapInArrow(count, "lang string, gram long, n long, fold boolean")
    grams = grams.groupBy("lang", "gram").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("fold"), 0).otherwise(F.col("n"))).alias("seen")
    )
    grams = pin(grams)
    model = _fit(grams, "n", languages, ngrams_per_language, slots)
    return replace(model, least=_least(sample.where("fold"), _fit(grams, "seen", languages, ngrams_per_language, slots)))


def _fit(grams: DataFrame, n: str, languages: tuple[str, ...], shortest: int, slots: int) -> Model:
    """Filters of each language's commonest n-grams by the counts `n`."""
    grams = grams.where(F.col(n) > 0)
    commonest = Window.partitionBy("lang").orderBy(F.desc(n), "gram")
    before = F.coalesce(F.sum(n).over(commonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grams = grams.withColumns({"r": F.row_number().over(commonest), "before": before})
    total = F.sum(n).over(Window.partitionBy("lang"))
    chosen = grams.withColumn("total", total).where((F.col("r") <= shortest) | (F.col("before") < COVERAGE * F.col("total")))
    chosen = chosen.select(F.array_position(F.lit(list(languages)), F.col("lang")).cast("int").alias("of"), "gram").toArrow()
    of, hashes = chosen.column("of").to_numpy() - 1, chosen.column("gram").to_numpy().view(np.uint64)
    longest = int(np.bincount(of).max()) if len(of) else 0
    while longest > shortest and slots < 16 * longest:
        slots *= 2
    width = next((w for w in (8, 16, 32) if len(languages) <= w), WORD)
    masks = np.zeros((slots, -(-len(languages) // WORD)), f"uint{width}")
    rates = []
    for i in range(len(languages)):
        word, bit = masks[:, i // WORD], masks.dtype.type(1 << i % WORD)
        for at in _slots(hashes[of == i], slots):
            word[at] |= bit
        rates.append(float((word & bit > 0).mean()) ** HASHES)
    return Model(languages, masks, tuple(rates))


def _least(rows: DataFrame, model: Model) -> tuple[float, ...]:
    """Each language's limit from its own rows' shares by a model that has not seen them; without rows `LEAST_SCORE`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    number = {name: i for i, name in enumerate(model.languages)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            share, has = _shares(batch.column("text").to_pylist(), shared.value)
            own = np.array([number[name] for name in batch.column("lang").to_pylist()], np.int64)
            columns = [batch.column("lang").filter(pa.array(has)), pa.array(share[np.arange(len(own)), own][has])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "own"])

    scored = rows.select("lang", "text").mapInArrow(score, "lang string, own double")
    low = {r["lang"]: r["low"] for r in scored.groupBy("lang").agg(F.percentile("own", F.lit(0.05)).alias("low")).collect()}
    return tuple(min(LEAST_SCORE, LEAST_SHARE * low.get(name, 1.0)) for name in model.languages)


def _shares(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Corrected share of known n-grams of each text by language, and whether it has a letter."""
    n = len(texts)
    total, hits, has = np.zeros(n), np.zeros((n, len(model.languages))), np.zeros(n, bool)
    for index, pieces in _chunks([t or "" for t in texts]):
        points, starts, lettered = _folded(pieces)
        np.logical_or.at(has, index, lettered)
        for h, piece in _ngrams(points, starts):
            doc, mask = index[piece], None
            for at in _slots(h, len(model.masks)):
                mask = model.masks[at] if mask is None else mask & model.masks[at]
            total += np.bincount(doc, minlength=n)
            for i in range(len(model.languages)):
                bit = mask.dtype.type(1 << i % WORD)
                hits[:, i] += np.bincount(doc[mask[:, i // WORD] & bit > 0], minlength=n)
    false = np.array(model.false_rate)
    share = (hits / np.maximum(total, 1)[:, None] - false) / np.maximum(1 - false, 1e-9)
    return np.clip(share, 0.0, 1.0), has


def classify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and corrected share of known n-grams of each text; the commoner language wins a tie."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    share, has = _shares(texts, model)
    best = share.argmax(1)
    score = share[np.arange(n), best]
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
    return names, np.where(has, score, 0.0)


def accepted(model: Model, lang: Column, score: Column) -> Column:
    """Whether a predicted language is known and the score not under that language's limit."""
    if not model.languages:
        return F.lit(False)
    least = dict(zip(model.languages, model.least, strict=True))
    limits = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    return F.coalesce(score >= limits[lang], F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, every column kept (a clashing one is replaced).

    Null texts and texts without a letter: `und`, 0. A text none of whose n-grams is known:
    the commonest training language, 0. A model without languages: `und`, 0.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("lang_pred string, score double").fields])
    return docs.mapInArrow(_predictor(shared, text), schema)


def _predictor(shared, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, 4 << 20):
            names, score = classify(batch.column(text).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score)],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return run
