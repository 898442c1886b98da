"""Hard negatives by slot-decomposed selection.

For an anchor, each positive asks for the best-scoring rows of other labels in a
window of scores below its own. The windows overlap; their upper limits cut the
scores into disjoint slots. Every block of rows keeps the best `negatives` rows of
each slot, the slots of all blocks are merged, and the best rows at or under a
positive's upper limit are those of its slot and the slots below, merged in
descending order. A lower limit only cuts that list short.

Anchors meet rows in blocks of bounded size: the anchors of a block are multiplied
with the rows of a block in one task, and what leaves it is a few rows an anchor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.sources.session import pin

#: Rows and anchors of one block, and anchors multiplied at a time.
ROWS = 8192
ANCHORS = 2048
_STEP = 256


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component as double; null where the vector or a component is missing or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    return F.when(vector.isNotNull() & ~odd, whole)


def _matrix(table: pa.Table, column: str = "v", width: int | None = None) -> np.ndarray:
    """Vectors of a block; shorter ones are filled with zeros."""
    lists = table.column(column).combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both as int64."""
    most = max(1, a.shape[1]) * _largest(a) * _largest(b)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise ValueError("inner products of these vectors may pass 64 bits")


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0))))


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` highest scores; of equal ones the first."""
    where = np.arange(len(scores))
    if len(scores) > count:
        where = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
    return where[np.argsort(-scores[where], kind="stable")[:count]]


def _pairs(anchors: pa.Table, rows: pa.Table):
    """(anchor number, scores against all rows) and the rows' ids and labels, rows by ascending id."""
    rows = rows.sort_by("id")
    b = _matrix(rows)
    a = _matrix(anchors, width=b.shape[1])
    if a.shape[1] > b.shape[1]:
        b = _matrix(rows, width=a.shape[1])

    def scored():
        for at in range(0, len(a), _STEP):
            block = products(a[at : at + _STEP], b)
            for i, scores in enumerate(block):
                yield at + i, scores

    return scored(), rows.column("id").to_numpy(), rows.column("label").to_numpy()


def _table(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*found, strict=True) if found else [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _positives(count: int) -> Callable:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(anchors) and len(rows):
            scored, ids, labels = _pairs(anchors, rows)
            own, kinds = anchors.column("id").to_pylist(), anchors.column("label").to_numpy()
            for i, scores in scored:
                same = np.flatnonzero((labels == kinds[i]) & (ids != own[i]))
                for j in same[_best(scores[same], count)]:
                    found.append((own[i], int(ids[j]), int(scores[j])))
        return _table(found, ["anchor", "id", "score"], [pa.int64()] * 3)

    return run


def _slots(count: int) -> Callable:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(anchors) and len(rows):
            scored, ids, labels = _pairs(anchors, rows)
            own, kinds = anchors.column("id").to_pylist(), anchors.column("label").to_numpy()
            uppers, least = anchors.column("uppers").to_pylist(), anchors.column("least").to_pylist()
            for i, scores in scored:
                limits = np.array(uppers[i], np.int64)
                here = np.flatnonzero((scores <= limits[0]) & (scores >= least[i]) & (labels != kinds[i]))
                inside = scores[here]
                slot = np.searchsorted(-limits, -inside, side="right") - 1
                for s in np.unique(slot):
                    of = np.flatnonzero(slot == s)
                    for j in of[_best(inside[of], count)]:
                        found.append((own[i], int(s), int(ids[here[j]]), int(inside[j])))
        return _table(found, ["anchor", "slot", "id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], work: Callable, schema: str) -> DataFrame:
    """`work` on every block of anchors with every block of rows."""
    a, r = blocks
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both come from one table: names of their own keep them apart
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("a", place(a)).withColumn("r", every(r))
    right = rows.withColumn("r", place(r)).withColumn("a", every(a))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(work, schema)


def _first(df: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The `count` highest-scoring rows of each key; of equal ones those of smaller id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "v",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    block_rows: int = ROWS, block_anchors: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vector` holds whole numbers (see `scaled`); a row's score is its inner product with the anchor, higher
    is better, ties fall to the smaller key. Anchors are the rows where `anchor` holds, their positives the first
    `positives` other rows of the same label, and a positive's negatives the first `negatives` rows of another
    label whose score lies between `low` and `high` percent of the positive's. Rows with a null key, label or vector
    take no part; of rows that share a key the one with the smallest label, then vector, counts; a shorter vector is
    filled with zeros. An anchor without positives, and a positive without negatives, gives no rows, as does an empty
    table; other columns are ignored. Products that may pass 64 bits are an error.
    """
    held = rows.select(
        F.col(key).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), F.col(vector).alias("v")).alias("s"),
        anchor.alias("anchor"),
    )
    held = held.where("id is not null and s.label is not null and s.v is not null")
    held = held.groupBy("id").agg(F.min(F.struct("s", "anchor")).alias("m"))
    held = pin(held.select("id", "m.s.label", "m.s.v", "m.anchor"))
    chosen, held = held.where("anchor").drop("anchor"), held.drop("anchor")
    blocks = 1 + chosen.count() // block_anchors, 1 + held.count() // block_rows

    near = _meet(chosen, held, blocks, _positives(positives), "anchor long, id long, score long")
    near = pin(_first(near, ["anchor"], positives))
    # floor and ceiling in whole numbers
    upper = F.expr(f"({high}L * score - pmod({high}L * score, 100L)) div 100L")
    lower = F.expr(f"({low}L * score + pmod(-({low}L * score), 100L)) div 100L")
    near = near.select("anchor", F.col("id").alias("positive"), "score", upper.alias("upper"), lower.alias("lower"))
    limits = near.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("least")
    )
    limited = chosen.join(limits, F.col("id") == F.col("anchor")).drop("anchor")
    found = _meet(limited, held, blocks, _slots(negatives), "anchor long, slot int, id long, score long")
    slots = _first(found, ["anchor", "slot"], negatives)
    # at most positives * negatives rows an anchor, best first
    best = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), "id"))).alias("best")
    slots = slots.groupBy(F.col("anchor").alias("owner")).agg(best)
    asked = near.join(limits.select(F.col("anchor").alias("of"), "uppers"), F.col("anchor") == F.col("of"))
    asked = asked.join(slots, F.col("anchor") == F.col("owner"))
    suffix = F.slice(F.filter("best", lambda x: x["slot"] >= F.array_position("uppers", F.col("upper")) - 1), 1, negatives)
    answer = F.filter(suffix, lambda x: -x["minus"] >= F.col("lower"))
    asked = asked.select("anchor", "positive", "score", F.posexplode(answer).alias("at", "n"))
    return asked.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("at") + 1).alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("n.minus")).alias("negative_score"),
    )
