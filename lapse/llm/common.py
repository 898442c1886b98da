"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one window task in `row_index`.
ROWS_PER_CELL = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells_for(rows: int) -> int:
    return 1 + rows // ROWS_PER_CELL


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], cell: Column, cells: int, name: str
) -> DataFrame:
    """Add `name`: 0, 1, 2, ... without gaps within `keys`, however many rows a key has.

    Rows of a key are dealt over `cells` hash cells by `cell`; a row's number is
    its rank in its cell plus the rows of the cells before. Only the table of
    counts (one row per key and cell) sees a key whole. `df` is read twice.
    """
    df = df.withColumn("_cell", F.pmod(F.xxhash64(cell), F.lit(cells)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col("_cell") == F.col("_c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(counts, same)
        .withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .drop("_cell", "_rank", "_c", "_before", *[f"_k{i}" for i in range(len(keys))])
    )


def by_bytes(batches: Iterable[pa.RecordBatch], column: str | None, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column`, or all columns, hold about `limit` bytes at most (one row at least)."""
    for batch in batches:
        per_row = max(1, (batch.column(column) if column else batch).nbytes // max(1, batch.num_rows))
        step = max(1, limit // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D, in order."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of `bits` (a power of two) that holds the hashes of `column`: a filter without false
    negatives whose size, on the driver and when broadcast, does not grow with the table."""
    slot = hashes.select(F.col(column).bitwiseAND(F.lit(bits - 1).cast("long")).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("held")
    )
    out = np.zeros(max(1, bits // 64), np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("held").to_numpy()
    return out.view(np.uint64)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in the bitmap."""
    slot = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch in UTF-8; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
