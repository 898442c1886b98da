"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Texts hash to points of a 64-bit ring, equal texts to the same point; each shard
owns `VNODES` points. A text goes to the first shard clockwise that is not full;
a shard is full at (1 + slack) times the mean size. The ring is read in `CELLS`
equal arcs, whose sizes are the only thing the placement sees - except groups of
equal texts larger than 1 / `CELLS` of everything, which are placed one by one
and cut where no shard can hold them whole. Cells and large groups are few
whatever the input, so the placement itself runs on the driver.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import cells_for, row_index
from lapse.sources.session import pin

VNODES = 256
CELL_BITS = 14
CELLS = 1 << CELL_BITS


def ring(shards: int) -> tuple[list[int], list[int]]:
    """Cells of the virtual nodes in order, and their shards."""
    nodes = sorted(
        (xxhash.xxh64_intdigest(f"{s}:{v}".encode()) >> (64 - CELL_BITS), s) for s in range(shards) for v in range(VNODES)
    )
    return [c for c, _ in nodes], [s for _, s in nodes]


@dataclass
class Placement:
    #: Shard of each cell that has rows.
    cells: dict[int, int]
    #: Of each large group, (rows before the first row that goes there, shard) in order.
    groups: list[list[tuple[int, int]]]
    loads: list[int]


def place(cells: dict[int, int], groups: list[tuple[int, int, int]], shards: int, slack: float) -> Placement:
    """Place large groups (cell, rows, size of a row), the largest first, then cells in ring order.

    A group that fits in no shard is cut: it fills shard after shard clockwise. A cell goes whole to
    the first shard clockwise that is not full, so a load exceeds the bound by one cell at most."""
    points, owners = ring(shards)
    total = sum(cells.values()) + sum(n * size for _, n, size in groups)
    bound = total * (1 + slack) / shards
    loads = [0] * shards

    def clockwise(cell: int) -> list[int]:
        at = bisect.bisect_left(points, cell)
        return list(dict.fromkeys(owners[at:] + owners[:at]))

    cuts: list[list[tuple[int, int]]] = [[] for _ in groups]
    for i in sorted(range(len(groups)), key=lambda i: (-groups[i][1] * groups[i][2], groups[i][0], i)):
        cell, n, size = groups[i]
        order = clockwise(cell)
        whole = next((s for s in order if loads[s] + n * size <= bound), None)
        if whole is not None:
            cuts[i].append((0, whole))
            loads[whole] += n * size
            continue
        done = 0
        for s in order:
            take = min(n - done, max(0, int((bound - loads[s]) // size)))
            if take:
                cuts[i].append((done, s))
                loads[s] += take * size
                done += take
        while done < n:  # what rounding left over
            s = min(order, key=lambda s: loads[s])
            cuts[i].append((done, s))
            loads[s] += size
            done += 1
    placed = {}
    for cell in sorted(cells):
        order = clockwise(cell)
        s = next((s for s in order if loads[s] < bound), None)
        placed[cell] = min(order, key=lambda x: loads[x]) if s is None else s
        loads[placed[cell]] += cells[cell]
    return Placement(placed, cuts, loads)


def shard(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 8, slack: float = 0.002
) -> DataFrame:
    """(key, size, text_crc32, shard, slot), one row per row: shards 0 to `shards` - 1, slots gapless from 0.

    `size` is the UTF-8 bytes of the text (null: none) plus 1; shard sizes stay within `slack` of their
    mean above, up to one cell or row, and within (shards - 1) times that below. Equal texts share a
    shard unless their group is larger than 1 / `CELLS` of all and no shard has room for it; the
    rows of a cut group are dealt by key. An empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    # null and empty texts differ in nothing that counts here
    point = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    base = pin(docs.select(F.col(key), size.alias("size"), crc.alias("text_crc32"), point.alias("point")))
    cell = F.shiftrightunsigned("point", 64 - CELL_BITS).cast("int")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    of = ["point", "text_crc32", "size"]
    groups = pin(base.groupBy(*of).agg(F.count(F.lit(1)).alias("n")))
    large = F.col("n") * F.col("size") * CELLS > total
    # fewer than CELLS groups can be larger than 1 / CELLS of everything
    big = groups.where(large & (F.col("n") > 1)).withColumn("cell", cell).orderBy("cell", *of).collect()
    rest = groups.where(~(large & (F.col("n") > 1))).groupBy(cell.alias("cell")).agg(F.sum(F.col("n") * F.col("size")))
    placed = place(dict(map(tuple, rest.collect())), [(r["cell"], r["n"], r["size"]) for r in big], shards, slack)

    spark = docs.sparkSession
    wide = spark.createDataFrame(
        [(r["point"], r["text_crc32"], r["size"], i, cuts) for i, (r, cuts) in enumerate(zip(big, placed.groups, strict=True))],
        "point long, text_crc32 long, size long, _group int, _cuts array<struct<first:bigint,shard:int>>",
    )
    marked = base.join(F.broadcast(wide), of, "left").withColumn("_cell", cell)
    cells = spark.createDataFrame(list(placed.cells.items()), "_cell int, _owner int")
    marked = marked.join(F.broadcast(cells), "_cell", "left").withColumnRenamed("_cell", "_arc")
    single = F.size("_cuts") == 1
    simple = marked.where("_cuts is null or size(_cuts) = 1").withColumn(
        "shard", F.when(single, F.col("_cuts")[0]["shard"]).otherwise(F.col("_owner"))
    )
    kept = [key, "size", "text_crc32", "point", "shard"]
    if any(len(c) > 1 for c in placed.groups):
        cut = marked.where("size(_cuts) > 1")
        cut = row_index(cut, ["_group"], [F.col(key)], F.col(key), cells_for(rows), "_row")
        mine = F.filter("_cuts", lambda c: c["first"] <= F.col("_row"))
        cut = cut.withColumn("shard", F.element_at(mine, -1)["shard"])
        simple = simple.select(*kept).unionByName(cut.select(*kept))
    done = pin(simple.select(*kept))
    slots = row_index(done, ["shard"], [F.col("point"), F.col(key)], F.col(key), cells_for(rows), "slot")
    return slots.select(key, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
