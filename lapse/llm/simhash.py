"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within three bits of each other meet half-way: flip at most one
bit of each and at most one differing bit is left. That odd bit is a wildcard:
the 64 bits form `BLOCKS` blocks, and a variant is a fingerprint with one block
blanked out and at most one other bit flipped. Any three differing bits that do
not all lie in the last block touch a block that can be blanked; the last block
is blanked too, without flips. So each distinct fingerprint emits
(BLOCKS - 1) * (1 + bits outside the block) + 1 variants (89), the variants are
shuffled, and fingerprints that share one are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import by_bytes
from lapse.llm.components import components
from lapse.sources.session import pin

BITS = 64
BLOCKS = 3
SEED = 42
#: Buckets with more members than this are taken apart by a second shuffle instead of in memory.
BUCKET = 1024
#: Shingles hashed at a time, whatever the length of a text.
CHUNK = 1 << 17

#: For each byte, its bits as eight byte-wide counters, lowest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of the text with A-Z in lower case; a shorter text is one shingle, no words none.

    `bytes.split` cuts at space and 0x09-0x0D, `bytes.lower` touches A-Z only."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(t) for t in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint_texts(texts: list[str | None], size: int) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    held: list[tuple[int, np.ndarray]] = []
    waiting = 0
    for i, text in enumerate(texts):
        parts = shingles(text or "", size)
        if not parts:
            continue
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        held.append((i, hashes))
        waiting += len(hashes)
        if waiting >= CHUNK:
            _majority(held, out)
            held, waiting = [], 0
    _majority(held, out)
    return out


def _majority(held: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
    if not held:
        return
    counts = np.stack([_bit_counts(h) for _, h in held])
    sizes = np.array([len(h) for _, h in held])
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    out[[i for i, _ in held]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set: byte-wide counters are added up 255 hashes at a time."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        lanes = _SPREAD[hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text. Null, empty or blank text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = fingerprint_texts(batch.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], names=[key, "fp"])

    docs = docs.select(F.col(key), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, fp long")


def _edges_of_blocks() -> list[tuple[int, int]]:
    cuts = [round(BITS * i / BLOCKS) for i in range(BLOCKS + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def variants(fps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, flipped bit or -1, variant of each fingerprint)."""
    for block, (low, high) in enumerate(_edges_of_blocks()):
        blank = np.uint64(~(((1 << high) - (1 << low))) & (2**BITS - 1))
        yield block, -1, fps & blank
        if block < BLOCKS - 1:
            for bit in (*range(low), *range(high, BITS)):
                yield block, bit, (fps & blank) ^ np.uint64(1 << bit)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
            made = list(variants(fps))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([b for b, _, _ in made], np.int8), len(fps))),
                    pa.array(np.concatenate([v for _, _, v in made]).view(np.int64)),
                    pa.array(np.tile(fps, len(made)).view(np.int64)),
                ],
                names=["block", "variant", "fp"],
            )


def _verifier(distance: int, bucket: int):
    """Sorted (block, variant, fp) to (a, b, block, variant): links within a bucket, each member to the
    least one it reaches there; b is null for a member of a bucket too large to hold."""

    def link(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        label = np.arange(len(fps))
        while True:
            least = np.where(near, label[None, :], len(fps)).min(1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        other = label != np.arange(len(fps))
        return fps[other], fps[label[other]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, overflow = None, None

        def rows(a, b, block=None, variant=None):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(a.view(np.int64)),
                    pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64)),
                    pa.nulls(n, pa.int8()) if block is None else pa.array(np.full(n, block, np.int8)),
                    pa.nulls(n, pa.int64()) if variant is None else pa.array(np.full(n, variant, np.int64)),
                ],
                names=["a", "b", "block", "variant"],
            )

        def work(block, variant, fps, last):
            """Links of all finished buckets; returns the unfinished rest."""
            nonlocal overflow
            cut = np.flatnonzero((block[1:] != block[:-1]) | (variant[1:] != variant[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(fps)]])
            made = []
            if overflow is not None:
                if (block[0], variant[0]) == overflow:
                    made.append(rows(fps[: ends[0]], None, *overflow))
                    starts, ends = starts[1:], ends[1:]
                if len(starts):
                    overflow = None
            rest = None
            if len(starts) and not last:
                s = starts[-1]
                if len(fps) - s > bucket:
                    overflow = (block[s], variant[s])
                    made.append(rows(fps[s:], None, *overflow))
                else:
                    rest = block[s:], variant[s:], fps[s:]
                starts, ends = starts[:-1], ends[:-1]
            size = ends - starts
            two = starts[size == 2]
            x, y = fps[two], fps[two + 1]
            near = np.bitwise_count(x ^ y) <= distance
            a, b = [x[near]], [y[near]]
            for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
                if e - s > bucket:
                    made.append(rows(fps[s:e], None, block[s], variant[s]))
                else:
                    p, q = link(fps[s:e])
                    a.append(p)
                    b.append(q)
            made.append(rows(np.concatenate(a), np.concatenate(b)))
            return made, rest

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("block", "variant")]
            now.append(batch.column("fp").to_numpy().view(np.uint64))
            if carried is not None:
                now = [np.concatenate([p, q]) for p, q in zip(carried, now, strict=True)]
            made, carried = work(*now, last=False)
            yield from made
        if carried is not None:
            yield from work(*carried, last=True)[0]

    return run


def _crowded_links(crowded: DataFrame, distance: int) -> DataFrame:
    """Links of the buckets too large to compare in memory, with work linear in their members.

    Again half-way: a member emits every point within `guest` = half the distance, rounded up,
    that lies in its bucket; those within `anchor` = half, rounded down, are the point's
    anchors. Anchor and guest are within the distance, and any two members within it have such
    a point, so linking all guests of a point to its least anchor loses nothing.
    """
    blocks, guest, anchor = _edges_of_blocks(), (distance + 1) // 2, distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, variant, fp in zip(*(batch.column(c).to_pylist() for c in ("block", "variant", "a")), strict=True):
                low, high = blocks[block]
                fp &= 2**BITS - 1
                own = ((1 << high) - (1 << low)) & fp
                flips = ((fp ^ own) ^ (variant & (2**BITS - 1))).bit_count()
                bits = [1 << i for i in range(low, high)]
                points = [(own, flips)]
                points += [(own ^ x, flips + 1) for x in bits]
                points += [(own ^ x ^ y, flips + 2) for i, x in enumerate(bits) for y in bits[:i]]
                points = [(p, d) for p, d in points if d <= guest]
                at = np.array([(variant & (2**BITS - 1)) | p for p, _ in points], np.uint64)
                far = np.array([d for _, d in points], np.int8)
                n = len(points)
                columns = [np.full(n, block, np.int8), at.view(np.int64), np.full(n, fp, np.uint64).view(np.int64), far]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "point", "fp", "far"])

    points = crowded.mapInArrow(run, "block byte, point long, fp long, far byte")
    anchors = points.where(F.col("far") <= anchor).groupBy("block", "point").agg(F.min("fp").alias("anchor"))
    linked = points.join(anchors, ["block", "point"]).where("fp <> anchor")
    return linked.select(F.col("fp").alias("a"), F.col("anchor").alias("b"))


def links(fps: DataFrame, distance: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints of column `fp` that lie within `distance`
    (0 to 3) bits, enough of them for the connected components to be exact."""
    if not 0 <= distance <= 3:
        raise ValueError("variants cover distances of 0 to 3 bits")
    shuffled = fps.select("fp").mapInArrow(_emit, "block byte, variant long, fp long")
    shuffled = shuffled.repartition("block", "variant").sortWithinPartitions("block", "variant", "fp")
    found = shuffled.mapInArrow(_verifier(distance, bucket), "a long, b long, block byte, variant long")
    found = pin(found.distinct())
    close = found.where("b is not null").select("a", "b")
    crowded = found.where("b is null")
    if crowded.isEmpty():
        return close
    return close.union(_crowded_links(crowded, distance))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 3, bucket: int = BUCKET
) -> DataFrame:
    """One row per row of `docs`: (key, fp, component), the component's least non-null key.

    Documents whose fingerprints differ in at most `distance` bits are linked, and links
    chain. Null, empty and blank texts have fingerprint zero and are linked like any other.
    Only distinct fingerprints are compared: a million copies cost as much as one. An empty
    table gives no rows; columns other than `key` and `text` are ignored.
    """
    prints = pin(fingerprints(docs, text, key, shingle))
    kinds = pin(prints.groupBy("fp").agg(F.min(key).alias("least")))
    tree = components(links(kinds, distance, bucket))
    rooted = kinds.join(tree, kinds["fp"] == tree["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    answer = rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component")
    return prints.join(answer, F.col("fp") == F.col("_fp")).select(key, "fp", "component")
