"""Length-bucketed batches with least padding.

Documents are cut into pieces of at most `max_length` tokens. A dynamic programme
over the global histogram of piece lengths places the bucket bounds so that
padding every piece to its bucket's bound costs the fewest tokens. Inside a
bucket, pieces fill batches of `budget` padded tokens.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import cells_for, row_index, words
from lapse.sources.session import pin


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding; the last is the longest length."""
    lengths = sorted(histogram)
    if not lengths:
        return []
    size = np.array(lengths, np.int64)
    rows = np.concatenate([[0], np.cumsum([histogram[x] for x in lengths])]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum([histogram[x] * x for x in lengths])]).astype(np.int64)
    n = len(lengths)
    # cost[i, j]: padding of lengths i..j in one bucket with bound size[j]
    cost = size[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    never = np.iinfo(np.int64).max // 4
    cost[np.tril_indices(n, -1)] = never
    best, cuts = cost[0].copy(), []
    for _ in range(min(buckets, n) - 1):
        # the bucket that ends at j starts at i + 1, the ones before end at i
        total = np.full((n, n), never, np.int64)
        total[:-1] = best[:-1, None] + cost[1:]
        total[total > never] = never
        start = total.argmin(0)
        shorter = total[start, np.arange(n)]
        cuts.append(np.where(shorter < best, start, -1))
        best = np.minimum(best, shorter)
    ends = [n - 1]
    for cut in reversed(cuts):
        if cut[ends[-1]] >= 0:
            ends.append(int(cut[ends[-1]]))
    return [lengths[i] for i in reversed(ends)]


def pieces(docs: DataFrame, key: str, length: Column, max_length: int) -> DataFrame:
    """(key, piece, start, n_tokens): each document in pieces of at most `max_length` tokens; one empty piece if it has none."""
    docs = docs.select(F.col(key), F.coalesce(length, F.lit(0)).cast("long").alias("_length"))
    last = F.greatest(F.ceil(F.col("_length") / max_length), F.lit(1)).cast("int") - 1
    docs = docs.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * max_length
    n = F.least(F.lit(max_length).cast("long"), F.col("_length") - start)
    return docs.select(key, "piece", start.alias("start"), n.alias("n_tokens"))


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    length: Column | None = None,
    max_length: int = 2048,
    buckets: int = 8,
    budget: int = 16_384,
) -> DataFrame:
    """(key, piece, start, n_tokens, bucket, padded, batch_id, slot), one row per piece.

    `length` is the tokens of a row, the words of `text` if not given. `batch_id` counts from 0
    without gaps over all buckets; a batch holds budget // padded pieces (one at least), and only
    the last batch of a bucket holds fewer. Null, empty and blank texts are one piece of 0 tokens.
    The histogram has at most max_length + 1 rows. An empty table gives no rows.
    """
    length = F.size(words(F.coalesce(F.col(text), F.lit("")))) if length is None else length
    cut = pin(pieces(docs, key, length, max_length))
    histogram = {r["n_tokens"]: r["count"] for r in cut.groupBy("n_tokens").count().collect()}
    bounds = bucket_bounds(histogram, buckets)
    if not bounds:
        bounds = [max_length]
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    cut = cut.withColumn("bucket", bucket)
    cells = cells_for(sum(histogram.values()))
    order = [F.col(key), F.col("piece"), F.col("n_tokens")]
    rows = row_index(cut, ["bucket"], order, F.struct(F.col(key), F.col("piece")), cells, "_row")
    low, begun, answer = -1, 0, {"padded": F.lit(None), "size": F.lit(None), "begun": F.lit(None)}
    for i, bound in enumerate(bounds):
        size = max(1, budget // max(1, bound))
        here = F.col("bucket") == i
        for name, value in (("padded", bound), ("size", size), ("begun", begun)):
            answer[name] = F.when(here, F.lit(value).cast("long")).otherwise(answer[name])
        begun += -(-sum(n for x, n in histogram.items() if low < x <= bound) // size)
        low = bound
    batch = answer["begun"] + F.floor(F.col("_row") / answer["size"])
    return rows.select(
        key, "piece", "start", "n_tokens", "bucket", answer["padded"].alias("padded"),
        batch.cast("long").alias("batch_id"), (F.col("_row") % answer["size"]).alias("slot"),
    )
