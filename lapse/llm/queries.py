"""One query opN_<name> per operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import (
    bpe, contamination, fingerprint, language, lines, negatives, packing, phrases, pii, quality, sharding, simhash, warc,
)
from lapse.llm.common import table
from lapse.sources.session import pin, shared_folder


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_with_next(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4))
    model = language.train(docs.where(fold != 2))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    spans = F.col("spans")
    counts = [pii.counted(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.sha2(pii.listed(spans, base=True), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), pii.listed(spans).alias("spans"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), folder)
    # the payloads are checked against their digests while they are read, and not kept
    records = pin(warc.sound(warc.read(spark, folder)).drop("payload"))
    found = warc.assemble(records)
    page = warc.field(F.col("metadata"), "page-id").cast("long")
    found = pin(found.select("capture_id", page.alias("page_id"), "response.*"))
    origin = found.where("record_type = 'response'").select(
        F.col("capture_id").alias("_origin"), F.col("page_id").alias("_page")
    )
    joined = found.join(origin, F.col("refers_to") == F.col("_origin"), "left")
    return joined.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("_page").alias("refers_to")
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicate(docs).select("doc_id", "lines_removed", "text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = pin(quality.statistics(docs))
    rules = quality.learn(stats, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(
        "doc_id", *quality.BASE, failed.alias("base_failed"), (~failed & quality.verdict(rules)).alias("kept")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), negatives.scaled(F.col("embedding"), 256).alias("v"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_bpe, op3_pii, op4_fingerprints, op5_language_id, op6_sharding, op7_warc,
        op8_line_dedup, op9_quality_rules, op10_packing, op11_collocations, op12_hard_negatives, op13_decontamination,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hexadecimal digits are four letters.
_LETTERS = " || ".join(
    f"substr('{_BASE32}', 1 + CAST((CAST('0x' || substr(h, {at}, 5) AS BIGINT) >> {shift}) & 31 AS INTEGER), 1)"
    for at in range(1, 41, 5)
    for shift in (15, 10, 5, 0)
)

SQL: dict[str, str] = {
    "op7_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op11_collocations": """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(u.piece, '[^\x20\x09]+') AS w
  FROM documents, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS u(piece)
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM pieces, range(1, 4) AS s(m), range(1, len(w) - m + 2) AS t(i)
), counted AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT o.lang, o.phrase, o.f AS a, k, l.f AS l, r.f AS r,
    (1000000::HUGEINT * o.f * o.f) // (l.f::HUGEINT * r.f) AS score
  FROM often o, range(1, 3) AS c(k)
  JOIN counted l ON l.lang = o.lang AND l.phrase = array_to_string(o.w[1:k], ' ')
  JOIN counted r ON r.lang = o.lang AND r.phrase = array_to_string(o.w[k + 1:], ' ')
  WHERE k < o.m
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT o.lang, array_to_string(o.w[i:i + 1], ' ') AS phrase, max(o.f) AS longer
  FROM often o, range(1, 3) AS p(i) WHERE o.m = 3 GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3""",
    "op13_decontamination": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), spans AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS span
  FROM b, range(1, len(w) - least(10, len(w)) + 2) AS r(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS span
  FROM d, (SELECT DISTINCT m FROM spans) AS s, range(1, len(w) - m + 2) AS r(i)
), hits AS (SELECT p.doc_id, p.i, p.m, s.item_id FROM places p JOIN spans s USING (m, span)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, range(i, i + m) AS r(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
