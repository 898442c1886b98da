"""documents to training batches: language, repeated lines, near-duplicates, personal data, packing.

Each stage reads what the one before wrote. Every stage but the last returns the
columns of `documents`; null and empty texts, ties and empty tables behave as the
operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm import language, lines, packing, pii, simhash
from lapse.sources.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language: no text, no letter or too few known n-grams goes."""
    model = language.train(docs)
    found = language.predict(docs.select(*COLUMNS), model)
    return found.where(language.accepted(model, F.col("lang_pred"), F.col("score"))).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go; a document all of whose lines stand elsewhere goes with them."""
    found = lines.deduplicate(docs.select(*COLUMNS))
    found = found.where((F.col("lines_removed") == 0) | (F.trim("text") != ""))
    return _measured(found)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays; rows that repeat both
    doc_id and text are one document. A group without any doc_id keeps one row per distinct text."""
    docs = docs.select(*COLUMNS)
    groups = simhash.near_duplicates(docs, shingle=3, distance=3)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("_id")).distinct()
    docs, keep = docs.withColumn("_k", F.xxhash64("doc_id")), keep.withColumn("_k2", F.xxhash64("_id"))
    same = (F.col("_k") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    # one shuffle by _k serves the join and the removal of repeated rows
    return docs.join(keep, same, "left_semi").dropDuplicates(["_k", "doc_id", "text"]).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return _measured(pii.redact(docs.select(*COLUMNS), pii.train(docs)))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in length buckets and token-budget batches."""
    return packing.pack(docs.select("doc_id", "text"))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", redact_personal_data),
    ("packing", pack_batches),
]

#: No stage can be written in SQL alone; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
