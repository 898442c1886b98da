import os
import sys

import edge
import pytest

import corpus_pipeline as pipeline
from lapse.llm import packing, pii, simhash

sys.path.insert(0, os.path.dirname(__file__))
from test_llm_lines import hashed  # noqa: E402
from test_llm_lines import plain as plain_lines  # noqa: E402
from test_llm_simhash import plain_components, plain_fingerprint  # noqa: E402


def documents(spark):
    docs = edge.small(spark)
    return docs.unionByName(edge.documents(spark).withColumn("doc_id", edge_id()).limit(10_000))


def edge_id():
    from pyspark.sql import functions as F

    return F.col("doc_id") + 1_000_000


def stages(spark, docs, folder):
    out = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, edge.SMALL).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        out[name] = before.collect(), docs.collect(), docs.columns
    return out


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    if not edge.have_data():
        pytest.skip("test tables not present")
    return stages(spark, documents(spark), f"file://{tmp_path_factory.mktemp('stages')}")


def test_shape(done):
    assert [n for n, _ in pipeline.STAGES] == list(done)
    for name in list(done)[:-1]:
        assert tuple(done[name][2]) == pipeline.COLUMNS


def test_language_keeps_clean_documents(done):
    before, after, _ = done["language"]
    kept = {r["doc_id"] for r in after}
    assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in after)
    real = [r for r in before if r["doc_id"] is not None and r["doc_id"] < 1_000_000]
    assert len([r for r in real if r["doc_id"] in kept]) >= 0.99 * len(real)


def test_lines(spark, done):
    before, after, _ = done["lines"]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    want = [(k, t, len(t)) for k, t, n in plain_lines(hashed(docs)) if not n or t.strip(" ")]
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in after), key=str) == sorted(want, key=str)


def test_near_duplicates(done):
    before, after, _ = done["near_duplicates"]
    roots = plain_components([plain_fingerprint(r["text"]) for r in before], 3)
    groups = {}
    for r in before:
        groups.setdefault(roots[plain_fingerprint(r["text"])], set()).add((r["doc_id"] is None, r["doc_id"]))
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(min(g)[1] for g in groups.values() if not min(g)[0])


def test_personal_data(done):
    before, after, _ = done["personal_data"]
    assert sorted(str(r["doc_id"]) for r in before) == sorted(str(r["doc_id"]) for r in after)
    assert not any(pii.base_spans(r["text"] or "") for r in after)
    clean = {r["doc_id"]: r["text"] for r in before if not pii.base_spans(r["text"] or "")}
    same = [clean[r["doc_id"]] == r["text"] for r in after if r["doc_id"] in clean]
    assert sum(same) >= 0.99 * len(same)


def test_packing(done):
    before, after, _ = done["packing"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    assert sum(r["n_tokens"] for r in after) == sum(len(simhash_words(r["text"])) for r in before)


def simhash_words(text):
    return (text or "").encode().split()


def test_awkward_and_empty(spark, tmp_path):
    stages(spark, edge.documents(spark, extra=True), f"file://{tmp_path}/a")
    found = stages(spark, edge.empty(spark), f"file://{tmp_path}/b")
    assert all(after == [] for _, after, _ in found.values())


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 3 + [(2, "A b c d", "en", "s", 7)], edge.COLUMNS)
    assert [r["doc_id"] for r in pipeline.keep_one_of_each_group(spark, docs, "").collect()] == [1]
    assert simhash.near_duplicates(docs).count() == 4 and packing.pack(docs).count() == 4


def test_run(spark):
    if not edge.have_data():
        pytest.skip("test tables not present")
    assert pipeline.run(spark, edge.SMALL).count() > 0
