import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapse.operators import prep


def plain_split(found, train=60, val=20):
    """Split of each (key, label): rows of a label by the hash of their key, a key's rows together."""
    split = {}
    for label in {r[1] for r in found}:
        units = Counter(0 if k is None else int(hashlib.md5(k.encode()).hexdigest()[:15], 16) for k, l in found if l == label)
        n, before = sum(units.values()), 0
        quotas = [(n * train + 50) // 100, (n * (train + val) + 50) // 100]
        for h in sorted(units):
            split[h, label] = "train" if before < quotas[0] else "val" if before < quotas[1] else "test"
            before += units[h]
    return sorted(
        (str(k), str(l), split[0 if k is None else int(hashlib.md5(k.encode()).hexdigest()[:15], 16), l]) for k, l in found
    )


@pytest.mark.parametrize("cells, slices", [(1, 0), (4, 3), (1 << 16, 0), (1 << 10, 40)])
def test_quotas_hold_in_each_label(spark, cells, slices):
    rng = random.Random(5)
    found = [(f"k{i}", rng.choice(["a", "a", "a", "a", "b", None])) for i in range(700)] + [("alone", "c"), ("p", "d"), ("q", "d")]
    table = spark.createDataFrame(found, "id string, label string").repartition(5)
    got = prep.stratified_split(table, "id", "label", cells=cells, rows_per_slice=slices)
    assert got.columns == ["id", "label", "split"]
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in got.collect()) == plain_split(found)
    sizes = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    for label in ("a", "b", None):
        n = sum(v for (l, _), v in sizes.items() if l == label)
        assert sizes[label, "train"] == (n * 60 + 50) // 100
        assert sizes[label, "train"] + sizes[label, "val"] == (n * 80 + 50) // 100


def test_repeated_and_missing_keys(spark):
    rng = random.Random(6)
    found = [("hot", "a")] * 300 + [(None, "a")] * 20 + [(f"k{rng.randint(0, 200)}", rng.choice("ab")) for _ in range(600)]
    table = spark.createDataFrame(found, "id string, label string").withColumn("_n", F.lit(1)).withColumn("_cell", F.lit("x"))
    got = prep.stratified_split(table, "id", "label", train=50, val=25, cells=8)
    assert got.columns == ["id", "label", "_n", "_cell", "split"]
    assert sorted((str(r["id"]), str(r["label"]), r["split"]) for r in got.collect()) == plain_split(found, 50, 25)
    # rows of a key and label are never apart
    assert got.groupBy("id", "label").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_all_or_none(spark):
    table = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, label int")
    assert {r[0] for r in prep.stratified_split(table, "id", "label", train=100, val=0).select("split").collect()} == {"train"}
    assert {r[0] for r in prep.stratified_split(table, "id", "label", train=0, val=0).select("split").collect()} == {"test"}
    assert prep.stratified_split(table.limit(0), "id", "label").count() == 0
