"""Mergeable profile sketches against the exact values."""

import pytest
from pyspark.sql import functions as F

from lapse.operators import sketches


@pytest.fixture(scope="module")
def data(spark):
    return spark.range(30_000).select(
        (F.col("id") % 3).alias("part"),
        F.when(F.col("id") % 10 != 0, F.xxhash64("id") % 100_000 + 1e9).alias("x"),
        F.when(F.col("id") % 4 == 0, "common").otherwise(F.concat(F.lit("v"), F.col("id") % 500)).alias("s"),
        F.lit(None).cast("double").alias("blank"),
    )


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_partitions_merge_to_the_whole(spark, data, tmp_path):
    path = str(tmp_path / "sketches")
    for part in range(3):
        sketches.sketch(data.where(F.col("part") == part), ["part"]).write.mode("append").parquet(path)
    got = by_column(sketches.report(sketches.merge(spark.read.parquet(path))))
    assert set(got) == {"x", "s", "blank"}
    exact = data.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.count_distinct("x").alias("distinct"),
    ).first()
    x = got["x"]
    assert (x["rows"], x["count"], x["missing"]) == (30_000, exact["n"], 30_000 - exact["n"])
    assert (x["min"], x["max"]) == (exact["min"], exact["max"])
    assert x["mean"] == pytest.approx(exact["mean"], rel=1e-12) and x["std"] == pytest.approx(exact["std"], rel=1e-9)
    assert x["distinct"] == pytest.approx(exact["distinct"], rel=0.04)
    for name, p in sketches.QUANTILES.items():
        rank = data.where(F.col("x") <= x[name]).count() / exact["n"]
        assert abs(rank - p) < 0.02
    counts = data.groupBy("s").count().orderBy(F.desc("count"), "s").limit(10).collect()
    assert [(c["value"], c["count"]) for c in got["s"]["frequent"]][:1] == [(counts[0]["s"], counts[0]["count"])]
    assert {c["count"] for c in got["s"]["frequent"][1:]} == {c["count"] for c in counts[1:]}
    assert got["blank"]["count"] == 0 and got["blank"]["p50"] is None and got["blank"]["frequent"] == []


def test_order_of_merging_does_not_change_what_is_exact(data):
    parts = sketches.sketch(data, ["part"])
    two = sketches.merge(parts.where("part < 2"))
    rest = parts.where("part = 2").drop("part")
    steps = by_column(sketches.report(sketches.merge(two.unionByName(rest))))
    at_once = by_column(sketches.report(sketches.merge(parts)))
    for c in ("x", "s"):
        for name in ("rows", "count", "missing", "min", "max", "distinct"):
            assert steps[c][name] == at_once[c][name], (c, name)
    assert steps["x"]["std"] == pytest.approx(at_once["x"]["std"], rel=1e-9)


def test_odd_values(spark):
    df = spark.createDataFrame(
        [(1.0, "a" * 5000), (float("nan"), "a" * 5000), (float("inf"), ""), (None, None)], "n double, `t x` string"
    )
    got = by_column(sketches.report(sketches.sketch(df)))
    assert (got["n"]["count"], got["n"]["missing"], got["n"]["infinite"], got["n"]["mean"], got["n"]["std"]) == (1, 3, 1, 1.0, None)
    top = got["t x"]["frequent"][0]
    assert top["value"].startswith("sha256:") and top["count"] == 2
    none = by_column(sketches.report(sketches.merge(sketches.sketch(df.limit(0)))))
    assert none["n"]["rows"] == 0 and none["n"]["distinct"] == 0 and none["n"]["p50"] is None
    with pytest.raises(ValueError, match="no column"):
        sketches.sketch(df, ["n", "t x"])
