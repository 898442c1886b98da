"""Missing, infinite and odd values, limits on both sides, and names that need quoting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lapse.functions import tails
from lapse.operators import aft, classify, clv, concordance, cox, describe, evaluate, kaplan_meier as km, kmeans
from lapse.operators import profile, running
from lapse.operators.logrank import logrank
from lapse.sources import session, tables

NAN, INF = float("nan"), float("inf")
SLICES = [0, 5]


def same(a, b):
    """Equal rows, NaN included, up to rounding."""
    flat = lambda df: sorted((tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in df.collect()))
    assert flat(a) == flat(b)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(2)
    data = [(i, float(rng.randint(1, 40)), int(rng.random() < 0.6), rng.random(), "ab"[i % 2]) for i in range(60)]
    data += [(100, NAN, 1, 0.5, "a"), (101, None, 1, 0.5, "a"), (102, INF, 0, 0.5, "b"), (103, 3.0, None, 0.5, "a"),
             (104, 3.0, 1, NAN, "b"), (105, 3.0, 1, None, None), (106, 3.0, 0, INF, "a")]
    return session.pin(spark.createDataFrame(data, "id int, t double, e int, s double, g string"))


@pytest.mark.parametrize(
    "run",
    [
        lambda df, n: km.km_curve(df, "t", "e", ["g"], rows_per_slice=n),
        lambda df, n: km.event_table(df, "t", "e", rows_per_slice=n),
        lambda df, n: logrank(df, "t", "e", ["g"], rows_per_slice=n),
        lambda df, n: concordance.concordance(df, "t", "e", "s", rows_per_slice=n),
        lambda df, n: evaluate.roc_curve(df, "e", "s", rows_per_slice=n),
        lambda df, n: evaluate.pr_curve(df, "e", "s", rows_per_slice=n),
        lambda df, n: describe.quantiles(df, "t", [0.1, 0.5, 0.9], rows_per_slice=n),
        lambda df, n: profile.Profile(df, rows_per_slice=n).spearman(),
    ],
)
def test_slices_treat_odd_values_alike(awkward, run):
    plain = run(awkward, 0)
    assert plain.count() > 0
    same(plain, run(awkward, 5))


def test_missing_values_are_left_out(awkward):
    clean = awkward.where("id < 100 OR id IN (102, 106)")
    same(km.km_curve(awkward.where("id <> 104 AND id <> 105"), "t", "e"), km.km_curve(clean, "t", "e"))
    ok = awkward.where("id < 100 OR id IN (102, 106)")
    same(evaluate.roc_curve(awkward.where("id >= 104 OR id < 100 OR id = 102"), "e", "s"), evaluate.roc_curve(ok, "e", "s"))


@pytest.mark.parametrize("n", SLICES)
def test_dates_can_be_ordered(spark, n):
    df = spark.range(30).select(F.expr("date_add(date '2020-01-01', int(id))").alias("d"), F.lit(1).alias("n"))
    df = session.pin(df.unionByName(spark.sql("SELECT CAST(NULL AS DATE) AS d, 1 AS n")))
    got = running.running_totals(running.sliced(df, "d", n), "d", {"upto": "n"}).orderBy("d").collect()
    assert [r["upto"] for r in got] == list(range(1, 32))


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_quantiles_on_both_sides_of_one_pass(spark, limit):
    values = [random.Random(4).random() for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = describe.quantiles(df, "x", [0.05, 0.5, 0.77], one_pass_rows=limit).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.77])))


def test_kmeans_far_from_zero(spark):
    rng = random.Random(5)
    values = [rng.gauss(c, 30) for c in (-1300, -130, 1100, 20000) for _ in range(50)]
    near = kmeans.value_counts(spark.createDataFrame([(round(v),) for v in values], "x long"), ["x"])
    far = kmeans.value_counts(spark.createDataFrame([(round(v) + 1_600_000_000_000_000,) for v in values], "x long"), ["x"])
    a = kmeans.fit_kmeans(near, [4])["x", 4]
    b = kmeans.fit_kmeans(far, [4])["x", 4]
    assert [v - 1.6e15 for v in b] == pytest.approx(a, abs=1.0)


def test_kmeans_reports_no_convergence_and_odd_names(spark):
    df = spark.createDataFrame([(float(i * i),) for i in range(50)], "`it's a ``name` double")
    counts = kmeans.value_counts(df.toDF("x"), ["x"]).withColumn("measure", F.lit("it's a `name"))
    with pytest.warns(UserWarning, match="still moved"):
        found = kmeans.fit_kmeans(counts, [3], max_iter=1)
    centers = kmeans.occupied(counts, found)
    assert kmeans.with_clusters(df, centers).count() == 50


def test_interactions_without_infinite_values_and_with_quotes(spark):
    data = [(float(i), float(i % 7)) for i in range(40)] + [(INF, 1.0), (NAN, 2.0), (None, 3.0)]
    df = spark.createDataFrame(data, "`it's` double, `b``c` double")
    cells = profile.Profile(df).interactions(4).collect()
    assert sum(r["n"] for r in cells) == 40 and {r["a"] for r in cells} == {"it's"}
    assert max(r["a_bin"] for r in cells) == 3


def test_spearman_per_pair(spark):
    data = [(float(i), float(i * i), float(i) if i % 8 == 0 else None, -float(i) if i % 3 else None) for i in range(64)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["value"] for r in profile.Profile(df).spearman().collect()}
    assert len(got) == 6
    sign = lambda p: -1.0 if "d" in p else 1.0
    assert all(v == pytest.approx(sign(p)) for p, v in got.items())


def test_spearman_with_holes_matches_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (80, 4)).astype(float)
    x[rng.random((80, 4)) < 0.2] = np.nan
    import pandas as pd

    frame = pd.DataFrame(x, columns=list("abcd"))
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double")
    for method, table in (("spearman", profile.Profile(df).spearman()), ("pearson", profile.Profile(df).pearson())):
        for r in table.collect():
            both = frame[[r["a"], r["b"]]].dropna()
            assert r["value"] == pytest.approx(both.rank().corr().iloc[0, 1] if method == "spearman" else both.corr().iloc[0, 1])


def test_correlation_of_many_columns_has_a_small_plan(spark):
    df = spark.range(100).select(*[F.rand(i).alias(f"x{i}") for i in range(300)])
    table = profile.Profile(df).pearson()
    assert table.count() == 300 * 299 // 2


def test_logrank_lists_every_pair_and_bounds_levels(spark):
    data = [(1.0 + i, int(i % 2 == 0), f"l{i % 6}") for i in range(60)]
    df = spark.createDataFrame(data, "t double, e int, g string")
    tests = logrank(df, "t", "e", ["g"]).collect()
    assert len(tests) == 15
    none = [r for r in tests if r["statistic"] is None]
    assert {(r["level_a"], r["level_b"]) for r in none} == {("l1", "l3"), ("l1", "l5"), ("l3", "l5")}
    assert all(r["p"] is None for r in none)
    quiet = logrank(df.withColumn("e", F.lit(0)), "t", "e", ["g"])
    assert quiet.count() == 15 and quiet.where("statistic IS NOT NULL").count() == 0
    with pytest.raises(ValueError, match="levels"):
        logrank(df, "t", "e", ["g"], most_levels=5)


def test_csv_folder_with_two_headers_is_refused(spark, tmp_path):
    from pyspark.sql.types import StructType

    for name, text in (("a.csv", "id,x,y\n1,2,3\n"), ("b.csv", "id,y,x\n4,5,6\n")):
        (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(tmp_path), StructType.fromDDL("id int, x int, y int")).collect()


def test_cox_leaves_out_nan_and_refuses_infinity(spark):
    rng = random.Random(1)
    data = [(float(rng.randint(1, 30)), 1, rng.random()) for _ in range(80)]
    df = spark.createDataFrame(data, "t double, e int, x double")
    more = spark.createDataFrame([(3.0, 1, NAN), (4.0, 1, None)], "t double, e int, x double")
    a, b = cox.fit_cox(df, "t", "e", ["x"]), cox.fit_cox(df.union(more), "t", "e", ["x"])
    assert list(a.coef) == pytest.approx(list(b.coef)) and b.observations == 80
    with pytest.raises(ValueError, match="infinite"):
        cox.fit_cox(df.union(spark.createDataFrame([(3.0, 1, INF)], "t double, e int, x double")), "t", "e", ["x"])


@pytest.mark.parametrize("low,high", [(0.5, 10.4), (-0.3, 0.7), (0.0, 1.0), (3.0, 3.0), (99.9, 1000.1), (-5.0, 5.0)])
def test_histogram_has_at_most_ten_bins(spark, low, high):
    df = spark.createDataFrame([(low + (high - low) * i / 500,) for i in range(501)], "x double")
    bins = describe.histogram(df, "x").orderBy("bin_start").collect()
    assert len(bins) <= 10 and sum(r["count"] for r in bins) == 501


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.1 * i,) for i in range(10)], "x double")
    assert [r["count"] for r in describe.histogram(df, "x").orderBy("bin_start").collect()] == [1] * 10


def test_confusion_counts_missing(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (0, None)], "label int, prediction int")
    got = {(r["label"], r["prediction"]): r["n"] for r in evaluate.confusion_matrix(df, "label", "prediction").collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 1, (None, 1): 1, (0, None): 1}


def test_erfc_as_columns(spark):
    values = [i / 50 for i in range(0, 1300)] + [2.4999999, 2.5, 30.0, 1000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", tails.log_erfc(F.col("x")).alias("y"))
    assert "Python" not in df._jdf.queryExecution().toString()
    for x, y in df.collect():
        if x < 26:
            assert math.exp(y) == pytest.approx(math.erfc(x), rel=1e-12, abs=0)
        else:
            assert y == pytest.approx(-x * x - math.log(x * math.sqrt(math.pi)), rel=1e-3)
    z = spark.createDataFrame([(v,) for v in (-8.0, -1.0, 0.0, 1.0, 8.0)], "z double")
    for v, s in z.select("z", tails.normal_log_survival(F.col("z"))).collect():
        assert s == pytest.approx(math.log(math.erfc(v / math.sqrt(2)) / 2), rel=1e-11)


def test_weibull_library_refuses_zero_durations(spark):
    df = spark.createDataFrame([(float(i % 9), 1, i % 2) for i in range(60)], "t double, e int, x int")
    with pytest.raises(ValueError, match="positive"):
        aft.fit_weibull_library(df, "t", "e", ["x"])
    assert aft.fit_weibull_library(df, "t", "e", ["x"], shift=0.5).count() == 3


def test_lifetime_value_by_stratum(spark):
    """A stratified model prices each stratum as a model of that stratum alone would."""
    data = [(i, float(1 + i % 12), 1, i % 2, "early") for i in range(240)]
    data += [(1000 + i, float(20 + i % 12), 1, i % 2, "late") for i in range(240)]
    df = spark.createDataFrame(data, "id int, t double, e int, x int, g string")
    both = cox.at_fixed(df, "t", "e", {"x": 0.0}, strata=["g"])
    got = {r["id"]: r["lifetime_value"] for r in clv.customer_ltv(df, both, "id").collect()}
    for g in ("early", "late"):
        own = df.where(F.col("g") == g)
        alone = cox.at_fixed(own, "t", "e", {"x": 0.0})
        for r in clv.customer_ltv(own, alone, "id").collect():
            assert got[r["id"]] == pytest.approx(r["lifetime_value"])
        mine = clv.payback(both, [{"x": 0}]).where(F.col("g") == g).drop("g")
        same(mine, clv.payback(alone, [{"x": 0}]))
    assert clv.milestones(clv.payback(both, [{"x": 0}])).columns == ["g", "scenario", "contract_month", "cumulative_npv"]
    unknown = df.limit(1).withColumn("g", F.lit("new"))
    assert clv.customer_ltv(unknown, both, "id").first()["lifetime_value"] is None


def test_patience():
    assert classify.best_round([5, 4, 3, 3.5, 3.4, 3.3, 3.2, 3.1, 2], 5) == (3, True)
    assert classify.best_round([5, 4, 3, 3.5, 2.9], 5) == (5, False)
    assert classify.best_round([1.0], 5) == (1, False)


def test_boosting_grows_more_than_one_tree_and_reports_missing_features(spark):
    from test_retention import churners

    df = churners(spark)
    model = classify.train_gbt(df, max_rounds=40, minInstancesPerNode=10)
    assert model.stages[-1].getNumTrees > 1
    with pytest.warns(UserWarning, match="TotalSpend"):
        classify.batch_score(df.withColumn("TotalSpend", F.lit(None).cast("double")), model)


def test_rank_correlation_makes_its_joined_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.sql("SELECT id * 7 % 50 AS a, id % 9 AS b, 1D * id AS c FROM range(200)").mapInArrow(counted, "a long, b long, c double")
    got = {(r["a"], r["b"]): r["value"] for r in profile.Profile(df).spearman().collect()}
    assert read.value == 3 * 200  # holes, counts per value, ranks of the rows
    ranks = df.toPandas().corr("spearman")
    assert all(abs(value - ranks.loc[pair]) < 1e-12 for pair, value in got.items()) and len(got) == 3


def test_publishing(spark, tmp_path):
    base, name = f"{tmp_path}/t", "lapse_published"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    first = tables.write_version(spark.range(3).toDF("a"), base)
    tables.register(spark, name, first)
    second = tables.write_version(spark.table(name).withColumn("b", F.lit("x")), base)
    tables.register(spark, name, second)
    assert (first[-3:], second[-3:]) == ("v=1", "v=2")
    assert rows(spark.table(name)) == [(0, "x"), (1, "x"), (2, "x")]
    third = tables.write_version(spark.range(2).toDF("c"), base)
    tables.register(spark, name, third)
    assert spark.table(name).columns == ["c"]
    assert tables.claim_version(spark, base) == 4 and tables.claim_version(spark, base) == 5
    with pytest.raises(ValueError, match="read by"):
        tables.overwrite(spark.read.parquet(third), third)
    spark.sql(f"DROP TABLE {name}")


def test_date_profile(spark):
    df = spark.sql("SELECT * FROM VALUES (date '2020-01-01', 1), (date '2020-03-01', 2), (NULL, 3) AS t(d, x)")
    (got,) = profile.Profile(df).date_stats().collect()
    assert (got["count"], got["missing"], got["distinct"], got["range_days"]) == (2, 1, 2, 60)


def test_one_scan_of_the_lines(spark):
    """Both counts of `frequency` come from one aggregation."""
    from conftest import SMALL
    from lapse.plans import catalogue

    plan = catalogue.QUERIES["frequency"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Join") == 1
