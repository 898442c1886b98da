"""Segmentation, preparation, tables, profile, classifier and lifetime value."""

import math
import random
import warnings

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from conftest import rows
from lapse.operators import classify, clv, cox, describe, evaluate, explain, kmeans, prep, profile, rfm
from lapse.plans import retention
from lapse.sources import schemas, tables
from lapse.sources.session import pin

HEADER = "﻿CustomerID,Gender,WinLossRatio,Tenure,NumberActiveGames,Platform,PaymentMethod,MonthlySpend,TimeWindow\r\n"
LINES = "a-1,Male,0.5,44,4,Web,Mailed check,400,202208-202210\r\nb-2,Female,bad,9,2,App,Mailed check,104.25,202208-202210\r\n"


# --- files and tables ---------------------------------------------------------------


def test_csv_is_bound_by_header(spark, tmp_path):
    path = str(tmp_path / "new.csv")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(HEADER + LINES)
    with pytest.warns(UserWarning, match="TotalSpend"):
        df = tables.read_csv(spark, path, schemas.NEW_CUSTOMERS)
    assert df.schema.fieldNames() == schemas.NEW_CUSTOMERS.fieldNames()
    first, second = sorted(df.collect())
    assert (first["CustomerID"], first["Tenure"], first["MonthlySpend"]) == ("a-1", 44, 400.0)
    assert first["TotalSpend"] is None and first["TimeWindow"] == "202208-202210"
    assert second["WinLossRatio"] is None
    # by position the window lands in TotalSpend and is lost
    by_position = tables.read_csv(spark, path, schemas.NEW_CUSTOMERS, positional=True).orderBy("CustomerID").first()
    assert by_position["TotalSpend"] is None and by_position["TimeWindow"] is None
    assert tables.read_csv_inferred(spark, path).schema["Tenure"].dataType.typeName() == "integer"


def test_medallion_tables(spark, tmp_path):
    tables.create_database(spark, "lapse_test", replace=True)
    bronze = spark.createDataFrame(
        [("a", "Yes"), ("b", "No"), ("c", None), ("d", "maybe")], "CustomerID string, Churn string"
    )
    silver = prep.silver(bronze)
    assert rows(silver) == [("a", 1), ("b", 0), ("c", 0), ("d", 0)]
    base = str(tmp_path / "silver")
    tables.register(spark, schemas.SILVER_TABLE, tables.write_version(silver, base))
    # rewrite a table from itself, with one more column
    current = spark.table(schemas.SILVER_TABLE)
    path = tables.write_version(current.withColumn("Churn", F.lit(1.0)), base)
    tables.register(spark, schemas.SILVER_TABLE, path)
    assert tables.latest_version(spark, base) == 2
    assert tables.select_all(spark, schemas.SILVER_TABLE).columns == ["CustomerID", "ChurnBool", "Churn"]
    assert tables.read_version(spark, base, 1).columns == ["CustomerID", "ChurnBool"]
    tables.overwrite(silver, str(tmp_path / "plain"))
    assert tables.read_snapshot(spark, str(tmp_path / "plain"), ["ChurnBool"]).columns == ["CustomerID"]
    tables.save_managed(silver, "managed_copy")
    assert spark.table("managed_copy").count() == 4
    assert rows(tables.column_types(silver)) == [(0, "CustomerID", "string", 4), (1, "ChurnBool", "int", 4)]
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, str(tmp_path / "nothing"))
    spark.sql("USE default")


# --- preparation ---------------------------------------------------------------------


def test_cleaning_drops_missing_ids_and_parses_dates(spark):
    df = spark.createDataFrame(
        [(1.0, "2024-01-02 10:00:00"), (float("nan"), "2024-01-02"), (None, "2024-01-02"), (2.0, "no date")],
        "CustomerID double, InvoiceDate string",
    )
    clean = prep.clean_transactions(df)
    got = {r["CustomerID"]: r["InvoiceDate"] for r in clean.collect()}
    assert set(got) == {"1.0", "2.0"} and got["2.0"] is None and got["1.0"].hour == 10


def test_one_hot_levels_and_nulls(spark):
    df = spark.createDataFrame([(1, "No"), (2, "Yes (auto)"), (3, None)], "id int, p string")
    assert rows(prep.one_hot(df, ["p"])) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    assert prep.one_hot(df, ["p"]).columns == ["id", "p_No", "p_Yes (auto)"]
    assert prep.one_hot(df, ["p"], drop_first=True).columns == ["id", "p_Yes (auto)"]
    with pytest.raises(ValueError, match="levels"):
        prep.levels(df, "p", at_most=1)


def test_split_and_sample_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    want = rows(prep.hash_split(df, "k"))
    assert rows(prep.hash_split(df.repartition(17), "k")) == want
    shares = {s: sum(r[1] == s for r in want) / 2000 for s in ("train", "val", "test")}
    assert shares == pytest.approx({"train": 0.6, "val": 0.2, "test": 0.2}, abs=0.03)
    sample = rows(prep.sample_n(df, "k", 100, seed=1))
    assert len(sample) == 100 and rows(prep.sample_n(df.repartition(5), "k", 100, seed=1)) == sample
    assert prep.sample_n(df, "k", 5000).count() == 2000


def test_filling(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("b", 3.0), ("a", None), (None, 5.0)], "s string, x double")
    assert rows(prep.modes(df, ["s", "x"])) == [("a", 1.0)]  # ties: the smallest
    assert [r["s"] for r in prep.fill_mode(df, ["s"]).collect()].count("a") == 3
    assert sorted(r["x"] for r in prep.impute_mean(df, ["x"]).collect()) == [1.0, 3.0, 3.0, 3.0, 5.0]
    empty = df.withColumn("x", F.lit(None).cast("double"))
    with pytest.raises(ValueError):
        prep.impute_mean(empty, ["x"])
    with pytest.warns(UserWarning, match="every row"):
        assert {r["x"] for r in prep.impute_mean(empty, ["x"], df).collect()} == {3.0}
    scaled = [r["x"] for r in prep.standardize(df.dropna(), ["x"]).orderBy("x").collect()]
    assert scaled == pytest.approx([-1.0, 1.0])
    assert {r["c"] for r in prep.standardize(df.withColumn("c", F.lit(4.0)), ["c"]).collect()} == {0.0}


# --- recency, frequency, revenue ------------------------------------------------------


def transactions(spark):
    data = [
        ("a", "2024-01-01 23:59:00", 1.0, 10.0), ("a", "2024-01-10 00:00:00", 2.0, 5.0), ("b", "2024-01-09 00:01:00", None, 3.0),
        ("c", "2024-01-01 00:00:00", 4.0, 2.5), ("c", None, 1.0, 1.0),
    ]
    df = spark.createDataFrame(data, "CustomerID string, d string, Quantity double, UnitPrice double")
    return df.withColumn("InvoiceDate", F.to_timestamp("d")).drop("d")


def test_measures(spark):
    got = {r["CustomerID"]: r for r in rfm.measures(transactions(spark)).collect()}
    # 23 h 59 min is no whole day
    assert (got["a"]["Recency"], got["b"]["Recency"], got["c"]["Recency"]) == (0, 0, 9)
    assert (got["a"]["Frequency"], got["c"]["Frequency"]) == (2, 1)
    assert (got["a"]["Revenue"], got["b"]["Revenue"], got["c"]["Revenue"]) == (20.0, 0.0, 11.0)
    joined = rfm.join_measures(
        [f(transactions(spark)) for f in (rfm.recency, rfm.frequency, rfm.revenue)]
    )
    assert rows(joined) == rows(rfm.measures(transactions(spark)))


def lloyd(values, centers, tol=1e-4):
    values, variance = np.array(values, dtype=float), np.var(values)
    while True:
        cuts = (centers[1:] + centers[:-1]) / 2
        label = (values[:, None] > cuts).sum(1)
        moved = np.array([values[label == j].mean() if (label == j).any() else c for j, c in enumerate(centers)])
        shift = ((moved - centers) ** 2).sum()
        centers = moved
        if shift <= tol * variance:
            return centers


def test_kmeans_is_plain_lloyd(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(m, 2), 2) for m in (0, 10, 30, 80) for _ in range(60)] + [5.0] * 40
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    counts = pin(kmeans.value_counts(df, ["x"]))
    fits = kmeans.fit_kmeans(counts, [1, 3, 4])
    ordered = sorted(values)
    for k in (1, 3, 4):
        seeds = sorted({ordered[math.floor((len(values) - 1) * (2 * i + 1) / (2 * k))] for i in range(k)})
        assert fits["x", k] == pytest.approx(lloyd(values, np.array(seeds)))
    inertia = {r["k"]: r["inertia"] for r in kmeans.inertia(counts, fits).collect()}
    assert inertia[1] > inertia[3] > inertia[4]
    assert kmeans.kmeans_library(df, "x").agg(F.sum("customers")).first()[0] == len(values)


def test_cluster_numbers(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, None), (4, 5.0)], "id int, x double")
    up = {r["id"]: r["xCluster"] for r in kmeans.with_clusters(df, {"x": [1.0, 5.0, 9.0]}).collect()}
    assert up == {1: 0, 2: 2, 3: None, 4: 1}
    down = {r["id"]: r["xCluster"] for r in kmeans.with_clusters(df, {"x": [1.0, 9.0]}, ["x"]).collect()}
    assert down == {1: 1, 2: 0, 3: None, 4: 1}  # a midpoint belongs to the lower cluster
    assert {r["xCluster"] for r in kmeans.with_clusters(df, {"x": [4.0]}).collect()} == {0, None}
    ranked = rfm.order_cluster(df.withColumn("c", F.col("id") % 2), "c", "x", ascending=False)
    assert {r["id"]: r["c"] for r in ranked.collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_segments(spark):
    rng = random.Random(4)
    data = [(i, rng.randint(0, 300), rng.randint(1, 60), rng.random() * 5000) for i in range(200)]
    customers = pin(spark.createDataFrame(data, "CustomerID int, Recency int, Frequency int, Revenue double"))
    got = rfm.segments(customers).collect()
    for r in got:
        assert r["OverallScore"] == r["RecencyCluster"] + r["FrequencyCluster"] + r["RevenueCluster"]
        want = "High-Value" if r["OverallScore"] > 4 else "Mid-Value" if r["OverallScore"] > 2 else "Low-Value"
        assert r["Segment"] == want
    newest, oldest = min(got, key=lambda r: r["Recency"]), max(got, key=lambda r: r["Recency"])
    assert newest["RecencyCluster"] == 3 and oldest["RecencyCluster"] == 0


def test_quantiles_match_numpy(spark):
    rng = random.Random(7)
    data = [("ab"[i % 5 == 0], round(rng.expovariate(0.1), 1)) for i in range(500)] + [("a", None)]
    df = spark.createDataFrame(data, "k string, x double")
    shares = (0.05, 0.25, 0.5, 0.95)
    for per_slice in (0, 17):
        got = {r["k"]: r[1:] for r in describe.quantiles(df, "x", shares, ["k"], rows_per_slice=per_slice).collect()}
        for key in "ab":
            values = [v for k, v in data if k == key and v is not None]
            assert list(got[key]) == pytest.approx(list(np.quantile(values, shares)))
    total = describe.describe(df, "x").first()
    values = [v for _, v in data if v is not None]
    assert (total["count"], total["p50"]) == (500, pytest.approx(np.median(values)))


def test_histogram_has_readable_bins(spark):
    df = spark.range(0, 95).select(F.col("id").cast("double").alias("x"))
    got = rows(describe.histogram(df, "x"))
    assert got[0] == (0.0, 10.0, 10) and len(got) == 10 and sum(r[2] for r in got) == 95
    assert rows(describe.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x")) == [(3.0, 4.0, 4)]


# --- profile ----------------------------------------------------------------------------


def test_profile_sections(spark):
    rng = random.Random(9)
    data = [(rng.randint(0, 5), round(rng.gauss(0, 3), 1), rng.choice(["u", "v", None]), rng.choice("pq"), 7) for _ in range(300)]
    df = spark.createDataFrame(data + data[:4], "a int, b double, s string, q string, c int")
    whole = profile.Profile(df)
    over = whole.overview().first()
    assert over["rows"] == 304 and over["duplicate_rows"] == 304 - len(set(data))
    assert over["missing_cells"] == sum(r[2] is None for r in data + data[:4])
    b = np.array([r[1] for r in data + data[:4]])
    stats = {r["column"]: r for r in whole.numeric_stats().collect()}
    assert stats["b"]["mad"] == pytest.approx(np.median(np.abs(b - np.median(b))))
    assert stats["b"]["distinct"] == len(set(b)) and stats["b"]["negatives"] == (b < 0).sum()
    assert stats["c"]["variance"] == 0 and stats["b"]["variance"] == pytest.approx(b.var(ddof=1))
    sliced = {r["column"]: r for r in profile.Profile(df, rows_per_slice=10).numeric_stats().collect()}
    assert sliced["b"]["mad"] == pytest.approx(stats["b"]["mad"])

    def ranks(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, x) + np.searchsorted(order, x, "right") + 1) / 2 for x in v])

    a = np.array([r[0] for r in data + data[:4]], dtype=float)
    rank = {(r["a"], r["b"]): r["value"] for r in whole.spearman().collect()}
    assert rank["a", "b"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1])
    assert rank["a", "c"] is None  # a constant has no correlation
    pearson = {(r["a"], r["b"]): r["value"] for r in whole.pearson().collect()}
    assert pearson["a", "b"] == pytest.approx(np.corrcoef(a, b)[0, 1])
    alerts = {(r["column"], r["alert"]) for r in whole.alerts().collect()}
    assert ("c", "constant") in alerts and ("(rows)", "duplicates") in alerts
    common = [r for r in whole.common_values(2).collect() if r["column"] == "q"]
    assert sum(r["count"] for r in common) == 304
    assert whole.interactions(5).where("a = 'a' AND b = 'b'").agg(F.sum("n")).first()[0] == 304
    perfect = profile.Profile(df.select("q", F.col("q").alias("r"))).cramers_v().first()
    assert perfect["value"] == pytest.approx(1.0)


# --- classifier ----------------------------------------------------------------------------

SCORED = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.3), (0, 0.1)]


def test_metrics_with_tied_scores(spark):
    df = spark.createDataFrame(SCORED, "y int, p double")
    m = evaluate.binary_metrics(df, "y", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (pytest.approx(4 / 6), pytest.approx(2 / 3), pytest.approx(2 / 3))
    wins = sum((p > q) + (p == q) / 2 for y, p in SCORED for z, q in SCORED if y and not z)
    assert m["roc_auc"] == pytest.approx(wins / 9)
    loss = -sum(math.log(p if y else 1 - p) for y, p in SCORED) / 6
    assert m["log_loss"] == pytest.approx(loss)
    assert evaluate.binary_metrics(df, "y", "p", rows_per_slice=1).first()["roc_auc"] == pytest.approx(wins / 9)
    roc = [(r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "y", "p").orderBy(F.desc("threshold")).collect()]
    assert np.allclose(roc, [(0, 0), (0, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 1), (1, 1)])
    pr = [(r["precision"], r["recall"]) for r in evaluate.pr_curve(df, "y", "p").orderBy(F.desc_nulls_last("threshold")).collect()]
    assert np.allclose(pr, [(1, 1 / 3), (2 / 3, 2 / 3), (3 / 5, 1), (1 / 2, 1), (1, 0)])
    assert evaluate.roc_curve(df, "y", "p", points=2).count() == 3
    none = df.withColumn("h", F.lit(0))
    assert rows(evaluate.confusion_matrix(none, "y", "h")) == [(0, 0, 3), (0, 1, 0), (1, 0, 3), (1, 1, 0)]


def churners(spark, n=1200):
    rng = random.Random(11)
    data = []
    for i in range(n):
        tenure, monthly = rng.randint(1, 72), round(rng.uniform(20, 400), 2)
        churn = int(rng.random() < 1 / (1 + math.exp(0.08 * (tenure - 30) - 0.004 * (monthly - 200))))
        data.append((i, tenure, monthly, None if i % 10 == 0 else round(tenure * monthly, 2), churn))
    df = spark.createDataFrame(data, "CustomerID int, Tenure int, MonthlySpend double, TotalSpend double, ChurnBool int")
    return prep.hash_split(df, "CustomerID")


def test_training_scoring_and_storage(spark, tmp_path):
    df = pin(churners(spark))
    table, model = classify.trials(
        df, [{"maxDepth": 2, "minInstancesPerNode": 10}, {"maxDepth": 1, "minInstancesPerNode": 10}], max_rounds=5
    )
    trials = table.collect()
    assert [t["best"] for t in trials].count(True) == 1
    assert max(trials, key=lambda t: t["f1"])["best"]
    scored = classify.batch_score(df, model)
    assert scored.columns == [*df.columns, "prediction", "probability", "Churn"]
    assert evaluate.binary_metrics(scored, "ChurnBool", "probability").first()["roc_auc"] > 0.7
    base = str(tmp_path)
    assert (classify.save_model(model, base, "churn"), classify.save_model(model, base, "churn")) == (1, 2)
    again = classify.batch_score(df, classify.load_model(base, "churn"))
    assert rows(again.select("CustomerID", "probability")) == rows(scored.select("CustomerID", "probability"))
    # scoring rows whose TotalSpend is missing throughout
    blank = df.withColumn("TotalSpend", F.lit(None).cast("double"))
    assert classify.batch_score(blank, model).where("probability IS NULL").count() == 0
    foreign = classify.score_with(df, lambda rows_: rows_["Tenure"] / 100)
    assert foreign.where(F.abs(F.col("Churn") - F.col("Tenure") / 100) > 1e-9).count() == 0


def test_medallion_to_scored_table(spark, tmp_path):
    churn = churners(spark, 400)
    history = str(tmp_path / "history.csv")
    lines = ["CustomerID,Gender,WinLossRatio,Tenure,NumberActiveGames,Platform,PaymentMethod,MonthlySpend,TotalSpend,TimeWindow,Churn"]
    for r in churn.collect():
        total = "" if r["TotalSpend"] is None else r["TotalSpend"]
        lines.append(f"c{r['CustomerID']},Male,0.5,{r['Tenure']},2,Web,Mailed check,{r['MonthlySpend']},{total},w,{'Yes' if r['ChurnBool'] else 'No'}")
    with open(history, "w") as f:
        f.write("\n".join(lines))
    new = str(tmp_path / "new.csv")
    with open(new, "w", encoding="utf-8", newline="") as f:
        f.write(HEADER + LINES)
    base = str(tmp_path / "tables")
    with pytest.warns(UserWarning):
        retention.load_medallion(spark, history, new, base, "lapse_flow", replace=True)
    assert spark.table(f"lapse_flow.{schemas.SILVER_TABLE}").count() == 400
    version = retention.train_and_store(spark, "lapse_flow", f"{base}/models", "churn", max_rounds=3, minInstancesPerNode=10)
    assert version == 1
    retention.score_and_store(spark, "lapse_flow", base, f"{base}/models", "churn")
    scored = spark.table(f"lapse_flow.{schemas.NEW_CUSTOMERS_TABLE}")
    assert scored.count() == 2 and {"Churn", "probability"} <= set(scored.columns)
    # scoring the scored table again replaces the column
    retention.score_and_store(spark, "lapse_flow", base, f"{base}/models", "churn")
    assert spark.table(f"lapse_flow.{schemas.NEW_CUSTOMERS_TABLE}").columns == scored.columns
    spark.sql("USE default")


def test_random_grid_is_repeatable():
    space = {"maxDepth": [2, 3, 4], "stepSize": [0.05, 0.1]}
    assert classify.random_grid(space, 5, 1) == classify.random_grid(space, 5, 1)
    assert len(classify.random_grid(space, 5, 1)) == 5


def test_preprocessing_uses_training_rows_only(spark):
    df = churners(spark)
    train = df.where("split = 'train'")
    fitted = classify.fit_preprocessing(train)
    out = fitted.transform(train).select(
        F.avg("std_TotalSpend").alias("m"), F.stddev_pop("std_TotalSpend").alias("s")
    ).first()
    assert out["m"] == pytest.approx(0, abs=1e-9) and out["s"] == pytest.approx(1)


def test_shapley_values_add_up(spark):
    df = churners(spark, 400)
    predict = PipelineModel(
        [SQLTransformer(statement="SELECT *, 2 * Tenure - MonthlySpend / 10 AS prediction FROM __THIS__")]
    ).transform
    examples, background = df.where("split = 'val'"), df.where("split = 'train'")
    values = explain.shapley_values(
        examples, background, "CustomerID", ["MonthlySpend", "Tenure", "TotalSpend"], predict, n_examples=20, n_background=30
    )
    drawn = prep.sample_n(background, "CustomerID", 30, 460409061).collect()
    mean_tenure = sum(r["Tenure"] for r in drawn) / 30
    for r in values.collect():
        if r["feature"] == "Tenure":  # linear: coefficient times distance from the mean
            assert r["shapley"] == pytest.approx(2 * (r["value"] - mean_tenure))
        if r["feature"] == "TotalSpend":
            assert r["shapley"] == pytest.approx(0, abs=1e-9)
    assert explain.shapley_summary(values).first()["feature"] == "Tenure"


# --- lifetime value ---------------------------------------------------------------------------


def half_even(x, places=2):
    return float(round(x, places))


def test_payback_arithmetic(spark):
    rng = random.Random(13)
    data = [(i, rng.randint(1, 40), rng.randint(0, 1), rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "id int, t int, e int, x int")
    model = cox.fit_cox(df, "t", "e", ["x"])
    with pytest.warns(UserWarning, match="partner"):
        table = clv.payback(model, [{"x": 1, "partner": 1}, {"x": 0, "rate": 0.0}], horizon=36)
    hazard = {r["t"]: r["cumulative_hazard"] for r in cox.baseline_hazard(model).collect()}
    got = {(r["scenario"], r["contract_month"]): r for r in table.collect()}
    assert len(got) == 72
    total = 0.0
    for month in range(36):
        h = max((v for t, v in hazard.items() if t <= month), default=0.0)
        s = half_even(math.exp(-h * math.exp(float(model.coef[0] * (1 - model.means[0]))))) if month else 1.0
        npv = half_even(half_even(s * 30) / (1 + 0.1 / 12) ** month)
        total += npv
        r = got[0, month + 1]
        assert (r["survival"], r["npv"]) == (pytest.approx(s), pytest.approx(npv))
        assert r["cumulative_npv"] == pytest.approx(total)
    assert got[1, 5]["npv"] == got[1, 5]["expected_profit"]
    assert {r["contract_month"] for r in clv.milestones(table).collect()} == {12, 24, 36}
    month = clv.payback_period(table, 200.0).where("scenario = 0").first()["payback_month"]
    assert got[0, month]["cumulative_npv"] >= 200 > got[0, month - 1]["cumulative_npv"]
    assert clv.payback_period(table, 1e9).first()["payback_month"] is None
    ltv = {r["id"]: r["lifetime_value"] for r in clv.customer_ltv(df, model, "id", horizon=36).collect()}
    assert ltv[next(i for i, _, _, x in data if x == 1)] == pytest.approx(total)
    sparse = clv.payback(model, [{"x": 1}], dense=False)
    assert sparse.count() == 1 + len(hazard)


def test_no_warning_for_known_covariates(spark):
    model = cox.CoxModel(["x"], np.array([0.1]), np.eye(1), 0, 0, 1, 1, "efron", 0.05, [], np.zeros(1), 0, None)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert clv.check_scenarios(model, [{"x": 1}]) == [{"x": 1.0, "rate": 0.1}]
