"""Every operator as a query over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapse.functions.scalars import rounded
from lapse.operators import aft, classify, clv, concordance as conc, cox, describe, episodes, evaluate, explain, sketches
from lapse.operators import kaplan_meier as km, kmeans, prep, profile, rfm, splines
from lapse.operators.logrank import logrank
from lapse.sources import retail, tables
from lapse.sources.session import pin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})


# --- survival: Kaplan-Meier and log-rank ---------------------------------------


@query
def event_table(spark, root):
    return km.event_table(retail.purchase_gaps(spark, root), "duration", "event")


@query
def km_curve(spark, root):
    curve = km.km_curve(retail.purchase_gaps(spark, root), "duration", "event")
    return _round(curve.select("t", "at_risk", "observed", "survival"), 6, "survival")


@query
def km_confidence(spark, root):
    curve = km.km_curve(retail.event_gaps(spark, root), "duration", "event")
    return _round(curve.select("t", "survival", "lower", "upper"), 6, "survival", "lower", "upper")


@query
def km_median(spark, root):
    gaps = retail.purchase_gaps(spark, root)
    return km.km_quantile(km.km_curve(gaps, "duration", "event", ["priority"]), ["priority"])


@query
def km_by_group(spark, root):
    curve = km.km_curve(retail.purchase_gaps(spark, root), "duration", "event", ["segment"])
    return _round(curve.drop("lower", "upper"), 6, "survival")


@query
def km_at_times(spark, root):
    gaps = retail.purchase_gaps(spark, root).where(F.col("segment") == "BUILDING")
    building = km.km_curve(gaps, "duration", "event", ["segment"])
    return _round(km.at_times(building, range(10), {"survival": 1.0}, ["segment"]), 6, "survival")


@query
def km_loglog(spark, root):
    curve = km.km_curve(retail.purchase_gaps(spark, root), "duration", "event", ["status"])
    return _round(km.km_log_log(curve, ["status"]), 6, "log_time", "log_log_survival")


@query
def km_log_odds(spark, root):
    curve = km.km_curve(retail.customers_survival(spark, root), "duration", "event", ["region"])
    return _round(km.km_log_odds(curve, ["region"]), 6, "log_time", "failure_odds_ref", "log_odds")


@query
def logrank_pairwise(spark, root):
    tests = logrank(retail.purchase_gaps(spark, root), "duration", "event", ["priority"])
    return _round(tests, 6, "statistic", "p").withColumn("neg_log2_p", rounded(F.col("neg_log2_p"), 4))


@query
def logrank_sweep(spark, root):
    variables = ["segment", "region", "nation"]
    tests = logrank(retail.customers_survival(spark, root), "duration", "event", variables)
    return _round(tests.drop("p", "neg_log2_p"), 6, "statistic")


# --- sources, projections and filters --------------------------------------------


@query
def scan_parquet(spark, root):
    return retail.table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query
def select_all(spark, root):
    retail.table(spark, root, "orders").createOrReplaceTempView("lapse_orders")
    return tables.select_all(spark, "lapse_orders")


@query
def preview(spark, root):
    return prep.preview(retail.table(spark, root, "customer"), "c_custkey")


@query
def schema_listing(spark, root):
    return tables.column_types(retail.table(spark, root, "lineitem"))


@query
def clean_transactions(spark, root):
    lines = prep.clean_transactions(retail.transactions(spark, root))
    return lines.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("lines"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last")
    )


@query
def clean_raw_transactions(spark, root):
    """Ids as numbers with holes (NULL and NaN), dates as text, some of which is none."""
    key = F.col("CustomerID")
    raw = retail.transactions(spark, root).select(
        F.when(key % 10 == 3, None).when(key % 10 == 7, float("nan")).otherwise(key.cast("double")).alias("CustomerID"),
        F.when(F.col("InvoiceNo") % 5 == 0, "unknown")
        .otherwise(F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss"))
        .alias("InvoiceDate"),
    )
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return prep.clean_transactions(raw).groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("InvoiceDate").alias("dated"),
        day(F.min("InvoiceDate")).alias("first"),
        day(F.max("InvoiceDate")).alias("last"),
    )


@query
def distinct_customers(spark, root):
    return prep.distinct_values(prep.clean_transactions(retail.transactions(spark, root)), "CustomerID")


@query
def churn_flag(spark, root):
    bronze = retail.table(spark, root, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "N", "No").alias("Churn"),
    )
    return prep.silver(bronze)


@query
def select_supported(spark, root):
    return prep.select_supported(retail.churn_features(spark, root), ["Tenure", "TotalSpend", "MonthlySpend"])


@query
def one_hot(spark, root):
    customers = retail.table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    return prep.one_hot(customers, ["c_mktsegment"])


@query
def coerce_numeric(spark, root):
    orders = retail.table(spark, root, "orders")
    # '1-URGENT' is not a number, the order key is
    texts = orders.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("good"),
        F.col("o_orderpriority").alias("bad"),
    )
    return prep.coerce_numeric(texts, ["good", "bad"])


@query
def fill_mode(spark, root):
    orders = retail.table(spark, root, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_totalprice") >= 20000, F.floor(F.col("o_totalprice") / 50000)).alias("price_band"),
    )
    return prep.fill_mode(orders, ["status", "price_band"])


@query
def sample_n(spark, root):
    return prep.sample_n(retail.table(spark, root, "customer"), "c_custkey", 100, seed=460409061).select(
        "c_custkey", "c_acctbal"
    )


@query
def hash_split(spark, root):
    return prep.hash_split(retail.churn_features(spark, root), "CustomerID").select("CustomerID", "ChurnBool", "split")


# --- recency, frequency, revenue ---------------------------------------------------


def _lines(spark, root):
    return prep.clean_transactions(retail.transactions(spark, root))


def _segments(spark, root):
    return rfm.segments(rfm.measures(_lines(spark, root)))


@query
def last_purchase(spark, root):
    return rfm.last_purchase(_lines(spark, root))


@query
def recency(spark, root):
    return rfm.recency(_lines(spark, root))


@query
def frequency(spark, root):
    return rfm.frequencies(_lines(spark, root))


@query
def revenue(spark, root):
    return _round(rfm.revenue(_lines(spark, root)), 2, "Revenue")


@query
def rfm_join(spark, root):
    lines = _lines(spark, root)
    joined = rfm.join_measures([rfm.recency(lines), rfm.frequency(lines), rfm.revenue(lines)])
    return _round(joined, 2, "Revenue")


@query
def top_customers(spark, root):
    top = prep.top_n(rfm.measures(_lines(spark, root)), "Revenue", "CustomerID", 5000)
    return _round(top, 2, "Revenue")


@query
def histogram(spark, root):
    customers = rfm.measures(_lines(spark, root))
    cells = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in rfm.MEASURES]
    )
    return describe.histogram(customers.select(F.inline(cells)), "x", ["measure"])


@query
def elbow(spark, root):
    customers = rfm.measures(_lines(spark, root))
    fits = kmeans.elbow(customers, rfm.MEASURES)
    return fits.withColumn("inertia", F.format_string("%.8e", "inertia"))


@query
def kmeans_1d(spark, root):
    ranked = rfm.clustered(rfm.measures(_lines(spark, root)), ["Revenue"])
    return ranked.select("CustomerID", "RevenueCluster")


@query
def kmeans_library(spark, root):
    return kmeans.kmeans_library(rfm.measures(_lines(spark, root)), "Revenue")


@query
def order_cluster(spark, root):
    customers = retail.customers_survival(spark, root)
    ranked = rfm.order_cluster(customers.select("o_custkey", "nation", "acctbal"), "nation", "acctbal", False)
    return ranked.select("o_custkey", F.col("nation").cast("bigint").alias("nation_rank"))


@query
def describe_by_cluster(spark, root):
    ranked = rfm.clustered(rfm.measures(_lines(spark, root)))
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"), F.col(f"{m}Cluster").alias("cluster"), F.col(m).cast("double").alias("x")
            )
            for m in rfm.MEASURES
        ]
    )
    stats = describe.describe(ranked.select(F.inline(cells)), "x", ["measure", "cluster"])
    return _round(stats, 4, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def score_means(spark, root):
    return _round(rfm.score_means(_segments(spark, root)), 4, *rfm.MEASURES)


@query
def segment_label(spark, root):
    return _segments(spark, root).groupBy("OverallScore", "Segment").agg(F.count(F.lit(1)).alias("customers"))


@query
def outlier_filter(spark, root):
    kept = rfm.without_outliers(rfm.measures(_lines(spark, root)), 1_800_000, 50)
    return _round(kept, 2, "Revenue")


@query
def rfm_segments(spark, root):
    return _round(_segments(spark, root), 2, "Revenue")


@query
def segment_scatter(spark, root):
    kept = rfm.without_outliers(_segments(spark, root), 1_800_000, 50)
    return _round(rfm.scatter(kept), 2, "y")


@query
def segment_scatter_binned(spark, root):
    return rfm.binned_scatter(rfm.scatter(_segments(spark, root)), 20)


# --- survival: Cox and accelerated failure time ------------------------------------

# Coefficients at which diagnostics and lifetime value are compared with SQL.
GAP_COEF = {"urgent": 0.15, "building": -0.25}
LAPSE_COEF = {"building": -0.3, "asia": 0.4}
SCENARIOS = (
    {"building": 0, "asia": 0},
    {"building": 1, "asia": 0},
    {"building": 0, "asia": 1, "rate": 0.05},
    {"building": 1, "asia": 1, "rate": 0.2},
)


def _gaps(spark, root):
    """Purchase gaps with 0/1 covariates."""
    flags = prep.one_hot(
        retail.purchase_gaps(spark, root), ["priority"],
        {"priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
    )
    return flags.withColumnRenamed("priority_1-URGENT", "urgent").withColumns(
        {"building": (F.col("segment") == "BUILDING").cast("int"), "filled": (F.col("status") == "F").cast("int")}
    )


def _lapses(spark, root):
    """Customers with 0/1 covariates and a scaled balance."""
    return retail.customers_survival(spark, root).withColumns(
        {
            "building": (F.col("segment") == "BUILDING").cast("int"),
            "asia": (F.col("region") == "ASIA").cast("int"),
            "balance": F.col("acctbal") / 1000,
        }
    )


@query
def cox_fit(spark, root):
    model = cox.fit_cox(_gaps(spark, root), "duration", "event", ["urgent"])
    return _round(cox.summary(spark, model).select("covariate", "coef", "exp_coef", "se", "z"), 5, "coef", "exp_coef", "se", "z")


@query
def cox_stratified(spark, root):
    model = cox.fit_cox(_gaps(spark, root), "duration", "event", ["urgent"], strata=["segment"])
    return _round(cox.summary(spark, model).select("covariate", "coef", "se"), 5, "coef", "se")


def _episodes(spark, root):
    return episodes.episodes(retail.order_spans(spark, root), retail.order_changes(spark, root), "id", ["urgent", "price"])


KNOTS = (90, 180, 365, 730, 1460)


@query
def order_episodes(spark, root):
    return _episodes(spark, root)


@query
def cox_time_varying(spark, root):
    model = cox.fit_cox(_episodes(spark, root), "stop", "event", ["urgent"], entry="start")
    return _round(cox.summary(spark, model).select("covariate", "coef", "exp_coef", "se", "z"), 5, "coef", "exp_coef", "se", "z")


@query
def piecewise_coefficients(spark, root):
    model = episodes.fit_piecewise(_episodes(spark, root), "stop", "event", KNOTS, ["urgent"], "start")
    table = episodes.piecewise_summary(spark, model).select("covariate", "coef", "exp_coef", "se", "z")
    return _round(table, 5, "coef", "exp_coef", "se", "z")


@query
def piecewise_hazards(spark, root):
    model = episodes.fit_piecewise(_episodes(spark, root), "stop", "event", KNOTS, ["urgent"], "start")
    return _round(episodes.piecewise_hazards(spark, model), 9, "hazard")


def _spline(rows):
    return splines.fit_spline(rows, "stop", "event", ["urgent"], 1, "start")


@query
def spline_coefficients(spark, root):
    table = splines.summary(spark, _spline(_episodes(spark, root))).where("covariate <> 'constant'")
    return _round(table.select("covariate", "coef", "se"), 5, "coef", "se")


@query
def spline_hazards(spark, root):
    """Hazard and survival of every episode at its end, with the covariates it has there."""
    rows = pin(_episodes(spark, root))  # read by the fit and by the prediction
    found = splines.predict(rows.select("id", "stop", "urgent"), "stop", _spline(rows))
    return _round(found, 6, "cumulative_hazard", "survival").withColumn("hazard", rounded(F.col("hazard"), 9))


@query
def km_at_rows(spark, root):
    people = retail.customers_survival(spark, root)
    curve = km.km_curve(people, "duration", "event", ["segment"])
    rows = people.select("o_custkey", "segment", (F.col("duration") + F.col("o_custkey") % 7 - 3).alias("time"))
    return _round(km.at_rows(rows, "time", curve, {"survival": 1.0}, ["segment"]), 6, "survival")


@query
def cox_summary(spark, root):
    table = cox.summary(spark, cox.fit_cox(_gaps(spark, root), "duration", "event", ["urgent", "building", "filled"]))
    rest = [c for c in table.columns if c not in ("covariate", "neg_log2_p")]
    return _round(table, 5, *rest).withColumn("neg_log2_p", rounded(F.col("neg_log2_p"), 4))


@query
def hazard_ratios(spark, root):
    return cox.hazard_ratios(spark, cox.fit_cox(_lapses(spark, root), "duration", "event", ["building", "asia", "balance"]))


@query
def hazard_ratios_flags(spark, root):
    model = cox.fit_cox(_gaps(spark, root), "duration", "event", ["urgent", "building", "filled"])
    return _round(cox.hazard_ratios(spark, model), 5, "exp_coef", "exp_lower", "exp_upper")


@query
def concordance(spark, root):
    counts = conc.concordance(retail.customers_survival(spark, root), "duration", "event", "acctbal")
    return _round(counts.withColumns({c: F.col(c).cast("long") for c in ("pairs", "concordant", "tied")}), 9, "concordance")


@query
def cox_metrics(spark, root):
    lapses = _lapses(spark, root)
    model = cox.fit_cox(lapses, "duration", "event", ["building", "asia"])
    scored = lapses.withColumn("score", -cox.relative_risk(model))
    index = conc.concordance(scored, "duration", "event", "score").first()["concordance"]
    table = _round(cox.metrics(spark, model, index), 6, "concordance")
    return _round(table, 5, "partial_log_likelihood", "partial_aic", "lr_statistic", "lr_p", "lr_neg_log2_p")


@query
def baseline_hazard(spark, root):
    model = cox.at_fixed(_gaps(spark, root), "duration", "event", GAP_COEF)
    return _round(cox.baseline_hazard(model), 6, "cumulative_hazard", "survival")


@query
def cox_predict(spark, root):
    model = cox.at_fixed(_lapses(spark, root), "duration", "event", LAPSE_COEF)
    return _round(cox.predict_survival(model, SCENARIOS), 6, "survival")


@query
def schoenfeld(spark, root):
    model = cox.at_fixed(_gaps(spark, root), "duration", "event", GAP_COEF)
    return _round(cox.schoenfeld(model).select("t", "covariate", "x", "n", "residual").groupBy("t", "covariate", "x").agg(
        F.sum("n").alias("n"), F.avg("residual").alias("residual")), 6, "residual")


@query
def ph_test(spark, root):
    model = cox.at_fixed(_gaps(spark, root), "duration", "event", {"urgent": 0.15})
    tests = cox.ph_test(model).drop("neg_log2_p")
    return _round(tests, 5, "statistic", "p")


@query
def ph_report(spark, root):
    return _round(cox.ph_report(cox.fit_cox(_gaps(spark, root), "duration", "event", ["urgent", "building", "filled"])), 5, "p")


@query
def smoothed_residuals(spark, root):
    model = cox.fit_cox(_gaps(spark, root), "duration", "event", ["urgent", "building", "filled"])
    return _round(cox.smoothed_residuals(model, "rank", 50), 4, "g", "residual", "effect")


# A gap of 0 days is a second order on the same day, a lifetime of 0 months a single order: half a unit.
HALF = 0.5


def _aft_table(table):
    table = _round(table.drop("neg_log2_p"), 4, "coef", "se", "lower", "upper", "p")
    return _round(table, 3, "exp_coef", "exp_lower", "exp_upper", "z")


@query
def aft_loglogistic(spark, root):
    model = aft.fit_aft(_gaps(spark, root), "duration", "event", ["urgent", "building"], shift=HALF)
    return _aft_table(aft.summary(spark, model))


@query
def aft_summary(spark, root):
    """Fit metrics of the three families side by side."""
    gaps = _lapses(spark, root)
    tables_ = []
    for family in ("loglogistic", "weibull", "lognormal"):
        model = aft.fit_aft(gaps, "duration", "event", ["building", "balance"], family, shift=HALF)
        scored = gaps.withColumn("score", aft.median_column(model))
        index = conc.concordance(scored, "duration", "event", "score").first()["concordance"]
        tables_.append(aft.metrics(spark, model, index))
    table = tables_[0].unionByName(tables_[1]).unionByName(tables_[2])
    return _round(_round(table, 4, "log_likelihood", "aic", "lr_statistic", "lr_p", "lr_neg_log2_p"), 6, "concordance")


@query
def aft_median(spark, root):
    model = aft.fit_aft(_lapses(spark, root), "duration", "event", ["building", "asia"], shift=HALF)
    table = _round(aft.median(spark, model), 3, "median")
    return table.withColumn("exp_median_ref", F.format_string("%.2e", "exp_median_ref"))


@query
def aft_coefficients(spark, root):
    """Location and shape of two families with 0/1 covariates."""
    lapses = _lapses(spark, root)
    rows = []
    for family in ("loglogistic", "weibull"):
        model = aft.fit_aft(lapses, "duration", "event", ["building", "asia"], family, shift=HALF)
        terms = [*zip([*model.covariates, "Intercept"], model.coef), ("ln shape", model.log_shape)]
        rows += [(family, term, float(value)) for term, value in terms]
    return _round(spark.createDataFrame(rows, "family string, term string, coef double"), 4, "coef")


@query
def aft_weibull(spark, root):
    fitted = aft.fit_weibull_library(_lapses(spark, root), "duration", "event", ["building", "asia"], shift=HALF)
    return _round(fitted, 3, "coef")


@query
def aft_intervals(spark, root):
    model = aft.fit_aft(_lapses(spark, root), "duration", "event", ["building", "asia"], "weibull", shift=HALF)
    return _round(aft.intervals(spark, model), 4, "coef", "lower", "upper")


@query
def aft_lognormal(spark, root):
    model = aft.fit_aft(_lapses(spark, root), "duration", "event", ["building", "asia"], "lognormal", shift=HALF)
    return _aft_table(aft.summary(spark, model))


# --- lifetime value -----------------------------------------------------------------


def _payback(spark, root):
    model = cox.at_fixed(_lapses(spark, root), "duration", "event", LAPSE_COEF)
    return clv.payback(model, SCENARIOS, horizon=60)


@query
def clv_payback(spark, root):
    return _round(_payback(spark, root), 2, "expected_profit", "npv", "cumulative_npv")


STRATA = {"strata": ["region"]}


@query
def clv_payback_stratified(spark, root):
    model = cox.at_fixed(_lapses(spark, root), "duration", "event", {"building": -0.3}, **STRATA)
    table = clv.payback(model, [{"building": 0}, {"building": 1, "rate": 0.05}], horizon=60)
    return _round(table, 2, "expected_profit", "npv", "cumulative_npv")


@query
def customer_ltv_stratified(spark, root):
    lapses = _lapses(spark, root)
    model = cox.at_fixed(lapses, "duration", "event", {"building": -0.3}, **STRATA)
    return _round(clv.customer_ltv(lapses, model, "o_custkey"), 2, "lifetime_value").withColumn(
        "relative_risk", rounded(F.col("relative_risk"), 6)
    )


@query
def npv_milestones(spark, root):
    return _round(clv.milestones(_payback(spark, root)), 2, "cumulative_npv")


@query
def clv_survival(spark, root):
    return clv.survival_curve(_payback(spark, root))


@query
def payback_period(spark, root):
    return clv.payback_period(_payback(spark, root), 600.0)


@query
def customer_ltv(spark, root):
    lapses = _lapses(spark, root)
    model = cox.at_fixed(lapses, "duration", "event", LAPSE_COEF)
    return _round(clv.customer_ltv(lapses, model, "o_custkey"), 2, "lifetime_value").withColumn(
        "relative_risk", rounded(F.col("relative_risk"), 6)
    )


# --- dataset profile ----------------------------------------------------------------


def _orders_with_gaps(spark, root):
    """Orders with values missing where the price is low or the status is partial."""
    return retail.table(spark, root, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.lit(1).alias("constant"),
    )


def _lineitem(spark, root):
    return profile.Profile(retail.table(spark, root, "lineitem"))


@query
def profile_overview(spark, root):
    return profile.Profile(_orders_with_gaps(spark, root).drop("o_orderkey")).overview()


@query
def profile_numeric(spark, root):
    stats = _lineitem(spark, root).numeric_stats()
    precise = ["mean", "std", "mad", "cv", "skewness", "kurtosis"]
    stats = _round(stats, 6, *precise)
    return _round(stats, 2, "min", "max", "range", "sum").withColumn("variance", F.format_string("%.8e", "variance"))


@query
def profile_quantiles(spark, root):
    return _round(_lineitem(spark, root).quantiles(), 4, "p5", "p25", "p50", "p75", "p95", "iqr")


@query
def profile_categorical(spark, root):
    return _round(profile.Profile(_orders_with_gaps(spark, root)).categorical_stats(), 6, "mean_length")


@query
def profile_common_values(spark, root):
    customers = retail.table(spark, root, "customer").select("c_mktsegment", "c_nationkey", "c_name")
    return profile.Profile(customers).common_values(3)


@query
def profile_extremes(spark, root):
    return _lineitem(spark, root).extremes()


@query
def profile_histogram(spark, root):
    return _lineitem(spark, root).histograms()


@query
def profile_dates(spark, root):
    return _lineitem(spark, root).date_stats()


@query
def profile_missing(spark, root):
    return _round(profile.Profile(_orders_with_gaps(spark, root)).missing(), 6, "share")


@query
def profile_missing_correlation(spark, root):
    return _round(profile.Profile(_orders_with_gaps(spark, root)).missing_correlation(), 6, "value")


@query
def profile_correlation(spark, root):
    lines = _lineitem(spark, root)
    pearson = lines.pearson().withColumn("method", F.lit("pearson"))
    spearman = lines.spearman().withColumn("method", F.lit("spearman"))
    cramer = lines.cramers_v().select("a", "b", "value", F.lit("cramers_v").alias("method"))
    return _round(pearson.unionByName(spearman).unionByName(cramer), 6, "value")


@query
def profile_correlation_holes(spark, root):
    """Two numeric columns with holes in different rows and one without."""
    orders = retail.table(spark, root, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") > 100_000, F.round("o_totalprice", -3)).alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 50).alias("bucket"),
    )
    found = profile.Profile(orders)
    pearson = found.pearson().withColumn("method", F.lit("pearson"))
    return _round(pearson.unionByName(found.spearman().withColumn("method", F.lit("spearman"))), 6, "value")


@query
def profile_sketch(spark, root):
    """Sketches of every partition of the orders, merged: what is exact in them, and the commonest of few values."""
    orders = retail.table(spark, root, "orders").withColumn("price", F.when(F.col("o_totalprice") > 100_000, F.col("o_totalprice")))
    merged = sketches.merge(sketches.sketch(orders.drop("o_orderdate"), ["o_orderstatus"]))
    found = sketches.report(merged).select("column", "kind", "rows", "count", "missing", "mean", "std", "min", "max", "frequent")
    few = F.when(F.col("column") == "o_orderpriority", F.col("frequent")[0]["count"]).alias("mode_count")
    return _round(_round(found, 4, "mean", "std"), 2, "min", "max").select(*[c for c in found.columns if c != "frequent"], few)


@query
def profile_interactions(spark, root):
    return _lineitem(spark, root).interactions()


@query
def profile_alerts(spark, root):
    return profile.Profile(_orders_with_gaps(spark, root)).alerts()


@query
def profile_sample(spark, root):
    return profile.Profile(retail.table(spark, root, "customer")).sample(["c_custkey"])


# --- churn classifier ---------------------------------------------------------------

# A fixed scorer: logistic in the three features, so that SQL can score too.
SCORER = "1 / (1 + exp(0.8 + 0.02 * Tenure - 0.00002 * MonthlySpend - 0.0000001 * TotalSpend))"


def _split_features(spark, root):
    return prep.hash_split(retail.churn_features(spark, root), "CustomerID")


@query
def stratified_split(spark, root):
    rows = prep.stratified_split(retail.churn_features(spark, root), "CustomerID", "ChurnBool")
    return rows.select("CustomerID", "ChurnBool", "split")


def _fixed_scorer():
    return PipelineModel(
        [
            SQLTransformer(statement=f"SELECT *, {SCORER} AS probability FROM __THIS__"),
            SQLTransformer(statement="SELECT *, if(probability >= 0.5, 1D, 0D) AS prediction FROM __THIS__"),
        ]
    )


@query
def impute_mean(spark, root):
    rows = _split_features(spark, root).withColumn("Balance", F.when(F.col("Balance") > 0, F.col("Balance")))
    filled = prep.impute_mean(rows, ["Balance"], rows.where("split = 'train'"))
    return _round(filled.select("CustomerID", "Balance"), 4, "Balance")


@query
def standardize(spark, root):
    rows = _split_features(spark, root)
    scaled = prep.standardize(rows, ["Tenure", "Balance"], rows.where("split = 'train'"))
    return _round(scaled.select("CustomerID", "Tenure", "Balance"), 6, "Tenure", "Balance")


@query
def train_gbt(spark, root):
    rows = _split_features(spark, root)
    model = classify.train_gbt(rows)
    return classify.batch_score(rows, model).select("CustomerID", "split", "prediction", "probability")


@query
def trial_table(spark, root):
    grid = classify.random_grid({"maxDepth": [2, 4, 6], "stepSize": [0.1, 0.3], "minInstancesPerNode": [20, 132]}, 3)
    return classify.trials(_split_features(spark, root), grid)[0]


@query
def trial_halving(spark, root):
    """Four sets, of which two go on after eight rounds."""
    grid = [{"maxDepth": depth, "stepSize": step, "minInstancesPerNode": 20} for depth in (2, 4) for step in (0.1, 0.3)]
    return classify.trials(_split_features(spark, root), grid, max_rounds=24, first_rounds=8)[0]


@query
def boosted_stumps(spark, root):
    """Boosting that SQL can follow: trees of one condition on one feature with few values, every row in every round."""
    rows = _split_features(spark, root)
    model = classify.train_gbt(
        rows, features=["Tenure"], max_rounds=6, maxDepth=1, minInstancesPerNode=1, subsamplingRate=1.0, featureSubsetStrategy="all"
    )
    return _round(classify.batch_score(rows, model).select("CustomerID", "split", "prediction", "probability"), 6, "probability")


@query
def score_bayes(spark, root):
    """Preprocessing with missing values and batch scores of a model with probability vectors."""
    rows = _split_features(spark, root).withColumn("TotalSpend", F.when(F.col("Balance") > 0, F.col("TotalSpend")))
    train = rows.where("split = 'train'")
    ready = classify.fit_preprocessing(train)
    bayes = NaiveBayes(modelType="gaussian", labelCol="ChurnBool").fit(ready.transform(train))
    scored = classify.batch_score(rows, PipelineModel([*ready.stages, bayes]))
    return _round(scored.select("CustomerID", "prediction", "probability", "Churn"), 5, "probability")


@query
def batch_score(spark, root):
    scored = classify.batch_score(_split_features(spark, root), _fixed_scorer())
    return _round(scored.select("CustomerID", "prediction", "probability", "Churn"), 8, "probability")


@query
def binary_metrics(spark, root):
    scored = classify.batch_score(_split_features(spark, root), _fixed_scorer())
    metrics = evaluate.binary_metrics(scored, "ChurnBool", "probability", ["split"])
    return _round(metrics, 6, "accuracy", "precision", "recall", "f1", "log_loss", "roc_auc")


@query
def metrics_table(spark, root):
    scored = classify.batch_score(_split_features(spark, root), _fixed_scorer())
    metrics = evaluate.binary_metrics(scored, "ChurnBool", "probability", ["split"])
    table = evaluate.metrics_table(metrics, "split", {"val": "validation", "test": "test"})
    return _round(table, 6, "validation", "test")


@query
def confusion_matrix(spark, root):
    scored = classify.batch_score(_split_features(spark, root), _fixed_scorer())
    return evaluate.confusion_matrix(scored.where("split = 'val'"), "ChurnBool", "prediction")


@query
def roc_curve(spark, root):
    return _round(evaluate.roc_curve(retail.scored_documents(spark, root), "label", "score"), 6, "threshold", "fpr", "tpr")


@query
def pr_curve(spark, root):
    points = evaluate.pr_curve(retail.scored_documents(spark, root), "label", "score")
    return _round(points, 6, "threshold", "precision", "recall")


def _shapley(spark, root):
    rows = _split_features(spark, root)
    return explain.shapley_values(
        rows.where("split = 'val'"), rows.where("split = 'train'"), "CustomerID",
        classify.FEATURES, _fixed_scorer().transform,
    )


@query
def shapley_values(spark, root):
    return _round(_shapley(spark, root), 6, "value", "shapley")


@query
def shapley_summary(spark, root):
    return _round(explain.shapley_summary(_shapley(spark, root)), 6, "mean_abs_shapley")


WIDE = ["Tenure", "TotalSpend", "MonthlySpend", "Balance", "Tenure_2", "Spend_3", "Balance_2"]
LEVELS = {"Segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "Region": ["AFRICA", "AMERICA", "ASIA", "EUROPE"]}


@query
def kernel_shapley(spark, root):
    """Sixteen features, with products of two: the values that the kernel regression estimates are known in closed form."""
    rows = prep.one_hot(_split_features(spark, root), ["Segment", "Region"], LEVELS).withColumns({
        "Tenure_2": F.col("Tenure") * F.col("Tenure") / F.lit(100.0),
        "Spend_3": F.col("CustomerID") % 3,
        "Balance_2": F.col("Balance") * 2 - F.col("Tenure"),
    })
    features = [*WIDE, *[f"{c}_{v}" for c, values in LEVELS.items() for v in values]]

    def predict(df):
        linear = " + ".join(f"{(j + 1) / 10}D * `{c}` / {1e6 if 'Spend' in c and c != 'Spend_3' else 1e3}D" for j, c in enumerate(features))
        return df.withColumn("prediction", F.expr(f"{linear} + 0.002D * Tenure * Spend_3 + 0.0001D * Segment_BUILDING * Balance"))

    values = explain.kernel_shapley(
        rows.where("split = 'val'"), rows.where("split = 'train'"), "CustomerID", features, predict, n_coalitions=200
    )
    return _round(values, 9, "value", "shapley")
