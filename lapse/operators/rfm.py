"""Recency, frequency, revenue: per-customer measures, ranks and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lapse.functions.scalars import segment_label, whole_days
from lapse.operators.kmeans import fit_kmeans, occupied, value_counts, with_clusters
from lapse.operators.running import lookup_join
from lapse.sources.session import pin

MEASURES = ("Recency", "Frequency", "Revenue")


def last_purchase(df: DataFrame, customer: str = "CustomerID", date: str = "InvoiceDate") -> DataFrame:
    """Latest purchase per customer and latest purchase overall."""
    per_customer = df.groupBy(customer).agg(F.max(date).alias("MaxPurchaseDate"))
    return per_customer.withColumn("Newest", per_customer.agg(F.max("MaxPurchaseDate")).scalar())


def recency(df: DataFrame, customer: str = "CustomerID", date: str = "InvoiceDate") -> DataFrame:
    """Whole days between a customer's latest purchase and the latest of all."""
    return last_purchase(df, customer, date).select(
        customer, whole_days(F.col("MaxPurchaseDate"), F.col("Newest")).alias("Recency")
    )


def frequency(
    df: DataFrame,
    customer: str = "CustomerID",
    date: str = "InvoiceDate",
    distinct_invoices: str | None = None,
) -> DataFrame:
    """Invoice lines with a date per customer, or distinct invoices when a column is named."""
    count = F.count(date) if distinct_invoices is None else F.count_distinct(distinct_invoices)
    return df.groupBy(customer).agg(count.alias("Frequency"))


def frequencies(
    df: DataFrame, customer: str = "CustomerID", date: str = "InvoiceDate", invoice: str = "InvoiceNo"
) -> DataFrame:
    """Both counts of `frequency` from one aggregation: Frequency (lines) and Invoices."""
    return df.groupBy(customer).agg(F.count(date).alias("Frequency"), F.count_distinct(invoice).alias("Invoices"))


def revenue(
    df: DataFrame, customer: str = "CustomerID", price: str = "UnitPrice", quantity: str = "Quantity"
) -> DataFrame:
    """Sum of price times quantity per customer (0 when every product is NULL)."""
    return df.groupBy(customer).agg(
        F.coalesce(F.sum(F.col(price) * F.col(quantity)), F.lit(0.0)).alias("Revenue")
    )


def join_measures(measures: Sequence[DataFrame], customer: str = "CustomerID") -> DataFrame:
    """Inner join of separately computed per-customer measures."""
    joined, *rest = measures
    for other in rest:
        joined = joined.join(other, customer)
    return joined


def measures(
    df: DataFrame,
    customer: str = "CustomerID",
    date: str = "InvoiceDate",
    price: str = "UnitPrice",
    quantity: str = "Quantity",
) -> DataFrame:
    """All three measures from one aggregation, materialised because clustering rereads it."""
    per_customer = pin(
        df.groupBy(customer).agg(
            F.max(date).alias("MaxPurchaseDate"),
            F.count(date).alias("Frequency"),
            F.coalesce(F.sum(F.col(price) * F.col(quantity)), F.lit(0.0)).alias("Revenue"),
        )
    )
    newest = per_customer.agg(F.max("MaxPurchaseDate")).scalar()
    return per_customer.select(
        customer,
        whole_days(F.col("MaxPurchaseDate"), newest).alias("Recency"),
        "Frequency",
        "Revenue",
    )


def order_cluster(df: DataFrame, cluster: str, target: str, ascending: bool) -> DataFrame:
    """Renumber clusters 0..k-1 by their mean target (cluster id breaks ties)."""
    means = df.groupBy(cluster).agg(F.avg(target).alias("_mean"))
    by = F.col("_mean").asc() if ascending else F.col("_mean").desc()
    # one row per cluster reaches this window
    ranks = means.select(cluster, (F.row_number().over(Window.orderBy(by, cluster)) - 1).alias("_rank"))
    return lookup_join(df, ranks, [cluster]).withColumn(cluster, F.col("_rank")).drop("_rank")


def clustered(
    customers: DataFrame,
    measures: Sequence[str] = MEASURES,
    k: int = 4,
    max_iter: int = 300,
    descending: Sequence[str] = (),
) -> DataFrame:
    """Add `<measure>Cluster` numbered by ascending (or descending) centroid.

    Clusters of one measure are intervals, so ascending centroids and ascending
    cluster means are the same order and no join is needed to rank them.
    """
    counts = pin(value_counts(customers, measures))
    centers = occupied(counts, fit_kmeans(counts, [k], max_iter))
    return with_clusters(customers, {m: centers.get(m, []) for m in measures}, descending)


def score(ranked: DataFrame) -> DataFrame:
    """Overall score and segment from the three cluster ranks."""
    total = F.col("RecencyCluster") + F.col("FrequencyCluster") + F.col("RevenueCluster")
    return ranked.withColumn("OverallScore", total).withColumn("Segment", segment_label(F.col("OverallScore")))


def segments(customers: DataFrame, k: int = 4) -> DataFrame:
    """Measures to ranks, score and segment. Recent customers rank high, so the
    recency clusters are numbered downwards."""
    return score(clustered(customers, MEASURES, k, descending=["Recency"]))


def score_means(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("OverallScore").agg(*[F.avg(m).alias(m) for m in MEASURES])


def without_outliers(segmented: DataFrame, revenue_below: float = 50_000, frequency_below: int = 2_000) -> DataFrame:
    return segmented.where((F.col("Revenue") < revenue_below) & (F.col("Frequency") < frequency_below))


def scatter(segmented: DataFrame, customer: str = "CustomerID") -> DataFrame:
    """The three measure pairs as points: pair, x, y, Segment."""
    pairs = (("Frequency", "Revenue"), ("Recency", "Revenue"), ("Recency", "Frequency"))
    points = F.array(
        *[
            F.struct(
                F.lit(f"{x}/{y}").alias("pair"),
                F.col(x).cast("double").alias("x"),
                F.col(y).cast("double").alias("y"),
            )
            for x, y in pairs
        ]
    )
    return segmented.select(customer, "Segment", F.inline(points))


def binned_scatter(points: DataFrame, bins: int = 50) -> DataFrame:
    """Point counts on a bins x bins grid per pair and segment: output bounded at any input size."""
    box = points.groupBy("pair").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )

    def cell(v: str, low: str, high: str):
        span = F.col(high) - F.col(low)
        place = F.floor((F.col(v) - F.col(low)) / span * bins)
        return F.when(span > 0, F.least(place, F.lit(bins - 1))).otherwise(0).cast("int")

    return (
        points.join(F.broadcast(box), "pair")  # three rows
        .groupBy("pair", "Segment", cell("x", "x0", "x1").alias("x_bin"), cell("y", "y0", "y1").alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
