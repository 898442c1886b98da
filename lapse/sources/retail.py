"""Role views: the tables the operators expect, derived from a retail star schema.

`root` is a folder of Parquet tables (customer, orders, lineitem, events, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lapse.functions.scalars import micros_between, whole_days


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def transactions(spark: SparkSession, root: str) -> DataFrame:
    """One row per invoice line: CustomerID, InvoiceNo, InvoiceDate, Quantity, UnitPrice."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderkey").alias("InvoiceNo"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.col("l_quantity").alias("Quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("UnitPrice"),
    )


def customers_survival(spark: SparkSession, root: str) -> DataFrame:
    """One row per ordering customer: duration in 30-day months, event = lapsed
    (no order in the last 180 days of the data), and covariates."""
    orders = table(spark, root, "orders")
    span = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        # summed as cents, so the total does not depend on the order of addition
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total_spend"),
    )
    newest = orders.agg(F.max("o_orderdate")).scalar()
    people = table(spark, root, "customer").join(
        table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return span.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_custkey",
        F.floor(whole_days(F.col("first_order"), F.col("last_order")) / 30).cast("int").alias("duration"),
        (F.col("last_order") < newest - F.expr("INTERVAL 180 DAYS")).cast("int").alias("event"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("acctbal"),
        "total_spend",
    )


def purchase_gaps(spark: SparkSession, root: str) -> DataFrame:
    """One row per order: days until the same customer's next order.

    Orders of one customer are sequenced by (date, order key). Only the last
    order of a date looks ahead to another date, so the look-ahead runs over
    distinct dates (bounded by the calendar), not over a customer's orders,
    and a customer holding a large share of the orders is never one task.
    """
    orders = table(spark, root, "orders")
    dates = orders.groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("closing_order"))
    ahead = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    dates = dates.withColumn("next_date", F.lead("o_orderdate").over(ahead))
    newest = orders.agg(F.max("o_orderdate")).scalar()
    closing = F.col("o_orderkey") == F.col("closing_order")
    people = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(dates, ["o_custkey", "o_orderdate"])
        .join(people, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            "o_custkey",
            F.when(~closing, 0)
            .otherwise(whole_days(F.col("o_orderdate"), F.coalesce("next_date", newest)))
            .cast("int")
            .alias("duration"),
            F.when(closing & F.col("next_date").isNull(), 0).otherwise(1).alias("event"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            F.col("c_mktsegment").alias("segment"),
        )
    )


def churn_features(spark: SparkSession, root: str) -> DataFrame:
    """Classifier table: Tenure, TotalSpend, MonthlySpend, categorical columns, ChurnBool."""
    return customers_survival(spark, root).select(
        F.col("o_custkey").alias("CustomerID"),
        F.col("duration").alias("Tenure"),
        F.col("total_spend").alias("TotalSpend"),
        (F.col("total_spend") / F.greatest("duration", F.lit(1))).alias("MonthlySpend"),
        F.col("segment").alias("Segment"),
        F.col("region").alias("Region"),
        F.col("acctbal").alias("Balance"),
        F.col("event").alias("ChurnBool"),
    )


def event_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Near-continuous durations: seconds between a user's consecutive events.

    The look-ahead is split by (user, day, hour); the last event of an hour takes
    the first event of the user's next active hour, found over distinct hours.
    """
    events = table(spark, root, "events").select(
        "event_id", "user_id", "event_type", "ts", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")
    )
    within = Window.partitionBy("user_id", "day", "hour").orderBy("ts", "event_id")
    stepped = events.withColumn("next_ts", F.lead("ts").over(within))
    across = Window.partitionBy("user_id").orderBy("day", "hour")
    hours = (
        events.groupBy("user_id", "day", "hour")
        .agg(F.min("ts").alias("first_ts"))
        .withColumn("next_hour_ts", F.lead("first_ts").over(across))
    )
    newest = table(spark, root, "events").agg(F.max("ts")).scalar()
    following = F.coalesce("next_ts", "next_hour_ts")
    return stepped.join(hours, ["user_id", "day", "hour"]).select(
        "event_id",
        "user_id",
        F.col("event_type").alias("kind"),
        (micros_between(F.col("ts"), F.coalesce(following, newest)) / F.lit(1e6)).alias("duration"),
        following.isNotNull().cast("int").alias("event"),
    )


def scored_documents(spark: SparkSession, root: str) -> DataFrame:
    """Labelled documents with a score: label = quality, score = length scaled to (0, 1)."""
    docs = table(spark, root, "documents").select("doc_id", "n_chars")
    labels = table(spark, root, "labels").select("doc_id", "quality")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score"),
    )


def order_spans(spark: SparkSession, root: str) -> DataFrame:
    """One row per ordering customer: (id, start, stop, event), days since the first order; the event is a
    lapse, 180 days after the last order, and who has not lapsed is followed to the newest order of all."""
    orders = table(spark, root, "orders").where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL")
    newest = orders.agg(F.max(F.to_date("o_orderdate"))).scalar()
    span = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.min(F.to_date("o_orderdate")).alias("first"), F.max(F.to_date("o_orderdate")).alias("last")
    )
    quiet = F.datediff(newest, "last")
    return span.select(
        "id", F.lit(0).alias("start"),
        (F.datediff("last", "first") + F.least(quiet, F.lit(180))).alias("stop"), (quiet > 180).cast("int").alias("event"),
    )


def order_changes(spark: SparkSession, root: str) -> DataFrame:
    """What a customer's latest order says: (id, at, urgent, price), `at` in days since the first order and
    `price` in hundred thousands; of orders on one day the urgent one and the dearest one count."""
    orders = table(spark, root, "orders").where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL")
    first = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("first"))
    return orders.join(first, F.col("o_custkey") == F.col("id")).select(
        "id", F.datediff(F.to_date("o_orderdate"), F.col("first")).alias("at"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), (F.col("o_totalprice") / 100000).alias("price"),
    )
