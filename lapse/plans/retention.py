"""The three end-to-end flows: customer files to scored table, transactions to
segments, and survival to lifetime value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from lapse.operators import classify, clv, cox, kaplan_meier, prep, rfm
from lapse.operators.logrank import logrank
from lapse.sources import schemas, tables
from lapse.sources.session import pin


def load_medallion(
    spark: SparkSession, history_csv: str, new_csv: str, base: str, database: str, replace: bool = False
) -> None:
    """Read both customer files and register the bronze, silver and new-customer tables."""
    bronze = tables.read_csv(spark, history_csv, schemas.BRONZE)
    frames = {
        schemas.BRONZE_TABLE: bronze,
        schemas.SILVER_TABLE: prep.silver(bronze),
        schemas.NEW_CUSTOMERS_TABLE: tables.read_csv(spark, new_csv, schemas.NEW_CUSTOMERS),
    }
    tables.create_database(spark, database, replace)
    for name, frame in frames.items():
        path = tables.write_version(frame, f"{base}/{name}")
        tables.register(spark, f"`{database}`.{name}", path)


def train_and_store(
    spark: SparkSession, database: str, models: str, name: str, key: str = "CustomerID", **parameters
) -> int:
    """Split the silver table by customer, train, and store the next model version."""
    silver = prep.hash_split(spark.table(f"`{database}`.{schemas.SILVER_TABLE}"), key)
    return classify.save_model(classify.train_gbt(silver, **parameters), models, name)


def score_and_store(
    spark: SparkSession, database: str, base: str, models: str, name: str, version: int | None = None
) -> str:
    """Score the new-customer table and repoint it at a version that has the predictions."""
    table = f"`{database}`.{schemas.NEW_CUSTOMERS_TABLE}"
    scored = classify.batch_score(spark.table(table), classify.load_model(models, name, version))
    path = tables.write_version(scored, f"{base}/{schemas.NEW_CUSTOMERS_TABLE}")
    tables.register(spark, table, path)
    return path


def segment_transactions(transactions: DataFrame) -> DataFrame:
    """Raw invoice lines to one row per customer with measures, ranks, score and segment."""
    return rfm.segments(rfm.measures(prep.clean_transactions(transactions)))


def survival_report(
    customers: DataFrame, duration: str, event: str, variables: Sequence[str]
) -> dict[str, DataFrame]:
    """Population curve, its median, one curve per level of each variable, and all pairwise tests."""
    # read once, not once per variable
    customers = pin(customers.select(duration, event, *variables))
    curve = kaplan_meier.km_curve(customers, duration, event)
    report = {
        "curve": curve,
        "median": kaplan_meier.km_quantile(curve),
        "logrank": logrank(customers, duration, event, variables),
    }
    for v in variables:
        report[f"curve by {v}"] = kaplan_meier.km_curve(customers, duration, event, [v])
    return report


def lifetime_value(
    customers: DataFrame,
    duration: str,
    event: str,
    encode: Sequence[str],
    covariates: Sequence[str],
    scenarios: Sequence[Mapping[str, float]],
    horizon: int = 36,
) -> tuple[cox.CoxModel, DataFrame]:
    """One-hot encode, fit a Cox model on the chosen flags, and price the scenarios."""
    flags = prep.one_hot(customers, encode).select(duration, event, *[f"`{c}`" for c in covariates])
    model = cox.fit_cox(flags, duration, event, covariates)
    return model, clv.payback(model, scenarios, horizon)
