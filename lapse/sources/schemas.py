"""Fixed schemas of the customer tables, declared so that no scan infers them."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Column names and types of the customer feature files.
NEW_CUSTOMERS = StructType(
    [
        StructField("CustomerID", StringType()),
        StructField("Gender", StringType()),
        StructField("WinLossRatio", DoubleType()),
        StructField("Tenure", IntegerType()),
        StructField("NumberActiveGames", DoubleType()),
        StructField("Platform", StringType()),
        StructField("PaymentMethod", StringType()),
        StructField("MonthlySpend", DoubleType()),
        StructField("TotalSpend", DoubleType()),
        StructField("TimeWindow", StringType()),
    ]
)
BRONZE = StructType([*NEW_CUSTOMERS.fields, StructField("Churn", StringType())])

BRONZE_TABLE = "bronze_customer_features"
SILVER_TABLE = "silver_customer_features"
NEW_CUSTOMERS_TABLE = "new_customers_features"
