"""Reading files, writing table versions and registering them in the catalog."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lapse.functions.scalars import text_literal

FORMAT = "parquet"


def read_csv(spark: SparkSession, path: str, schema: StructType, positional: bool = False) -> DataFrame:
    """CSV with a header, without an inference scan over the rows. The files of a folder must
    have the same header.

    Columns are bound by header name and cast; text that does not fit becomes
    NULL, and a column missing from the file is added as NULL and reported.
    `positional` binds by position instead, as a declared schema alone does.
    """
    if positional:
        return spark.read.schema(schema).option("header", True).csv(path)
    # every file must have the header of the first; the read fails where one differs
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        warnings.warn(f"{path} has no column {', '.join(missing)}: filled with NULL", stacklevel=2)
    return raw.select(
        *[
            (F.lit(None).cast(f.dataType) if f.name in missing else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose types are inferred, at the price of a second scan."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_snapshot(spark: SparkSession, path: str, drop: Sequence[str] = ()) -> DataFrame:
    return spark.read.parquet(path).drop(*drop)


def overwrite(df: DataFrame, path: str, fmt: str = FORMAT) -> None:
    """Replace the files at `path`; refused if `df` reads them."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    folder = fs.makeQualified(target).toUri().getPath().rstrip("/") + "/"
    if any(hadoop.Path(f).toUri().getPath().startswith(folder) for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the frame that would replace it; write a version instead")
    df.write.format(fmt).mode("overwrite").save(path)


def write_version(df: DataFrame, base: str, fmt: str = FORMAT) -> str:
    """Write `df` as the next version folder under `base` and return its path.

    The folder read before stays intact, so a table may be rewritten from
    itself and its columns may change. A writer first claims its number, so two
    writers never share a folder; a version counts once it holds _SUCCESS, so a
    failed write leaves a gap in the numbers and no half version.
    """
    path = f"{base}/v={claim_version(df.sparkSession, base)}"
    df.write.format(fmt).mode("overwrite").save(path)
    return path


def claim_version(spark: SparkSession, base: str) -> int:
    """The next version number under `base`, taken by creating a marker that must not exist yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    number = (latest_version(spark, base) or 0) + 1
    while True:
        marker = hadoop.Path(f"{base}/_claims/v={number}")
        fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        try:
            fs.create(marker, False).close()
            return number
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            number += 1


def mark_finished(spark: SparkSession, path: str) -> None:
    """Put the end-of-write marker into a folder, as a DataFrame writer does."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(marker).close()


def finished_versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the version folders under `base` whose write has finished."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(base)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    paths = [status.getPath() for status in fs.listStatus(folder)]
    return [
        int(path.getName()[2:])
        for path in paths
        if path.getName().startswith("v=") and fs.exists(hadoop.Path(path, "_SUCCESS"))
    ]


def latest_version(spark: SparkSession, base: str) -> int | None:
    return max(finished_versions(spark, base), default=None)


def read_version(spark: SparkSession, base: str, version: int | None = None, fmt: str = FORMAT) -> DataFrame:
    chosen = latest_version(spark, base) if version is None else version
    if chosen is None:
        raise FileNotFoundError(f"no finished version under {base}")
    return spark.read.format(fmt).option("mergeSchema", True).load(f"{base}/v={chosen}")


def create_database(spark: SparkSession, name: str, replace: bool = False) -> None:
    """Create and use a database; an existing one is dropped only when asked."""
    if replace:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    spark.sql(f"USE `{name}`")


def register(spark: SparkSession, table: str, path: str, fmt: str = FORMAT) -> None:
    """(Re)point an external table at `path`; the files are never dropped with it.

    A table whose columns stay, or are joined by new ones at the end, is altered in place, so
    readers find a table at all times. Only where a column goes or changes is it dropped and created.
    """
    where = text_literal(path)
    if spark.catalog.tableExists(table):
        have = [(f.name, f.dataType) for f in spark.table(table).schema]
        new = spark.read.format(fmt).load(path).schema
        if [(f.name, f.dataType) for f in new][: len(have)] == have:
            added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.fields[len(have) :])
            if added:
                spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({added})")
            spark.sql(f"ALTER TABLE {table} SET LOCATION {where}")
            spark.catalog.refreshTable(table)
            return
        spark.sql(f"DROP TABLE {table}")
    spark.sql(f"CREATE TABLE {table} USING {fmt} LOCATION {where}")


def save_managed(df: DataFrame, table: str, fmt: str = FORMAT) -> None:
    df.write.format(fmt).mode("overwrite").saveAsTable(table)


def select_all(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {table}")


def column_types(df: DataFrame) -> DataFrame:
    """Column names, types and filled cells: position, column, type, filled."""
    counts = df.agg(*[F.count(f"`{name}`").alias(f"c{i}") for i, name in enumerate(df.columns)])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type"),
                        F.col(f"c{i}").alias("filled"),
                    )
                    for i, (name, kind) in enumerate(df.dtypes)
                ]
            )
        )
    )
