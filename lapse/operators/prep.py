"""Row preparation: cleaning, encoding, coercion, splitting, sampling, filling."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapse.functions.scalars import present_id, yes_flag
from lapse.operators.running import lookup_join, running_totals, same_keys_join, sliced
from lapse.sources.session import pin


def clean_transactions(
    df: DataFrame, customer: str = "CustomerID", date: str = "InvoiceDate"
) -> DataFrame:
    """Parse the date, drop rows without a customer id, and make the id text."""
    return df.where(present_id(F.col(customer))).withColumns(
        {customer: F.col(customer).cast("string"), date: F.try_to_timestamp(F.col(date).cast("string"))}
        if dict(df.dtypes)[date] == "string"
        else {customer: F.col(customer).cast("string")}
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def silver(df: DataFrame, churn: str = "Churn", flag: str = "ChurnBool") -> DataFrame:
    """Replace the Yes/No churn text by a 0/1 flag."""
    return df.withColumn(flag, yes_flag(F.col(churn))).drop(churn)


def select_supported(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the columns a model was trained on; extra columns are ignored."""
    return df.select(*columns)


def levels(df: DataFrame, column: str, at_most: int = 1000) -> list:
    """Sorted distinct values of a categorical column, for use as column names.

    A column with more than `at_most` levels is refused: it is not a
    categorical column, and its levels must not be collected.
    """
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()
    if len(found) > at_most:
        raise ValueError(f"{column} has more than {at_most} levels")
    return sorted(row[0] for row in found)


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    known: Mapping[str, Sequence] | None = None,
    drop_first: bool = False,
) -> DataFrame:
    """Replace each column by 0/1 columns named `<column>_<level>`; NULL gives all zeros.

    Pass `known` levels to skip the scan that looks for them.
    """
    flags: list[Column] = []
    for column in columns:
        values = list((known or {}).get(column) or levels(df, column))
        flags += [
            F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
            for v in values[1 if drop_first else 0 :]
        ]
    return df.select(*[c for c in df.columns if c not in set(columns)], *flags)


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; text that is not a number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def key_bucket(key: Column, buckets: int = 100) -> Column:
    """Stable bucket of a key: the first 32 bits of its MD5, modulo `buckets`."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_split(
    df: DataFrame, key: str, split: str = "split", train: int = 60, val: int = 20
) -> DataFrame:
    """Add a train / val / test column that depends on the key alone, so it does
    not change with partitioning, retries or new rows."""
    bucket = key_bucket(F.col(key))
    return df.withColumn(
        split,
        F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test"),
    )


def stratified_split(
    df: DataFrame, key: str, label: str, split: str = "split", train: int = 60, val: int = 20, cells: int = 1 << 16, rows_per_slice: int = 0
) -> DataFrame:
    """Add a train / val / test column whose shares hold within each value of the label, to the row.

    Rows of a label are ordered by a hash of the key, and a split ends at the hash where its quota, rounded, is reached.
    Counts per (label, cell of hashes) say which cell that is; only the rows of such cells are ordered. Rows of one key
    and label stay together, so a quota is exceeded by at most the other rows of the key at its end. A NULL key is one
    key, a NULL label one label. Unlike `hash_split`, new rows may move others. Reads the table three times, twice by two columns.
    """
    if df.columns.count(key) != 1 or df.columns.count(label) != 1:
        raise ValueError("key and label are single columns")
    hashed = F.coalesce(F.conv(F.substring(F.md5(F.col(f"`{key}`").cast("string")), 1, 15), 16, 10).cast("long"), F.lit(0))
    rows = df.select(F.col(f"`{label}`").alias("_label"), hashed.alias("_h"))
    cell = F.floor(F.col("_h") / F.lit((1 << 60) // cells)).cast("long")
    counts = pin(rows.groupBy("_label", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy("_label").agg(F.sum("_n").alias("_all"))
    quota = F.array(*[F.floor((F.col("_all") * share + 50) / 100) for share in (train, train + val)])
    run = running_totals(sliced(counts, "_cell", rows_per_slice), "_cell", {"_c": "_n"}, ["_label"])
    ends = lookup_join(run.select("_label", "_cell", "_n", "_c"), totals, ["_label"])
    ends = ends.select("_label", "_cell", (F.col("_c") - F.col("_n")).alias("_before"), "_c", F.posexplode(quota).alias("_i", "_quota"))
    ends = pin(ends.where("_before < _quota AND _quota <= _c").drop("_c"))

    crossed = same_keys_join(rows.withColumn("_cell", cell), ends.select("_label", "_cell").distinct(), ["_label", "_cell"], "left_semi")
    units = crossed.groupBy("_label", "_cell", "_h").agg(F.count(F.lit(1)).alias("_n"))
    units = units.withColumn("_c", F.sum("_n").over(Window.partitionBy("_label", "_cell").orderBy("_h")))
    reached = same_keys_join(units, ends, ["_label", "_cell"]).where("_before + _c >= _quota")
    cuts = reached.groupBy("_label").agg(
        *[F.min(F.when(F.col("_i") == i, F.col("_h"))).alias(f"_cut{i}") for i in range(2)]
    )
    # a quota of 0 rows has no end: nothing is before it
    cuts = same_keys_join(totals.select("_label"), cuts, ["_label"], "left")
    found = lookup_join(df.withColumns({"_label": F.col(f"`{label}`"), "_h": hashed}), cuts, ["_label"])
    within = [F.col("_h") <= F.coalesce(f"_cut{i}", F.lit(-1)) for i in range(2)]
    return found.withColumn(split, F.when(within[0], "train").when(within[1], "val").otherwise("test")).drop("_label", "_h", "_cut0", "_cut1")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Repeatable sample of exactly min(n, rows) rows: the n smallest salted key hashes."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(order, key).limit(n)


def preview(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def top_n(df: DataFrame, measure: str, key: str, n: int = 5000) -> DataFrame:
    """The n rows with the largest measure; the key breaks ties."""
    return df.orderBy(F.col(measure).desc(), F.col(key)).limit(n)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column in one row; ties go to the smallest value.

    Each column is first collapsed to (value, count), so no task ever holds a
    whole column.
    """
    types = dict(df.dtypes)
    values = [f"v{j}" for j in range(len(columns))]

    def cell(column: str) -> Column:
        fields = [
            (F.col(c) if c == column else F.lit(None).cast(types[c])).alias(v)
            for c, v in zip(columns, values)
        ]
        return F.struct(F.lit(column).alias("i"), *fields)

    cells = F.array(*[cell(c) for c in columns])
    counts = df.select(F.inline(cells)).groupBy("i", *values).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        *[
            F.min(F.when(F.col(v).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(v))))[v].alias(c)
            for v, c in zip(values, columns)
        ]
    )


def fill_mode(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill missing values with the column's mode."""
    mode = modes(df if fitted_on is None else fitted_on, columns)
    # one value for all columns, so that the plan holds one aggregate however many there are
    found = mode.select(F.struct(*[F.col(c).alias(f"m{j}") for j, c in enumerate(columns)])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), found[f"m{j}"]) for j, c in enumerate(columns)})


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, in one scan."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def impute_mean(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers with the mean of the fitting rows.

    A column that is all missing in the fitting rows is an error; one that is
    all missing in the rows being filled is reported, as every value is then
    invented.
    """
    source = df if fitted_on is None else fitted_on
    means = source.agg(*[F.avg(c).alias(c) for c in columns]).first()
    for c in columns:
        if means[c] is None:
            raise ValueError(f"{c} has no value to impute from")
    if fitted_on is not None:
        present = df.agg(*[F.count(c).alias(c) for c in columns]).first()
        for c in columns:
            if present[c] == 0:
                warnings.warn(f"{c} is missing in every row and is filled with {means[c]}", stacklevel=2)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(means[c]))) for c in columns})


def standardize(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Centre and divide by the population standard deviation (1 when it is zero)."""
    fitted = moments(df if fitted_on is None else fitted_on, columns)
    return df.withColumns(
        {c: (F.col(c) - F.lit(mean)) / F.lit(std if std else 1.0) for c, (mean, std) in fitted.items()}
    )
