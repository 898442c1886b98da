"""Dataset profile: the sections of a profiling report as tables.

Moments come from one scan without a shuffle. Distinct counts, quantiles,
common and extreme values and histograms all come from one materialised table
of (column, value, count), so the input is read twice, not once per section.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lapse.functions.scalars import whole_days
from lapse.operators import describe
from lapse.operators.running import running_totals, same_keys_join, sliced
from lapse.sources.session import pin

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
# Thresholds of the alert rules.
HIGH_CARDINALITY = 50
SKEWED = 20.0
CORRELATED = 0.9
MOSTLY = 0.5


DATE_STATS = (
    "column string, count long, missing long, distinct long, first timestamp_ntz, last timestamp_ntz, range_days long"
)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _finite(name: str) -> str:
    """The value as a double; NULL where it is missing, NaN or infinite, which count as not present everywhere."""
    x = f"double({_quoted(name)})"
    # NaN sorts above infinity, so one comparison leaves both out
    return f"if(abs({x}) < double('infinity'), {x}, NULL)"


def pair_correlation(df: DataFrame, names: Sequence[str], place: tuple[float, float] | None = None) -> DataFrame:
    """Correlation of every two columns (doubles) of `df`, called by `names` in the result (a, b, value),
    over the rows where both are present; NULL when either does not vary there.

    Each batch of rows adds its matrix products to one set of sums per task, so plan and code do
    not grow with the columns; what is shuffled is a row per pair and task. Columns are first
    centred and scaled as a whole, so a large mean costs no digits; where the caller knows a centre and a scale for
    all columns (`place`), `df` is read once instead of twice.
    """
    columns = df.columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, value double")
    cells = F.array(*[F.coalesce(F.col(c), F.lit(None).cast("double")) for c in columns])
    width = len(columns)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = np.zeros(width), np.zeros(width), np.full(width, np.inf), np.full(width, -np.inf)
        for x, there in _matrices(batches, width):
            n += there.sum(0)
            total += np.where(there, x, 0.0).sum(0)
            low = np.minimum(low, np.where(there, x, np.inf).min(0, initial=np.inf))
            high = np.maximum(high, np.where(there, x, -np.inf).max(0, initial=-np.inf))
        arrays = [np.arange(width, dtype=np.int32), n, total, low, high]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["i", "n", "total", "low", "high"])

    rows = df.select(cells.alias("x"))
    centre, scale = np.zeros(width), np.ones(width)
    if place:
        centre, scale = np.full(width, place[0]), np.full(width, place[1])
    wide = rows.mapInArrow(moments, "i int, n double, total double, low double, high double").groupBy("i")
    wide = wide.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    for r in [] if place else wide.collect():
        if r["n"] and math.isfinite(r["total"]):
            centre[r["i"]] = r["total"] / r["n"]
            scale[r["i"]] = (r["high"] - r["low"]) or 1.0
    upper = np.triu_indices(width, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x_, xx, xy = (np.zeros((width, width)) for _ in range(4))
        for x, there in _matrices(batches, width):
            z = np.where(there, (x - centre) / scale, 0.0)
            there = there.astype(float)
            n += there.T @ there
            x_ += z.T @ there  # [i, j]: sum of i over the rows that have j
            xx += (z * z).T @ there
            xy += z.T @ z
        i, j = upper
        arrays = [i.astype(np.int32), j.astype(np.int32), n[i, j], x_[i, j], x_[j, i], xx[i, j], xx[j, i], xy[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["i", "j", *SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    pairs = rows.mapInArrow(sums, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    called = F.array(*[F.lit(n) for n in names])
    # what rounding leaves of a spread that is none
    least = "1e-14 * n"
    return pairs.select(
        F.element_at(called, F.col("i") + 1).alias("a"), F.element_at(called, F.col("j") + 1).alias("b"),
        F.expr(
            f"CASE WHEN n > 0 AND NOT (xx - x * x / n <= {least} OR yy - y * y / n <= {least}) "
            "THEN (xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)) END"
        ).alias("value"),
    )


SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values, and which of them are present, of each batch of arrays of `width` doubles."""
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(0).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, width), there


class Profile:
    """Profile of `df`: numbers, text, dates; columns of other types are only counted."""

    def __init__(self, df: DataFrame, drop: Sequence[str] = (), rows_per_slice: int = 0):
        self.df = df.drop(*drop)
        self.rows_per_slice = rows_per_slice
        kinds = dict(self.df.dtypes)
        self.numeric = [c for c in self.df.columns if kinds[c].split("(")[0] in NUMERIC]
        self.categorical = [c for c in self.df.columns if kinds[c] in ("string", "boolean")]
        self.dates = [c for c in self.df.columns if kinds[c] in ("date", "timestamp", "timestamp_ntz")]

    # --- shared tables ---------------------------------------------------------

    @cached_property
    def numbers(self) -> DataFrame:
        """(column, x, n) over the numeric columns, materialised."""
        cells = [F.struct(F.lit(c).alias("column"), F.expr(_finite(c)).alias("x")) for c in self.numeric]
        return pin(self._value_counts(cells, "x", "double"))

    @cached_property
    def number_rows(self) -> int:
        return self.numbers.count()

    @cached_property
    def texts(self) -> DataFrame:
        """(column, x, n) over the categorical columns, materialised."""
        cells = [F.struct(F.lit(c).alias("column"), F.col(_quoted(c)).cast("string").alias("x")) for c in self.categorical]
        return pin(self._value_counts(cells, "x", "string"))

    def _value_counts(self, cells: list[Column], value: str, kind: str) -> DataFrame:
        if not cells:
            return self._empty(f"column string, {value} {kind}, n long")
        return (
            self.df.select(F.inline(F.array(*cells)))
            .where(F.col(value).isNotNull())
            .groupBy("column", value)
            .agg(F.count(F.lit(1)).alias("n"))
        )

    def _empty(self, schema: str) -> DataFrame:
        """What a section gives that has no columns to speak of."""
        return self.df.sparkSession.createDataFrame([], schema)

    def _per_column(self, columns: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
        """One scan of aggregates over every column, turned into one row per column.

        `{c}` in an aggregate stands for the quoted column, `{x}` for its finite values. No columns: no rows.
        """
        if not columns:
            nothing = {"c": "CAST(NULL AS DOUBLE)", "x": "CAST(NULL AS DOUBLE)"}
            blank = self.df.agg(F.lit("").alias("column"), *[F.expr(e.format(**nothing)).alias(n) for n, e in aggregates.items()])
            return blank.where(F.lit(False))
        wide = self.df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    *[F.expr(e.format(c=_quoted(c), x=_finite(c))).alias(name) for name, e in aggregates.items()],
                ).alias(f"_{i}")
                for i, c in enumerate(columns)
            ]
        )
        return wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))

    # --- sections --------------------------------------------------------------

    def overview(self) -> DataFrame:
        """rows, columns, missing cells, duplicate rows, and columns by kind."""
        missing = " + ".join(f"int(isnull({_quoted(c)}))" for c in self.df.columns)
        totals = self.df.agg(F.count(F.lit(1)).alias("rows"), F.expr(f"coalesce(sum({missing}), 0)").alias("missing_cells"))
        distinct = self.df.groupBy(*map(_quoted, self.df.columns)).agg(F.lit(1).alias("_one")).agg(F.count("_one")).scalar()
        return totals.select(
            "rows",
            F.lit(len(self.df.columns)).alias("columns"),
            "missing_cells",
            (F.col("rows") - distinct).alias("duplicate_rows"),
            F.lit(len(self.numeric)).alias("numeric_columns"),
            F.lit(len(self.categorical)).alias("categorical_columns"),
            F.lit(len(self.df.columns) - len(self.numeric) - len(self.categorical)).alias("other_columns"),
        )

    def numeric_stats(self, approximate_distinct: bool = False) -> DataFrame:
        """Counts, moments, range and shape of each numeric column.

        std and variance are sample estimates, skewness and kurtosis are
        bias-corrected, mad is the median absolute deviation from the median. Only finite values count;
        NaN is missing, infinite values are counted by themselves.
        """
        aggregates = {
            "count": "count({x})",
            "missing": "count_if({c} IS NULL OR isnan(double({c})))",
            "mean": "avg({x})",
            "std": "stddev_samp({x})",
            "variance": "var_samp({x})",
            "min": "min({x})",
            "max": "max({x})",
            "sum": "sum({x})",
            "zeros": "count_if({c} = 0)",
            "negatives": "count_if({x} < 0)",
            "infinite": "count_if(abs(double({c})) = double('infinity'))",
            "_g1": "skewness({x})",
            "_g2": "kurtosis({x})",
        }
        if approximate_distinct:
            aggregates["distinct"] = "approx_count_distinct({x})"
        stats = self._per_column(self.numeric, aggregates)
        if not approximate_distinct:
            distinct = self.numbers.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
            stats = stats.join(distinct, "column", "left").fillna(0, ["distinct"])
        stats = stats.join(self._mad(), "column", "left")
        n = F.col("count").cast("double")
        return stats.select(
            "column", "count", "missing", "distinct", "mean", "std", "variance", "min", "max",
            (F.col("max") - F.col("min")).alias("range"),
            "sum", "zeros", "negatives", "infinite",
            F.try_divide("std", "mean").alias("cv"),
            "mad",
            F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
            F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)).alias("kurtosis"),
        )

    def _mad(self) -> DataFrame:
        # one row per column
        medians = F.broadcast(self._quantiles(self.numbers, "x", [0.5]))
        gaps = self.numbers.join(medians, "column").select("column", F.abs(F.col("x") - F.col("q0")).alias("gap"), "n")
        return self._quantiles(gaps, "gap", [0.5]).withColumnRenamed("q0", "mad")

    def _quantiles(self, values: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
        return describe.quantiles(
            values, column, probabilities, ["column"], "n", self.rows_per_slice, rows=self.number_rows
        )

    def quantiles(self) -> DataFrame:
        """Exact 5, 25, 50, 75 and 95 % quantiles and the interquartile range."""
        found = self._quantiles(self.numbers, "x", [0.05, 0.25, 0.5, 0.75, 0.95])
        return found.select(
            "column",
            *[F.col(f"q{i}").alias(name) for i, name in enumerate(("p5", "p25", "p50", "p75", "p95"))],
            (F.col("q3") - F.col("q1")).alias("iqr"),
        )

    def categorical_stats(self) -> DataFrame:
        """count, missing, distinct, mode with its frequency, and text length."""
        lengths = self._per_column(
            self.categorical, {"count": "count({c})", "missing": "count_if({c} IS NULL)"}
        )
        from_values = self.texts.groupBy("column").agg(
            F.count(F.lit(1)).alias("distinct"),
            F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("_top"),
            F.min(F.length("x")).alias("min_length"),
            (F.sum(F.length("x") * F.col("n")) / F.sum("n")).alias("mean_length"),
            F.max(F.length("x")).alias("max_length"),
        )
        return lengths.join(from_values, "column", "left").select(
            "column", "count", "missing", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
            F.col("_top.x").alias("mode"), (-F.col("_top.n")).alias("mode_count"),
            "min_length", "mean_length", "max_length",
        )

    def common_values(self, n: int = 10) -> DataFrame:
        """The n most frequent values of every column: column, rank, value, count."""
        values = self._all_values()
        order = Window.partitionBy("column").orderBy(F.desc("n"), "x")
        # a rank filter: every task keeps its own n rows per column before the shuffle
        return (
            values.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= n)
            .select("column", "rank", F.col("x").alias("value"), F.col("n").alias("count"))
        )

    def _all_values(self) -> DataFrame:
        return self.numbers.withColumn("x", F.col("x").cast("string")).unionByName(self.texts)

    def extremes(self, n: int = 5) -> DataFrame:
        """The n smallest and n largest distinct values of every numeric column."""
        def end(name: str, order: Column) -> DataFrame:
            rank = F.row_number().over(Window.partitionBy("column").orderBy(order))
            return (
                self.numbers.withColumn("rank", rank)
                .where(F.col("rank") <= n)
                .select("column", F.lit(name).alias("end"), "rank", F.col("x").alias("value"), F.col("n").alias("count"))
            )

        return end("smallest", F.col("x").asc()).unionByName(end("largest", F.col("x").desc()))

    def histograms(self, at_most: int = 10) -> DataFrame:
        return describe.histogram(self.numbers, "x", ["column"], at_most, weight="n")

    def missing(self) -> DataFrame:
        """Missing count and share of every column."""
        stats = self._per_column(self.df.columns, {"missing": "count_if({c} IS NULL)", "_rows": "count(1)"})
        return stats.select("column", "missing", F.try_divide("missing", "_rows").alias("share"))

    def missing_correlation(self) -> DataFrame:
        """Correlation of the null indicators of every two columns (NULL when one never varies)."""
        flags = self.df.select(*[F.col(_quoted(c)).isNull().cast("double").alias(f"c{i}") for i, c in enumerate(self.df.columns)])
        return pair_correlation(flags, self.df.columns)

    def pearson(self) -> DataFrame:
        """Correlation of every two numeric columns over the rows where both are present; NULL when
        either does not vary there."""
        return pair_correlation(self._doubles(), self.numeric)

    def _doubles(self) -> DataFrame:
        """The numeric columns as c0, c1, ..., their finite values only."""
        return self.df.select(*[F.expr(_finite(c)).alias(f"c{i}") for i, c in enumerate(self.numeric)])

    def spearman(self) -> DataFrame:
        """Rank correlation (average ranks) of every two numeric columns, over the rows where both are
        present and finite.

        A column is ranked once among all its values and once among the rows that have each column
        with holes, from one table of counts per value; a pair then reads the ranks it needs.
        """
        names = [f"c{i}" for i in range(len(self.numeric))]
        if len(names) < 2:
            return self._empty("a string, b string, value double")
        rows = self._doubles()
        held = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in names]).first()
        holes = [i for i, c in enumerate(names) if held[c] < held["rows"]]
        # entry 0: among all rows; entry h + 1: among the rows that have column holes[h]
        masks = [F.lit(1).cast("long"), *[F.col(names[i]).isNotNull().cast("long") for i in holes]]
        cells = [
            F.struct(F.lit(i).alias("column"), F.col(c).alias("x"), *[m.alias(f"m{k}") for k, m in enumerate(masks)])
            for i, c in enumerate(names)
        ]
        counts = rows.select(F.inline(F.array(*cells))).where("x IS NOT NULL").groupBy("column", "x")
        counts = pin(counts.agg(*[F.sum(f"m{k}").alias(f"n{k}") for k in range(len(masks))]))
        totals = {f"upto{k}": f"n{k}" for k in range(len(masks))}
        ranks = running_totals(sliced(counts, "x", self.rows_per_slice), "x", totals, ["column"])
        rank = [(F.col(f"upto{k}") - (F.col(f"n{k}") - 1) / 2).alias(f"r{k}") for k in range(len(masks))]
        ranks = pin(ranks.select("column", "x", F.array(*rank).alias("ranks")))
        for i, c in enumerate(names):
            # without holes a column has one rank, a number; the value is not carried on once it has its rank
            found = F.col("ranks") if holes else F.col("ranks")[0]
            own = ranks.where(F.col("column") == i).select(F.col("x").alias(c), found.alias(f"r{i}"))
            rows = same_keys_join(rows, own, [c], "left").drop(c)
        entry = {j: 1 + h for h, j in enumerate(holes)}

        def picked(i: int, j: int) -> Column:
            """Rank of column i among the rows that have column j, where a row has both."""
            return F.when(F.col(f"r{j}").isNotNull(), F.col(f"r{i}")[entry.get(j, 0)])

        if not holes:
            # ranks from 1 to n have a known mean, so the joined rows are made only once
            place = ((held["rows"] + 1) / 2, float(max(held["rows"], 1)))
            return pair_correlation(rows.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(names)]), self.numeric, place)
        parts = []
        for i, j in combinations(range(len(names)), 2):
            x, y = picked(i, j), picked(j, i)
            value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            parts.append(F.struct(F.lit(self.numeric[i]).alias("a"), F.lit(self.numeric[j]).alias("b"), value.alias("value")))
        wide = rows.agg(*[part.alias(f"p{k}") for k, part in enumerate(parts)])
        return wide.select(F.inline(F.array(*[f"p{k}" for k in range(len(parts))])))

    def cramers_v(self) -> DataFrame:
        """Association of every two categorical columns: a, b, chi2, value, corrected value."""
        pairs = list(combinations(self.categorical, 2))
        if not pairs:
            return self._empty("a string, b string, chi2 double, value double, corrected double")
        cells = F.array(
            *[
                F.struct(
                    F.lit(a).alias("a"), F.lit(b).alias("b"),
                    F.col(_quoted(a)).cast("string").alias("u"), F.col(_quoted(b)).cast("string").alias("v"),
                )
                for a, b in pairs
            ]
        )
        table = pin(
            self.df.select(F.inline(cells))
            .dropna(subset=["u", "v"])
            .groupBy("a", "b", "u", "v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        rows = table.groupBy("a", "b", "u").agg(F.sum("n").alias("n_u"))
        columns = table.groupBy("a", "b", "v").agg(F.sum("n").alias("n_v"))
        levels = (
            rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("r"), F.sum("n_u").alias("total"))
            .join(columns.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")), ["a", "b"])
        )
        share = F.col("n") * F.col("n") / (F.col("n_u").cast("double") * F.col("n_v"))
        sums = (
            table.join(rows, ["a", "b", "u"]).join(columns, ["a", "b", "v"])
            .groupBy("a", "b").agg(F.sum(share).alias("share"))
            .join(levels, ["a", "b"])
        )
        return sums.selectExpr(
            "a", "b", "total * (share - 1) AS chi2",
            "sqrt(try_divide(greatest(share - 1, 0D), least(r, k) - 1)) AS value",
            "sqrt(try_divide(greatest(share - 1 - (r - 1) * (k - 1) / (total - 1), 0D), "
            "least(r - pow(r - 1, 2) / (total - 1), k - pow(k - 1, 2) / (total - 1)) - 1)) AS corrected",
        )

    def interactions(self, bins: int = 20) -> DataFrame:
        """Counts on a bins x bins grid for every two numeric columns: a, b, a_bin, b_bin, n. Missing
        and infinite values are left out."""
        names = [f"c{i}" for i in range(len(self.numeric))]
        if len(names) < 2:
            return self._empty("a string, b string, a_bin int, b_bin int, n long")
        values = self._doubles()
        bounds = values.agg(*[F.min(c).alias(f"lo{c}") for c in names], *[F.max(c).alias(f"hi{c}") for c in names])
        box = bounds.select(F.struct(*bounds.columns)).scalar()

        def cell(c: str) -> Column:
            share = f"({c} - _box.lo{c}) / (_box.hi{c} - _box.lo{c})"
            return F.expr(
                f"CASE WHEN {c} IS NULL THEN NULL WHEN _box.hi{c} = _box.lo{c} THEN 0 "
                f"ELSE int(least(floor({share} * {bins}), {bins - 1})) END"
            ).alias(c)

        placed = values.withColumn("_box", box).select(*map(cell, names))
        cells = [
            F.struct(F.lit(self.numeric[i]).alias("a"), F.lit(self.numeric[j]).alias("b"),
                     F.col(names[i]).alias("a_bin"), F.col(names[j]).alias("b_bin"))
            for i, j in combinations(range(len(names)), 2)
        ]
        return (
            placed.select(F.inline(F.array(*cells)))
            .where("a_bin IS NOT NULL AND b_bin IS NOT NULL")
            .groupBy("a", "b", "a_bin", "b_bin")
            .agg(F.count(F.lit(1)).alias("n"))
        )

    def date_stats(self) -> DataFrame:
        """count, missing, distinct, first, last and range in whole days of each date column; dates
        are shown as timestamps."""
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(_quoted(c)).cast("timestamp_ntz").alias("x")) for c in self.dates
        ]
        if not cells:
            return self.df.sparkSession.createDataFrame([], DATE_STATS)
        counts = self.df.select(F.inline(F.array(*cells))).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
        there = F.col("x").isNotNull()
        return counts.groupBy("column").agg(
            F.sum(F.when(there, F.col("n")).otherwise(0)).alias("count"),
            F.sum(F.when(there, 0).otherwise(F.col("n"))).alias("missing"),
            F.count("x").alias("distinct"),
            F.min("x").alias("first"),
            F.max("x").alias("last"),
            whole_days(F.min("x"), F.max("x")).alias("range_days"),
        )

    def alerts(self) -> DataFrame:
        """column, alert: what a reader should look at first."""
        numbers = self.numeric_stats().selectExpr(
            "column", "count", "missing", "distinct", "zeros", "skewness", "false AS is_text"
        )
        texts = self.categorical_stats().selectExpr(
            "column", "count", "missing", "distinct", "0L AS zeros", "CAST(NULL AS DOUBLE) AS skewness", "true AS is_text"
        )
        rules = (
            "if(distinct = 1, 'constant', NULL)",
            "if(distinct = count AND count > 1, 'unique', NULL)",
            f"if(is_text AND distinct > {HIGH_CARDINALITY}, 'high cardinality', NULL)",
            f"if(zeros > {MOSTLY} * count, 'mostly zero', NULL)",
            f"if(missing > {MOSTLY} * (count + missing), 'mostly missing', NULL)",
            # a column that does not vary has no skewness
            f"if(NOT isnan(skewness) AND abs(skewness) > {SKEWED}, 'skewed', NULL)",
        )
        per_column = numbers.unionByName(texts).selectExpr("column", f"explode(array({', '.join(rules)})) AS alert")
        correlated = self.pearson().where(F.abs("value") > CORRELATED).select(
            F.concat_ws(", ", "a", "b").alias("column"), F.lit("highly correlated").alias("alert")
        )
        duplicated = self.overview().where("duplicate_rows > 0").select(
            F.lit("(rows)").alias("column"), F.lit("duplicates").alias("alert")
        )
        return per_column.where("alert IS NOT NULL").unionByName(correlated).unionByName(duplicated)

    def sample(self, order: Sequence[str], n: int = 10) -> DataFrame:
        """First and last n rows in the given order, marked by `part`."""
        head = self.df.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
        tail = self.df.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("part", F.lit("tail"))
        return head.unionByName(tail)
