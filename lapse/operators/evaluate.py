"""Binary classifier metrics and curves from score groups.

Scores are collapsed to (split, score) with positive and total counts; ranks
and curves are running totals over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lapse.operators.running import present, running_totals, same_keys_join, sliced
from lapse.sources.session import pin

CLIP = 1e-15


def _score_groups(df, label, score, keys, rows_per_slice) -> DataFrame:
    """(keys, score): positives, n, and both summed from the highest score down. Rows without a label or score are left out."""
    groups = pin(
        df.where(present(df, label, score))
        .groupBy(*keys, F.col(score).alias("threshold"))
        .agg(F.sum(F.col(label).cast("long")).alias("positives"), F.count(F.lit(1)).alias("n"))
    )
    return running_totals(
        sliced(groups, "threshold", rows_per_slice), "threshold", {"tp": "positives", "flagged": "n"}, keys, descending=True
    )


def _with_sizes(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = groups.groupBy(*keys).agg(F.sum("positives").alias("all_positives"), F.sum("n").alias("all_n"))
    if keys:
        return same_keys_join(groups, sizes, keys)
    both = sizes.select(F.struct("all_positives", "all_n")).scalar()
    return groups.withColumn("_all", both).select("*", "_all.*").drop("_all")


def binary_metrics(
    df: DataFrame,
    label: str,
    score: str,
    keys: Sequence[str] = (),
    threshold: float = 0.5,
    rows_per_slice: int = 0,
) -> DataFrame:
    """accuracy, precision, recall, F1 (positive class 1), log loss and ROC AUC per key."""
    groups = _score_groups(df, label, score, keys, rows_per_slice)
    hit = F.col("threshold") >= threshold
    p = F.greatest(F.least(F.col("threshold"), F.lit(1 - CLIP)), F.lit(CLIP))
    negatives = F.col("n") - F.col("positives")
    counts = groups.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("positives").alias("_p"),
        F.sum(F.when(hit, F.col("positives")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, negatives).otherwise(0)).alias("_fp"),
        F.sum(-F.col("positives") * F.log(p) - negatives * F.log(1 - p)).alias("_loss"),
        # positives ranked strictly above a negative, ties counting half
        F.sum(negatives * (F.col("tp") - F.col("positives") / 2)).alias("_above"),
    )
    return counts.selectExpr(
        *keys,
        "n",
        "(_tp + n - _p - _fp) / n AS accuracy",
        "coalesce(try_divide(_tp, _tp + _fp), 0D) AS precision",
        "coalesce(try_divide(_tp, _p), 0D) AS recall",
        "coalesce(try_divide(2 * _tp, _p + _tp + _fp), 0D) AS f1",
        "_loss / n AS log_loss",
        "try_divide(_above, CAST(_p AS DOUBLE) * (n - _p)) AS roc_auc",
    )


def metrics_table(metrics: DataFrame, split: str, names: dict[str, str]) -> DataFrame:
    """Metrics of the named splits as one row per metric and one column per split."""
    values = [c for c in metrics.columns if c not in (split, "n")]
    long = metrics.where(F.col(split).isin(list(names))).unpivot([split], values, "metric", "value")
    return (
        long.groupBy("metric")
        .pivot(split, list(names))
        .agg(F.first("value"))
        .withColumnsRenamed(names)
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """All four cells, zeros included: label, prediction, n. Rows without a label or a prediction are
    counted in cells of their own, with NULL there."""
    counts = df.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.sql("SELECT * FROM VALUES (0, 0), (0, 1), (1, 0), (1, 1) AS cells(label, prediction)")
    counted = counts.unionByName(cells.withColumn("n", F.lit(0).cast("long")))
    return counted.groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def _thinned(curve: DataFrame, points: int | None) -> DataFrame:
    """Keep the curve points that complete one of `points` equal shares of the rows."""
    if points is None:
        return curve
    share = F.col("all_n") / F.lit(points)
    ends = F.floor(F.col("flagged") / share) > F.floor((F.col("flagged") - F.col("n")) / share)
    return curve.where(ends)


def roc_curve(
    df: DataFrame, label: str, score: str, points: int | None = None, rows_per_slice: int = 0
) -> DataFrame:
    """One point per distinct score (or about `points` of them): threshold, fpr, tpr.
    The curve opens at threshold infinity with (0, 0)."""
    curve = _thinned(_with_sizes(_score_groups(df, label, score, (), rows_per_slice), ()), points)
    first = df.sparkSession.sql("SELECT double('infinity') AS threshold, 0D AS fpr, 0D AS tpr")
    return first.unionByName(
        curve.selectExpr(
            "threshold",
            "try_divide(flagged - tp, all_n - all_positives) AS fpr",
            "try_divide(tp, all_positives) AS tpr",
        )
    )


def pr_curve(
    df: DataFrame, label: str, score: str, points: int | None = None, rows_per_slice: int = 0
) -> DataFrame:
    """One point per distinct score: threshold, precision, recall. The curve ends at
    (precision 1, recall 0), which has no threshold."""
    curve = _thinned(_with_sizes(_score_groups(df, label, score, (), rows_per_slice), ()), points)
    last = df.sparkSession.sql("SELECT CAST(NULL AS DOUBLE) AS threshold, 1D AS precision, 0D AS recall")
    return curve.selectExpr(
        "threshold", "tp / flagged AS precision", "try_divide(tp, all_positives) AS recall"
    ).unionByName(last)
