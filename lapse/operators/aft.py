"""Accelerated failure time models: log-logistic, log-normal and Weibull.

ln t = x * b + e / k with a standard logistic, normal or minimum-extreme-value
error e and one shape k for everybody. Subjects are collapsed to (time, event,
covariates) with a count; each Newton step is one aggregation of value,
gradient and Hessian to a single row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapse.functions.scalars import log1p_exp, logistic
from lapse.functions.tails import chi2_tail, normal_log_survival, surprise
from lapse.operators.cox import COEFFICIENT_SCHEMA, _scales, coefficient_rows, risk_table
from lapse.operators.running import present

# Names of the location and shape parameter of each family.
PARAMETERS = {"loglogistic": ("alpha_", "beta_"), "weibull": ("lambda_", "rho_"), "lognormal": ("mu_", "sigma_")}


@dataclass
class AftModel:
    """`coef` holds the covariates and then the intercept; `log_shape` is ln k."""

    family: str
    covariates: list[str]
    coef: np.ndarray
    log_shape: float
    covariance: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    observations: int
    events: int
    alpha: float
    means: np.ndarray

    @property
    def shape(self) -> float:
        return math.exp(self.log_shape)


def _likelihood_terms(family: str, z: Column, is_event: Column) -> tuple[Column, Column, Column]:
    """Log density (event) or log survival (censored) of the standard error, and its
    first two derivatives in z."""
    if family == "loglogistic":
        f = logistic(z)
        both = F.when(is_event, 2.0).otherwise(1.0)
        return (
            F.when(is_event, z).otherwise(0.0) - both * log1p_exp(z),
            F.when(is_event, 1.0).otherwise(0.0) - both * f,
            -both * f * (1 - f),
        )
    if family == "weibull":
        rise = F.exp(z)
        up = F.when(is_event, 1.0).otherwise(0.0)
        return up * z - rise, up - rise, -rise
    log_density = -z * z / 2 - math.log(2 * math.pi) / 2
    log_survival = F.col("_log_survival")
    hazard = F.exp(log_density - log_survival)
    return (
        F.when(is_event, log_density).otherwise(log_survival),
        F.when(is_event, -z).otherwise(-hazard),
        F.when(is_event, -1.0).otherwise(-hazard * (hazard - z)),
    )


def _evaluate(table, family, b, c, means, scales) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and Hessian in (b, c); b[0] is the intercept."""
    p = len(b)
    xs = ["1.0D"] + [f"((x{j} - {means[j]!r}D) / {scales[j]!r}D)" for j in range(p - 1)]
    k = math.exp(c)
    fit = " + ".join(f"{float(w)!r}D * {x}" for w, x in zip(b, xs))
    rows = table.selectExpr(
        "n", "e", "ln(t) AS y", f"(ln(t) - ({fit})) * {k!r}D AS z", *[f"{x} AS v{j}" for j, x in enumerate(xs)]
    )
    if family == "lognormal":
        rows = rows.withColumn("_log_survival", normal_log_survival(F.col("z")))
    value, u, w = _likelihood_terms(family, F.col("z"), F.col("e") == 1)
    rows = rows.select("n", "e", "y", "z", *[f"v{j}" for j in range(p)], value.alias("l"), u.alias("u"), w.alias("w"))
    wanted = {"value": f"sum(n * (e * ({c!r}D - y) + l))", "gc": "sum(n * (e + u * z))", "hc": "sum(n * (w * z * z + u * z))"}
    for j in range(p):
        wanted[f"g{j}"] = f"sum(n * -u * v{j}) * {k!r}D"
        wanted[f"hc{j}"] = f"sum(n * -v{j} * (w * z + u)) * {k!r}D"
        for i in range(j, p):
            wanted[f"h{j}_{i}"] = f"sum(n * w * v{j} * v{i}) * {k * k!r}D"
    row = rows.agg(*[F.expr(e).alias(name) for name, e in wanted.items()]).first()
    gradient = np.array([row[f"g{j}"] for j in range(p)] + [row["gc"]], dtype=float)
    hessian = np.zeros((p + 1, p + 1))
    hessian[p, p] = row["hc"]
    for j in range(p):
        hessian[j, p] = hessian[p, j] = row[f"hc{j}"]
        for i in range(j, p):
            hessian[j, i] = hessian[i, j] = row[f"h{j}_{i}"]
    return float(row["value"]), gradient, hessian


def _maximise(table, family, start, means, scales, max_iter, precision):
    """Newton steps with halving; a direction that is not uphill is damped first."""
    at = np.array(start, dtype=float)
    value, gradient, hessian = _evaluate(table, family, at[:-1], float(at[-1]), means, scales)
    for _ in range(max_iter):
        curvature = -hessian
        lowest = np.linalg.eigvalsh(curvature)[0]
        if lowest <= 1e-8:
            curvature = curvature + (1e-3 * np.abs(curvature).max() - lowest) * np.eye(len(at))
        step = np.linalg.solve(curvature, gradient)
        step = step * min(1.0, 2.0 / np.max(np.abs(step)))
        while True:
            tried = _evaluate(table, family, (at + step)[:-1], float((at + step)[-1]), means, scales)
            if tried[0] >= value - 1e-9 * abs(value) or np.max(np.abs(step)) < precision:
                break
            step = step / 2
        at = at + step
        value, gradient, hessian = tried
        if np.max(np.abs(step)) < precision:
            return at, value, hessian
    raise ValueError(f"no convergence in {max_iter} steps")


def fit_aft(
    df: DataFrame,
    duration: str,
    event: str,
    covariates: Sequence[str],
    family: str = "loglogistic",
    alpha: float = 0.05,
    shift: float = 0.0,
    max_iter: int = 100,
    precision: float = 1e-7,
) -> AftModel:
    """Maximum likelihood fit. Durations must be positive; `shift` is added to all
    of them when the caller decides that zero durations are to be kept."""
    covariates = list(covariates)
    table = risk_table(df.withColumn(duration, F.col(duration) + F.lit(shift)) if shift else df, duration, event, covariates)
    sizes = table.agg(
        F.expr("sum(n) AS n"), F.expr("sum(n * e) AS events"), F.expr("count_if(t <= 0) AS bad"),
        *[F.expr(f"sum(n * x{j}) / sum(n) AS m{j}") for j in range(len(covariates))],
    ).first()
    if sizes["bad"]:
        raise ValueError("durations must be positive: drop such rows or pass a shift")
    if not sizes["events"]:
        raise ValueError("no event was observed")
    means = [float(sizes[f"m{j}"]) for j in range(len(covariates))]
    scales = _scales(table, means)
    for name, scale in zip(covariates, scales):
        if scale == 0:
            raise ValueError(f"{name} does not vary")
    logs = table.agg(
        F.expr("sum(n * ln(t)) / sum(n) AS mean"), F.expr("sum(n * ln(t) * ln(t)) / sum(n) AS square")
    ).first()
    spread = math.sqrt(max(logs["square"] - logs["mean"] ** 2, 1e-4))
    start = [logs["mean"], math.log(1.5 / spread)]
    null_at, null_value, _ = _maximise(table, family, start, [], [], max_iter, precision)
    at, value, hessian = _maximise(
        table, family, [null_at[0], *[0.0] * len(covariates), null_at[1]], means, scales, max_iter, precision
    )
    # back from (intercept, scaled and centred covariates, ln k) to the original covariates
    p = len(covariates)
    back = np.zeros((p + 2, p + 2))
    for j in range(p):
        back[j, j + 1] = 1 / scales[j]
        back[p, j + 1] = -means[j] / scales[j]
    back[p, 0] = back[p + 1, p + 1] = 1.0
    original = back @ at
    return AftModel(
        family, covariates, original[: p + 1], float(original[p + 1]),
        back @ np.linalg.inv(-hessian) @ back.T, value, null_value, int(sizes["n"]), int(sizes["events"]),
        alpha, np.array(means),
    )


def summary(spark: SparkSession, model: AftModel) -> DataFrame:
    """One row per parameter: coef, exp(coef), standard error, interval, z, p, -log2 p."""
    location, shape = PARAMETERS[model.family]
    names = [(location, c) for c in [*model.covariates, "Intercept"]] + [(shape, "Intercept")]
    # a log-normal is reported by its standard deviation, the inverse of the shape
    sign = -1.0 if model.family == "lognormal" else 1.0
    coef = [*model.coef, sign * model.log_shape]
    rows = coefficient_rows(names, coef, np.sqrt(np.diag(model.covariance)), model.alpha)
    return spark.createDataFrame(rows, "parameter string, " + COEFFICIENT_SCHEMA)


def intervals(spark: SparkSession, model: AftModel) -> DataFrame:
    """Coefficient interval data for a plot, largest coefficient first."""
    return summary(spark, model).select("parameter", "covariate", "coef", "lower", "upper").orderBy(F.desc("coef"))


def metrics(spark: SparkSession, model: AftModel, concordance: float | None = None) -> DataFrame:
    p = len(model.covariates)
    ratio = 2 * (model.log_likelihood - model.null_log_likelihood)
    tail = chi2_tail(ratio, p)
    row = (
        model.family, model.observations, model.events, model.log_likelihood, concordance,
        -2 * model.log_likelihood + 2 * (p + 2), ratio, p, tail, surprise(tail),
    )
    return spark.createDataFrame(
        [row],
        "family string, observations long, events long, log_likelihood double, concordance double, aic double, "
        "lr_statistic double, lr_df int, lr_p double, lr_neg_log2_p double",
    )


def median_column(model: AftModel) -> Column:
    """Median survival time of a row, as a column over the covariates."""
    terms = [F.lit(float(model.coef[-1]))]
    terms += [F.lit(float(b)) * F.col(f"`{c}`") for c, b in zip(model.covariates, model.coef)]
    location = terms[0]
    for term in terms[1:]:
        location = location + term
    extra = math.log(math.log(2.0)) / model.shape if model.family == "weibull" else 0.0
    return F.exp(location + F.lit(extra))


def median(spark: SparkSession, model: AftModel) -> DataFrame:
    """Median at the mean covariates, and its exponential, which is what treating the
    median as a log time reports."""
    location = float(model.coef[-1] + sum(b * m for b, m in zip(model.coef, model.means)))
    if model.family == "weibull":
        location += math.log(math.log(2.0)) / model.shape
    value = math.exp(location)
    inflated = math.exp(value) if value < 700 else math.inf
    return spark.createDataFrame([(model.family, value, inflated)], "family string, median double, exp_median_ref double")


def fit_weibull_library(
    df: DataFrame, duration: str, event: str, covariates: Sequence[str], max_iter: int = 100, shift: float = 0.0
) -> DataFrame:
    """Weibull by the built-in learner: parameter, covariate, coef (location) and ln k (shape).
    `shift` is added to every duration; a duration that is not positive then is refused, as
    `fit_aft` does, and rows with a missing value are left out."""
    df = df.where(present(df, duration, event, *covariates))
    least = df.agg(F.min(duration)).first()[0]
    if least is not None and least + shift <= 0:
        raise ValueError(f"durations must be positive, the smallest is {least}: pass shift=")
    ready = df.select(
        (F.col(duration) + shift).cast("double").alias("label"), F.col(event).cast("double").alias("censor"), *[f"`{c}`" for c in covariates]
    )
    points = VectorAssembler(inputCols=list(covariates), outputCol="features").transform(ready)
    model = AFTSurvivalRegression(maxIter=max_iter).fit(points)
    location, shape = PARAMETERS["weibull"]
    rows = [(location, c, float(b)) for c, b in zip(covariates, model.coefficients)]
    rows += [(location, "Intercept", float(model.intercept)), (shape, "Intercept", -math.log(model.scale))]
    return df.sparkSession.createDataFrame(rows, "parameter string, covariate string, coef double")
