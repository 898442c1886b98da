"""Customer lifetime value from a Cox survival curve.

A scenario is a covariate profile plus an annual rate. Survival is rounded to
two places, and so are the monthly amounts, because that rounding is part of
the result; half goes to even.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lapse.functions.scalars import discounted
from lapse.operators.cox import CoxModel, baseline_hazard, predict_survival, relative_risk
from lapse.operators.kaplan_meier import at_times
from lapse.operators.running import same_keys_join

# Monthly profit of the plan, default annual rate, reported months.
MONTHLY_PROFIT = 30.0
ANNUAL_RATE = 0.10
MILESTONES = (12, 24, 36)

Scenario = Mapping[str, float]


def check_scenarios(model: CoxModel, scenarios: Sequence[Scenario]) -> list[dict[str, float]]:
    """Fill in what a scenario leaves out (0, default rate); unknown names have no effect."""
    ready = []
    for s in scenarios:
        unknown = sorted(set(s) - set(model.covariates) - {"rate"})
        if unknown:
            warnings.warn(f"not a covariate of the model, ignored: {', '.join(unknown)}", stacklevel=3)
        ready.append({c: float(s.get(c, 0)) for c in model.covariates} | {"rate": float(s.get("rate", ANNUAL_RATE))})
    return ready


def payback(
    model: CoxModel,
    scenarios: Sequence[Scenario],
    horizon: int = 36,
    profit: float = MONTHLY_PROFIT,
    dense: bool = True,
) -> DataFrame:
    """Payback table per scenario: scenario, contract_month, survival, monthly_profit,
    expected_profit, npv, cumulative_npv.

    Month m is shown as contract month m + 1; month 0 has survival 1. `dense`
    gives every month up to the horizon (a step function holds its last
    value); otherwise only observed times appear, after the extra month 0. A
    stratified model has a baseline per stratum: the table then starts with the
    strata columns and prices every scenario in every stratum.
    """
    ready, strata = check_scenarios(model, scenarios), model.strata
    baseline = baseline_hazard(model)
    if dense:
        months = at_times(baseline, range(1, horizon), {"cumulative_hazard": 0.0}, strata)
        steps = months.select(*strata, F.col("time").alias("t"), "cumulative_hazard")
    else:
        steps = baseline.select(*strata, F.col("t").cast("double").alias("t"), "cumulative_hazard")
    curves = predict_survival(model, ready, steps)
    starts = ", ".join(f"named_struct('row', {i}, 't', 0.0D, 'survival', 1.0D)" for i in range(len(ready)))
    groups = baseline.select(*strata).distinct() if strata else model.table.sparkSession.range(1).select()
    origin = groups.selectExpr(*[f"`{s}`" for s in strata], f"inline(array({starts}))")
    rates = F.element_at(F.array(*[F.lit(s["rate"]) for s in ready]), F.col("row") + 1)
    table = origin.unionByName(curves.select(*strata, "row", "t", F.bround("survival", 2).alias("survival")))
    return _discount(table.withColumn("rate", rates), profit, strata).select(
        *strata,
        F.col("row").alias("scenario"),
        (F.col("t").cast("int") + 1).alias("contract_month"),
        "survival",
        F.lit(profit).alias("monthly_profit"),
        "expected_profit",
        "npv",
        "cumulative_npv",
    )


def _discount(table: DataFrame, profit: float, strata: Sequence[str] = ()) -> DataFrame:
    month = F.col("t").cast("int")
    priced = table.withColumn("expected_profit", F.bround(F.col("survival") * F.lit(profit), 2)).withColumn(
        "npv", F.bround(discounted(F.col("expected_profit"), F.col("rate"), month), 2)
    )
    # `survival` descending keeps the added month 0 ahead of an observed one
    running = (
        Window.partitionBy(*strata, "row").orderBy("t", F.desc("survival")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return priced.withColumn("cumulative_npv", F.sum("npv").over(running))


def milestones(table: DataFrame, months: Sequence[int] = MILESTONES) -> DataFrame:
    """Cumulative NPV at the given contract months, selected by month number."""
    return table.where(F.col("contract_month").isin(list(months))).select(
        *_who(table), "contract_month", "cumulative_npv"
    )


def _who(table: DataFrame) -> list[str]:
    """Strata, if any, and scenario of a payback table."""
    return table.columns[: table.columns.index("scenario") + 1]


def survival_curve(table: DataFrame) -> DataFrame:
    return table.select(*_who(table), "contract_month", "survival")


def payback_period(table: DataFrame, acquisition_cost: float) -> DataFrame:
    """First contract month whose cumulative NPV covers the cost; NULL if never."""
    covered = F.when(F.col("cumulative_npv") >= acquisition_cost, F.col("contract_month"))
    return table.groupBy(*_who(table)).agg(F.min(covered).alias("payback_month"))


def customer_ltv(
    customers: DataFrame,
    model: CoxModel,
    key: str,
    horizon: int = 36,
    rate: float = ANNUAL_RATE,
    profit: float = MONTHLY_PROFIT,
) -> DataFrame:
    """Cumulative NPV over the horizon for every customer.

    The baseline at the horizon's months is an array of `horizon` doubles (a
    scalar subquery), so each customer is valued inside its own row: no join,
    no shuffle, and no grouping that a common profile could skew. A stratified
    model has one such array per stratum, joined by the strata; a customer in a
    stratum the model has not seen gets NULL.
    """
    strata = model.strata
    months = at_times(baseline_hazard(model), range(1, horizon), {"cumulative_hazard": 0.0}, strata)
    arrays = months.groupBy(*strata).agg(
        F.sort_array(F.collect_list(F.struct("time", "cumulative_hazard"))).alias("h")
    ).select(*strata, F.col("h.cumulative_hazard").alias("_h"))
    scored = customers.select(F.col(key), *strata, relative_risk(model).alias("relative_risk"))
    if strata:
        scored = same_keys_join(scored, arrays, strata, "left")
    else:
        scored = scored.withColumn("_h", arrays.scalar())
    survival = "bround(exp(-h * relative_risk), 2)"
    value = f"bround(bround({survival} * {profit!r}D, 2) / pow({1 + rate / 12!r}D, i + 1), 2)"
    total = F.expr(f"aggregate(transform(_h, (h, i) -> {value}), bround({profit!r}D, 2), (total, v) -> total + v)")
    total = F.when(F.col("_h").isNotNull(), total)
    return scored.select(key, "relative_risk", total.alias("lifetime_value"))
