"""Tail probabilities of the normal and chi-square distributions.

Spark SQL has no error function. Scalars are for fitted parameters on the
driver; the pandas UDF is for result tables. The log-normal likelihood, whose
argument is a column of any length, uses column arithmetic.
"""

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for chi-square with `df` degrees of freedom (finite closed form)."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for j in range(1, df // 2):
            term *= half / j
            total += term
        return math.exp(-half) * total
    tail = math.erfc(math.sqrt(half))
    term = math.sqrt(half) / math.gamma(1.5)
    for j in range(1, (df + 1) // 2):
        tail += math.exp(-half) * term
        term *= half / (j + 0.5)
    return tail


def surprise(p: float) -> float:
    """-log2 p, infinite when p underflows to zero."""
    return math.inf if p == 0 else -math.log2(p)


def chi2_tail_1df(statistic: Column) -> Column:
    """Column form of `chi2_tail(x, 1)`; meant for result tables."""
    import pandas as pd

    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)), na_action="ignore")

    return F.pandas_udf(tail, "double")(statistic)


# Rational Chebyshev approximations of erf and erfc (W. J. Cody, Math. Comp. 23, 1969),
# numerators and denominators with the highest power first and the constant last.
NEAR = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
     1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2,
     2.33520497626869185e-3),
)


def _ratio(fraction: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    def polynomial(coefficients: tuple[float, ...]) -> Column:
        value = F.lit(coefficients[0])
        for c in coefficients[1:]:
            value = value * x + c
        return value

    return polynomial(fraction[0]) / polynomial(fraction[1])


def log_erfc(x: Column) -> Column:
    """ln of the complementary error function of x >= 0, as column arithmetic: 12 digits and more, and
    no underflow in the far tail."""
    near, middle, far = F.least(x, F.lit(0.46875)), F.least(x, F.lit(4.0)), F.greatest(x, F.lit(4.0))
    inverse = 1.0 / (far * far)
    tail = (1.0 / math.sqrt(math.pi) - inverse * _ratio(FAR, inverse)) / far
    return (
        F.when(x <= 0.46875, F.log1p(-near * _ratio(NEAR, near * near)))
        .when(x <= 4.0, F.log(_ratio(MIDDLE, middle)) - middle * middle)
        .otherwise(F.log(tail) - far * far)
    )


def normal_log_survival(z: Column) -> Column:
    """ln P(Z > z), accurate in the far tail."""
    tail = log_erfc(F.abs(z) / math.sqrt(2.0)) - math.log(2.0)
    return F.when(z >= 0, tail).otherwise(F.log1p(-F.exp(tail)))
