"""The smoothed residual curve against a plain local linear fit."""

import random

import numpy as np
import pytest

from lapse.operators import cox


def rows(spark, n=600, groups=1):
    rng = random.Random(5)
    data = [
        (1 + rng.randrange(60), int(rng.random() < 0.7), rng.randrange(2), rng.gauss(0, 1), f"g{i % groups}") for i in range(n)
    ]
    return spark.createDataFrame(data, "t int, e int, a int, b double, g string")


def plain(points, bins, reach):
    """points: (n, u in 0..1, r) -> a fit at the centre of every bin."""
    n, u, r = map(np.array, zip(*points))
    own = np.minimum(bins - 1, np.floor(u * bins))
    wide = max(1, int(np.ceil(reach * bins)))
    found = {}
    for j in range(bins):
        far = np.abs(own - j)
        w = np.where(far < wide, (1 - (far / wide) ** 3) ** 3, 0.0) * n
        if w.sum() > 0:
            d = u - (j + 0.5) / bins
            a0, a1, a2, b0, b1 = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * r).sum(), (w * r * d).sum()
            det = a0 * a2 - a1 * a1
            found[j] = (a2 * b0 - a1 * b1) / det if det > 1e-12 * a0 * a0 else b0 / a0
    return found


@pytest.mark.parametrize("bins,reach", [(20, 0.3), (7, 0.01)])
def test_against_a_plain_fit(spark, bins, reach):
    model = cox.fit_cox(rows(spark), "t", "e", ["a", "b"])
    residuals = cox.schoenfeld(model).collect()
    lo, hi = min(r["t"] for r in residuals), max(r["t"] for r in residuals)
    got = cox.smoothed_residuals(model, "t", bins, reach).collect()
    for name, coef in zip(model.covariates, model.coef):
        points = [(r["n"], (r["t"] - lo) / (hi - lo), r["scaled"]) for r in residuals if r["covariate"] == name]
        expected = plain(points, bins, reach)
        mine = {round((r["g"] - lo) / (hi - lo) * bins - 0.5): r for r in got if r["covariate"] == name}
        assert set(mine) == set(expected)
        for j, value in expected.items():
            assert mine[j]["residual"] == pytest.approx(value, rel=1e-6, abs=1e-8)
            assert mine[j]["effect"] == pytest.approx(value + coef, rel=1e-6, abs=1e-8)


def test_strata_and_transforms(spark):
    model = cox.fit_cox(rows(spark, groups=2), "t", "e", ["a"], strata=["g"])
    for transform in ("km", "rank"):
        found = cox.smoothed_residuals(model, transform, 10).collect()
        assert 0 < len(found) <= 10 and {r["covariate"] for r in found} == {"a"}
        assert all(np.isfinite(r["residual"]) for r in found)
    with pytest.raises(ValueError, match="transform"):
        cox.smoothed_residuals(model, "log")


def test_one_time_of_death(spark):
    data = [(5, 1, i % 2) for i in range(20)] + [(9, 0, i % 2) for i in range(20)]
    model = cox.at_fixed(spark.createDataFrame(data, "t int, e int, a int"), "t", "e", {"a": 0.1})
    found = cox.smoothed_residuals(model, "t", 5).collect()
    assert found and all(np.isfinite(r["residual"]) for r in found)
