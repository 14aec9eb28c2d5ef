"""Against exact values, sums, integrals and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as D

PARAMETERS = {
    "normal": (1.5, 2.0), "lognormal": (0.3, 0.8), "student_t": (7.0,), "chi_squared": (5.0,), "f": (6.0, 11.0), "gamma": (2.5, 1.7), "beta": (2.2, 3.7), "weibull": (1.8, 2.0),
    "exponential": (2.0,), "logistic": (1.0, 0.7), "cauchy": (0.5, 1.5), "poisson": (6.3,), "geometric": (0.3,), "binomial": (12.0, 0.35), "negative_binomial": (3.5, 0.4),
}


def test_log_gamma():
    x = np.array([1e-8, 0.1, 0.5, 1, 1.5, 2, 7.9, 8, 30, 171, 1e6])
    assert np.allclose(D.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-14)


def test_known_values():
    # closed forms: chi-square of 2, t of 1 and 2, F of (2, 2), gamma of whole shape, the normal by erf
    x = np.array([0.01, 0.5, 1.0, 3.0, 20.0])
    assert np.allclose(D.tails("chi_squared", x, 2.0)[1], np.exp(-x / 2), rtol=1e-13)
    assert np.allclose(D.tails("student_t", -x, 1.0)[0], 0.5 - np.arctan(x) / np.pi, rtol=1e-12)
    assert np.allclose(D.tails("student_t", x, 2.0)[0], 0.5 + x / (2 * np.sqrt(2 + x * x)), rtol=1e-13)
    assert np.allclose(D.tails("f", x, 2.0, 2.0)[0], x / (1 + x), rtol=1e-13)
    assert np.allclose(D.tails("gamma", x, 3.0, 1.0)[1], np.exp(-x) * (1 + x + x * x / 2), rtol=1e-13)
    assert np.allclose(D.tails("normal", -x, 0.0, 1.0)[0], [math.erfc(v / math.sqrt(2)) / 2 for v in x], rtol=1e-12)
    assert np.allclose(D.quantiles("normal", [0.025, 0.5, 0.975], 0.0, 1.0), [-1.959963984540054, 0, 1.959963984540054], atol=1e-14)
    assert np.allclose(D.quantiles("student_t", [0.975, 0.05], [10.0, 3.0]), [2.2281388519649385, -2.3533634348018264], rtol=1e-12)
    assert np.allclose(D.quantiles("f", 0.95, 3.0, 8.0), 4.06618055713, rtol=1e-10)
    assert np.allclose(D.tails("gamma", np.array([9000.0, 10000.0, 11000.0]), 1e4, 1.0)[0].round(6), [0.0, 0.50133, 1.0])


@pytest.mark.parametrize("family", sorted(PARAMETERS))
def test_density_and_distribution_agree(family):
    ps, f = PARAMETERS[family], D.FAMILIES[family]
    if f.discrete:
        k = np.arange(0, 60.0)
        assert np.allclose(np.cumsum(D.densities(family, k, *ps)), D.tails(family, k, *ps)[0], atol=1e-12)
        assert D.densities(family, 1.5, *ps) == 0 and np.allclose(D.tails(family, k + 0.7, *ps)[0], D.tails(family, k, *ps)[0])
    else:
        a, b = D.quantiles(family, [0.2, 0.8], *ps)
        x = np.linspace(a, b, 20001)
        y, h = D.densities(family, x, *ps), (b - a) / 20000
        area = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
        assert abs(area - 0.6) < 1e-10
    x = np.array([0.3, 0.9, 4.0])
    assert np.allclose(sum(D.tails(family, x, *ps)), 1)


@pytest.mark.parametrize("family", sorted(PARAMETERS))
def test_quantile_inverts(family):
    ps, f = PARAMETERS[family], D.FAMILIES[family]
    p = np.array([1e-12, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9])
    x = D.quantiles(family, p, *ps)
    if f.discrete:
        assert (D.tails(family, x, *ps)[0] >= p).all() and ((D.tails(family, x - 1, *ps)[0] < p) | (x == 0)).all()
    else:
        assert np.allclose(D.tails(family, x, *ps)[0], p, rtol=1e-9, atol=0)
    assert (D.quantiles(family, [0.0, 1.0], *ps) == [f.low, f.high]).all()


def test_columns_and_what_has_no_value(spark):
    rows = [(0.5, 2.0, 3.0), (None, 2.0, 3.0), (0.5, -1.0, 3.0), (-4.0, 2.0, 3.0), (4.0, 2.0, 3.0), (float("nan"), 1.0, 1.0)]
    d = spark.createDataFrame(rows, "x double, a double, b double").select("x", *[f("beta", F.col("x"), F.col("a"), F.col("b")).alias(n) for n, f in (("c", D.cdf), ("s", D.survival), ("d", D.pdf), ("q", D.quantile))])
    got = [tuple(r)[1:] for r in d.collect()]
    assert np.allclose(got[0], (0.6875, 0.3125, 1.5, D.quantiles("beta", 0.5, 2.0, 3.0)))
    assert got[1] == got[2] == got[5] == (None,) * 4
    assert got[3] == (0.0, 1.0, 0.0, None) and got[4] == (1.0, 0.0, 0.0, None)
    assert d.where("x < -100").count() == 0
    with pytest.raises(ValueError):
        D.cdf("f", F.lit(1.0), 2.0)
