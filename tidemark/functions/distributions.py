"""Densities, distribution functions and quantiles of the usual families, as column expressions.

Values go through in Arrow batches; every rule works on whole arrays, and elements that have
converged drop out of its loop. The incomplete gamma and beta functions are a series where it falls
fast and a continued fraction elsewhere; quantiles are Newton steps inside a bracket that shrinks
with each of them, halved where a step would leave it. Parameters or arguments that a family
does not have give null, as do nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
#: Bernoulli numbers B(2k) / (2k (2k - 1)) of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series from 8 on, where smaller arguments are moved to."""
    x = np.asarray(x, float)
    small = x < 8
    z = np.where(small, x + 8, x)
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + sum(b / z ** (2 * k + 1) for k, b in enumerate(STIRLING))
    shift = np.prod([np.where(small, x + k, 1.0) for k in range(8)], axis=0)
    return out - np.log(shift)


def _until(step: Callable, *arrays: np.ndarray) -> np.ndarray:
    """Repeat step(n, state) -> (state, value, done) over the elements that are not done, and gather the values."""
    arrays = np.broadcast_arrays(*arrays)
    value, at, state, n = np.empty(arrays[0].shape), np.arange(arrays[0].size), tuple(a.ravel() for a in arrays), 0
    while at.size:
        state, v, done = step(n, state)
        value.flat[at[done]] = v[done]
        at, state, n = at[~done], tuple(s[~done] for s in state), n + 1
    return value


def _gamma_series(a, x):
    def step(n, s):
        a, x, term, total = s
        term = np.where(n, term * x / (a + n), 1 / a)
        total = np.where(n, total + term, term)
        return (a, x, term, total), total, ~(term > 1e-17 * total)

    return _until(step, a, x, np.zeros_like(a), np.zeros_like(a))


def _gamma_fraction(a, x):
    """The fraction of the upper function, from its front (Lentz)."""

    def step(n, s):
        a, x, h, c, d = s
        if n == 0:
            d = 1 / (x + 1 - a)
            return (a, x, d, np.full_like(a, 1 / TINY), d), d, np.zeros(a.shape, bool)
        k = -n * (n - a)
        b = x + 1 - a + 2 * n
        d, c = k * d + b, b + k / c
        d, c = 1 / np.where(np.abs(d) < TINY, TINY, d), np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
        return (a, x, h, c, d), h, ~(np.abs(d * c - 1) > 1e-15)

    z = np.zeros_like(a)
    return _until(step, a, x, z, z, z)


def gamma_pq(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper regularised incomplete gamma functions, a > 0 and x >= 0; each is exact in its own tail."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    p, q = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    good = (a > 0) & (x >= 0)
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - log_gamma(a))
        low = good & (x < a + 1) & (x > 0)
        p[low] = front[low] * _gamma_series(a[low], x[low])
        q[low] = 1 - p[low]
        high = good & (x >= a + 1) & np.isfinite(x)
        q[high] = front[high] * _gamma_fraction(a[high], x[high])
        p[high] = 1 - q[high]
    for at, v in ((good & (x == 0), 0.0), (good & np.isposinf(x), 1.0)):
        p[at], q[at] = v, 1 - v
    return p, q


def _beta_fraction(a, b, x):
    def step(n, s):
        a, b, x, h, c, d = s
        if n == 0:
            d = 1 - (a + b) * x / (a + 1)
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            return (a, b, x, d, np.ones_like(a), d), d, np.zeros(a.shape, bool)
        for k in (n * (b - n) * x / ((a + 2 * n - 1) * (a + 2 * n)), -(a + n) * (a + b + n) * x / ((a + 2 * n) * (a + 2 * n + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / np.where(np.abs(d) < TINY, TINY, d), np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        return (a, b, x, h, c, d), h, ~(np.abs(d * c - 1) > 1e-15)

    z = np.zeros_like(a)
    return _until(step, a, b, x, z, z, z)


def beta_pq(a, b, x, y=None) -> tuple[np.ndarray, np.ndarray]:
    """The regularised incomplete beta function and its complement; y is 1 - x, if that is known better."""
    y = 1 - np.asarray(x, float) if y is None else y
    a, b, x, y = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x, y))
    p, q = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    good = (a > 0) & (b > 0) & (x >= 0) & (y >= 0)
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log(y))
        inside = good & (x > 0) & (y > 0)
        left = inside & (x < (a + 1) / (a + b + 2))
        right = inside & ~left
        p[left] = front[left] / a[left] * _beta_fraction(a[left], b[left], x[left])
        q[left] = 1 - p[left]
        q[right] = front[right] / b[right] * _beta_fraction(b[right], a[right], y[right])
        p[right] = 1 - q[right]
    for at, v in ((good & (x == 0), 0.0), (good & (y == 0), 1.0)):
        p[at], q[at] = v, 1 - v
    return p, q


class Family(NamedTuple):
    """cdf gives (lower, upper tail); low and high are the ends of the support; whole numbers if discrete."""

    parameters: int
    valid: Callable
    cdf: Callable
    pdf: Callable
    low: float = 0.0
    high: float = np.inf
    discrete: bool = False


def _normal_pq(z):
    p, q = gamma_pq(np.full(np.shape(z), 0.5), z * z / 2)
    return np.where(z < 0, q / 2, 0.5 + p / 2), np.where(z < 0, 0.5 + p / 2, q / 2)


def _t_pq(x, n):
    p, q = beta_pq(n / 2, np.full(np.shape(n), 0.5), n / (n + x * x), x * x / (n + x * x))
    return np.where(x < 0, p / 2, 0.5 + q / 2), np.where(x < 0, 0.5 + q / 2, p / 2)


def _two(p):
    return p, 1 - p


def _up(q):
    return 1 - q, q


def _swap(pq):
    return pq[1], pq[0]


_positive = lambda *p: np.all([v > 0 for v in p], axis=0)
_scale = lambda m, s: s > 0
_share = lambda p: (p > 0) & (p <= 1)
_choose = lambda n, k: log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)

#: Location and scale, shape and scale, degrees of freedom: parameters in the usual order.
FAMILIES: dict[str, Family] = {
    "normal": Family(2, _scale, lambda x, m, s: _normal_pq((x - m) / s), lambda x, m, s: np.exp(-(((x - m) / s) ** 2) / 2) / (s * np.sqrt(2 * np.pi)), -np.inf),
    "lognormal": Family(2, _scale, lambda x, m, s: _normal_pq((np.log(x) - m) / s), lambda x, m, s: np.exp(-(((np.log(x) - m) / s) ** 2) / 2) / (x * s * np.sqrt(2 * np.pi))),
    "student_t": Family(1, _positive, _t_pq, lambda x, n: np.exp(log_gamma((n + 1) / 2) - log_gamma(n / 2) - (n + 1) / 2 * np.log1p(x * x / n)) / np.sqrt(n * np.pi), -np.inf),
    "chi_squared": Family(1, _positive, lambda x, n: gamma_pq(n / 2, x / 2), lambda x, n: np.exp((n / 2 - 1) * np.log(x / 2) - x / 2 - log_gamma(n / 2)) / 2),
    "f": Family(2, _positive, lambda x, m, n: beta_pq(m / 2, n / 2, m * x / (m * x + n), n / (m * x + n)), lambda x, m, n: np.exp(m / 2 * np.log(m) + n / 2 * np.log(n) + (m / 2 - 1) * np.log(x) - (m + n) / 2 * np.log(m * x + n) + log_gamma((m + n) / 2) - log_gamma(m / 2) - log_gamma(n / 2))),
    "gamma": Family(2, _positive, lambda x, k, s: gamma_pq(k, x / s), lambda x, k, s: np.exp((k - 1) * np.log(x / s) - x / s - log_gamma(k)) / s),
    "beta": Family(2, _positive, lambda x, a, b: beta_pq(a, b, x), lambda x, a, b: np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)), 0.0, 1.0),
    "weibull": Family(2, _positive, lambda x, k, s: (-np.expm1(-((x / s) ** k)), np.exp(-((x / s) ** k))), lambda x, k, s: k / s * (x / s) ** (k - 1) * np.exp(-((x / s) ** k))),
    "exponential": Family(1, _positive, lambda x, s: (-np.expm1(-x / s), np.exp(-x / s)), lambda x, s: np.exp(-x / s) / s),
    "logistic": Family(2, _scale, lambda x, m, s: (1 / (1 + np.exp(-(x - m) / s)), 1 / (1 + np.exp((x - m) / s))), lambda x, m, s: 1 / (4 * s * np.cosh((x - m) / (2 * s)) ** 2), -np.inf),
    "cauchy": Family(2, _scale, lambda x, m, s: (np.arctan2(1, -(x - m) / s) / np.pi, np.arctan2(1, (x - m) / s) / np.pi), lambda x, m, s: 1 / (np.pi * s * (1 + ((x - m) / s) ** 2)), -np.inf),
    "poisson": Family(1, _positive, lambda k, m: _swap(gamma_pq(k + 1, m)), lambda k, m: np.exp(k * np.log(m) - m - log_gamma(k + 1)), discrete=True),
    "geometric": Family(1, _share, lambda k, p: _up((1 - p) ** (k + 1)), lambda k, p: p * (1 - p) ** k, discrete=True),
    "binomial": Family(2, lambda n, p: (n >= 0) & (n == np.floor(n)) & (p > 0) & (p < 1), lambda k, n, p: tuple(np.where(k >= n, v, w) for v, w in zip((1.0, 0.0), beta_pq(np.maximum(n - k, TINY), k + 1, 1 - p, p))), lambda k, n, p: np.where(k > n, 0.0, np.exp(_choose(n, np.minimum(k, n)) + k * np.log(p) + (n - k) * np.log1p(-p))), discrete=True),
    "negative_binomial": Family(2, lambda r, p: (r > 0) & (p > 0) & (p < 1), lambda k, r, p: beta_pq(r, k + 1, p, 1 - p), lambda k, r, p: np.exp(log_gamma(k + r) - log_gamma(r) - log_gamma(k + 1) + r * np.log(p) + k * np.log1p(-p)), discrete=True),
}


def tails(family: str, x, *parameters) -> tuple[np.ndarray, np.ndarray]:
    """(P(X <= x), P(X > x)) of arrays."""
    f = FAMILIES[family]
    x, *ps = (np.asarray(v, float) for v in np.broadcast_arrays(x, *parameters))
    x = np.floor(x) if f.discrete else x
    out = [np.full(x.shape, np.nan), np.full(x.shape, np.nan)]
    known = ~np.isnan([x, *ps]).any(axis=0)
    with np.errstate(all="ignore"):
        known &= f.valid(*ps)
        inside = known & (x >= f.low) & (x <= f.high) & np.isfinite(x)
        if f.low == 0 and not f.discrete:
            inside &= x > 0
        p, q = f.cdf(x[inside], *[v[inside] for v in ps])
    out[0][inside], out[1][inside] = p, q
    below, above = known & ~inside & (x <= f.low), known & ~inside & (x > f.low)
    out[0][below], out[1][below] = 0.0, 1.0
    out[0][above], out[1][above] = 1.0, 0.0
    return out[0], out[1]


def densities(family: str, x, *parameters) -> np.ndarray:
    """The density at x, or the probability of exactly x; 0 outside the support and at fractions of a discrete family."""
    f = FAMILIES[family]
    x, *ps = (np.asarray(v, float) for v in np.broadcast_arrays(x, *parameters))
    known = ~np.isnan([x, *ps]).any(axis=0)
    with np.errstate(all="ignore"):
        known &= f.valid(*ps)
        inside = known & (x >= f.low) & (x <= f.high) & np.isfinite(x)
        if f.discrete:
            inside &= x == np.floor(x)
        v = f.pdf(x[inside], *[v[inside] for v in ps])
    out = np.where(known, 0.0, np.nan)
    out[inside] = v
    return out


def quantiles(family: str, p, *parameters) -> np.ndarray:
    """The x with P(X <= x) = p; of a discrete family the least whole x with P(X <= x) >= p."""
    f = FAMILIES[family]
    p, *ps = (np.asarray(v, float) for v in np.broadcast_arrays(p, *parameters))
    known = ~np.isnan([p, *ps]).any(axis=0)
    with np.errstate(all="ignore"):
        known &= f.valid(*ps) & (p >= 0) & (p <= 1)
    out = np.full(p.shape, np.nan)
    ends = known & ((p == 0) | (p == 1))
    out[ends] = np.where(p[ends] == 0, f.low, f.high)
    at = np.flatnonzero(known & ~ends)
    if not at.size:
        return out
    p, ps = p.flat[at], [v.flat[at] for v in ps]
    cdf = lambda x: tails(family, x, *ps)

    # a bracket, doubled until it holds the quantile
    low, high = np.full(p.shape, max(f.low, -1.0)), np.full(p.shape, min(f.high, 1.0))
    while f.high == np.inf and (out_of := cdf(high)[0] < p).any():
        low = np.where(out_of, high, low)
        high = np.where(out_of, high * 2, high)
    while f.low == -np.inf and (out_of := (cdf(low)[0] >= p) & (low < 0)).any():
        high = np.where(out_of & (low < high), np.minimum(high, low), high)
        low = np.where(out_of, low * 2, low)
    if f.discrete:
        low, high = np.full(p.shape, -1.0), np.floor(high)
        while (high - low > 1).any():
            mid = np.floor((low + high) / 2)
            enough = cdf(mid)[0] >= p
            low, high = np.where(enough, low, mid), np.where(enough, mid, high)
        out.flat[at] = high
        return out
    x = (low + high) / 2
    for _ in range(2000):  # a halving at worst gains one digit of two in a thousand
        below, above = cdf(x)
        off = np.where(p <= 0.5, below - p, (1 - p) - above)
        low, high = np.where(off < 0, x, low), np.where(off < 0, high, x)
        with np.errstate(all="ignore"):
            new = x - off / densities(family, x, *ps)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        settled = (np.abs(new - x) <= 4e-16 * np.abs(x)) | (off == 0) | (high - low <= 4e-16 * np.abs(x))
        x = np.where(off == 0, x, new)
        if settled.all():
            break
    out.flat[at] = x
    return out


def _column(of: Callable, family: str, x: Column, parameters) -> Column:
    if len(parameters) != FAMILIES[family].parameters:
        raise ValueError(f"{family} has {FAMILIES[family].parameters} parameters")

    @F.pandas_udf("double")
    def f(*values: pd.Series) -> pd.Series:
        return pd.Series(of(family, *[v.to_numpy(float) for v in values])).replace({np.nan: None}).astype("float64")

    return F.nanvl(f(x.cast("double"), *[(p if isinstance(p, Column) else F.lit(p)).cast("double") for p in parameters]), F.lit(None).cast("double"))


def cdf(family: str, x: Column, *parameters) -> Column:
    """P(X <= x)."""
    return _column(lambda *a: tails(*a)[0], family, x, parameters)


def survival(family: str, x: Column, *parameters) -> Column:
    """P(X > x), exact where it is small."""
    return _column(lambda *a: tails(*a)[1], family, x, parameters)


def pdf(family: str, x: Column, *parameters) -> Column:
    return _column(densities, family, x, parameters)


def quantile(family: str, p: Column, *parameters) -> Column:
    return _column(quantiles, family, p, parameters)
