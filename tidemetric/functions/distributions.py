"""Normal, t, chi-square and binomial distribution functions in numpy, as columns.

They are for result rows: one row per test, never per observation. Inputs are arrays or
scalars; quantiles are found by bisection on the distribution function.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_NORMAL = NormalDist()
_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def normal_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2.0))


def normal_quantile(p):
    return np.vectorize(lambda q: _NORMAL.inv_cdf(q) if 0 < q < 1 else math.nan, otypes=[float])(p)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, by Lentz's method, on arrays."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d, c = 1.0 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def beta_cdf(x, a, b):
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    one = front * _beta_fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)) / np.where(low, a, b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, one, 1 - one)))


def t_cdf(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return np.where(t > 0, 1 - tail, tail)


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def _bisect(cdf, p, low, high):
    p = np.asarray(p, float)
    low, high = np.full(p.shape, low, float), np.full(p.shape, high, float)
    for _ in range(200):
        mid = (low + high) / 2
        above = cdf(mid) > p
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return (low + high) / 2


def t_quantile(p, df):
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    return _bisect(lambda t: t_cdf(t, df), p, -1e4, 1e4)


def beta_quantile(p, a, b):
    p, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, a, b)))
    return _bisect(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def gamma_cdf(x, a):
    """Lower regularised incomplete gamma function, by its series or continued fraction."""

    def one(x, a):
        if not x > 0:
            return 0.0 if x <= 0 else math.nan
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1.0 / a
            n = a
            while abs(term) > 1e-16 * abs(total):
                n += 1
                term *= x / n
                total += term
            return front * total
        b = x + 1 - a
        c, d = 1e300, 1 / b
        h = d
        for i in range(1, 2000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - front * h

    return np.vectorize(one, otypes=[float])(x, a)


def chi_square_tail(x, df):
    return 1 - gamma_cdf(np.asarray(x, float) / 2, np.asarray(df, float) / 2)


def sign_test(wins, losses):
    """Two-sided exact binomial p at one half; 1 without trials."""

    def one(w, n):
        if n <= 0:
            return 1.0
        k = min(w, n - w)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(int(k) + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, logs)))

    wins, losses = np.asarray(wins, float), np.asarray(losses, float)
    return np.vectorize(one, otypes=[float])(wins, wins + losses)


def _safe(function, *columns):
    """Rows with a null or NaN input give null."""
    known = ~np.any([c.isna().to_numpy() for c in columns], axis=0)
    out = np.full(len(columns[0]), np.nan)
    if known.any():
        out[known] = function(*[c.to_numpy(float)[known] for c in columns])
    return pd.array(out, "Float64") if known.all() else pd.array([x if k else None for x, k in zip(out, known, strict=True)], "Float64")


def normal_cdf_of(x):
    return F.pandas_udf(lambda a: pd.Series(_safe(normal_cdf, a)), "double")(x)


def t_p_value(t, df):
    return F.pandas_udf(lambda a, b: pd.Series(_safe(t_two_sided, a, b)), "double")(t, df)


def t_upper_p(t, df):
    """P(T > t)."""
    return F.pandas_udf(lambda a, b: pd.Series(_safe(lambda x, d: 1 - t_cdf(x, d), a, b)), "double")(t, df)


def t_quantile_of(p: float, df):
    return F.pandas_udf(lambda a: pd.Series(_safe(lambda d: t_quantile(p, d), a)), "double")(df)


def normal_p_value(z):
    return F.pandas_udf(lambda a: pd.Series(_safe(lambda x: 2 * normal_cdf(-np.abs(x)), a)), "double")(z)


def chi_square_p(x, df):
    return F.pandas_udf(lambda a, b: pd.Series(_safe(chi_square_tail, a, b)), "double")(x, df)


def sign_test_p(wins, losses):
    return F.pandas_udf(lambda a, b: pd.Series(_safe(sign_test, a, b)), "double")(wins, losses)
