"""Tail probabilities as vectorised columns on grouped results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _norm_sf(z):
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def _betainc(a, b, x):
    """Regularised incomplete beta by continued fraction, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(p), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def _t_sf(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * _betainc(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0, half, 1 - half)


def _t_ppf(q, df):
    q, df = np.broadcast_arrays(np.asarray(q, float), np.asarray(df, float))
    lo, hi = np.full(q.shape, -1e4), np.full(q.shape, 1e4)
    for _ in range(90):
        mid = (lo + hi) / 2
        below = 1 - _t_sf(mid, df) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def _shifted_t_sf(t, df, shift):
    """P(T > t) for the non-central t, by quadrature over the scale variable."""
    x, wgt = np.polynomial.legendre.leggauss(160)
    out = np.empty(len(t))
    for i, (ti, v, d) in enumerate(zip(t, df, shift)):
        spread = 12 / math.sqrt(2 * v)
        a, b = max(1e-9, 1 - spread), 1 + spread
        s = a + (b - a) * (x + 1) / 2
        logf = math.log(2) + v / 2 * math.log(v / 2) - math.lgamma(v / 2) + (v - 1) * np.log(s) - v * s * s / 2
        out[i] = np.sum(wgt * (b - a) / 2 * np.exp(logf) * _norm_sf(ti * s - d))
    return out


def _frame(*cols):
    arr = [c.to_numpy(dtype=float, na_value=np.nan) for c in cols]
    return arr, np.logical_and.reduce([~np.isnan(c) for c in arr])


def _masked(fn, *cols) -> pd.Series:
    arr, ok = _frame(*cols)
    out = np.full(len(ok), np.nan)
    if ok.any():
        out[ok] = fn(*[c[ok] for c in arr])
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("Float64")


@F.pandas_udf(T.DoubleType())
def t_greater(t: pd.Series, df: pd.Series) -> pd.Series:
    """One-sided p-value, alternative greater."""
    return _masked(_t_sf, t, df.where(df > 0))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: 2 * _t_sf(np.abs(a), b), t, df.where(df > 0))


@F.pandas_udf(T.DoubleType())
def t_quantile(q: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(_t_ppf, q, df)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _masked(lambda a: np.minimum(1.0, 2 * _norm_sf(np.abs(a))), z)


@F.pandas_udf(T.DoubleType())
def sign_test(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided binomial p-value against one half."""

    def f(k, n):
        m = np.minimum(k, n - k)
        return np.where(2 * m == n, 1.0, np.minimum(1.0, 2 * _betainc(n - m, m + 1, np.full_like(n, 0.5))))

    return _masked(f, k, n)


@F.pandas_udf(T.DoubleType())
def power_two_sample(d: pd.Series, n: pd.Series) -> pd.Series:
    """Power of a two-sided two-sample t-test at 0.05 with n per group."""

    def f(d, n):
        df = 2 * n - 2
        shift, tc = np.abs(d) * np.sqrt(n / 2), _t_ppf(np.full_like(df, 0.975), df)
        return np.minimum(1.0, _shifted_t_sf(tc, df, shift) + 1 - _shifted_t_sf(-tc, df, shift))

    return _masked(f, d, n)


@F.pandas_udf(T.DoubleType())
def power_one_sample(d: pd.Series, n: pd.Series) -> pd.Series:
    """Power of a one-sided one-sample t-test at 0.05."""

    def f(d, n):
        df = n - 1
        return np.minimum(1.0, _shifted_t_sf(_t_ppf(np.full_like(df, 0.95), df), df, np.abs(d) * np.sqrt(n)))

    return _masked(f, d, n)
