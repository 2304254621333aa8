"""Tails of the normal, t and F distributions, vectorised, without SciPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    c, d, tiny = np.ones_like(z), 1 - (p + q) * z / (p + 1), 1e-300
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        step = 1.0
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
            break
    out = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def t_two_sided(t, dof) -> np.ndarray:
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return betainc(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f = np.maximum(np.asarray(f, float), 0)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * f))


def normal_two_sided(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


def normal_quantile(p) -> np.ndarray:
    """z with upper tail p, by bisection and Newton steps on erfc."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    tail = np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])
    for _ in range(80):
        mid = (lo + hi) / 2
        over = tail(mid) > p
        lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
    return (lo + hi) / 2


def _udf(f):
    """A Column function from an array function; UDFs are made when used, as they need a session."""

    def column(*cols):
        return F.pandas_udf(f, "double")(*cols)

    column.__doc__ = f.__doc__
    return column


def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p of a t value."""
    return pd.Series(t_two_sided(t, dof))


def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p of an F value."""
    return pd.Series(f_upper(f, d1, d2))


def _t_z(t: pd.Series, dof: pd.Series) -> pd.Series:
    """The z value with the same tails."""
    return pd.Series(np.sign(t) * normal_quantile(t_two_sided(t, dof) / 2))


t_to_p, f_to_p, t_to_z = _udf(_t_p), _udf(_f_p), _udf(_t_z)
