"""Tail probabilities for a handful of result rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma, by series below a + 1 and continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_reg(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(0, 400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-square with df degrees of freedom > x)."""
    return pd.Series([None if pd.isna(v) else gamma_upper(k / 2, v / 2) for v, k in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def corr_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation, t with n - 2 degrees of freedom."""

    def p(rho: float, m: float) -> float | None:
        if pd.isna(rho) or m < 3:
            return None
        if abs(rho) >= 1:
            return 0.0
        t2 = rho * rho * (m - 2) / (1 - rho * rho)
        return beta_reg((m - 2) / 2, 0.5, (m - 2) / (m - 2 + t2))

    return pd.Series([p(a, b) for a, b in zip(r, n)], dtype="float64")
