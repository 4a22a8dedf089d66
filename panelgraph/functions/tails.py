"""Upper tails of the chi-square and Student t distributions, in numpy only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_regularised(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def _mapped(f):
    @F.pandas_udf("double")
    def apply(x: pd.Series, df: pd.Series) -> pd.Series:
        ok = x.notna() & df.notna() & (df > 0)
        out = np.full(len(x), np.nan)
        out[ok.to_numpy()] = [f(a, b) for a, b in zip(x[ok], df[ok], strict=True)]
        return pd.Series(out).astype(object).where(ok.reset_index(drop=True), None).astype("float64")

    return apply


def chi2_p(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-square variable; one Arrow batch at a time. Null where undefined."""
    p = _mapped(chi2_sf)(x, df.cast("double"))
    return F.when(x.isNotNull(), F.nanvl(p, F.lit(None)))


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic. Null where undefined."""
    p = _mapped(t_two_sided)(t, df.cast("double"))
    return F.when(t.isNotNull(), F.nanvl(p, F.lit(None)))
