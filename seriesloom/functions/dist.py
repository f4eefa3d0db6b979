"""Tail probabilities of the usual test statistics, as Arrow functions over (small) result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return h * scale


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1 - x) / b


def chi2_sf(x: float, k: float) -> float:
    return gamma_q(k / 2.0, x / 2.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def kolmogorov_sf(x: float) -> float:
    """Limit distribution of the scaled two-sample distance."""
    if x < 1e-6:
        return 1.0
    if x < 1.18:  # the theta-function form converges fast for small x
        w = math.sqrt(2 * math.pi) / x
        return 1.0 - w * sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


_TAILS = {
    "normal2": lambda z: 2.0 * normal_sf(abs(z)),
    "chi2": chi2_sf,
    "f": f_sf,
    "t2": t_two_sided,
    "kolmogorov": kolmogorov_sf,
}


def p_value(kind: str, *args: Column) -> Column:
    """Tail probability; NULL when an argument is NULL."""
    tail = _TAILS[kind]

    @F.pandas_udf("double")
    def compute(values: pd.DataFrame) -> pd.Series:
        rows = values.astype(float).to_numpy()
        return pd.Series([None if np.isnan(r).any() else tail(*r) for r in rows], dtype="float64")

    return compute(F.struct(*[a.cast("double").alias(f"a{i}") for i, a in enumerate(args)]))
