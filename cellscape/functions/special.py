"""Tail probabilities that Spark has no function for, as Arrow-batched expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny) if abs(1.0 - (a + b) * x / (a + 1.0)) > tiny else 1 / tiny
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    if x in (0.0, 1.0):
        return x
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-values of Student's t, in Arrow batches."""

    def of(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(a, b) for a, b in zip(x, n)])

    return F.pandas_udf(of, "double")(t, df)


def normal_p(z: Column | str) -> Column:
    """Two-sided p-values of a standard normal, in Arrow batches."""

    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))

    return F.pandas_udf(of, "double")(z)
