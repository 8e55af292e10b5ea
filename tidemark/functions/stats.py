"""Tail probabilities that SQL lacks, as vectorised functions over a few rows for each topic."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma, by series or continued fraction, without losing small tails."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * lead
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def _gamma_p(a: float, x: float) -> float:
    """Lower regularised incomplete gamma; the small side is summed directly."""
    if x <= 0:
        return 0.0
    if x >= a + 1:
        return 1.0 - _gamma_q(a, x)
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    term = total = 1.0 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * lead


def poisson_upper(k: float, lam: float) -> float:
    """P(X >= floor(k))."""
    k = math.floor(k)
    return 1.0 if k <= 0 else _gamma_p(k, lam)


def poisson_lower(k: float, lam: float) -> float:
    """P(X <= k)."""
    return _gamma_q(math.floor(k) + 1, lam)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + t * d)
            c = 1 + t / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def student_two_sided(t: float, df: float) -> float:
    return 0.0 if math.isinf(t) else _beta(df / 2, 0.5, df / (df + t * t))


def _vector(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return _vector(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def poisson_p(k: pd.Series, lam: pd.Series) -> pd.Series:
    """Upper tail from the mean on, lower tail below it."""
    return _vector(lambda a, m: poisson_upper(a, m) if a >= m else poisson_lower(a, m), k, lam)


@F.pandas_udf(DoubleType())
def poisson_upper_p(k: pd.Series, lam: pd.Series) -> pd.Series:
    return _vector(poisson_upper, k, lam)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(student_two_sided, t, df)


