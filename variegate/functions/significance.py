"""Quantiles and p-values for the report functions."""

from __future__ import annotations

from math import lgamma
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_quantile(confidence: float) -> float:
    """z of a two-sided interval."""
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


# Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]

# Most terms of the continued fraction; it settles within a few times the root of the larger
# argument.
MOST_TERMS = 1_000_000


def log_gamma_ratio(a: float, b: float) -> float:
    """``ln(gamma(a + b) / gamma(a))``, without losing digits where ``a`` is large."""
    if a < 1e4:
        return lgamma(a + b) - lgamma(a)
    def rest(x):
        return sum(c / x ** (2 * i + 1) for i, c in enumerate(STIRLING))
    return float((a - 0.5) * np.log1p(b / a) + b * np.log(a + b) - b + rest(a + b) - rest(a))


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    large, small = max(a, b), min(a, b)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma_ratio(large, small)
                   - lgamma(small)) / a
    fraction, c, d = 1.0, 1.0, 0.0
    for i in range(1, MOST_TERMS):
        m = i // 2
        if i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / (1.0 + term * d)
        c = 1.0 + term / c
        fraction *= c * d
        if abs(1.0 - c * d) < 1e-15:
            return float(front / fraction)
    raise ArithmeticError(f"no tail found for a = {a}, b = {b}, x = {x}")


@F.pandas_udf(T.DoubleType())
def _two_sided(rho: pd.Series, df: pd.Series) -> pd.Series:
    def one(r, n):
        if pd.isna(r) or pd.isna(n) or n < 1:
            return None
        return beta_tail(n / 2.0, 0.5, max(0.0, 1.0 - r * r))
    return pd.Series([one(r, n) for r, n in zip(rho, df)], dtype="float64")


def correlation_p(rho: Column, degrees_of_freedom: Column) -> Column:
    """Two-sided p of a correlation under the t distribution; few rows only."""
    return _two_sided(rho.cast("double"), degrees_of_freedom.cast("double"))
