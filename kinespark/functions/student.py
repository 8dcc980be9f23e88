"""Two-sided p-value of a correlation coefficient."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


TERMS = 200_000
# From here on the normal distribution is t's up to less than 1e-7, and log-gamma differences lose digits.
NORMAL_FREEDOM = 10_000_000


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return out
    raise ArithmeticError(f"no convergence after {TERMS} terms: a={a}, b={b}, x={x}")


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def p_value(r: float | None, n: int | None) -> float | None:
    """Student's t with n − 2 degrees of freedom, t² = r²(n − 2)/(1 − r²)."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if n - 2 > NORMAL_FREEDOM and abs(r) < 1:
        return math.erfc(abs(r) * math.sqrt((n - 2) / (2 * (1 - r * r))))
    return regularized_beta((n - 2) / 2, 0.5, max(0.0, 1.0 - r * r))


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """For a report with one row per feature."""
    return pd.Series([p_value(None if pd.isna(a) else a, None if pd.isna(b) else int(b)) for a, b in zip(r, n)])
