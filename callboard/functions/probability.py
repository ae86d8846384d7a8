"""p-values of the t and chi-square tests.

They run on test results, one row per attribute, never on data rows.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"the incomplete beta function of {a}, {b}, {x} does not converge")


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            return front * value
    raise ArithmeticError(f"the incomplete gamma function of {a}, {x} does not converge")


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2.0, 0.5, df / (df + t * t))


def chi_square_p_value(x: float, df: float) -> float:
    return gamma_tail(df / 2.0, x / 2.0)


def p_value(test: str, statistic: float | None, df: float | None) -> float | None:
    """p-value of one result; NULL without a statistic, 1 where nothing is free to vary."""
    if pd.isna(statistic) or pd.isna(df):
        return None
    if df <= 0:
        return 1.0 if test == "chi_square" else None
    return {"t": t_p_value, "chi_square": chi_square_p_value}[test](statistic, df)


@F.pandas_udf(T.DoubleType())
def p_values(test: pd.Series, statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([p_value(*row) for row in zip(test, statistic, df)], dtype="float64")


# Workers get these functions by value, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
