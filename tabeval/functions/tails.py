"""Tail probabilities of the t, chi-square and normal distributions.

Spark SQL has no distribution functions.  Statistics and degrees of freedom are computed
in Spark; these tails are applied to the aggregated rows (one per variable).  They use the
continued fractions of the incomplete beta and gamma functions (DLMF 8.17.22 and 8.9.2),
evaluated from a fixed depth upwards, and the power series of the latter (DLMF 8.7.1).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TERMS = 100_000


def series(first: float, ratio) -> float:
    """first * (1 + r(0) + r(0) r(1) + ...), for positive ratios that end below one."""
    total, term = 0.0, first
    for n in range(TERMS):
        total += term
        term *= ratio(n)
        if term <= total * 1e-17:
            break
    return total


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b): x^a (1-x)^b / (a B(a,b)) over 1 + d1/(1 + d2/(1 + ...)),
    used on the side of the mean where the fraction converges fast."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    if x * (a + b + 2) > a + 1:
        return 1.0 - beta_lower(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b))
    k = 1.0
    for m in range(100 + 3 * int(math.sqrt(max(a, b))), -1, -1):   # d(2m+1) and d(2m+2), from the tail upwards
        even = (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        k = 1.0 + odd / (1.0 + even / k)
    return front / k


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 10.0:
        return 1.0 - series(math.exp(log_front) / a, lambda n: x / (a + 1 + n))
    k = 0.0   # x^a e^-x / Gamma(a) over x + (1-a)/(1 + 1/(x + (2-a)/(1 + 2/(x + ...))))
    for n in range(400, 0, -1):
        k = (n - a) / (1.0 + n / (x + k))
    return math.exp(log_front) / (x + k)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if t is None or df is None or not math.isfinite(t) or not (df > 0):
        return float("nan")
    return beta_lower(df / 2.0, 0.5, df / (df + t * t))


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or not (dof > 0) or not math.isfinite(x):
        return float("nan")
    return gamma_upper(dof / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    """P(|Z| > |z|) = erfc(|z|/sqrt 2); keeps small p-values that 1 - cdf loses."""
    if z is None or not math.isfinite(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float))], dtype=np.float64)


@F.pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x.astype(float), dof.astype(float))], dtype=np.float64)
