"""Tail probabilities of test statistics, for result rows (one per feature or test), from numerical integrals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Nodes and weights of Gauss-Legendre quadrature on (-1, 1).
NODES, WEIGHTS = np.polynomial.legendre.leggauss(400)


def _integral(log_density, low: float, high: float) -> float:
    x = (high - low) / 2 * NODES + (high + low) / 2
    return float((high - low) / 2 * (WEIGHTS * np.exp(log_density(x))).sum())


def t_tail(t: float, free: float) -> float:
    """Two-sided p of Student's t. With t = sqrt(free) tan(a) the density is a power of cos(a), so the range is finite."""
    scale = math.lgamma((free + 1) / 2) - math.lgamma(free / 2) - math.log(math.pi) / 2
    start = math.atan(abs(t) / math.sqrt(free))
    # Beyond 40 deviations of that power nothing is left to add.
    end = min(math.pi / 2, start + 40 / math.sqrt(free))
    return min(1.0, 2 * _integral(lambda a: scale + (free - 1) * np.log(np.cos(a)), start, end))


def f_tail(f: float, over: int, under: int) -> float:
    """P(F > f). With F = under / over * tan(a)^2 the density is a product of powers of sin(a) and cos(a)."""
    scale = math.log(2) + math.lgamma((over + under) / 2) - math.lgamma(over / 2) - math.lgamma(under / 2)
    start = math.atan(math.sqrt(max(f, 0.0) * over / under))
    # As many deviations past the density's peak or the start, whichever is later.
    end = min(math.pi / 2, max(start, math.atan(math.sqrt(over / under))) + 40 / math.sqrt(over + under))
    return min(1.0, _integral(lambda a: scale + (over - 1) * np.log(np.sin(a)) + (under - 1) * np.log(np.cos(a)), start, end))


def chi_tail(x: float, free: int) -> float:
    """P(chi-squared > x), over the root of the variable, whose deviation is under 1."""
    scale = (1 - free / 2) * math.log(2) - math.lgamma(free / 2)
    start = math.sqrt(max(x, 0.0))
    return min(1.0, _integral(lambda r: scale + (free - 1) * np.log(r) - r * r / 2, start, max(start, math.sqrt(free)) + 40))


def t_quantile(level: float, free: float) -> float:
    """The t that holds `level` between -t and t, by bisection."""
    low, high = 0.0, 1.0
    while t_tail(high, free) > 1 - level:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, free) > 1 - level else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n pairs (t with n - 2 degrees); 0 at |r| = 1, null under three pairs."""
    def one(r: float, n: float) -> float | None:
        if np.isnan(r) or np.isnan(n) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(*x) for x in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi_p(x: pd.Series, free: pd.Series) -> pd.Series:
    """P(chi-squared > x); null for nulls and no degree of freedom."""
    return pd.Series([None if np.isnan(a) or np.isnan(k) or k < 1 else chi_tail(a, int(k)) for a, k in zip(x, free)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal statistic."""
    return pd.Series([None if np.isnan(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z], dtype="float64")
