"""Tail probabilities for the small tables of test statistics.

These run on one row per column pair, never on table rows.
"""

from __future__ import annotations

import math
import sys
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXACT_ROWS = 33  # rows up to which Kendall's tau without ties has its exact distribution
NORMAL_FROM = 1_000_000  # degrees of freedom beyond which Student's t is taken as normal


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by the continued fraction of the incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularized_beta(1.0 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b)
                     - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 20_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    total = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation coefficient by Student's t with n - 2 degrees."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    r = max(-1.0, min(1.0, r))
    left = 1.0 - r * r
    if left <= 0.0:
        return 0.0
    if n - 2 > NORMAL_FROM:
        return math.erfc(abs(r) * math.sqrt((n - 2) / left) / math.sqrt(2.0))
    return min(1.0, regularized_beta(left, (n - 2) / 2.0, 0.5))


@lru_cache(maxsize=64)
def orders_by_discordance(n: int) -> tuple[int, ...]:
    """How many orders of n things have at most 0, 1, 2 ... discordant pairs."""
    ways = [1]
    for size in range(2, n + 1):
        # the thing put in last stands behind 0 to size - 1 of those it should precede
        longer = [0] * (len(ways) + size - 1)
        for shift in range(size):
            for k, w in enumerate(ways):
                longer[k + shift] += w
        ways = longer
    return tuple(accumulate(ways))


def kendall_p(discordant: int, n: int) -> float | None:
    """Two-sided p-value of Kendall's tau without ties, by counting the orders that are as far from chance."""
    if n < 2:
        return None
    total = n * (n - 1) // 2
    fewest = min(discordant, total - discordant)
    if 2 * fewest == total:
        return 1.0
    # one order has no discordant pair, n - 1 have one
    orders = (1, n)[fewest] if fewest < 2 else orders_by_discordance(n)[fewest]
    return min(1.0, float(Fraction(2 * orders, math.factorial(n)))) if n <= 1000 else 0.0


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution."""
    return 1.0 if dof <= 0 else min(1.0, upper_gamma(dof / 2.0, statistic / 2.0))


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(v) / math.sqrt(2.0)) for v in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def kendall_p_value(discordant: pd.Series, n: pd.Series) -> pd.Series:
    """None where the number of discordant pairs is not given."""
    return pd.Series([None if pd.isna(d) else kendall_p(int(d), int(m)) for d, m in zip(discordant, n)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_p(a, b) for a, b in zip(statistic, dof)], dtype="float64")
