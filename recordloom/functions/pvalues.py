"""Upper-tail probabilities for one-row test results.

Spark has no incomplete gamma or beta function, so these two tails are small
vectorised helpers applied to the finished statistic, never to fact rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
#: Terms after which a sum counts as not converging; its result is then null.
_MOST_TERMS = 1_000_000
#: Shapes from which the uniform expansion is used; below, a million terms are more than enough.
_LARGE = 1e5


def _lentz(terms, start: float) -> float:
    """Continued fraction ``start + a1/(b1 + a2/(b2 + ...))`` by the modified Lentz rule; nan if it doesn't converge."""
    value = start or _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    return math.nan


def _gamma_tail_large(shape: float, x: float) -> float:
    """Upper gamma tail by Temme's uniform expansion (1979), whose error falls with the square of ``shape``."""
    mu = (x - shape) / shape
    if mu <= -1:
        return 1.0
    eta = math.copysign(math.sqrt(max(0.0, 2 * (mu - math.log1p(mu)))), mu)
    if abs(mu) < 1e-2:  # the two parts cancel near the middle; series of their difference
        half = mu * mu * (0.5 - mu / 3 + mu * mu / 4 - mu**3 / 5 + mu**4 / 6 - mu**5 / 7 + mu**6 / 8)
        eta = math.copysign(math.sqrt(2 * half), mu)
        first = -1 / 3 + eta / 12 - 2 * eta**2 / 135 + eta**3 / 864 + eta**4 / 2835
        second = -1 / 540 - eta / 288 + 25 * eta**2 / 12096
    else:
        first = 1 / mu - 1 / eta
        second = 1 / eta**3 - 1 / mu**3 - 1 / mu**2 - 1 / (12 * mu)
    small = math.exp(-shape * eta * eta / 2) / math.sqrt(2 * math.pi * shape)
    return 0.5 * math.erfc(eta * math.sqrt(shape / 2)) + small * (first + second / shape)


def gamma_tail(shape: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if shape > _LARGE:
        return _gamma_tail_large(shape, x)
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        for k in range(1, _MOST_TERMS):
            term *= x / (shape + k)
            total += term
            if term < total * 1e-16:
                return 1.0 - front * total
        return math.nan
    terms = ((1.0 if k == 0 else -k * (k - shape), x + 2 * k + 1 - shape) for k in range(_MOST_TERMS))
    return front * _lentz(terms, 0.0)


def _beta_front(a: float, b: float, x: float, rest: float) -> float:
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest))


def beta_part(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function; ``rest`` is ``1 - x`` where that is known more exactly."""
    rest = 1 - x if rest is None else rest
    if x <= 0 or rest <= 0:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_part(b, a, rest, x)

    def terms():
        yield 1.0, 1.0
        for m in range(_MOST_TERMS):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            k = m + 1
            yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    return _beta_front(a, b, x, rest) * _lentz(terms(), 0.0) / a


def f_upper(f: float, between: float, within: float) -> float:
    """Upper tail of the F distribution.

    With very many residual degrees of freedom the beta tail is a gamma tail of a
    shifted argument, up to the square of ``between / within``.
    """
    if f <= 0:
        return 1.0
    a, b, ratio = between / 2, within / 2, between * f / within
    if b > _LARGE and a < 1e-3 * b:
        return gamma_tail(a, (b + a / 2 - 0.5) * math.log1p(ratio))
    return beta_part(b, a, 1 / (1 + ratio), ratio / (1 + ratio))


@F.pandas_udf(DoubleType())
def _chi2_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(s) or pd.isna(d) or d <= 0 else gamma_tail(d / 2, s / 2) for s, d in zip(statistic, dof)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def _f_tail(statistic: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(f) or b <= 0 or w <= 0 else f_upper(f, b, w)
            for f, b, w in zip(statistic, between, within)
        ],
        dtype="float64",
    )


def chi2_tail(statistic: Column, dof: Column) -> Column:
    """Probability of a chi-square value at least this large."""
    return _chi2_tail(statistic.cast("double"), dof.cast("double"))


def f_tail(statistic: Column, between: Column, within: Column) -> Column:
    """Probability of an F value at least this large."""
    return _f_tail(statistic.cast("double"), between.cast("double"), within.cast("double"))


def verdict(p_value: Column, level: float = 0.05) -> Column:
    """Whether the result is significant at ``level``."""
    return p_value < F.lit(level)
