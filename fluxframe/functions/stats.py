"""Statistical expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fluxframe.functions import constants as k
from fluxframe.functions.expr import ColumnLike, col, total


def propagate(
    derivatives: Sequence[ColumnLike], sigmas: Sequence[ColumnLike], corr: Sequence[Sequence[float]] | None = None
) -> Column:
    """Linear error propagation sqrt(s R s^T), s = derivative * |sigma|."""
    s = [col(d) * F.abs(col(e)) for d, e in zip(derivatives, sigmas)]
    if corr is None:
        return F.sqrt(total([v * v for v in s]))
    return F.sqrt(total([F.lit(float(corr[i][j])) * s[i] * s[j] for i in range(len(s)) for j in range(len(s))]))


def loglik_to_chi2(log_l: ColumnLike) -> Column:
    return F.lit(-2.0) * col(log_l)


def clean_loglik(log_l: ColumnLike) -> Column:
    """NULL, NaN or too low scores become the worst score; a magnitude below 1e-99 becomes 1e-99."""
    x = col(log_l)
    return (
        F.when(x.isNull() | F.isnan(x) | (x < k.WORST_LOG_L), F.lit(k.WORST_LOG_L))
        .when(F.abs(x) < k.TINY_LOG_L, F.lit(k.TINY_LOG_L))
        .otherwise(x)
    )


def rounding_digits(sigma: ColumnLike) -> Column:
    """Decimals worth printing for a value with this uncertainty."""
    return F.greatest(F.lit(0).cast("bigint"), -F.floor(F.log10(col(sigma))) + 1)


# Above this Bayes factor (about exp(25)) the significance follows a square root.
BAYES_SQRT_ABOVE = 72004899337.0


def _lambert_w_lower(a: float) -> float:
    """w <= -1 with w exp(w) = a for -1/e <= a < 0 (Newton on w + log(-w) = log(-a))."""
    target = math.log(-a)
    if target >= -1.0:
        return -1.0
    u = -target  # solve v - log v = u for v = -w >= 1
    v = u + math.log(u) if u > 2 else 1.0 + math.sqrt(2 * (u - 1))
    for _ in range(60):
        step = (v - math.log(v) - u) / (1 - 1 / v) if v > 1 else 0.0
        v = max(v - step, 1.0 + 1e-16)
        if abs(step) <= 1e-15 * v:
            break
    return -v


def _sigma_of(bayes: float) -> float:
    from statistics import NormalDist

    if not bayes >= 1.0:
        return float("nan")
    if bayes > BAYES_SQRT_ABOVE:
        offset = _sigma_of(BAYES_SQRT_ABOVE) - math.sqrt(2 * math.log(BAYES_SQRT_ABOVE))
        return math.sqrt(2 * math.log(bayes)) + offset
    rho = math.exp(_lambert_w_lower(-1 / (math.e * bayes)))
    return NormalDist().inv_cdf(1 - rho / 2) if rho < 1 else 0.0


@F.pandas_udf(DoubleType())
def bayes_factor_to_sigma(bayes: pd.Series) -> pd.Series:
    """Significance in sigma of a Bayes factor; undefined (NaN) below 1."""
    return bayes.map(_sigma_of, na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def sigma_to_bayes_factor(sigma: pd.Series) -> pd.Series:
    def one(s: float) -> float:
        rho = math.erfc(s / math.sqrt(2))
        if rho == 0.0:  # beyond the smallest probability
            return math.inf
        return -1 / (math.e * rho * math.log(rho))

    return sigma.map(one, na_action="ignore").astype("float64")
