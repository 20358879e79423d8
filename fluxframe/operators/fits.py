"""Weighted polynomial fits per group from power sums.

The sums combine map-side, so a group of any size costs one small row per
partition. The axis is moved to [-1, 1] per group first, which keeps the normal
equations well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fluxframe.functions.expr import horner
from fluxframe.operators.groups import with_group_stats


def _solve(s: list[Column], t: list[Column], degree: int) -> list[Column]:
    """Coefficients from power sums s[m] = sum w^2 x^m and t[m] = sum w^2 y x^m; NULL if singular."""
    if degree == 0:
        return [F.when(s[0] != 0, t[0] / s[0])]
    if degree == 1:
        det = s[0] * s[2] - s[1] * s[1]
        raw = [t[0] * s[2] - t[1] * s[1], s[0] * t[1] - s[1] * t[0]]
        return [F.when(det > 1e-12 * s[0] * s[0], r / det) for r in raw]
    if degree == 2:
        m00, m01, m02 = s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2]
        m11, m12, m22 = s[0] * s[4] - s[2] * s[2], s[0] * s[3] - s[1] * s[2], s[0] * s[2] - s[1] * s[1]
        det = s[0] * m00 - s[1] * m01 + s[2] * m02
        raw = [
            t[0] * m00 - t[1] * m01 + t[2] * m02,
            -t[0] * m01 + t[1] * m11 - t[2] * m12,
            t[0] * m02 - t[1] * m12 + t[2] * m22,
        ]
        return [F.when(det > 1e-15 * F.pow(s[0], 3), r / det) for r in raw]
    solved = _solve_many(F.array(*s), F.array(*t))
    return [F.element_at(solved, i + 1) for i in range(degree + 1)]


@F.pandas_udf(ArrayType(DoubleType()))
def _solve_many(sums: pd.Series, rights: pd.Series) -> pd.Series:
    """Small normal equations, one per group."""
    out = []
    for s, t in zip(sums, rights):
        n = len(t)
        matrix = np.array([[s[i + j] for j in range(n)] for i in range(n)], dtype=float)
        try:
            out.append(np.linalg.solve(matrix, np.asarray(t, dtype=float)).tolist())
        except (np.linalg.LinAlgError, TypeError, ValueError):
            out.append([None] * n)
    return pd.Series(out)


def with_poly_fit(
    df: DataFrame, by: Sequence[str], x: str, y: Column, weight: Column, degree: int, out: str = "__fit",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Add the fitted value of each row, the number of weighted points ``__used`` and the unit axis ``__u``.

    ``extra`` aggregates ride along with the power sums. ``weight`` multiplies the residual; NULL y or NULL or zero weight leaves a point out.
    """
    ends = with_group_stats(df, by, {"__x0": F.min(x), "__x1": F.max(x)})
    half = (F.col("__x1") - F.col("__x0")) / 2
    unit = F.when(half > 0, (F.col(x) - (F.col("__x0") + F.col("__x1")) / 2) / half).otherwise(F.lit(0.0))
    use = y.isNotNull() & weight.isNotNull() & (weight != 0)
    base = ends.withColumns({
        "__u": unit, "__w2": F.when(use, weight * weight).otherwise(F.lit(0.0)), "__y": F.when(use, y).otherwise(F.lit(0.0)),
    }).drop("__x0", "__x1")
    u, w2, value = F.col("__u"), F.col("__w2"), F.col("__y")
    powers = [F.lit(1.0)]
    for _ in range(2 * degree):
        powers.append(powers[-1] * u)
    sums = {f"__s{m}": F.sum(w2 * p) for m, p in enumerate(powers)}
    sums |= {f"__t{m}": F.sum(w2 * value * powers[m]) for m in range(degree + 1)}
    sums["__used"] = F.count_if(w2 > 0)
    sums |= extra or {}
    totals = base.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    coefficients = _solve([F.col(f"__s{m}") for m in range(2 * degree + 1)], [F.col(f"__t{m}") for m in range(degree + 1)], degree)
    names = [f"__c{m}" for m in range(degree + 1)]
    small = totals.select(*by, "__used", *(extra or {}), *[c.alias(n) for n, c in zip(names, coefficients)])
    got = base.join(small, list(by)).drop("__w2", "__y")
    return got.withColumn(out, horner([F.col(n) for n in names], F.col("__u")))


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Intercept and slope of the straight line through each group."""
    return df.groupBy(*by).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))
