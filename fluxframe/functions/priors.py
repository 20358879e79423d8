"""Prior transforms of unit-cube draws and range checks."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fluxframe.functions.expr import ColumnLike, col, horner

# The published rational approximation of the normal quantile (AS 241, PPND16).
CENTRE_TOP = (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
              45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727)
CENTRE_BOTTOM = (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
                 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)
MIDDLE_TOP = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
              1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4)
MIDDLE_BOTTOM = (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
                 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
TAIL_TOP = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
            0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
TAIL_BOTTOM = (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
               7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def _ratio(top: tuple, bottom: tuple, t: Column) -> Column:
    return horner([F.lit(v) for v in top], t) / horner([F.lit(v) for v in bottom], t)


def normal_quantile(p: ColumnLike) -> Column:
    """Standard normal quantile inside whole-stage code; NULL outside (0, 1)."""
    u = col(p)
    q = u - 0.5
    inner = q * _ratio(CENTRE_TOP, CENTRE_BOTTOM, F.lit(0.180625) - q * q)
    r = F.sqrt(-F.log(F.least(u, 1 - u)))
    outer = F.when(r <= 5, _ratio(MIDDLE_TOP, MIDDLE_BOTTOM, r - 1.6)).otherwise(_ratio(TAIL_TOP, TAIL_BOTTOM, r - 5.0))
    return F.when((u > 0) & (u < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * outer))


@F.pandas_udf(DoubleType())
def gamma_function(a: pd.Series) -> pd.Series:
    return a.map(math.gamma, na_action="ignore").astype("float64")


CustomPrior = Callable[[Column, Column, Column], Column]


def prior_value(kind: ColumnLike, u: ColumnLike, a: ColumnLike, b: ColumnLike, gamma_a: ColumnLike,
                custom: dict[str, CustomPrior] | None = None) -> Column:
    """Value of a draw ``u``; ``custom`` maps further kinds to functions of (u, a, b)."""
    t, x, p, q = F.col(kind) if isinstance(kind, str) else kind, col(u), col(a), col(b)
    z = normal_quantile(x)
    out = (
        F.when(t == "uniform", p + x * (q - p))
        .when(t == "log", F.pow(F.lit(10.0), p + x * (q - p)))
        .when(t == "gaussian", p + q * z)
        .when(t == "log_gaussian", p * F.exp(q * q - q * z))
        .when(t == "delta", p)
        .when(t == "inverse_gamma", F.pow(q, p) / col(gamma_a) * F.pow(1 / x, p + 1) * F.exp(-q / x))
    )
    for name, fn in (custom or {}).items():
        out = out.when(t == name, fn(x, p, q))
    return out


def upper_bound_flag(x: ColumnLike, high: ColumnLike) -> Column:
    """0 up to the bound, minus infinity beyond."""
    return F.when(col(x) > col(high), F.lit(float("-inf"))).otherwise(F.lit(0.0))


def range_flag(x: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    v = col(x)
    return F.when((v < col(low)) | (v > col(high)), F.lit(float("-inf"))).otherwise(F.lit(0.0))


