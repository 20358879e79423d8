"""Small helpers for column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int


def col(value: ColumnLike) -> Column:
    """Names become columns, numbers DOUBLE literals, columns stay."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value))


def horner(coefficients: list[Column], t: Column) -> Column:
    """c0 + c1 t + c2 t^2 + ..."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out
