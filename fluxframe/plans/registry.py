"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the DOUBLE columns half away from zero in plain arithmetic, with one zero, as the SQL side does.

    The built-in ``round`` goes through decimals and costs more than most queries here.
    """
    unit = float(10**digits)
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            big = F.abs(c) * F.lit(unit)
            r = F.floor(big + F.lit(0.5)).cast("double") * F.signum(c) / F.lit(unit)
            c = F.when(big < 0.5, F.lit(0.0)).when(big < 2.0**52, r).otherwise(c)
        out.append(c.alias(name))
    return df.select(*out)
