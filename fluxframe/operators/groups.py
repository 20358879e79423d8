"""Group statistics put back on the rows, and exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.operators.axis import chunk_span, rejoin, running_total
from fluxframe.operators.ranks import KINDS, values_at_ranks


def scalars(df: DataFrame, stats: dict[str, Column]) -> Column:
    """Aggregates over a whole table as one struct: a scalar subquery, so no join is needed to use them."""
    return df.agg(F.struct(*[c.alias(n) for n, c in stats.items()])).scalar()


def with_scalars(df: DataFrame, source: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """Add aggregates over all of ``source`` to every row of ``df``."""
    return df.withColumn("__scalars", scalars(source, stats)).select(*df.columns, *[F.col(f"__scalars.{n}").alias(n) for n in stats])


def with_group_stats(df: DataFrame, by: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Add per-group aggregates as columns.

    An aggregate with map-side combine plus an equi-join: unlike an unordered
    window it never gathers a group in one task, and the group side is
    broadcast by Spark itself when it is small. Rows with a NULL key are a group too.
    """
    if not by:
        return with_scalars(df, df, stats)
    return rejoin(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), list(by))


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], span: float | str | None = "auto"
) -> DataFrame:
    """Values at 0-based ranks of the sorted non-NULL values of each group.

    Each rank is an expression of ``n``, the group's number of values. Large
    groups are narrowed to the stretches that hold the ranks (``ranks``). For
    types that doubles do not hold, and with a ``span``, all distinct values are counted and summed up in chunks of that
    width along the value axis instead, which gives the same values.
    """
    if span == "auto" and dict(df.dtypes)[value] in KINDS:
        return values_at_ranks(df, by, value, ranks)
    keys = list(by) or ["__one"]  # a constant group, not a join
    base = df.withColumn("__one", F.lit(1)) if not by else df
    counts = base.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("__k"))
    if span == "auto":
        span = chunk_span(counts, keys, value)
    seen = running_total(counts, keys, value, {"__seen": "__k"}, span=span)
    sizes = counts.groupBy(*keys).agg(F.sum("__k").alias("n"))
    ranked = rejoin(seen, sizes, keys) if by else with_scalars(seen, counts, {"n": F.sum("__k")})
    out = ranked.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("__seen") - F.col("__k") <= r) & (r < F.col("__seen")), F.col(value))).alias(name)
            for name, r in ranks.items()
        ],
        F.max("n").cast("bigint").alias("n"),
    )
    return out if by else out.drop("__one")


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float], span: float | str | None = "auto"
) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics.

    The values are those of the built-in ``percentile``, whose buffer would hold
    all distinct values of a group.
    """
    ranks = {}
    for name, q in qs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        ranks[f"__lo_{name}"], ranks[f"__hi_{name}"] = F.floor(at), F.ceil(at)
    found = order_statistics(df, by, value, ranks, span)
    out = []
    for name, q in qs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        lo, hi, part = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), at - F.floor(at)
        # As ``percentile`` does it: a rank, or a stretch between equal values, needs no arithmetic, which infinite values would not survive.
        out.append(F.when((part == 0) | (lo == hi), lo).otherwise((1 - part) * lo + part * hi).cast("double").alias(name))
    return found.select(*by, *out)
