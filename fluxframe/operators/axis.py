"""Ordered work along an axis, safe for groups of any size.

A window partitioned by a group key sorts the whole group in one task. That is
the right plan while every group is small, and the wrong one as soon as one
series holds a third of the table. ``chunk_span`` measures the groups with one
partial aggregate: if all are small it returns ``None`` and the operators below
use the plain window; otherwise it returns an axis width, the operators cut each
group into chunks of that width, work inside chunks, and exchange only the rows
(or totals) at the chunk borders. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 1_000_000
CHUNK = "__chunk"
#: Halvings of a chunk's width at most; beyond them values differ by rounding only.
NARROWINGS = 64


def axis_stats(df: DataFrame, by: Sequence[str], x: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[float | None, float | None]:
    """(chunk width or None, mean step along the axis) from partial aggregates.

    One pass while all groups are small. Otherwise the width is narrowed until
    no chunk is much fuller than asked, so a clump on the axis is cut as well.
    """
    at = F.col(x).cast("double")
    at = F.when(~F.isnan(at) & (F.abs(at) < float("inf")), at)  # infinite and NaN values lie in chunks of their own
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("extent"))
    big = F.col("n") > rows_per_chunk
    row = sizes.agg(
        F.min(F.when(big & (F.col("extent") > 0), F.col("extent") / F.ceil(F.col("n") / F.lit(float(rows_per_chunk))))).alias("span"),
        (F.sum("extent") / F.sum(F.greatest(F.col("n") - 1, F.lit(1)))).alias("step"),
    ).first()
    span = row["span"]
    for _ in range(NARROWINGS):
        if span is None:
            break
        chunks = df.filter(at.isNotNull()).groupBy(*by, F.floor(at / F.lit(float(span))).alias(CHUNK)).agg(
            F.count(F.lit(1)).alias("n"), (F.max(at) - F.min(at)).alias("extent"))
        # Equal values cannot be cut, so only chunks with an extent count.
        full = chunks.filter("extent > 0").agg(F.max(F.struct("n", "extent")).alias("c")).first()["c"]
        if full is None or full["n"] <= 2 * rows_per_chunk:
            break
        span = min(span / 2, full["extent"] / (full["n"] / rows_per_chunk))
    return span, row["step"]


def chunk_span(df: DataFrame, by: Sequence[str], x: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> float | None:
    """Axis width of one chunk, or None if no group exceeds ``rows_per_chunk``."""
    return axis_stats(df, by, x, rows_per_chunk)[0]


def resolve_span(df: DataFrame, by: Sequence[str], x: str, span: float | str | None) -> float | None:
    """``"auto"`` measures the groups; None or a width is taken as given."""
    return chunk_span(df, by, x) if span == "auto" else span


def with_chunk(df: DataFrame, x: str, span: float) -> DataFrame:
    """Number of the chunk: below all others for -inf, above them for +inf and NaN, NULL for NULL, as values sort."""
    at = F.col(x).cast("double")
    return df.withColumn(CHUNK, F.when(F.isnan(at), F.lit((1 << 63) - 1)).otherwise(F.floor(at / F.lit(float(span)))))


def rejoin(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on ``keys`` in which NULL keys meet as well; the keys of ``other`` do not show."""
    renamed = other.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(renamed, same).drop(*[f"__k_{k}" for k in keys])


def _shift(column: str, offset: int) -> Column:
    return F.lead(column, offset) if offset > 0 else F.lag(column, -offset)


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    wanted: dict[str, tuple[str, int]],
    ties: Sequence[str] = (),
    span: float | str | None = "auto",
) -> DataFrame:
    """Add columns of the row ``offset`` places ahead (> 0) or behind (< 0) along ``x``.

    ``x`` must not be NULL and (x, *ties) must be unique in a group.
    """
    span = resolve_span(df, by, x, span)
    order = [x, *ties]
    if span is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.select("*", *[_shift(c, o).over(w).alias(name) for name, (c, o) in wanted.items()])

    depth = max(abs(o) for _, o in wanted.values())
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order)
    across = Window.partitionBy(*by).orderBy(*order)
    found = {o: f"__found_{'p' if o > 0 else 'm'}{abs(o)}" for _, o in wanted.values()}
    looked = with_chunk(df, x, span).select(
        "*",
        *[_shift(c, o).over(inside).alias(name) for name, (c, o) in wanted.items()],
        *[_shift(x, o).over(inside).isNotNull().alias(flag) for o, flag in found.items()],
        (F.lag(x, depth).over(inside).isNull() | F.lead(x, depth).over(inside).isNull()).alias("__edge"),
    )
    edge = looked.filter("__edge")
    edge = edge.select(
        *df.columns,
        *[
            F.when(F.col(found[o]), F.col(name)).otherwise(_shift(c, o).over(across)).alias(name)
            for name, (c, o) in wanted.items()
        ],
    )
    inner = looked.filter("NOT __edge").select(*df.columns, *wanted)
    return inner.unionByName(edge)


def running_total(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    sums: dict[str, str],
    ties: Sequence[str] = (),
    descending: bool = False,
    span: float | str | None = "auto",
) -> DataFrame:
    """Running sums along ``x`` up to and including the row (NULL adds nothing)."""
    span = resolve_span(df, by, x, span)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in [x, *ties]]

    def running(w):
        frame = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {name: F.coalesce(F.sum(c).over(frame), F.lit(0.0)) for name, c in sums.items()}

    if span is None:
        return df.select("*", *[c.alias(name) for name, c in running(Window.partitionBy(*by)).items()])

    cut = with_chunk(df, x, span)
    local = cut.select("*", *[c.alias(name) for name, c in running(Window.partitionBy(*by, CHUNK)).items()])
    totals = cut.groupBy(*by, CHUNK).agg(*[F.sum(c).alias(f"__t_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*by).orderBy(F.col(CHUNK).desc() if descending else F.col(CHUNK).asc())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *by, CHUNK, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0.0)).alias(f"__c_{n}") for n in sums]
    )
    joined = rejoin(local, carry, [*by, CHUNK])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__c_{n}")).alias(n) for n in sums])


def nearest_known(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    wanted: dict[str, str],
    after: bool = False,
    ties: Sequence[str] = (),
    span: float | str | None = "auto",
) -> DataFrame:
    """Last non-NULL value at or before the row along ``x`` (first at or behind it with ``after``)."""
    span = resolve_span(df, by, x, span)

    def seen(w, columns: Sequence[str], near: int):
        # Both directions look back along their own order: a frame that reaches
        # forward to the end would be recomputed for every row.
        order = [F.col(c).desc() if after else F.col(c).asc() for c in columns]
        return w.orderBy(*order).rowsBetween(Window.unboundedPreceding, near)

    def known(column: str, w):
        return F.last(column, ignorenulls=True).over(w)

    if span is None:
        w = seen(Window.partitionBy(*by), [x, *ties], 0)
        return df.select("*", *[known(c, w).alias(n) for n, c in wanted.items()])

    cut = with_chunk(df, x, span)
    inside = seen(Window.partitionBy(*by, CHUNK), [x, *ties], 0)
    local = cut.select("*", *[known(c, inside).alias(n) for n, c in wanted.items()])
    rank = F.struct(x, *ties)
    best = F.min_by if after else F.max_by
    ends = cut.groupBy(*by, CHUNK).agg(
        *[best(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"__e_{n}") for n, c in wanted.items()]
    )
    beyond = seen(Window.partitionBy(*by), [CHUNK], -1)
    carry = ends.select(*by, CHUNK, *[known(f"__e_{n}", beyond).alias(f"__c_{n}") for n in wanted])
    joined = rejoin(local, carry, [*by, CHUNK])
    return joined.select(*df.columns, *[F.coalesce(n, f"__c_{n}").alias(n) for n in wanted])
