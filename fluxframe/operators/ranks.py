"""Values at given ranks of each group, without a full sort.

A group of few values is sorted as one array. A larger one is narrowed round by
round: an approximate summary proposes splits, an exact count says between which
two splits each rank lies, and only that stretch goes on, until it is short
enough for an array. All steps are partial aggregates of bounded size, so a
group may hold any share of the table, and the result does not depend on how
good the proposed splits were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.operators.axis import rejoin
from fluxframe.session import staged

#: Values that are sorted as one array; longer stretches are split.
ARRAY_VALUES = 100_000
#: Types of values.
KINDS = ("double", "float", "int", "smallint", "tinyint")
#: Parts that a round cuts a stretch into.
PARTS = 64

_INSIDE = "get(filter(__b, b -> (b.__lo IS NULL OR __v > b.__lo) AND (b.__hi IS NULL OR __v < b.__hi)), 0)"


def _inside(rows: DataFrame, stretches: DataFrame, keys: list[str], extra: Sequence[str] = ()) -> DataFrame:
    """(keys, __below, extra, __v): the values that lie in a stretch; stretches of a group do not overlap, and how many values lie below one names it."""
    lists = stretches.groupBy(*keys).agg(F.collect_list(F.struct("__lo", "__hi", "__below", *extra)).alias("__b"))  # one per rank at most
    met = rejoin(rows, lists, keys).select(*keys, "__v", F.expr(_INSIDE).alias("__s")).filter("__s IS NOT NULL")
    return met.select(*keys, "__v", *[F.col(f"__s.{c}").alias(c) for c in ("__below", *extra)])


def _narrowed(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets after one round: found, or in a shorter stretch."""
    stretches = targets.select(*keys, "__below", "__lo", "__hi").distinct()
    at = [(i + 1) / PARTS for i in range(PARTS - 1)]
    splits = _inside(rows, stretches, keys).groupBy(*keys, "__below").agg(
        F.array_sort(F.array_distinct(F.percentile_approx("__v", at, 16 * PARTS))).alias("__splits"))
    cut = staged(rejoin(stretches, splits, [*keys, "__below"]))
    # Odd places are the splits themselves, even ones the open stretches between them.
    place = F.expr("2 * size(filter(__splits, s -> s <= __v)) - CAST(array_contains(__splits, __v) AS int)")
    counts = _inside(rows, cut, keys, ["__splits"]).groupBy(*keys, "__below", place.alias("__place")).agg(F.count(F.lit(1)).alias("__k"))
    runs = counts.groupBy(*keys, "__below").agg(F.array_sort(F.collect_list(F.struct("__place", "__k"))).alias("__runs"))  # 2 PARTS at most
    runs = runs.withColumn("__upto", F.expr("transform(__runs, (x, i) -> aggregate(slice(__runs, 1, i + 1), 0L, (a, y) -> a + y.__k))"))
    both = rejoin(rejoin(targets.drop("__lo", "__hi", "__k", "__found"), cut, [*keys, "__below"]), runs, [*keys, "__below"])
    hit = both.withColumn("__i", F.expr("size(filter(__upto, u -> u <= __r - __below)) + 1"))
    hit = hit.withColumn("__place", F.expr("element_at(__runs, __i).__place")).withColumn("__k", F.expr("element_at(__runs, __i).__k"))
    half = F.expr("CAST(floor(__place / 2) AS int)")
    return hit.select(
        *keys, "__name", "__r", (F.col("__below") + F.expr("element_at(__upto, __i)") - F.col("__k")).alias("__below"),
        F.when(half > 0, F.get("__splits", half - 1)).otherwise(F.col("__lo")).alias("__lo"), F.when(half < F.size("__splits"), F.get("__splits", half)).otherwise(F.col("__hi")).alias("__hi"),
        "__k", F.when(F.col("__place") % 2 == 1, F.get("__splits", half)).alias("__found"),
    )


def values_at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column], array_values: int = ARRAY_VALUES) -> DataFrame:
    """(by, one column per rank, n): values at 0-based ranks of each group's sorted non-NULL numbers.

    Each rank is an expression of ``n``, the group's number of values; fractions
    are cut off, ranks outside the group give NULL. NaN sorts above all, -0.0 and
    0.0 are the same, ties take one rank each. Rows with NULL keys are a group,
    a group without values has n = 0 and NULL at every rank, an empty table gives
    no row. Other columns of ``df`` are not read. ``value`` is of a type whose
    values doubles hold (``KINDS``): the summary works on doubles, and splits that
    are no values of the group would not shorten a stretch.
    """
    keys = list(by) or ["__one"]  # a constant group, not a join
    v, kind = F.col(value), dict(df.dtypes)[value]
    if kind not in KINDS:
        raise TypeError(f"{value} is {kind}, not one of {', '.join(KINDS)}")
    if kind in ("double", "float"):
        v = v + F.lit(0.0).cast(kind)  # -0.0 becomes 0.0
    nan = F.isnan("__v") if kind in ("double", "float") else F.lit(False)
    rows = df.select(*by, v.alias("__v")) if by else df.select(F.lit(1).alias("__one"), v.alias("__v"))
    names = list(ranks)
    whole = {c: F.floor(r.cast("double")).cast("bigint") for c, r in ranks.items()}
    sizes = rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.count(F.when(~nan, F.lit(1)) if kind in ("double", "float") else F.col("__v")).alias("__known"))
    largest = sizes.agg(F.max("n")).first()[0] or 0

    def small(some: DataFrame) -> DataFrame:
        arrays = some.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("__a")).withColumn("n", F.size("__a").cast("bigint"))
        at = {c: F.when((r >= 0) & (r < F.col("n")), F.get("__a", r.cast("int"))) for c, r in whole.items()}
        return arrays.select(*keys, *[x.alias(c) for c, x in at.items()], "n")

    if largest <= array_values:
        out = small(rows)
    else:
        sizes, rows = staged(sizes), staged(rows)  # every round reads the rows, however they were made
        big = sizes.filter(F.col("n") > array_values)
        options = F.explode(F.array(*[F.struct(F.lit(c).alias("__name"), r.alias("r")) for c, r in whole.items()]))
        wanted = big.select(*keys, "n", "__known", options.alias("__o")).select(*keys, "n", "__known", "__o.__name", F.col("__o.r").alias("__r"))
        known = rejoin(rows, big.select(*keys), keys).filter("__v IS NOT NULL").filter(~nan)
        inside = (F.col("__r") >= 0) & (F.col("__r") < F.col("__known"))
        none = F.lit(None).cast(kind)
        targets = staged(wanted.filter(inside).select(*keys, "__name", "__r", F.lit(0).cast("bigint").alias("__below"), none.alias("__lo"), none.alias("__hi"),
                                                      F.col("__known").alias("__k"), none.alias("__found")))
        done = []
        while True:
            done.append(targets.filter((F.col("__found").isNotNull()) | (F.col("__k") <= array_values)))
            targets = targets.filter(F.col("__found").isNull() & (F.col("__k") > array_values))
            if targets.isEmpty():
                break
            targets = staged(_narrowed(known, targets, keys))
        ends = done[0]
        for d in done[1:]:
            ends = ends.unionByName(d)
        ends = staged(ends)
        short = ends.filter("__found IS NULL")
        arrays = _inside(known, short.select(*keys, "__below", "__lo", "__hi").distinct(), keys).groupBy(*keys, "__below").agg(F.array_sort(F.collect_list("__v")).alias("__a"))
        sorted_out = rejoin(short, arrays, [*keys, "__below"]).select(*keys, "__name", F.get("__a", (F.col("__r") - F.col("__below")).cast("int")).alias("__found"))
        found = ends.filter("__found IS NOT NULL").select(*keys, "__name", "__found").unionByName(sorted_out)
        if kind in ("double", "float"):
            above = wanted.filter((F.col("__r") >= F.col("__known")) & (F.col("__r") < F.col("n")))
            found = found.unionByName(above.select(*keys, "__name", F.lit(float("nan")).cast(kind).alias("__found")))
        wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == c, F.col("__found"))).alias(f"__{c}") for c in names])
        wide = big.select(*keys, "n").join(wide.withColumnsRenamed({k: f"__k_{k}" for k in keys}), _same(keys), "left")
        large = wide.select(*keys, *[F.col(f"__{c}").alias(c) for c in names], "n")
        out = small(rejoin(rows, sizes.filter(F.col("n") <= array_values).select(*keys), keys)).unionByName(large)
    return out if by else out.drop("__one")


def _same(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return same
