"""Running means and Gaussian smoothing.

Kernels need a bounded neighbourhood, not a whole group: rows are cut into
blocks, rows near a block border are copied into the next block as a halo, and
the window runs inside a block. A block is a shuffle unit of known size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fluxframe.functions.expr import ColumnLike, col
from fluxframe.operators.axis import neighbours, rejoin, running_total
from fluxframe.operators.groups import with_group_stats

BLOCK = 8192
FWHM = 2 * math.sqrt(2 * math.log(2))
# A Gaussian is below half a unit in the last place of its peak beyond this many sigmas.
FULL_SUPPORT_SIGMAS = 9.0


def _haloed(df: DataFrame, index: str, before: int, after: int, block: int) -> DataFrame:
    """Copy each row to every block whose rows can see it; ``__home`` marks the row's own block."""
    size = max(block, before + after + 1)
    i = F.col(index).cast("bigint")
    first, last = F.floor((i - after) / F.lit(size)), F.floor((i + before) / F.lit(size))
    return df.withColumn("__block", F.explode(F.sequence(first, last))).withColumn(
        "__home", F.col("__block") == F.floor(i / F.lit(size))
    )


def _window(by: Sequence[str], index: str, before: int, after: int):
    return Window.partitionBy(*by, "__block").orderBy(F.col(index).cast("bigint")).rangeBetween(-before, after)


def running_mean(df: DataFrame, by: Sequence[str], index: str, y: str, n: int, out: str = "mean", block: int = BLOCK) -> DataFrame:
    """Mean of the row and the n-1 before it along a gap-free integer index; only full windows are kept."""
    w = _window(by, index, n - 1, 0)
    got = _haloed(df, index, n - 1, 0, block).select(
        "*", F.avg(y).over(w).alias(out), F.count(F.lit(1)).over(w).alias("__n")
    )
    return got.filter(F.col("__home") & (F.col("__n") == n)).select(*df.columns, out)


def boxcar(df: DataFrame, by: Sequence[str], index: str, y: str, n: int, out: str = "smooth", block: int = BLOCK) -> DataFrame:
    """Box-car [i-h, i+h) with h = n // 2; at the edges the window shrinks to stay symmetric. Masked points are left out of their windows."""
    half = n // 2
    base = with_group_stats(df, by, {"__len": F.max(index) + 1})
    i, size = F.col(index), F.col("__len")
    right = F.least(F.lit(half), size + 1 - i)
    reach = F.when((i - half >= 0) & (i + half <= size + 1), F.struct((i - half).alias("a"), (i + half).alias("b")))
    reach = reach.when(i + half > size + 1, F.struct((i - right).alias("a"), (i + right).alias("b")))
    reach = reach.otherwise(F.struct(F.lit(0).cast("bigint").alias("a"), F.greatest(2 * i, F.lit(1)).cast("bigint").alias("b")))
    w = _window(by, index, half, half)
    near = _haloed(base, index, half, half, block).select(
        "*", F.collect_list(F.struct(i.alias("i"), F.col(y).alias("y"))).over(w).alias("__near")
    )
    used = F.filter("__near", lambda e: (e["i"] >= F.col("__reach")["a"]) & (e["i"] < F.col("__reach")["b"]))
    known = F.filter(used, lambda e: e["y"].isNotNull())
    value = F.try_divide(F.aggregate(known, F.lit(0.0), lambda acc, e: acc + e["y"]), F.size(known))
    home = near.filter("__home").withColumn("__reach", reach)
    return home.withColumn(out, value).select(*df.columns, out)


def _edge_copies(base: DataFrame, i: Column, n: Column, radius: Column, edge: str) -> DataFrame:
    """Rows standing in for the indices beyond both ends (``__at``), beside the rows themselves (``__real``)."""
    if edge == "nearest":
        none = F.array().cast("array<bigint>")
        beyond = F.when(radius > 0, F.sequence(F.lit(1).cast("bigint"), radius)).otherwise(none)
        left, right = F.when(i == 0, F.transform(beyond, lambda k: -k)), F.when(i == n - 1, F.transform(beyond, lambda k: n - 1 + k))
        at = F.concat(F.array(i), F.coalesce(left, none), F.coalesce(right, none))
    elif edge == "reflect":
        # Mirrored with the end sample repeated: period 2n, images of i at 2nk + i and 2nk - 1 - i.
        turns = F.ceil(radius / (2 * n)).cast("bigint") + 1
        images = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(2 * n * k + i, 2 * n * k - 1 - i)))
        at = F.filter(images, lambda j: (j >= -radius) & (j <= n - 1 + radius))
    else:
        raise ValueError(f"edge must be nearest or reflect, not {edge!r}")
    return base.withColumn("__at", F.explode(at)).withColumn("__real", F.col("__at") == i)


@F.pandas_udf(ArrayType(DoubleType()))
def _convolved(at: pd.Series, y: pd.Series, sigma: pd.Series, radius: pd.Series) -> pd.Series:
    """Weighted means around each position of one block; masked samples (NaN) have no weight, repeated positions count each."""
    out = []
    for places, values, s, r in zip(at, y, sigma, radius):
        places, values = np.asarray(places, dtype=np.int64), np.asarray(values, dtype=float)
        places = places - places.min()
        known = ~np.isnan(values)
        top, weight = (np.bincount(places, weights=w) for w in (np.where(known, values, 0.0), known.astype(float)))
        kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2) if r else np.ones(1)
        sums, norms = (np.convolve(v, kernel)[r : r + len(v)] for v in (top, weight))
        near = np.divide(sums, norms, out=np.full(len(sums), np.nan), where=norms > 0)[places]
        out.append([None if math.isnan(v) else v for v in near.tolist()])
    return pd.Series(out, dtype=object)


def gauss_smooth(
    df: DataFrame, by: Sequence[str], index: str, y: str, sigma: ColumnLike, edge: str = "reflect",
    truncate: float = 4.0, out: str = "smooth", block: int = BLOCK,
) -> DataFrame:
    """Gaussian in samples along a gap-free index 0..n-1 per group, of one width for all groups or one per group.

    ``sigma`` is a number, a column or an expression that is constant in a group;
    where it is NULL or gives no neighbour, values stay as they are. The radius,
    and so the halo of a block, is the group's own. A block of samples travels as
    one array row and is convolved as one. Masked samples (NULL or NaN) are left
    out of the means of their neighbours, and take the mean of theirs.
    """
    keys, i = list(by), F.col("__i")
    value = F.when(~F.isnan(F.col(y).cast("double")), F.col(y).cast("double"))
    rows = df.select(*keys, F.col(index).cast("bigint").alias("__i"), value.alias("__y"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
                     (F.lit(float(sigma)) if isinstance(sigma, (int, float)) else col(sigma)).cast("double").alias("__width"))
    base = with_group_stats(rows, keys, {"__len": F.max("__i") + 1, "__sigma": F.max("__width")})
    radius = F.coalesce(F.floor(F.lit(truncate) * F.col("__sigma") + F.lit(0.5)), F.lit(0)).cast("bigint")
    padded = _edge_copies(base.withColumn("__radius", radius), i, F.col("__len"), F.col("__radius"), edge)
    reach, at = F.col("__radius"), F.col("__at")
    size = F.greatest(F.lit(block).cast("bigint"), 2 * reach + 1)
    spread = padded.withColumn("__block", F.explode(F.sequence(F.floor((at - reach) / size), F.floor((at + reach) / size))))
    home = F.col("__real") & (F.col("__block") == F.floor(at / size))
    cells = F.collect_list(F.struct(at.alias("at"), F.col("__y").alias("y"), F.when(home, F.col("__row")).alias("row")))
    blocks = spread.groupBy(*keys, "__block", "__sigma", "__radius").agg(cells.alias("__cells"), F.max(home).alias("__any")).filter("__any")
    smooth = _convolved(F.col("__cells.at"), F.col("__cells.y"), F.coalesce("__sigma", F.lit(1.0)), F.col("__radius"))
    pairs = blocks.select("__cells", smooth.alias("__smooth")).select(F.explode(F.arrays_zip(F.col("__cells.row").alias("row"), F.col("__smooth").alias("value"))).alias("__pair"))
    names = [F.col(f"__pair.row.`{c}`").alias(c) for c in df.columns if c != out]
    return pairs.filter("__pair.row IS NOT NULL").select(*names, F.col("__pair.value").alias(out))


def convolve_to_resolution(
    df: DataFrame, by: Sequence[str], resolving_power: ColumnLike, x: str = "wavelength", y: str = "flux", edge: str = "nearest",
    truncate: float = 4.0, block: int = BLOCK,
) -> DataFrame:
    """``y`` seen by an instrument of the given resolving power, which each group may have of its own; NULL leaves the group as it is.

    The kernel has a FWHM of x / R; its width in samples comes from the group's
    mean relative step, as on a grid of even logarithmic steps.
    """
    keys = list(by)
    ranked = running_total(df.withColumn("__one", F.lit(1.0)), keys, x, {"__rank": "__one"}).drop("__one")
    steps = neighbours(df.select(*keys, F.col(x).alias("__x")), keys, "__x", {"__x1": ("__x", 1)})
    spacing = steps.groupBy(*keys).agg(F.avg(2 * (F.col("__x1") - F.col("__x")) / (F.col("__x1") + F.col("__x"))).alias("__step"))
    placed = rejoin(ranked, spacing, keys).withColumn("__index", (F.col("__rank") - 1).cast("bigint"))
    sigma = 1 / col(resolving_power) / F.lit(FWHM) / F.col("__step")
    return gauss_smooth(placed, keys, "__index", y, sigma, edge, truncate, "__smooth", block).withColumn(y, F.col("__smooth")).select(*df.columns)


def gauss_smooth_running(
    df: DataFrame, by: Sequence[str], index: str, y: str, sigma: str | Column, max_sigma: float,
    truncate: float = 4.0, out: str = "smooth", block: int = BLOCK,
) -> DataFrame:
    """Gaussian whose width in samples varies per row; rows nearer to an end than the radius stay as they are.

    ``max_sigma`` sets one radius for all rows, as the kernel support is shared.
    """
    radius = int(truncate * max_sigma + 0.5)
    width = F.col(sigma) if isinstance(sigma, str) else sigma
    base = with_group_stats(df.withColumn("__sigma", width), by, {"__len": (F.max(index) + 1).cast("bigint")})
    w = _window(by, index, radius, radius)
    near = _haloed(base, index, radius, radius, block).select(
        "*", F.collect_list(F.struct(F.col(index).alias("i"), F.col(y).alias("y"))).over(w).alias("__near")
    )

    def weight(e):
        return F.exp(F.lit(-0.5) * F.pow((e["i"] - F.col(index)) / F.col("__sigma"), 2))

    top = F.aggregate("__near", F.lit(0.0), lambda acc, e: acc + F.coalesce(weight(e) * e["y"], F.lit(0.0)))
    norm = F.aggregate("__near", F.lit(0.0), lambda acc, e: acc + F.when(e["y"].isNotNull(), weight(e)).otherwise(F.lit(0.0)))
    valid = (F.col(index) >= radius) & (F.col(index) < F.col("__len") - radius)
    return (
        near.filter("__home").withColumn(out, F.when(valid, F.try_divide(top, norm)).otherwise(F.col(y))).select(*df.columns, out)
    )


def gauss_smooth_full(
    df: DataFrame, by: Sequence[str], x: str, y: str, resolving_power: str | Column, fwhm_factor: float = 2.355,
    out: str = "smooth", bucket: float | None = None, support: float = FULL_SUPPORT_SIGMAS,
) -> DataFrame:
    """Normalised Gaussian over the axis with FWHM x / R of each row.

    Every sample within ``support`` sigmas takes part; beyond the default a weight
    is lost in the rounding of the sum, so this equals the full-support sum. Rows
    meet through axis buckets, never all against all. Masked samples have no
    weight; repeated rows stay.
    """
    r = F.col(resolving_power) if isinstance(resolving_power, str) else resolving_power
    base = df.withColumn("__sigma", F.col(x) / r / F.lit(float(fwhm_factor)))
    if bucket is None:
        widest = base.agg(F.avg("__sigma").alias("s")).first()["s"]
        bucket = 2 * support * (widest or 1.0)
    w, reach = F.lit(float(bucket)), F.lit(float(support)) * F.col("__sigma")
    targets = base.withColumn("__row", F.monotonically_increasing_id()).withColumn("__b", F.explode(F.sequence(F.floor((F.col(x) - reach) / w), F.floor((F.col(x) + reach) / w))))
    sources = df.select(*by, F.col(x).alias("__sx"), F.col(y).alias("__sy"), F.floor(F.col(x) / w).alias("__b"))
    pairs = targets.join(sources, [*by, "__b"]).filter(F.abs(F.col("__sx") - F.col(x)) <= reach)
    weight = F.exp(-F.pow(F.col("__sx") - F.col(x), 2) / (2 * F.pow(F.col("__sigma"), 2)))
    weight = F.when(F.col("__sy").isNotNull(), weight)
    summed = pairs.groupBy("__row", *df.columns).agg(F.try_divide(F.sum(weight * F.col("__sy")), F.sum(weight)).alias(out))
    return summed.drop("__row")
