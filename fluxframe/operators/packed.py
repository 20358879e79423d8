"""Spectra as one array per row: work within a spectrum needs no shuffle.

A packed row is (order_id, exposure_id, flux ARRAY, uncertainty ARRAY), channels
in order, NULL for masked points. Where spectra are stored this way (or a row of
the source holds one spectrum), the mean over channels and the correlation are
computed in the row; only per-channel statistics travel, as partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ORDER = ["order_id"]
SPECTRUM = ["order_id", "exposure_id"]


def _weight(s: Column, f: Column, weighted: bool) -> Column:
    valid = f.isNotNull() & s.isNotNull() & (s != 0)
    return F.when(valid, 1 / s if weighted else F.lit(1.0)).otherwise(F.lit(0.0))


def _sum(values: Column) -> Column:
    """Sum of an array, NULLs left out."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def _divide(df: DataFrame, factor: Column) -> DataFrame:
    f = F.when(factor != 0, factor)
    return df.withColumn("__f", f).withColumns({
        "flux": F.transform("flux", lambda v: v / F.col("__f")),
        "uncertainty": F.transform("uncertainty", lambda v: v / F.abs(F.col("__f"))),
    }).drop("__f")


def remove_throughput_mean(df: DataFrame, weighted: bool = True) -> DataFrame:
    """Divide each spectrum by its weighted mean, inside the row."""
    weights = F.zip_with("uncertainty", "flux", lambda s, f: _weight(s, f, weighted))
    work = df.withColumn("__w", weights)
    mean = _sum(F.zip_with("__w", "flux", lambda w, f: w * f)) / F.nullif(_sum(F.col("__w")), F.lit(0.0))
    return _divide(work.withColumn("__mean", mean), F.col("__mean")).drop("__w", "__mean")


def channel_table(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """Per-channel aggregate (an expression over ``f`` and ``s``) back as one array per group.

    Points are exploded only as far as the partial aggregation of their own task.
    """
    points = df.select(*by, F.posexplode(F.arrays_zip(F.col("flux").alias("f"), F.col("uncertainty").alias("s"))).alias("channel", "p"))
    per = points.select(*by, "channel", "p.f", "p.s").groupBy(*by, "channel").agg(value.alias("v"))
    listed = per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("channel", "v"))).alias("__l"))
    return listed.select(*by, F.transform("__l", lambda e: e["v"]).alias(out))


def remove_tellurics_mean(df: DataFrame, weighted: bool = True, threshold: float = 1e-16, by: Sequence[str] = ORDER) -> DataFrame:
    """Divide each channel by its weighted mean over the exposures of the group; mask it if the mean is too low."""
    w = _weight(F.col("s"), F.col("f"), weighted)
    mean = F.sum(w * F.col("f")) / F.nullif(F.sum(w), F.lit(0.0))
    table = channel_table(df, by, mean, "__mean")
    got = df.join(table, list(by)).withColumn("__mean", F.transform("__mean", lambda m: F.when(m >= F.lit(float(threshold)), m)))
    return got.withColumns({
        "flux": F.zip_with("flux", "__mean", lambda f, m: f / m),
        "uncertainty": F.zip_with("uncertainty", "__mean", lambda s, m: s / F.abs(m)),
    }).drop("__mean")


@F.arrow_udf(DoubleType())
def correlation(a: pa.Array, b: pa.Array) -> pa.Array:
    """sum(ab) / sqrt(sum(a^2) sum(b^2)) of two equally long arrays per row; NULL pairs do not count, 0/0 is 0."""
    lengths = a.value_lengths().to_numpy(zero_copy_only=False)
    x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (a, b))
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
    filled = np.flatnonzero(lengths > 0)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)[filled]
    out = np.zeros(len(a))
    if filled.size:
        norm = np.sqrt(np.add.reduceat(x * x, starts) * np.add.reduceat(y * y, starts))
        dot = np.add.reduceat(x * y, starts)
        out[filled] = np.divide(dot, norm, out=np.zeros_like(dot), where=norm != 0)
    return pa.array(out)


def cross_correlate(data: DataFrame, models: DataFrame, on: Sequence[str] = ORDER, keep: Sequence[str] = SPECTRUM,
                    shift: Sequence[str] = ("v_index",), model: str = "model", out: str = "ccf") -> DataFrame:
    """Correlation of every spectrum with every model of its group.

    ``models`` holds one array per (on, shift) on the channels of the data. The
    join fans a spectrum out to its models, which is the size of the result; the
    sums run on whole Arrow batches, as array lambdas cost far more per element.
    """
    got = data.select(*keep, "flux").join(models.select(*on, *shift, model), list(on))
    return got.select(*keep, *shift, correlation("flux", model).alias(out))


def unpack(df: DataFrame, keep: Sequence[str] = SPECTRUM) -> DataFrame:
    """Back to one row per point."""
    points = F.posexplode(F.arrays_zip(F.col("flux").alias("f"), F.col("uncertainty").alias("s"))).alias("channel", "p")
    return df.select(*keep, points).select(*keep, F.col("channel").cast("bigint").alias("channel"), F.col("p.f").alias("flux"), F.col("p.s").alias("uncertainty"))


def pack(df: DataFrame, keep: Sequence[str] = SPECTRUM) -> DataFrame:
    """One row per spectrum. A spectrum is one instrument read-out, bounded by its number of channels."""
    listed = df.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("channel", "flux", "uncertainty"))).alias("__l"))
    return listed.select(*keep, F.transform("__l", lambda e: e["flux"]).alias("flux"), F.transform("__l", lambda e: e["uncertainty"]).alias("uncertainty"))
