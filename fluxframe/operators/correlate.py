"""Cross-correlation of data with shifted models, co-adding along the orbit, peak statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxframe.functions import orbits, physics
from fluxframe.operators import grids
from fluxframe.operators.axis import neighbours
from fluxframe.operators.groups import with_group_stats


def ccf_velocities(
    exposures: DataFrame, by: Sequence[str], system: str, kp: float, fwhm: float, pixels: float, extension: float = 0.25
) -> DataFrame:
    """Velocity grid per group: system velocities -+ Kp, widened, snapped to the instrument step."""
    step = fwhm / pixels
    ends = exposures.groupBy(*by).agg((F.min(system) - kp).alias("__lo"), (F.max(system) + kp).alias("__hi"))
    margin = F.lit(float(extension)) * (F.col("__hi") - F.col("__lo"))
    first = F.floor((F.col("__lo") - margin) / F.lit(step))
    last = F.ceil((F.col("__hi") + margin) / F.lit(step))
    got = ends.withColumn("__i", F.explode(F.sequence(first, last))).withColumn("__first", first)
    return got.select(*by, (F.col("__i") - F.col("__first")).alias("v_index"), (F.col("__i") * F.lit(step)).alias("velocity"))


def shifted_models(
    model: DataFrame, data_grid: DataFrame, velocities: Column, by: Sequence[str], target_by: Sequence[str] | None = None,
    relative: str | None = None, bucket: float | None = None, span: float | str | None = "auto",
) -> DataFrame:
    """Models Doppler-shifted to each rest velocity and rebinned onto the data grid.

    ``velocities`` is an array column of rest velocities; ``relative`` names the
    velocity the model already carries.
    """
    by = list(by)
    moved = model.select(*model.columns, F.posexplode(velocities).alias("v_index", "velocity"))
    speed = F.col("velocity") - (F.col(relative) if relative else F.lit(0.0))
    moved = moved.withColumn("v_index", F.col("v_index").cast("bigint")).withColumn("wavelength", physics.doppler("wavelength", speed))
    return grids.rebin(moved, data_grid, [*by, "v_index", "velocity"], target_by=target_by or by, bucket=bucket, span=span)


def cross_correlate(
    data: DataFrame, models: DataFrame, on: Sequence[str], by: Sequence[str], shift: Sequence[str] = ("v_index",),
    normalize: bool = False, data_by: Sequence[str] | None = None, model_by: Sequence[str] | None = None, out: str = "ccf",
) -> DataFrame:
    """sum(ab) / sqrt(sum(a^2) sum(b^2)) of data and model over the channels they share.

    ``on`` are the keys both have (with the channel), ``by`` the data keys kept,
    ``shift`` the model keys kept. Pairs with a NULL do not count; a zero
    denominator gives 0. ``normalize`` first removes the means of the data
    (per ``data_by``) and of the model (per ``model_by``).
    """
    a, b = data.select(*{*on, *by}, F.col("flux").alias("__a")), models.select(*{*on, *shift}, F.col("flux").alias("__b"))
    if normalize:
        a = with_group_stats(a, list(data_by or by), {"__m": F.avg("__a")}).withColumn("__a", F.col("__a") - F.col("__m")).drop("__m")
        b = with_group_stats(b, list(model_by or shift), {"__m": F.avg("__b")}).withColumn("__b", F.col("__b") - F.col("__m")).drop("__m")
    x, y = F.col("__a"), F.col("__b")
    pairs = a.join(b, list(on)).filter(x.isNotNull() & y.isNotNull())
    sums = pairs.groupBy(*by, *shift).agg(F.sum(x * y).alias("__ab"), F.sum(x * x).alias("__aa"), F.sum(y * y).alias("__bb"))
    norm = F.sqrt(F.col("__aa") * F.col("__bb"))
    return sums.select(*by, *shift, F.when(norm != 0, F.col("__ab") / norm).otherwise(F.lit(0.0)).alias(out))


def velocity_cube(
    exposures: DataFrame, by: Sequence[str], kp: float, ccf_limits: DataFrame, kp_factor: float = 2.0, n_kp: int = 11, n_vr: int = 11,
    system: str = "system_velocity", longitude: str = "longitude", exposure: str = "exposure_id",
    radial: Callable[[Column, Column], Column] = orbits.radial_velocity,
) -> DataFrame:
    """Velocity of every (Kp, exposure, rest velocity).

    Kp runs over -+ factor Kp; the rest velocities are shrunk so that no lookup
    leaves the CCF grid given by ``ccf_limits`` (by, v_min, v_max). Both grids
    are generated per row, so nothing is joined without a key.
    """
    top = float(kp * kp_factor)
    kp_step = 2 * top / (n_kp - 1)
    grid = exposures.select(*by, exposure, system, longitude).withColumn(
        "kp_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_kp - 1).cast("bigint"))))
    grid = grid.withColumn("kp", F.lit(-top) + F.col("kp_index") * F.lit(kp_step))
    grid = grid.withColumn("__v", F.col(system) + radial(F.col("kp"), F.col(longitude)))
    ends = grid.groupBy(*by).agg(F.min("__v").alias("__vmin"), F.max("__v").alias("__vmax")).join(ccf_limits, list(by))
    low = F.greatest(F.lit(-top), F.col("v_min") - F.col("__vmin"))
    high = F.least(F.lit(top), F.col("v_max") - F.col("__vmax"))
    ends = ends.select(*by, low.alias("__lo"), ((high - low) / F.lit(float(n_vr - 1))).alias("__step"))
    cube = grid.join(ends, list(by)).withColumn(
        "vr_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_vr - 1).cast("bigint"))))
    rest = F.col("__lo") + F.col("vr_index") * F.col("__step")
    return cube.withColumn("v_rest", rest).select(*by, exposure, "kp_index", "kp", "vr_index", "v_rest", (F.col("v_rest") + F.col("__v")).alias("velocity"))


def co_add(
    ccf: DataFrame, cube: DataFrame, by: Sequence[str], v_start: Column, v_step: Column, n_velocities: Column,
    exposure: str = "exposure_id", keep: Sequence[str] = ("kp_index", "kp", "vr_index", "v_rest"),
) -> DataFrame:
    """Sum over exposures of the CCF interpolated at each cube velocity.

    The CCF grid is uniform, so the lower neighbour is index arithmetic and the
    lookup an equi-join. ``v_start``, ``v_step`` and ``n_velocities`` are
    expressions over the cube rows. A velocity outside the grid gives NULL.
    """
    # One exposure holds one value per grid velocity, a bounded number.
    pairs = neighbours(ccf.select(*by, exposure, "v_index", "ccf"), [*by, exposure], "v_index", {"__next": ("ccf", 1)}, span=None)
    at = (F.col("velocity") - v_start) / v_step
    last = n_velocities - 2
    index = F.least(F.greatest(F.floor(at + F.lit(1e-9)), F.lit(0).cast("bigint")), last.cast("bigint"))
    inside = (at >= -1e-9) & (at <= n_velocities - 1 + F.lit(1e-9))
    looked = cube.withColumn("v_index", index).withColumn("__f", at - F.col("v_index")).withColumn("__in", inside)
    got = looked.join(pairs, [*by, exposure, "v_index"])
    value = F.col("ccf") + (F.col("__next") - F.col("ccf")) * F.col("__f")
    return got.groupBy(*by, *keep).agg(
        F.when(F.bool_and("__in"), F.sum(value)).alias("ccf"), F.count(F.lit(1)).alias("n_exposures"))


def ccf_snr(ccf: DataFrame, by: Sequence[str], width: float, v: str = "v_rest", index: str = "vr_index", out: str = "snr") -> DataFrame:
    """CCF over the scatter of its row (``by``) farther than ``width`` from the row's maximum.

    A row holds the rest velocities of one Kp, as many as the caller asked for,
    so a window over it is bounded and the costly map is computed once.
    """
    row = Window.partitionBy(*by)
    peak = F.max_by(F.col(v), F.struct(F.col("ccf"), -F.col(index))).over(row)
    far = F.abs(F.col(v) - F.col("__at")) > F.lit(float(width))
    got = ccf.withColumn("__at", peak).withColumn("__noise", F.stddev_pop(F.when(far, F.col("ccf"))).over(row))
    return got.withColumn(out, F.when(F.col("__noise") > 0, F.col("ccf") / F.col("__noise"))).drop("__at", "__noise")


def ccf_peak(ccf: DataFrame, by: Sequence[str], axes: Sequence[str], order: Sequence[str], cutoff: float, y: str = "ccf") -> DataFrame:
    """Highest value, where it is (first in the order of ``order``) and how many points reach cutoff * highest.

    ``by`` keys one co-added map, whose size is the requested grid.
    """
    best = F.struct(F.col(y).alias("v"), *[(-F.col(c)).alias(f"o{i}") for i, c in enumerate(order)], *axes)
    top = ccf.withColumn("__top", F.max(y).over(Window.partitionBy(*by)))
    return top.groupBy(*by).agg(
        F.max(best).alias("__b"), F.count_if(F.col(y) >= F.lit(float(cutoff)) * F.col("__top")).alias("n_around_peak"),
    ).select(*by, F.col("__b.v").alias("peak"), *[F.col(f"__b.{a}").alias(f"peak_{a}") for a in axes], "n_around_peak")
