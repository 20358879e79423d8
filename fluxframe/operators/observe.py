"""Steps of the observation chain: scale, shift, light loss, tellurics, deformation, noise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions import orbits, physics
from fluxframe.functions.expr import ColumnLike, col
from fluxframe.operators import grids
from fluxframe.session import staged

KEYS = ("order_id", "exposure_id", "channel")


def scale_spectrum(df: DataFrame, mode: str, star: DataFrame | None = None, on: Sequence[str] = (),
                   star_radius: ColumnLike | None = None, y: str = "flux", out: str | None = None) -> DataFrame:
    """Emission: flux over stellar flux (joined on ``on``). Transmission: 1 - (radius / stellar radius)^2."""
    out = out or y
    if mode == "emission":
        return df.join(star.select(*on, F.col("star_flux").alias("__star")), list(on)).withColumn(
            out, F.col(y) / F.col("__star")).drop("__star")
    if mode == "transmission":
        return df.withColumn(out, physics.transit_signal(y, star_radius))
    raise ValueError(f"mode must be emission or transmission, not {mode!r}")


def shift_spectrum(df: DataFrame, velocity: ColumnLike, x: str = "wavelength") -> DataFrame:
    return df.withColumn(x, physics.doppler(x, velocity))


def apply_light_loss(df: DataFrame, impact: ColumnLike, longitude: ColumnLike, duration: ColumnLike, period: ColumnLike,
                     y: str = "flux", keep_distance: str | None = None) -> DataFrame:
    """Replace a scaled spectrum 1 - p^2 by 1 - (light a uniform stellar disk loses now)."""
    ratio = F.sqrt(1 - F.col(y))
    got = df.withColumn("__p", ratio).withColumn(
        "__z", orbits.centre_distance(impact, "__p", longitude, duration, period)
    ).withColumn(y, 1 - orbits.uniform_light_loss("__p", "__z"))
    if keep_distance:
        got = got.withColumn(keep_distance, F.col("__z"))
    return got.drop("__p", "__z")


def apply_deformation(df: DataFrame, deformation: DataFrame | None = None, noise: DataFrame | None = None,
                      on: Sequence[str] = KEYS, y: str = "flux") -> DataFrame:
    """Multiply by the instrumental deformation, then add the noise matrix."""
    on = list(on)
    if deformation is not None:
        df = df.join(deformation.select(*on, "deformation"), on).withColumn(y, F.col(y) * F.col("deformation")).drop("deformation")
    if noise is not None:
        df = df.join(noise.select(*on, "noise"), on).withColumn(y, F.col(y) + F.col("noise")).drop("noise")
    return df


Step = Callable[[DataFrame], DataFrame]
# The order of the chain; a caller replaces or leaves out steps by name.
STEP_ORDER = ("star", "scale", "shift", "light_loss", "tellurics", "smooth", "rebin", "deformation", "prepare")


def observe(df: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """Run the given steps in the fixed order of the chain.

    Preparation reads its input several times, so the steps before it end in a
    written table.
    """
    unknown = set(steps) - set(STEP_ORDER)
    if unknown:
        raise ValueError(f"unknown steps {sorted(unknown)}")
    for name in STEP_ORDER:
        if name in steps:
            df = steps[name](staged(df) if name == "prepare" else df)
    return df


def bias_metric(model: DataFrame, mock: DataFrame, matrix: DataFrame | None = None, noise: DataFrame | None = None,
                on: Sequence[str] = KEYS) -> DataFrame:
    """1 - (prepared model - noise * preparation matrix) / prepared mock data."""
    on = list(on)
    got = model.select(*on, F.col("flux").alias("__m")).join(mock.select(*on, F.col("flux").alias("__o")), on)
    extra: Column = F.lit(0.0)
    if noise is not None:
        got = got.join(noise.select(*on, F.col("noise").alias("__n")), on)
        extra = F.col("__n")
        if matrix is not None:
            got = got.join(matrix.select(*on, F.col("matrix").alias("__r")), on)
            extra = F.col("__n") * F.col("__r")
    return got.select(*on, (1 - (F.col("__m") - extra) / F.col("__o")).alias("bias"))


def apply_tellurics(
    spectra: DataFrame, template: DataFrame, low: float, high: float, margin: float, resolving_power: float | None = None,
    by: Sequence[str] = ("order_id", "exposure_id"), airmass: str | None = "airmass", bucket: float | None = None,
    span: float | str | None = "auto",
) -> DataFrame:
    """Multiply shifted spectra by a telluric template, on a common intermediate grid.

    The grid runs from ``low`` - ``margin`` to ``high`` + ``margin`` at the mean
    resolving power of the spectra (measured unless given). Spectra and template
    are both rebinned to it; the template then follows the airmass law. The
    template is one spectrum (wavelength, transmittance), so the join with its
    rebinned points is small on one side.
    """
    by = list(by)
    if resolving_power is None:
        per = grids.mean_resolving_power(spectra, by, span=span)
        resolving_power = per.agg(F.avg("resolving_power").alias("r")).first()["r"]
    grid = grids.grid_mul(spectra.sparkSession, low - margin, high + margin, resolving_power).select("wavelength")
    moved = grids.rebin(spectra, grid, by, target_by=[], bucket=bucket, span=span)
    sky = grids.rebin(template, grid, [], y="transmittance", target_by=[], bucket=bucket, span=span)
    # Both sides carry the very numbers of the grid, so the wavelengths match exactly.
    got = moved.join(sky.select("wavelength", "transmittance"), "wavelength")
    if airmass is not None:
        seen = spectra.groupBy(*by).agg(F.first(airmass, ignorenulls=True).alias("__air"))
        got = got.join(seen, by).withColumn("transmittance", physics.airmass_law("transmittance", "__air"))
    return got.select(*by, "wavelength", (F.col("flux") * F.col("transmittance")).alias("flux"))


def multiply_tellurics(df: DataFrame, transmittance: DataFrame, on: Sequence[str], y: str = "flux") -> DataFrame:
    """Multiply by a transmittance that already sits on the grid of ``df``."""
    on = list(on)
    t = transmittance.select(*on, col("transmittance").alias("__t"))
    return df.join(t, on).withColumn(y, F.col(y) * F.col("__t")).drop("__t")
