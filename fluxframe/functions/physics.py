"""Radiation and wavelength expressions (CGS unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions.expr import ColumnLike, col


def doppler(wavelength: ColumnLike, velocity: ColumnLike) -> Column:
    """Wavelength seen from a source moving away at ``velocity`` (cm/s)."""
    beta = col(velocity) / F.lit(k.C)
    return col(wavelength) * F.sqrt((1 + beta) / (1 - beta))


def reciprocal_c(value: ColumnLike) -> Column:
    """Wavelength (cm) <-> frequency (Hz)."""
    return F.lit(k.C) / col(value)


def hz_to_um(frequency: ColumnLike) -> Column:
    return reciprocal_c(frequency) * F.lit(1e4)


def um_to_hz(wavelength: ColumnLike) -> Column:
    return reciprocal_c(col(wavelength) * F.lit(1e-4))


def flux_cm_to_hz(flux: ColumnLike, wavelength: ColumnLike) -> Column:
    w = col(wavelength)
    return col(flux) * w * w / F.lit(k.C)


def flux_hz_to_cm(flux: ColumnLike, frequency: ColumnLike) -> Column:
    f = col(frequency)
    return col(flux) * f * f / F.lit(k.C)


def irradiance(flux: ColumnLike, source_radius: ColumnLike, distance: ColumnLike) -> Column:
    return col(flux) * F.pow(col(source_radius) / col(distance), 2)


def jansky_to_flux(flux_jy: ColumnLike, wavelength_um: ColumnLike) -> Column:
    """Jansky to W m^-2 um^-1."""
    return col(flux_jy) * F.lit(1e-26) * F.lit(k.C * 1e4) / F.pow(col(wavelength_um), 2)


def planck_cm(temperature: ColumnLike, wavelength: ColumnLike) -> Column:
    w, t = col(wavelength), col(temperature)
    return F.lit(2 * k.H * k.C**2) / F.pow(w, 5) / F.expm1(F.lit(k.H * k.C / k.KB) / w / t)


def planck_hz(temperature: ColumnLike, frequency: ColumnLike) -> Column:
    f, t = col(frequency), col(temperature)
    return F.lit(2 * k.H / k.C**2) * F.pow(f, 3) / F.expm1(F.lit(k.H / k.KB) * f / t)


def planck_hz_dt(temperature: ColumnLike, frequency: ColumnLike) -> Column:
    """dB_nu/dT. Written with exp(-x) so that large x gives 0, not inf/inf."""
    f, t = col(frequency), col(temperature)
    x = F.lit(k.H / k.KB) * f / t
    shrink = F.exp(-x)
    return F.lit(2 * k.H / k.C**2) * F.pow(f, 3) * x / t * shrink / F.pow(1 - shrink, 2)


def planck_bin_mean(temperature: ColumnLike, f_low: ColumnLike, f_high: ColumnLike) -> Column:
    """Mean of B_nu over a frequency bin by Boole's rule on five even points."""
    lo, hi = col(f_low), col(f_high)
    step = (hi - lo) / 4
    weights = (7, 32, 12, 32, 7)
    out = None
    for i, w in enumerate(weights):
        term = F.lit(w / 90) * planck_hz(temperature, lo + i * step)
        out = term if out is None else out + term
    return out


def black_body_disk(flux: ColumnLike, temperature: ColumnLike, wavelength_um: ColumnLike, radius: ColumnLike, distance: ColumnLike) -> Column:
    """Flux (W m^-2 um^-1) plus a flat disk radiating as a black body."""
    glow = planck_cm(temperature, col(wavelength_um) * F.lit(1e-4)) * F.lit(1e-7)
    return col(flux) + glow * F.pow(col(radius) / col(distance), 2)


def transit_signal(radius: ColumnLike, star_radius: ColumnLike) -> Column:
    return 1 - F.pow(col(radius) / col(star_radius), 2)


def airmass_law(transmittance: ColumnLike, airmass: ColumnLike) -> Column:
    """exp(airmass ln T); a transmittance of 0 or less is masked."""
    t = col(transmittance)
    return F.when(t > 0, F.exp(col(airmass) * F.log(t)))


def scaled_metallicity(
    mass: ColumnLike, star: ColumnLike = 1.0, mixing: ColumnLike = 1.0, power: float = -0.68, scale: float = 7.2
) -> Column:
    """Power-law mass-metallicity relation, never 0 or below."""
    z = F.lit(scale) * F.pow(col(mass) / F.lit(k.M_JUP), power) * col(star) * col(mixing)
    return F.when(z <= 0, F.lit(2.2250738585072014e-308)).otherwise(z)
