"""Derived planet quantities with (upper, lower) errors, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions.expr import ColumnLike, col
from fluxframe.functions.stats import propagate

# (upper, lower) errors; both are taken by magnitude.
Errors = tuple[ColumnLike, ColumnLike]
NONE: Errors = (0.0, 0.0)


def _both(derivatives: list[ColumnLike], errors: list[Errors]) -> tuple[Column, Column]:
    upper = propagate(derivatives, [e[0] for e in errors])
    lower = propagate(derivatives, [e[1] for e in errors])
    return upper, -lower


def equilibrium_temperature(axis, t_star, r_star, albedo: ColumnLike = 0.0, axis_err=NONE, t_err=NONE, r_err=NONE):
    t = col(t_star) * F.sqrt(col(r_star) / (2 * col(axis))) * F.pow(1 - col(albedo), 0.25)
    up, low = _both([t / col(t_star), 0.5 * t / col(r_star), -0.5 * t / col(axis)], [t_err, r_err, axis_err])
    return t, up, low


def surface_gravity(mass, radius, mass_err=NONE, radius_err=NONE):
    """NULL where mass or radius is not positive."""
    g = F.when((col(mass) > 0) & (col(radius) > 0), F.lit(k.G) * col(mass) / F.pow(col(radius), 2))
    up, low = _both([g / col(mass), -2 * g / col(radius)], [mass_err, radius_err])
    return g, up, low


def radius_from_gravity(gravity, mass, gravity_err=NONE, mass_err=NONE):
    r = F.when(col(gravity) > 0, F.sqrt(F.lit(k.G) * col(mass) / col(gravity)))
    up, low = _both([r / (2 * col(mass)), -r / (2 * col(gravity))], [mass_err, gravity_err])
    return r, up, low


def mass_from_gravity(gravity, radius, gravity_err=NONE, radius_err=NONE):
    m = col(gravity) / F.lit(k.G) * F.pow(col(radius), 2)
    up, low = _both([m / col(gravity), 2 * m / col(radius)], [gravity_err, radius_err])
    return m, up, low


def radius_from_density(mass, density, mass_err=NONE, density_err=NONE):
    r = F.pow(3 * col(mass) / (F.lit(4 * math.pi) * col(density)), 1 / 3)
    up, low = _both([r / (3 * col(mass)), -r / (3 * col(density))], [mass_err, density_err])
    return r, up, low


def mass_from_density(radius, density, radius_err=NONE, density_err=NONE):
    m = col(density) * F.lit(4 / 3 * math.pi) * F.pow(col(radius), 3)
    up, low = _both([m / col(density), 3 * m / col(radius)], [density_err, radius_err])
    return m, up, low


# Power-law luminosity relation (value, error) for constant, mass, radius and age.
LUMINOSITY_LAW = {"const": (-12.46, 0.05), "mass": (1.74, 0.03), "radius": (-0.94, 0.09), "age": (-1.04, 0.04)}


def intrinsic_temperature(mass, radius, age, mass_err=NONE, radius_err=NONE, age_err=NONE):
    """From the power law of luminosity in mass, radius and age."""
    law = LUMINOSITY_LAW
    lm = F.log10(col(mass) / F.lit(k.M_EARTH))
    lr = F.log10(col(radius) / F.lit(k.R_JUP))
    lt = F.log10(col(age) / F.lit(1e9 * k.YEAR))
    log_l = F.lit(law["const"][0]) + law["mass"][0] * lm + law["radius"][0] * lr + law["age"][0] * lt
    ln10 = math.log(10)
    d = [F.lit(1.0), lm, lr, lt, ln10 / col(mass), ln10 / col(radius), ln10 / col(age)]
    fixed = [(law[n][1], law[n][1]) for n in ("const", "mass", "radius", "age")]
    up, low = _both(d, [*fixed, mass_err, radius_err, age_err])
    luminosity = F.pow(F.lit(10.0), log_l) * F.lit(k.L_SUN)
    l_err = (luminosity * ln10 * up, luminosity * ln10 * low)
    area = F.lit(4 * math.pi * k.SIGMA) * F.pow(col(radius), 2)
    t4 = luminosity / area
    up, low = _both([1 / area, -2 * t4 / col(radius)], [l_err, radius_err])
    slope = 1 / (4 * F.pow(t4, 0.75))
    return F.pow(t4, 0.25), slope * up, slope * low


def intrinsic_temperature_inflated(t_eq: ColumnLike) -> Column:
    """Bell curve in log flux for inflated hot giants."""
    scale, mean, width = 0.39, 0.14, 1.095
    flux = F.lit(4 * k.SIGMA) * F.pow(col(t_eq), 4)
    return scale * col(t_eq) * F.exp(-F.pow(F.log10(flux * 1e-9) - mean, 2) / width)


def intrinsic_temperature_tidal(
    quality, radius, axis, velocity, eccentricity, star_mass, love: ColumnLike = 1.5, emissivity: ColumnLike = 1.0
) -> Column:
    """Tidal heating of a nearly synchronous planet, radiated from its surface."""
    spin = col(velocity) / col(axis)
    heat = (
        10.5 * col(love) / col(quality) * F.lit(k.G) * F.pow(col(star_mass), 2) * F.pow(col(radius), 5)
        / F.pow(col(axis), 6) * spin * F.pow(col(eccentricity), 2)
    )
    return F.pow(heat / (F.lit(4 * math.pi) * F.pow(col(radius), 2) * col(emissivity) * F.lit(k.SIGMA)), 0.25)
