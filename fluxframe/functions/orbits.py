"""Orbit and transit expressions (angles in degrees, times in the unit of the period)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions.expr import ColumnLike, col
from fluxframe.functions.stats import propagate


def orbital_phase(time: ColumnLike, period: ColumnLike, phase_start: ColumnLike = 0.0) -> Column:
    """Phase in [0, 1), or in [-1, 0) where the unfolded phase is negative."""
    raw = col(phase_start) + col(time) / col(period)
    folded = raw - F.floor(raw)
    return F.when(raw < 0, folded - 1).otherwise(folded)


def phase_to_longitude(phase: ColumnLike, degrees: bool = True) -> Column:
    return col(phase) * F.lit(360.0 if degrees else 2 * math.pi)


def longitude_to_phase(longitude: ColumnLike) -> Column:
    """From radians."""
    return col(longitude) / F.lit(2 * math.pi)


def orbital_velocity(star_mass: ColumnLike, semi_major_axis: ColumnLike) -> Column:
    return F.sqrt(F.lit(k.G) * col(star_mass) / col(semi_major_axis))


def semi_amplitude(velocity: ColumnLike, inclination: ColumnLike) -> Column:
    return col(velocity) * F.sin(F.radians(col(inclination)))


def radial_velocity(kp: ColumnLike, longitude: ColumnLike) -> Column:
    return col(kp) * F.sin(F.radians(col(longitude)))


def relative_velocity(radial: ColumnLike, system: ColumnLike, shift: ColumnLike = 0.0) -> Column:
    return col(radial) + col(system) + col(shift)


def impact_parameter(semi_major_axis: ColumnLike, inclination: ColumnLike, star_radius: ColumnLike) -> Column:
    return col(semi_major_axis) * F.cos(F.radians(col(inclination))) / col(star_radius)


def full_transit_duration(total: ColumnLike, radius: ColumnLike, star_radius: ColumnLike, impact: ColumnLike) -> Column:
    ratio, b2 = col(radius) / col(star_radius), F.pow(col(impact), 2)
    return col(total) * F.sqrt((F.pow(1 - ratio, 2) - b2) / (F.pow(1 + ratio, 2) - b2))


def mid_transit(
    day: ColumnLike,
    source_time: ColumnLike,
    period: ColumnLike,
    time_error: tuple[ColumnLike, ColumnLike] = (0.0, 0.0),
    period_error: tuple[ColumnLike, ColumnLike] = (0.0, 0.0),
    seconds: bool = True,
) -> dict[str, Column]:
    """First mid-transit at or after ``day`` (days), with (lower, upper) errors and the orbit count."""
    orbits = F.ceil((col(day) - col(source_time)) / col(period)).cast("double")
    when = col(source_time) + orbits * col(period)
    lower = propagate([F.lit(1.0), orbits], [time_error[0], period_error[0]])
    upper = propagate([F.lit(1.0), orbits], [time_error[1], period_error[1]])
    if seconds:
        when = (when - F.floor(when)) * F.lit(k.DAY)
        lower, upper = lower * F.lit(k.DAY), upper * F.lit(k.DAY)
    return {"mid_transit": when, "err_upper": upper, "err_lower": -lower, "n_orbits": orbits.cast("bigint")}


def centre_distance(
    impact: ColumnLike, ratio: ColumnLike, longitude: ColumnLike, duration: ColumnLike, period: ColumnLike
) -> Column:
    """Sky-projected planet-star distance in stellar radii, near transit. NULL if the planet never transits."""
    b2, outer2 = F.pow(col(impact), 2), F.pow(1 + col(ratio), 2)
    half = F.degrees(col(duration) / col(period) * F.lit(math.pi))
    return F.when(b2 <= outer2, F.sqrt(b2 + (outer2 - b2) * F.pow(col(longitude) / half, 2)))


def uniform_light_loss(ratio: ColumnLike, distance: ColumnLike) -> Column:
    """Share of a uniform stellar disk hidden by a disk of relative radius ``ratio`` at ``distance``."""
    p, z = col(ratio), col(distance)
    p2, z2 = p * p, z * z
    planet_angle = F.acos((p2 + z2 - 1) / (2 * p * z))
    star_angle = F.acos((1 - p2 + z2) / (2 * z))
    kite = F.sqrt((4 * z2 - F.pow(1 + z2 - p2, 2)) / 4)
    return (
        F.when(z <= p - 1, F.lit(1.0))
        .when(z <= 1 - p, p2)
        .when((z < 1 + p) & (z > F.abs(1 - p)), (p2 * planet_angle + star_angle - kite) / F.lit(math.pi))
        .when(z.isNotNull(), F.lit(0.0))
    )
