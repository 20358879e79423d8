"""Lookups in gridded tables by equi-joins on cell indices.

A grid becomes a table of cells, each holding the values of its 2^n corners; a
point finds its cell by bracketing its coordinates on the axes and takes one
equi-join. Axes travel as arrays in a scalar subquery.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions.expr import total
from fluxframe.operators.grids import trapezoid_integral
from fluxframe.operators.groups import with_scalars


@dataclass(frozen=True)
class Axis:
    """One grid dimension: its column in the grid and the coordinate column of the points."""

    grid: str
    point: str
    shrink: float = 0.0  # coordinates are moved this far inside the ends
    outside: str = "clamp"  # or "null"


def _with_axes(df: DataFrame, grid: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Add the sorted values of every axis as arrays ``__ax<n>`` (one scalar subquery)."""
    return with_scalars(df, grid, {f"__ax{n}": F.array_sort(F.collect_set(F.col(a.grid).cast("double"))) for n, a in enumerate(axes)})


def cells(grid: DataFrame, axes: Sequence[Axis], value: str | Column, payload: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """(payload, __i0.., __v): the corner values of each cell by corner number (bit n = upper end of axis n).

    ``source`` may give the axis values where ``grid`` is costly to compute.
    """
    value = F.col(value) if isinstance(value, str) else value
    base = _with_axes(grid.withColumn("__val", value), grid if source is None else source, axes)
    at = [F.array_position(F.col(f"__ax{n}"), F.col(a.grid).cast("double")) - 1 for n, a in enumerate(axes)]
    corners = list(itertools.product((0, 1), repeat=len(axes)))
    options = F.array(*[
        F.struct(F.lit(c).alias("c"), *[(at[n] - bits[n]).alias(f"i{n}") for n in range(len(axes))]) for c, bits in enumerate(corners)
    ])
    spread = base.select(*payload, "__val", F.explode(options).alias("__o"), *[F.size(f"__ax{n}").alias(f"__n{n}") for n in range(len(axes))])
    inside = total([((F.col(f"__o.i{n}") < 0) | (F.col(f"__o.i{n}") > F.col(f"__n{n}") - 2)).cast("int") for n in range(len(axes))]) == 0
    keys = [F.col(f"__o.i{n}").cast("bigint").alias(f"__i{n}") for n in range(len(axes))]
    return spread.filter(inside).groupBy(*payload, *keys).agg(
        *[F.max(F.when(F.col("__o.c") == c, F.col("__val"))).alias(f"__v{c}") for c in range(len(corners))])


def bracket(points: DataFrame, grid: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Add the lower cell index ``__i<n>`` and the fraction ``__f<n>`` in the cell per axis."""
    got = _with_axes(points, grid, axes)
    for n, a in enumerate(axes):
        ax, x = F.col(f"__ax{n}"), F.col(a.point).cast("double")
        low, high = F.element_at(ax, 1), F.element_at(ax, -1)
        if a.outside == "null":
            x = F.when((x >= low) & (x <= high), x)
        else:
            x = F.when(x <= low, low + a.shrink).when(x >= high, high - a.shrink).otherwise(x)
        got = got.withColumn("__x", x)
        below = F.size(F.filter(ax, lambda v: v <= F.col("__x")))
        index = F.least(F.greatest(below, F.lit(1)), F.size(ax) - 1)
        got = got.withColumn(f"__i{n}", F.when(F.col("__x").isNotNull(), (index - 1).cast("bigint")))
        start, stop = F.get(ax, F.col(f"__i{n}").cast("int")), F.get(ax, (F.col(f"__i{n}") + 1).cast("int"))
        got = got.withColumn(f"__f{n}", (F.col("__x") - start) / (stop - start)).drop("__x")
    return got.drop(*[f"__ax{n}" for n in range(len(axes))])


def multilinear(axes: Sequence[Axis], first: int = 0) -> Column:
    """Weighted sum of the corner values, axis by axis."""
    values = [F.col(f"__v{c}") for c in range(2 ** len(axes))]
    for n in range(len(axes)):  # the first axis is the highest bit
        half = len(values) // 2
        f = F.col(f"__f{n + first}")
        values = [values[c] + (values[c + half] - values[c]) * f for c in range(half)]
    return values[0]


def _drop_work(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    return df.drop(*[f"__{p}{n}" for p in "if" for n in range(len(axes))], *[f"__v{c}" for c in range(2 ** len(axes))])


def grid_lookup(points: DataFrame, grid: DataFrame, axes: Sequence[Axis], value: str, on: Sequence[str] = (), payload: Sequence[str] = (),
                out: str = "value", log10: bool = False) -> DataFrame:
    """Multilinear lookup. ``on`` are further equal keys; ``payload`` grid columns fan a point out.

    ``log10``: the table holds decadic logarithms (NaN counts as -50), the result is 10^x.
    """
    source: str | Column = value
    if log10:
        source = F.when(F.isnan(value) | F.col(value).isNull(), F.lit(-50.0)).otherwise(F.col(value))
    table = cells(grid, axes, source, [*on, *payload])
    keys = [*on, *[f"__i{n}" for n in range(len(axes))]]
    joined = bracket(points, grid, axes).join(table, keys, "left")  # a point without a cell has no value
    result = multilinear(axes)
    return _drop_work(joined.withColumn(out, F.pow(F.lit(10.0), result) if log10 else result), axes)


def cia_lookup(points: DataFrame, cia: DataFrame, on: Sequence[str] = ("pair",), temperature: str = "temperature",
               wavelength: str = "wavelength", out: str = "alpha") -> DataFrame:
    """Pair absorption: linear in T on log10 alpha (clamped), then linear in wavelength (0 outside).

    ``cia`` has ``on``, temperature, wavelength, alpha on one rectangular grid.
    """
    axes = [Axis("temperature", temperature), Axis("wavelength", wavelength, outside="null")]
    table = cells(cia, axes, F.log10("alpha"), on)
    located = bracket(points, cia, axes)
    joined = located.join(table, [*on, "__i0", "__i1"], "left")
    v = [F.col(f"__v{c}") for c in range(4)]  # bits: temperature, wavelength
    ft, fw = F.col("__f0"), F.col("__f1")
    left = F.pow(F.lit(10.0), v[0] + (v[2] - v[0]) * ft)
    right = F.pow(F.lit(10.0), v[1] + (v[3] - v[1]) * ft)
    value = F.coalesce(left + (right - left) * fw, F.lit(0.0))
    return _drop_work(joined.withColumn(out, value), axes)


# Fixed value: number density of an ideal gas at 273.15 K and one atmosphere (cm^-3).
LOSCHMIDT = 2.686780111798444e19


def cia_opacity(alpha: Column, combined_mass_fraction: Column, weight: Column, mean_molar_mass: Column, pressure: Column,
                temperature: Column) -> Column:
    """Absorption per mass from the pair table value; ``weight`` is the product of the two molar masses."""
    density = mean_molar_mass / F.lit(k.AMU * LOSCHMIDT**2) * pressure / F.lit(k.KB) / temperature
    return alpha * combined_mass_fraction / weight * density


def star_lookup(stars: DataFrame, grid: DataFrame, teff: str = "teff", span: float | str | None = "auto") -> DataFrame:
    """Blend the two neighbouring template spectra in log T, then scale the total flux to sigma T^4.

    ``grid``: log10_teff, wavelength (cm), flux, radius. Beyond the grid the end
    template is used. The total of a blend is the blend of the totals, so the
    integral runs once per template and no star needs one.
    """
    axes = [Axis("log10_teff", "__log_t")]
    nu = grid.withColumn("__nu", F.lit(k.C) / F.col("wavelength"))
    totals = trapezoid_integral(nu, ["log10_teff"], "__nu", "flux", "__norm", span)
    template = grid.groupBy("log10_teff").agg(F.max("radius").alias("radius")).join(totals, "log10_teff")
    full = grid.select("log10_teff", "wavelength", "flux").join(template, "log10_teff")
    levels = grid.select("log10_teff")
    located = bracket(stars.withColumn("__log_t", F.log10(teff)), levels, axes)
    table = cells(full, axes, F.struct("flux", "radius", "__norm"), ["wavelength"], levels)

    def blend(name: str) -> Column:
        low, high = F.col(f"__v0.{name}"), F.col(f"__v1.{name}")
        return low + (high - low) * F.col("__f0")

    got = located.join(table, "__i0")
    scaled = blend("flux") / blend("__norm") * F.lit(k.SIGMA) * F.pow(F.col(teff), 4)
    return got.select(*stars.columns, "wavelength", scaled.alias("flux"), blend("radius").alias("radius"))


def quench(layers: DataFrame, by: Sequence[str], p_quench: float, species: Sequence[str] = ("CH4", "CO", "H2O"), name: str = "species",
           value: str = "mass_fraction", pressure: str = "pressure") -> DataFrame:
    """Above the quench level the listed species keep the value at the first layer at or below it."""
    keys = [*by, name]
    at = F.col(pressure) >= F.lit(float(p_quench))
    listed = layers.filter(F.col(name).isin(list(species)))
    frozen = listed.groupBy(*keys).agg(
        F.coalesce(F.min_by(value, F.when(at, F.col(pressure))), F.max_by(value, pressure)).alias("__q"))
    got = layers.join(frozen, keys, "left")
    new = F.when((F.col(pressure) < F.lit(float(p_quench))) & F.col("__q").isNotNull(), F.col("__q")).otherwise(F.col(value))
    return got.withColumn(value, new).drop("__q")


def to_mass_opacity(df: DataFrame, masses: DataFrame, cross_section: str = "cross_section", species: str = "species", out: str = "kappa") -> DataFrame:
    """Cross-section per particle to opacity per mass; negative values count as 0, a species without a molar mass gives NULL."""
    return df.join(masses.select(species, "molar_mass"), species, "left").withColumn(
        out, F.greatest(F.col(cross_section), F.lit(0.0)) / (F.col("molar_mass") * F.lit(k.AMU)))


__all__ = ["Axis", "grid_lookup", "cia_lookup", "cia_opacity", "star_lookup", "quench", "to_mass_opacity"]
