"""Work along the layers of atmospheric columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fluxframe.functions import constants as k
from fluxframe.functions.expr import ColumnLike, col
from fluxframe.functions.physics import planck_bin_mean, planck_hz_dt
from fluxframe.operators.axis import neighbours, resolve_span, running_total
from fluxframe.operators.groups import with_group_stats

Span = float | str | None


def cumulative_trapz(df: DataFrame, by: Sequence[str], x: str = "pressure", y: str = "kappa", factor: float = 1.0, out: str = "tau",
                     span: Span = "auto") -> DataFrame:
    """Running trapezoid integral of ``factor`` y dx, 0 at the first point."""
    span = resolve_span(df, by, x, span)
    near = neighbours(df, by, x, {"__px": (x, -1), "__py": (y, -1)}, span=span)
    step = (F.col(y) + F.col("__py")) / 2 * F.lit(float(factor)) * (F.col(x) - F.col("__px"))
    return running_total(near.withColumn("__step", step), by, x, {out: "__step"}, span=span).drop("__px", "__py", "__step")


def _parabola_integral(x, y, z, fx, fy, fz, a, b) -> Column:
    """Integral from a to b of the parabola through (x, fx), (y, fy), (z, fz), in Newton form around x."""
    slope = (fy - fx) / (y - x)
    bend = ((fz - fy) / (z - y) - slope) / (z - x)
    u, v, h = a - x, b - x, y - x

    def primitive(t):
        return fx * t + slope * t * t / 2 + bend * (t * t * t / 3 - h * t * t / 2)

    return primitive(v) - primitive(u)


def hydrostatic_radius(df: DataFrame, by: Sequence[str], reference_pressure: ColumnLike, gravity: ColumnLike, planet_radius: ColumnLike,
                       pressure: str = "pressure", density: str = "density", variable_gravity: bool = True, out: str = "radius",
                       span: Span = "auto") -> DataFrame:
    """Radius of every layer from hydrostatic equilibrium, anchored at the reference pressure.

    1/density is integrated from the bottom by parabolas over three layers (a
    trapezoid in the lowest interval).
    """
    base = df.withColumn("__f", 1 / F.col(density)).withColumn("__x", F.col(pressure))
    span = resolve_span(base, by, pressure, span)
    wanted = {"__y": ("__x", 1), "__fy": ("__f", 1), "__z": ("__x", 2), "__fz": ("__f", 2)}
    near = neighbours(base, by, pressure, wanted, span=span)
    x, y, z, fx, fy, fz = (F.col(c) for c in ("__x", "__y", "__z", "__f", "__fy", "__fz"))
    scale = 1 / col(gravity) / F.pow(col(planet_radius), 2) if variable_gravity else -1 / col(gravity)
    flat = (fx + fy) * (y - x) / 2
    part = F.when(z.isNotNull(), _parabola_integral(x, y, z, fx, fy, fz, x, y)).when(y.isNotNull(), flat)
    p0 = col(reference_pressure)
    above = F.when(z.isNotNull(), _parabola_integral(x, y, z, fx, fy, fz, p0, y)).otherwise((fx + fy) * (y - p0) / 2)
    near = near.withColumns({"__step": -part * scale, "__part": -above * scale, "__hit": (y > p0) & (x <= p0)})
    summed = running_total(near, by, pressure, {"__sum": "__step"}, descending=True, span=span)
    # Altitude of the anchor: that of the layer below it plus the part up to the reference pressure.
    level = F.when(F.col("__hit"), F.col("__sum") - F.coalesce("__step", F.lit(0.0)) + F.col("__part"))
    anchored = with_group_stats(summed, by, {"__anchor": F.max(level)})
    shift = F.coalesce("__anchor", F.lit(0.0))
    if variable_gravity:
        radius = 1 / (F.col("__sum") + 1 / col(planet_radius) - shift)
    else:
        radius = F.col("__sum") + col(planet_radius) - shift
    return anchored.withColumn(out, radius).select(*df.columns, out)


def pressure_from_radius(df: DataFrame, by: Sequence[str], p_start: float, gravity: float, planet_radius: float,
                         temperature: Callable[[Column], Column], molar_mass: Callable[[Column], Column], radius: str = "radius",
                         out: str = "pressure") -> DataFrame:
    """Pressure along given radii by fourth-order Runge-Kutta in 1/radius, from ``p_start`` (bar) at the first radius.

    ``temperature`` and ``molar_mass`` are column functions of the pressure in
    cgs. A column is one array (its layers are few), folded inside the JVM.
    """
    packed = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-1 / F.col(radius)).alias("v"), F.col(radius).alias(radius)))).alias("__r"))
    factor = F.lit(k.AMU * gravity * planet_radius**2 / k.KB)

    def slope(chi: Column) -> Column:
        p = F.exp(chi)
        return molar_mass(p) * factor / temperature(p)

    def step(state: Column, point: Column) -> Column:
        dv, chi = -point["v"] - state["v"], state["chi"]
        k1 = slope(chi)
        k2 = slope(chi + dv / 2 * k1)
        k3 = slope(chi + dv / 2 * k2)
        k4 = slope(chi + dv * k3)
        new = F.when(state["n"] == 0, chi).otherwise(chi + (k1 + 2 * k2 + 2 * k3 + k4) * dv / 6)
        return F.struct((-point["v"]).alias("v"), new.alias("chi"), (state["n"] + 1).alias("n"), F.concat(state["all"], F.array(F.exp(new) / F.lit(1e6))).alias("all"))

    start = F.struct(F.lit(0.0).alias("v"), F.lit(math.log(p_start * 1e6)).alias("chi"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("all"))
    done = packed.withColumn("__p", F.aggregate("__r", start, step, lambda s: s["all"]))
    return done.select(*by, F.inline(F.arrays_zip(F.transform("__r", lambda e: e[radius]).alias(radius), F.col("__p").alias(out)))).toDF(*by, radius, out)


def curvature_prior(df: DataFrame, by: Sequence[str], gamma: ColumnLike, x: str = "pressure", y: str = "temperature", out: str = "log_prior",
                    span: Span = "auto") -> DataFrame:
    """-1/2 sum(second difference^2) / gamma - 1/2 ln(2 pi gamma)."""
    near = neighbours(df.withColumn("__g", col(gamma)), by, x, {"__p": (y, -1), "__n": (y, 1)}, span=span)
    bend = F.col("__n") - 2 * F.col(y) + F.col("__p")
    got = near.groupBy(*by).agg(F.coalesce(F.sum(bend * bend), F.lit(0.0)).alias("__s"), F.max("__g").alias("__g"))
    return got.select(*by, (F.lit(-0.5) * F.col("__s") / F.col("__g") - F.lit(0.5) * F.log(F.lit(2 * math.pi) * F.col("__g"))).alias(out))


def level_crossing(df: DataFrame, by: Sequence[str], curve: str, profile: str, x: str = "pressure", out: str = "level", span: Span = "auto") -> DataFrame:
    """Mid-point of the last interval where curve - profile changes sign; the lowest ``x`` if it never does."""
    base = df.withColumn("__d", F.col(curve) - F.col(profile))
    near = neighbours(base, by, x, {"__pd": ("__d", -1), "__px": (x, -1)}, span=span)
    crossed = F.col("__d") * F.col("__pd") < 0
    middle = F.max_by((F.col(x) + F.col("__px")) / 2, F.when(crossed, F.col(x)))
    return near.groupBy(*by).agg(F.coalesce(middle, F.min(x)).alias(out))


def level_of(df: DataFrame, by: Sequence[str], depth: str, value: str, target: float = 2 / 3, x: str = "pressure", out: str = "level",
             span: Span = "auto") -> DataFrame:
    """``value`` where the cumulative ``depth`` reaches ``target``; the deepest value if it never does."""
    near = neighbours(df, by, x, {"__pd": (depth, -1), "__pv": (value, -1)}, span=span)
    t = F.lit(float(target))
    hit = (F.col("__pd") < t) & (F.col(depth) >= t)
    there = F.col("__pv") + (F.col(value) - F.col("__pv")) * (t - F.col("__pd")) / (F.col(depth) - F.col("__pd"))
    first = F.min_by(there, F.when(hit, F.col(x)))
    return near.groupBy(*by).agg(F.when(F.max(depth) > t, F.coalesce(first, F.max_by(value, x))).otherwise(F.max_by(value, x)).alias(out))


def cloud_profile(pressure: ColumnLike, base_pressure: ColumnLike, base_value: ColumnLike, settling: ColumnLike) -> Column:
    """Condensate X (P / P_base)^f above the cloud base, 0 below."""
    p, b = col(pressure), col(base_pressure)
    return F.when(p < b, col(base_value) * F.pow(p / b, col(settling))).otherwise(F.lit(0.0))


def mix_opacity(opacity: DataFrame, abundances: DataFrame, on: Sequence[str], by: Sequence[str], continuum: str | None = None, out: str = "kappa") -> DataFrame:
    """Sum over species of mass fraction times opacity, plus a continuum that is the same for all of them."""
    joined = opacity.join(abundances, list(on))
    value = F.sum(F.col("mass_fraction") * F.col("kappa"))
    if continuum:
        value = value + F.max(continuum)
    return joined.groupBy(*by).agg(value.alias(out))


def g_average(df: DataFrame, by: Sequence[str], species: Sequence[str] = ("species",), mu: float = 1.0, tau: str = "tau", weight: str = "weight",
              out: str = "transmission") -> DataFrame:
    """Weighted mean of exp(-tau / mu) over the quadrature points, then the product over species."""
    mean = df.groupBy(*by, *species).agg(F.sum(F.col(weight) * F.exp(-F.col(tau) / F.lit(float(mu)))).alias("__t"))
    return mean.groupBy(*by).agg(F.product("__t").alias(out))


def planck_mean(df: DataFrame, by: Sequence[str], temperature: str = "temperature", kappa: str = "kappa", weight: str = "weight",
                f_low: str = "f_low", f_high: str = "f_high", out: str = "planck_mean") -> DataFrame:
    """Planck-weighted mean opacity. Rows are (by, frequency bin, quadrature point); weights of a bin add up to 1."""
    source = planck_bin_mean(temperature, f_low, f_high) * (F.col(f_high) - F.col(f_low)) * F.col(weight)
    return df.groupBy(*by).agg((F.sum(source * F.col(kappa)) / F.sum(source)).alias(out))


def rosseland_mean(df: DataFrame, by: Sequence[str], temperature: str = "temperature", kappa: str = "kappa", weight: str = "weight",
                   f_low: str = "f_low", f_high: str = "f_high", out: str = "rosseland_mean") -> DataFrame:
    """Harmonic mean weighted with dB/dT at the middle of each frequency bin."""
    source = planck_hz_dt(temperature, (F.col(f_low) + F.col(f_high)) / 2) * (F.col(f_high) - F.col(f_low)) * F.col(weight)
    return df.groupBy(*by).agg((F.sum(source) / F.sum(source / F.col(kappa))).alias(out))


def contribution_share(df: DataFrame, by: Sequence[str], value: str = "contribution", out: str = "share") -> DataFrame:
    got = with_group_stats(df, by, {"__t": F.sum(value)})
    return got.withColumn(out, F.try_divide(value, "__t")).drop("__t")


def layer_weights(df: DataFrame, by: Sequence[str], channel: str = "channel", layer: str = "layer", pressure: str = "pressure",
                  wavelength: str = "wavelength", flux: str = "flux", contribution: str = "contribution", out: str = "layer_weight") -> DataFrame:
    """Contribution per layer, weighted with the flux in each channel and per unit of log pressure, adding up to 1.

    A channel counts with flux times its frequency step, a layer with its step
    in log10 pressure; the last step repeats the one before.
    """
    by = list(by)

    def step(table: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        near = neighbours(table.withColumn("__v", value), by, order, {"__n": ("__v", 1), "__p": ("__v", -1)})
        return near.withColumn(name, F.abs(F.coalesce(F.col("__n") - F.col("__v"), F.col("__v") - F.col("__p")))).drop("__v", "__n", "__p")

    channels = step(df.groupBy(*by, channel).agg(F.max(wavelength).alias("__w"), F.max(flux).alias("__flux")), channel, F.lit(k.C) / F.col("__w"), "__dnu")
    channels = contribution_share(channels.withColumn("__e", F.col("__flux") * F.col("__dnu")), by, "__e", "__cw").select(*by, channel, "__cw")
    levels = step(df.groupBy(*by, layer).agg(F.max(pressure).alias("__lp")), layer, F.log10("__lp"), "__dp")
    levels = contribution_share(levels, by, "__dp", "__lw").select(*by, layer, "__lw")
    joined = df.join(channels, [*by, channel]).join(levels, [*by, layer])
    summed = joined.groupBy(*by, layer).agg(F.sum(F.col(contribution) / F.col("__lw") * F.col("__cw")).alias("__c"))
    return contribution_share(summed, by, "__c", out).drop("__c")


def combine_quantiles(df: DataFrame, column: str, nodes: Sequence[float], weights: Sequence[float], out: str = "combined", negligible: float = 0.01) -> DataFrame:
    """Quantiles of the sum of independent distributions, each given by its quantiles at ``nodes``.

    A further distribution counts only if its top quantile reaches the share
    ``negligible`` of the largest bottom quantile; with 0 all non-negative ones do.

    ``column`` holds one array of quantile arrays per row. Two distributions are
    added by all pairs of their nodes (as many as the nodes squared, a fixed
    number), sorted; the cumulative weights at mid-points are read at the nodes.
    """
    g, w = np.asarray(nodes, dtype=float), np.asarray(weights, dtype=float)
    pair_weight = np.outer(w, w).ravel()
    pair_weight = pair_weight / pair_weight.sum()

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of quantiles plus rows of quantiles."""
        sums = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
        order = np.argsort(sums, axis=1, kind="stable")
        sums = np.take_along_axis(sums, order, axis=1)
        share = pair_weight[order]
        middle = np.cumsum(share, axis=1) - share / 2
        sums = np.concatenate([sums, (a[:, -1] + b[:, -1])[:, None]], axis=1)
        middle = np.concatenate([middle, np.ones((len(a), 1))], axis=1)
        at = np.clip((middle[:, :, None] <= g[None, None, :]).sum(axis=1) - 1, 0, middle.shape[1] - 2)
        x0, x1 = np.take_along_axis(middle, at, 1), np.take_along_axis(middle, at + 1, 1)
        y0, y1 = np.take_along_axis(sums, at, 1), np.take_along_axis(sums, at + 1, 1)
        return y0 + (y1 - y0) / (x1 - x0) * (g[None, :] - x0)

    @F.pandas_udf(ArrayType(DoubleType()))
    def fold(series: pd.Series) -> pd.Series:
        out_rows: list = [None] * len(series)
        sizes: dict[int, list[int]] = {}
        for i, s in enumerate(series):
            sizes.setdefault(len(s), []).append(i)
        for index in sizes.values():
            stack = np.array([[np.asarray(q, dtype=float) for q in series.iloc[i]] for i in index])  # rows, species, nodes
            threshold = stack[:, :, 0].max(axis=1) * negligible
            total = stack[:, 0, :]
            for s in range(1, stack.shape[1]):
                counts = stack[:, s, -1] >= threshold
                if counts.any():
                    total[counts] = add(total[counts], stack[counts, s, :])
            for i, row in zip(index, total):
                out_rows[i] = row.tolist()
        return pd.Series(out_rows)

    return df.withColumn(out, fold(F.col(column)))
