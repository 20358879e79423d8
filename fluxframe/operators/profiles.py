"""Temperature and abundance profiles of many samples over a pressure grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions.expr import ColumnLike, col
from fluxframe.operators.axis import running_total
from fluxframe.operators.groups import with_group_stats

LN10 = math.log(10)


def over_pressures(samples: DataFrame, log_top: float, log_bottom: float, n: int) -> DataFrame:
    """Every sample on a log-even pressure grid: adds layer and pressure (bar).

    The grid is a generated array per sample, so samples are not joined with anything.
    """
    step = (log_bottom - log_top) / (n - 1)
    got = samples.withColumn("layer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return got.withColumn("log_pressure", F.lit(float(log_top)) + F.col("layer") * F.lit(step)).withColumn("pressure", F.pow(F.lit(10.0), F.col("log_pressure")))


def isothermal(temperature: ColumnLike) -> Column:
    return col(temperature) * F.lit(1.0)


def power_law(pressure: ColumnLike, top_pressure: ColumnLike, t0: ColumnLike, alpha: ColumnLike) -> Column:
    return col(t0) * F.pow(col(pressure) / col(top_pressure), col(alpha))


def _irradiated(tau: Column, gamma: Column, t_int: Column, t_eq: Column, share: ColumnLike) -> Column:
    """Two-stream temperature under irradiation; ``share`` is the redistribution of the incident flux."""
    root3 = math.sqrt(3)
    incident = 4 * F.pow(t_eq, 4)  # (sqrt(2) T_eq)^4
    glow = F.lit(2 / 3) + 1 / (gamma * root3) + (gamma / root3 - 1 / (gamma * root3)) * F.exp(-gamma * tau * root3)
    return F.pow(0.75 * F.pow(t_int, 4) * (F.lit(2 / 3) + tau) + 0.75 * incident * col(share) * glow, 0.25)


def guillot(pressure: ColumnLike, kappa: ColumnLike, gamma: ColumnLike, gravity: ColumnLike, t_int: ColumnLike, t_eq: ColumnLike,
            share: ColumnLike = 0.25) -> Column:
    """Pressure in bar; share 1/4 is the global mean, 1/2 the day side, 1 the substellar point."""
    return _irradiated(col(kappa) * col(pressure) * 1e6 / col(gravity), col(gamma), col(t_int), col(t_eq), share)


def guillot_dayside(pressure, kappa, gamma, gravity, t_int, t_eq) -> Column:
    return guillot(pressure, kappa, gamma, gravity, t_int, t_eq, 0.5)


def guillot_global(pressure, kappa, gamma, gravity, t_int, t_eq) -> Column:
    return guillot(pressure, kappa, gamma, gravity, t_int, t_eq, 0.25)


def guillot_delta(pressure: ColumnLike, delta: ColumnLike, gamma: ColumnLike, t_int: ColumnLike, t_eq: ColumnLike) -> Column:
    """Opacity over gravity as one parameter; all parameters count by magnitude."""
    return _irradiated(col(pressure) * 1e6 * F.abs(col(delta)), F.abs(col(gamma)), F.abs(col(t_int)), F.abs(col(t_eq)), 0.25)


def guillot_metallic(pressure, gamma, gravity, t_int, t_eq, kappa_solar: ColumnLike, metallicity: ColumnLike = 1.0) -> Column:
    return guillot_global(pressure, col(kappa_solar) * col(metallicity), gamma, gravity, t_int, t_eq)


def guillot_modified(pressure, delta, gamma, t_int, t_eq, p_trans: ColumnLike, alpha: ColumnLike) -> Column:
    return guillot_delta(pressure, delta, gamma, t_int, t_eq) * (1 - col(alpha) / (1 + col(pressure) / col(p_trans)))


def smoothed_grid(samples: DataFrame, profile, by: Sequence[str], n: int = 260, window: int = 25, stride: int = 2,
                  log_top: float = -8.0, log_bottom: float = 5.0, low: float = 1e-6, high: float = 1e3) -> DataFrame:
    """Profile on a fine grid, running mean in log pressure and temperature, every ``stride``-th point within the limits."""
    from fluxframe.operators.smooth import running_mean

    fine = over_pressures(samples, log_top, log_bottom, n).withColumn("temperature", profile(F.col("pressure")))
    mean_t = running_mean(fine, by, "layer", "temperature", window, "__t")
    both = running_mean(mean_t.select(*fine.columns), by, "layer", "log_pressure", window, "__lp")
    got = mean_t.select(*by, "layer", "__t").join(both.select(*by, "layer", "__lp"), [*by, "layer"])
    kept = got.withColumn("pressure", F.pow(F.lit(10.0), "__lp")).filter((F.col("pressure") <= high) & (F.col("pressure") >= low))
    first = with_group_stats(kept, by, {"__first": F.min("layer")})
    picked = first.filter(F.pmod(F.col("layer") - F.col("__first"), F.lit(stride)) == 0)
    return picked.select(*by, "layer", "pressure", F.col("__t").alias("temperature"))


def _interval(x: Column, nodes: Sequence[float]) -> Column:
    """0-based interval of x between ascending nodes, the ends included."""
    out = F.lit(len(nodes) - 2)
    for i in range(len(nodes) - 2, 0, -1):
        out = F.when(x < F.lit(float(nodes[i])), F.lit(i - 1)).otherwise(out)
    return out


def even_nodes(log_top: float, log_bottom: float, n_inner: int) -> list[float]:
    return [log_top + (log_bottom - log_top) * i / (n_inner + 1) for i in range(n_inner + 2)]


def linear_spline(x: ColumnLike, nodes: Sequence[float], values: Sequence[ColumnLike]) -> Column:
    """Straight lines between node values (columns) at fixed nodes, clamped beyond the ends."""
    t, y = col(x), [col(v) for v in values]
    pieces = F.lit(None).cast("double")
    for i in range(len(nodes) - 2, -1, -1):
        line = y[i] + (y[i + 1] - y[i]) / F.lit(float(nodes[i + 1] - nodes[i])) * (t - F.lit(float(nodes[i])))
        pieces = line if i == len(nodes) - 2 else F.when(t < F.lit(float(nodes[i + 1])), line).otherwise(pieces)
    return F.when(t <= F.lit(float(nodes[0])), y[0]).when(t >= F.lit(float(nodes[-1])), y[-1]).otherwise(pieces)


def _pchip_slopes(h: list[float], d: list[Column]) -> list[Column]:
    """Node slopes of the shape-preserving cubic: harmonic means inside, limited three-point formula at the ends."""
    n = len(d) + 1
    if n == 2:
        return [d[0], d[0]]

    def end(h0: float, h1: float, d0: Column, d1: Column) -> Column:
        s = (F.lit(2 * h0 + h1) * d0 - F.lit(h0) * d1) / F.lit(h0 + h1)
        return F.when(F.signum(s) != F.signum(d0), F.lit(0.0)).when(
            (F.signum(d0) != F.signum(d1)) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)

    slopes = [end(h[0], h[1], d[0], d[1])]
    for i in range(1, n - 1):
        w1, w2 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        mean = F.lit(w1 + w2) / (F.lit(w1) / d[i - 1] + F.lit(w2) / d[i])
        slopes.append(F.when(d[i - 1] * d[i] > 0, mean).otherwise(F.lit(0.0)))
    slopes.append(end(h[-1], h[-2], d[-1], d[-2]))
    return slopes


def with_pchip(df: DataFrame, x: ColumnLike, nodes: Sequence[float], values: Sequence[ColumnLike], out: str) -> DataFrame:
    """Monotone cubic through node values (columns) at fixed ascending nodes.

    Slopes become columns of the sample once, then each row takes the cubic of its interval.
    """
    h = [float(b - a) for a, b in zip(nodes, nodes[1:])]
    y = [col(v) for v in values]
    d = [(b - a) / F.lit(w) for a, b, w in zip(y, y[1:], h)]
    work = {f"__d{i}": c for i, c in enumerate(d)}
    df = df.withColumns({**work, "__x": col(x)})
    slopes = _pchip_slopes(h, [F.col(n) for n in work])
    df = df.withColumns({f"__s{i}": s for i, s in enumerate(slopes)})
    packed = F.array(*[F.struct(F.lit(float(nodes[i])).alias("x"), F.lit(h[i]).alias("h"), y[i].alias("a"), y[i + 1].alias("b"),
                                F.col(f"__s{i}").alias("p"), F.col(f"__s{i + 1}").alias("q")) for i in range(len(h))])
    df = df.withColumn("__k", F.get(packed, _interval(F.col("__x"), nodes)))
    k, t = F.col("__k"), (F.col("__x") - F.col("__k.x")) / F.col("__k.h")
    t2, t3 = t * t, t * t * t
    value = (
        (2 * t3 - 3 * t2 + 1) * k["a"] + (t3 - 2 * t2 + t) * k["h"] * k["p"] + (3 * t2 - 2 * t3) * k["b"] + (t3 - t2) * k["h"] * k["q"]
    )
    drop = [*work, "__x", "__k", *[f"__s{i}" for i in range(len(nodes))]]
    return df.withColumn(out, value).drop(*drop)


def stepped(log_pressure: ColumnLike, nodes: Sequence[float], log_values: Sequence[ColumnLike]) -> Column:
    """10^value per step, from high to low pressure.

    ``nodes`` holds the bottom, the step edges and the top in falling order; the
    i-th value applies at or above its lower edge, the last one below the last edge.
    """
    if len(log_values) != len(nodes) - 1:
        raise ValueError("one value less than nodes is needed")
    t = col(log_pressure)
    out = F.pow(F.lit(10.0), col(log_values[-1]))
    for i in range(len(nodes) - 3, -1, -1):
        out = F.when(t >= F.lit(float(nodes[i + 1])), F.pow(F.lit(10.0), col(log_values[i]))).otherwise(out)
    return out


def three_region(df: DataFrame, points: Sequence[ColumnLike], t_set: ColumnLike, alpha: tuple[ColumnLike, ColumnLike],
                 beta: tuple[float, float] = (0.5, 0.5), by: Sequence[str] = ("sample_id",), out: str = "temperature",
                 levels: Sequence[float] | None = None) -> DataFrame:
    """Three-region profile: two power-law regions over an isothermal one.

    ``points`` are log10 pressures: top, boundary 1-2, inversion, boundary 2-3,
    and the level at which ``t_set`` holds; the layer nearest to that level sets
    the anchor in regions 1 and 2. ``levels`` are the log10 pressures of all
    samples where these share one grid: each row then finds the anchor among
    them, and samples meet nothing.
    """
    top, p1, p2, p3, p_set = (col(p) for p in points)
    a1, a2 = (col(a) for a in alpha)
    at = F.pow(F.lit(10.0), p_set)
    base = df.withColumn("__off", F.abs(F.col("pressure") - at))
    # The first layer among equally near ones.
    if levels is None:
        near = with_group_stats(base, by, {"__anchor": F.min_by("log_pressure", F.struct("__off", "pressure"))})
    else:
        grid = [(F.lit(float(v)), F.pow(F.lit(10.0), F.lit(float(v)))) for v in levels]
        places = [F.struct(F.abs(p - at).alias("off"), p.alias("p"), v.alias("at")) for v, p in grid]
        near = base.withColumn("__anchor", F.array_min(F.array(*places))["at"])

    def bend(delta: Column, a: Column, b: float) -> Column:
        return F.pow(delta / a, 1 / b)

    anchor, t = F.col("__anchor"), col(t_set)
    deep, middle = p_set >= p3, (p_set < p3) & (p_set >= p1)
    # Temperatures at the inversion (t2), the first boundary (t1), below (t3) and at the top (t0), by where t_set lies.
    t0_high = t - bend(anchor - top, a1, beta[0])
    t1_high = t0_high + bend(p1 - top, a1, beta[0])
    t2 = F.when(deep, t - bend(p3 - p2, a2, beta[1])).when(middle, t - bend(anchor - p2, a2, beta[1])).otherwise(t1_high - bend(p1 - p2, a2, beta[1]))
    t3 = F.when(deep, t).otherwise(t2 + bend(p3 - p2, a2, beta[1]))
    t1 = F.when(middle, t2 + bend(p1 - p2, a2, beta[0])).otherwise(t2 + bend(p1 - p2, a2, beta[1]))
    t0 = F.when(deep | middle, t1 - bend(p1 - top, a1, beta[0])).otherwise(t0_high)
    log_p = F.col("log_pressure")
    value = (
        F.when(log_p < p1, t0 + bend(log_p - top, a1, beta[0]))
        .when(log_p < p3, t2 + bend(log_p - p2, a2, beta[1]))
        .otherwise(t3)
    )
    return near.withColumn(out, value).drop("__off", "__anchor")


def quadratic_spline_weights(nodes: Sequence[float]) -> tuple[list[list[tuple[float, ...]]], list[float]]:
    """Quadratic spline through n nodes as linear maps of the node values.

    Knots lie midway between inner nodes (the end intervals are merged), as for
    an interpolating spline of even degree. Entry [piece][node] holds the
    polynomial coefficients (1, x, x^2) this node's unit value contributes.
    """
    import numpy as np

    x = np.asarray(nodes, dtype=float)
    n = len(x)
    breaks = [x[0], *[(x[i] + x[i + 1]) / 2 for i in range(1, n - 2)], x[-1]]
    pieces = len(breaks) - 1
    rows, rhs = [], []
    piece_of = np.clip(np.searchsorted(breaks, x, side="right") - 1, 0, pieces - 1)
    for i in range(n):
        row = np.zeros(3 * pieces)
        row[3 * piece_of[i]:3 * piece_of[i] + 3] = [1, x[i], x[i] ** 2]
        rows.append(row)
        rhs.append(np.eye(n)[i])
    for b in range(1, pieces):
        at = breaks[b]
        for basis in ([1, at, at**2], [0, 1, 2 * at]):
            row = np.zeros(3 * pieces)
            row[3 * (b - 1):3 * b] = basis
            row[3 * b:3 * b + 3] = [-v for v in basis]
            rows.append(row)
            rhs.append(np.zeros(n))
    solved = np.linalg.solve(np.array(rows), np.array(rhs))
    return [[tuple(float(v) for v in solved[3 * p:3 * p + 3, i]) for i in range(n)] for p in range(pieces)], [float(b) for b in breaks]


def gradient_profile(df: DataFrame, slopes: Sequence[ColumnLike], t_bottom: ColumnLike, by: Sequence[str], log_top: float = -3.0,
                     log_bottom: float = 3.0, out: str = "temperature", span: float | str | None = "auto") -> DataFrame:
    """ln T integrated upwards from the bottom with slopes d ln T / d ln P, isothermal above ``log_top``.

    Slopes are given at even nodes from ``log_top`` to ``log_bottom`` and joined
    by a quadratic spline. ``df`` has the columns ``by``, pressure and log_pressure.
    """
    n = len(slopes)
    nodes = [log_top + (log_bottom - log_top) * i / (n - 1) for i in range(n)]
    weights, breaks = quadratic_spline_weights(nodes)
    t, s = F.col("log_pressure"), [col(v) for v in slopes]

    def piece(p: int) -> Column:
        value = None
        for i in range(n):
            c0, c1, c2 = weights[p][i]
            term = s[i] * (F.lit(c0) + F.lit(c1) * t + F.lit(c2) * t * t)
            value = term if value is None else value + term
        return value

    slope = piece(len(weights) - 1)
    for p in range(len(weights) - 2, -1, -1):
        slope = F.when(t < F.lit(breaks[p + 1]), piece(p)).otherwise(slope)
    from fluxframe.operators.axis import neighbours, resolve_span

    span = resolve_span(df, by, "log_pressure", span)
    lower = neighbours(df.withColumn("__s", slope), by, "log_pressure", {"__ns": ("__s", 1), "__nt": ("log_pressure", 1)}, span=span)
    # One step upwards: ln T falls by the slope of the layer below times the step in ln P. Nothing above log_top.
    step = F.when(F.col("pressure") >= F.lit(10.0**log_top), -F.col("__ns") * (F.col("__nt") - t) * F.lit(LN10))
    got = running_total(lower.withColumn("__step", step), by, "log_pressure", {"__sum": "__step"}, descending=True, span=span)
    return got.withColumn(out, col(t_bottom) * F.exp("__sum")).select(*df.columns, out)
