"""Grids: bin edges, overlap rebinning, interpolation, clipping, generated grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.operators.axis import axis_stats, nearest_known, neighbours, resolve_span, running_total
from fluxframe.operators.groups import with_group_stats, with_scalars

Span = float | str | None


def with_bin_widths(df: DataFrame, by: Sequence[str], x: str = "wavelength", out: str = "bin_width", span: Span = "auto") -> DataFrame:
    """Forward difference; the last point repeats the difference before it."""
    near = neighbours(df, by, x, {"__n": (x, 1), "__p": (x, -1)}, span=span)
    width = F.coalesce(F.col("__n") - F.col(x), F.col(x) - F.col("__p"))
    return near.withColumn(out, width).drop("__n", "__p")


def bin_edges(df: DataFrame, by: Sequence[str], x: str = "wavelength", span: Span = "auto") -> DataFrame:
    """Add ``bin_low`` and ``bin_high``: mid-points, outer edges mirrored."""
    near = neighbours(df, by, x, {"__n": (x, 1), "__p": (x, -1)}, span=span)
    at, up, down = F.col(x), F.col("__n"), F.col("__p")
    low = F.coalesce(at - (at - down) / 2, at - (up - at) / 2)
    high = F.coalesce(up - (up - at) / 2, at + (at - down) / 2)
    return near.withColumn("bin_low", low).withColumn("bin_high", high).drop("__n", "__p")


def bin_resolving_power(df: DataFrame, by: Sequence[str], x: str = "wavelength", out: str = "resolving_power", span: Span = "auto") -> DataFrame:
    """x / (width of the mid-point bin); the end points repeat their neighbour's value."""
    wanted = {"__p2": (x, -2), "__p1": (x, -1), "__n1": (x, 1), "__n2": (x, 2)}
    near = neighbours(df, by, x, wanted, span=span)
    at, p1, p2, n1, n2 = F.col(x), F.col("__p1"), F.col("__p2"), F.col("__n1"), F.col("__n2")
    value = F.coalesce(at / ((n1 - p1) / 2), n1 / ((n2 - at) / 2), p1 / ((at - p2) / 2))
    return near.withColumn(out, value).drop(*wanted)


def mean_resolving_power(df: DataFrame, by: Sequence[str], x: str = "wavelength", span: Span = "auto") -> DataFrame:
    near = neighbours(df, by, x, {"__n": (x, 1)}, span=span)
    step = F.col("__n") - F.col(x)
    return near.groupBy(*by).agg(F.avg(F.col(x) / step + F.lit(0.5)).alias("resolving_power"))


def _pieces(low: Column, high: Column, bucket: float) -> Column:
    w = F.lit(float(bucket))
    return F.explode(F.sequence(F.floor(low / w), F.floor(high / w)))


def rebin(
    spec: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    x: str = "wavelength",
    y: str = "flux",
    target_by: Sequence[str] | None = None,
    target: str = "wavelength",
    widths: str | None = None,
    strict: bool = True,
    bucket: float | None = None,
    span: Span = "auto",
) -> DataFrame:
    """Mean of the piecewise-linear spectrum over each target bin (flux conserving).

    ``by`` keys one spectrum; ``target_by`` (default ``by``) is the part of it
    that keys a target grid. Bins come from ``widths`` or from mid-points.
    Segments and bins meet in an equi-join on axis buckets; a pair that shares
    several buckets counts in the first of them only. With ``strict`` a spectrum
    that does not reach beyond both outer edges of its bins fails the job,
    otherwise the bins it does not cover are NULL. A grid needs two bins or more.
    """
    by = list(by)
    target_by = by if target_by is None else list(target_by)
    spec = spec.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    step = None
    if span == "auto":
        span, step = axis_stats(spec, by, "__x")
    if widths is None:
        grid = targets.select(*target_by, F.col(target).alias("__t"))
        grid_span, grid_step = axis_stats(grid, target_by, "__t") if bucket is None or span is not None else (None, None)
        bins = bin_edges(grid, target_by, "__t", span=grid_span)
    else:
        grid_step = targets.agg(F.avg(widths).alias("w")).first()["w"] if bucket is None else None
        t, half = F.col(target), F.col(widths) / 2
        bins = targets.select(*target_by, t.alias("__t"), (t - half).alias("bin_low"), (t + half).alias("bin_high"))

    near = neighbours(spec, by, "__x", {"__x1": ("__x", 1), "__y1": ("__y", 1)}, span=span)
    segments = near.filter(F.col("__x1").isNotNull())
    if bucket is None:
        step = axis_stats(spec, by, "__x")[1] if step is None else step
        bucket = max(w for w in (grid_step, step, 1e-300) if w is not None)

    message = F.lit("rebin: fewer than two bins, or the spectrum does not reach beyond the outer bin edges")
    ends = {"__min": F.min("__x"), "__max": F.max("__x")}
    reach = spec.groupBy(*by).agg(*[c.alias(n) for n, c in ends.items()])
    asked = {"__low": F.min("bin_low"), "__high": F.max("bin_high"), "__bins": F.count(F.lit(1))}
    if target_by:
        scope = reach.join(bins.groupBy(*target_by).agg(*[c.alias(n) for n, c in asked.items()]), target_by)
    else:
        scope = with_scalars(reach, bins, asked)

    w = F.lit(float(bucket))
    left = segments.withColumn("__b", _pieces(F.col("__x"), F.col("__x1"), bucket))
    right = bins.withColumn("__b", _pieces(F.col("bin_low"), F.col("bin_high"), bucket))
    first = F.greatest(F.floor(F.col("__x") / w), F.floor(F.col("bin_low") / w))
    pairs = left.join(right, [*target_by, "__b"]).filter(
        (F.col("__x1") > F.col("bin_low")) & (F.col("__x") < F.col("bin_high")) & (F.col("__b") == first)
    )
    lo, hi = F.greatest("__x", "bin_low"), F.least("__x1", "bin_high")
    slope = (F.col("__y1") - F.col("__y")) / (F.col("__x1") - F.col("__x"))
    area = (F.col("__y") + slope * ((lo + hi) / 2 - F.col("__x"))) * (hi - lo)
    sums = (
        pairs.select(*by, "__t", "bin_low", "bin_high", area.alias("__a"), (hi - lo).alias("__l"))
        .groupBy(*by, "__t", "bin_low", "bin_high")
        .agg(F.try_divide(F.sum("__a"), F.sum(F.when(F.col("__a").isNotNull(), F.col("__l")))).alias("__v"))  # over what is not masked
    )
    if not by:
        # A single spectrum: its limits are scalars, the bins drive the join.
        every = with_scalars(with_scalars(bins, bins, asked), spec, ends)
    elif strict:
        # One row per spectrum drives the join, so a spectrum without any overlap fails too.
        covered = (F.col("__min") < F.col("__low")) & (F.col("__max") > F.col("__high")) & (F.col("__bins") >= 2)
        checked = scope.select(*by, covered.alias("__ok")).join(sums.hint("merge"), by, "left")  # both have rows of every spectrum
        value = F.when(F.col("__ok"), F.col("__v")).otherwise(F.raise_error(message).cast("double"))
        return checked.select(*by, F.col("__t").alias(x), "bin_low", "bin_high", value.alias(y))
    elif target_by:
        every = scope.join(bins, target_by)
    else:
        # The shared grid travels as one array; the result has every bin of every spectrum anyway.
        grid = bins.agg(F.collect_list(F.struct("__t", "bin_low", "bin_high"))).scalar()
        every = scope.select("*", F.inline(grid))
    inside = (F.col("__min") < F.col("bin_low")) & (F.col("__max") > F.col("bin_high")) & (F.col("__bins") >= 2)
    value = F.when(inside, F.col("__v"))
    if strict:
        value = F.when(inside, F.col("__v")).otherwise(F.raise_error(message).cast("double"))
    return every.join(sums.hint("merge"), [*by, "__t", "bin_low", "bin_high"], "left").select(
        *by, F.col("__t").alias(x), "bin_low", "bin_high", value.alias(y))


def band_average(
    spec: DataFrame, bands: DataFrame, by: Sequence[str], x: str = "wavelength", y: str = "flux",
    band: str = "band", low: str = "w_low", high: str = "w_high",
    transform=None, bucket: float | None = None, span: Span = "auto", band_by: Sequence[str] = (),
) -> DataFrame:
    """Top-hat mean of each spectrum over each band. ``transform(flux, x)`` may weight the flux first.

    Bands hold for all spectra, or for those with the same values of ``band_by``, columns of both.

    A band that the spectrum does not cover, or in which a point is masked, is NULL.
    """
    flux = F.col(y) if transform is None else transform(F.col(y), F.col(x))
    near = neighbours(spec.select(*by, F.col(x).alias("__x"), flux.alias("__y")), by, "__x",
                      {"__x1": ("__x", 1), "__y1": ("__y", 1)}, span=span)
    segments = near.filter(F.col("__x1").isNotNull())
    shared = bands.select(*band_by, F.col(band).alias("band"), F.col(low).alias("__low"), F.col(high).alias("__high"))
    if bucket is None:
        bucket = shared.agg(F.avg(F.col("__high") - F.col("__low")).alias("w")).first()["w"] or 1.0
    w = F.lit(float(bucket))
    left = segments.withColumn("__b", _pieces(F.col("__x"), F.col("__x1"), bucket))
    right = shared.withColumn("__b", _pieces(F.col("__low"), F.col("__high"), bucket))
    first = F.greatest(F.floor(F.col("__x") / w), F.floor(F.col("__low") / w))
    pairs = left.join(right, [*band_by, "__b"]).filter(
        (F.col("__x1") > F.col("__low")) & (F.col("__x") < F.col("__high")) & (F.col("__b") == first)
    )
    lo, hi = F.greatest("__x", "__low"), F.least("__x1", "__high")
    slope = (F.col("__y1") - F.col("__y")) / (F.col("__x1") - F.col("__x"))
    area = (F.col("__y") + slope * ((lo + hi) / 2 - F.col("__x"))) * (hi - lo)
    known = F.sum(F.when(area.isNotNull(), hi - lo))
    full = known >= (F.max("__high") - F.max("__low")) * F.lit(1 - 1e-9)
    return pairs.groupBy(*by, "band").agg(F.when(full, F.sum(area) / known).alias(y))


def interp_join(
    points: DataFrame, knots: DataFrame, by: Sequence[str], x: str, y: str | Sequence[str],
    knot_x: str | None = None, outside: str = "clamp", ties: Sequence[str] = (), span: Span = "auto",
) -> DataFrame:
    """Linear interpolation of the knots at each point, without a theta join.

    Points and knots are sorted together; each point takes the nearest knot on
    either side. ``ties`` are point columns that make (by, x) unique. Outside the
    knots: ``clamp`` repeats the end value, ``null`` gives NULL, ``error`` fails.
    """
    names = [y] if isinstance(y, str) else list(y)
    extra = [c for c in points.columns if c not in (*by, x)]
    payload = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None).cast("struct<none:int>")
    knot = F.struct(F.col(knot_x or x).cast("double").alias("x"), *[F.col(n).cast("double").alias(n) for n in names])
    a = knots.select(*by, F.col(knot_x or x).cast("double").alias(x), F.lit(0).alias("__kind"), knot.alias("__knot"))
    b = points.select(*by, F.col(x).cast("double").alias(x), F.lit(1).alias("__kind"), payload.alias("__p"))
    both = a.unionByName(b, allowMissingColumns=True)
    tie_columns = ["__kind"]
    for i, t in enumerate(ties):
        both = both.withColumn(f"__tie{i}", F.col(f"__p.{t}"))
        tie_columns.append(f"__tie{i}")
    span = resolve_span(both, by, x, span)
    low = nearest_known(both, by, x, {"__lo": "__knot"}, ties=tie_columns, span=span)
    seen = nearest_known(low, by, x, {"__hi": "__knot"}, after=True, ties=tie_columns, span=span)
    at, lo, hi = F.col(x), F.col("__lo"), F.col("__hi")
    out = []
    for n in names:
        inner = F.when(at == lo["x"], lo[n]).otherwise(lo[n] + (hi[n] - lo[n]) / (hi["x"] - lo["x"]) * (at - lo["x"]))
        both_sides = lo.isNotNull() & (hi.isNotNull() | (at == lo["x"]))
        if outside == "clamp":
            value = F.when(both_sides, inner).otherwise(F.coalesce(lo[n], hi[n]))
        elif outside == "null":
            value = F.when(both_sides, inner)
        else:
            value = F.when(both_sides, inner).otherwise(F.raise_error(F.lit("interpolation outside the knots")).cast("double"))
        out.append(value.alias(n))
    found = seen.filter(F.col("__kind") == 1)
    return found.select(*by, x, *[F.col(f"__p.{c}").alias(c) for c in extra], *out)


def in_range(df: DataFrame, low: float, high: float, x: str = "wavelength") -> DataFrame:
    """Range filter with a small relative tolerance; literals, so it reaches the scan."""
    return df.filter((F.col(x) >= F.lit(low * 0.99999999)) & (F.col(x) <= F.lit(high * 1.00000001)))


def grid_overlap(a: DataFrame, b: DataFrame, by: Sequence[str], x: str = "wavelength") -> DataFrame:
    """Rows of ``a`` within the range of ``b`` of the same group (relative tolerance 1e-15)."""
    tiny = 1e-15
    keys = list(by)
    limits = {"__lo": F.min(x), "__hi": F.max(x)}
    if keys:
        joined = a.join(b.groupBy(*keys).agg(*[c.alias(n) for n, c in limits.items()]), keys)
    else:
        joined = with_scalars(a, b, limits)
    kept = joined.filter((F.col(x) >= F.col("__lo") * F.lit(1 - tiny)) & (F.col(x) <= F.col("__hi") * F.lit(1 + tiny)))
    return kept.select(*a.columns)


def clip_grid(df: DataFrame, by: Sequence[str], low: float, high: float, x: str = "wavelength", stride: int = 1,
              span: Span = "auto") -> DataFrame:
    """Points whose range fully contains [low, high] (one extra point each side), then every n-th from the low end."""
    ends = {"__from": F.max(F.when(F.col(x) <= low, F.col(x))), "__to": F.min(F.when(F.col(x) >= high, F.col(x)))}
    joined = with_group_stats(df, by, ends)
    start, stop = F.coalesce("__from", F.lit(float("-inf"))), F.coalesce("__to", F.lit(float("inf")))
    if stride == 1:
        return joined.filter((F.col(x) >= start) & (F.col(x) <= stop)).select(*df.columns)
    # Rank from the low end; the last kept point must not fall below the request,
    # so up to stride - 1 points behind it stay eligible.
    counted = joined.filter(F.col(x) >= start).withColumn("__i", F.lit(1.0)).withColumn("__in", (F.col(x) <= stop).cast("double"))
    ranked = running_total(counted, by, x, {"__rank": "__i", "__inside": "__in"}, span=span)
    beyond = F.col("__rank") - F.col("__inside")
    picked = (F.pmod(F.col("__rank") - 1, F.lit(float(stride))) == 0) & (beyond <= stride - 1)
    return ranked.filter(picked).select(*df.columns)


def _steps(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, n, 1, partitions) if partitions else spark.range(n)


def grid_exp(spark: SparkSession, start: float, stop: float, resolving_power: float) -> DataFrame:
    """start exp(i/R) up to and including the first point >= stop."""
    n = max(1, math.ceil(resolving_power * math.log(stop / start) - 1e-9)) + 1
    return _steps(spark, n).select("id", (F.lit(float(start)) * F.exp(F.col("id") / F.lit(float(resolving_power)))).alias("wavelength"))


def grid_mul(spark: SparkSession, start: float, stop: float, resolving_power: float) -> DataFrame:
    """start (1 + 1/R)^i inside [start, stop]."""
    ratio = 1 + 1 / resolving_power
    n = math.floor(math.log(stop / start) / math.log(ratio) + 1e-9) + 1
    return _steps(spark, n).select("id", (F.lit(float(start)) * F.pow(F.lit(ratio), F.col("id"))).alias("wavelength"))


def group_grid(limits: DataFrame, start: str, stop: str, resolving_power: float, multiplicative: bool = True) -> DataFrame:
    """One constant-resolving-power grid per row of ``limits``: H1/H2 for many ranges at once."""
    r = float(resolving_power)
    lo, hi = F.col(start), F.col(stop)
    if multiplicative:
        ratio = 1 + 1 / r
        last = F.floor(F.log(hi / lo) / F.lit(math.log(ratio)) + F.lit(1e-9))
        value = lo * F.pow(F.lit(ratio), F.col("i"))
    else:
        last = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(r) * F.log(hi / lo) - F.lit(1e-9)))
        value = lo * F.exp(F.col("i") / F.lit(r))
    return limits.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn("wavelength", value)


def required_range(df: DataFrame, by: Sequence[str], velocity_low: str | Column, velocity_high: str | Column,
                   x: str = "wavelength", span: Span = "auto") -> DataFrame:
    """Model range a grid needs: outer bins widened by half a bin, then by the Doppler extremes."""
    from fluxframe.functions.expr import col
    from fluxframe.functions.physics import doppler

    edges = bin_edges(df, by, x, span)
    agg = edges.groupBy(*by).agg(
        F.min("bin_low").alias("lo"), F.max("bin_high").alias("hi"),
        F.min(col(velocity_low)).alias("vmin"), F.max(col(velocity_high)).alias("vmax"),
    )
    # A source moving away reddens, so the blue end must be requested bluer.
    return agg.select(*by, doppler("lo", -F.greatest(F.col("vmax"), F.lit(0.0))).alias("range_low"),
                      doppler("hi", -F.least(F.col("vmin"), F.lit(0.0))).alias("range_high"))


def velocity_range(exposures: DataFrame, by: Sequence[str], time: str, system: str, period: float, kp: tuple[float, float],
                   shift: tuple[float, float] = (0.0, 0.0), mid_transit: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Extreme relative velocities over the prior ranges of Kp, rest-frame shift and mid-transit time.

    The lowest uses the smallest shift and mid-transit time, the highest the largest, both the largest Kp.
    """
    from fluxframe.functions import orbits

    top = max(abs(kp[0]), abs(kp[1]))

    def velocity(v: float, t0: float) -> Column:
        longitude = orbits.phase_to_longitude(orbits.orbital_phase(F.col(time) - F.lit(float(t0)), float(period)))
        return orbits.relative_velocity(orbits.radial_velocity(top, longitude), system, float(v))

    return exposures.groupBy(*by).agg(
        F.min(velocity(min(shift), min(mid_transit))).alias("velocity_min"), F.max(velocity(max(shift), max(mid_transit))).alias("velocity_max"))


def min_max_scale(df: DataFrame, by: Sequence[str], y: str, low: float = 0.0, high: float = 1.0, out: str = "scaled") -> DataFrame:
    near = with_group_stats(df, by, {"__mn": F.min(y), "__mx": F.max(y)})
    value = F.lit(float(low)) + (F.col(y) - F.col("__mn")) * F.lit(float(high - low)) / (F.col("__mx") - F.col("__mn"))
    value = F.when(F.col("__mx") == F.col("__mn"), F.when(F.col(y).isNotNull(), F.lit(float(low)))).otherwise(value)  # a constant group lies at the lower end
    return near.withColumn(out, value).drop("__mn", "__mx")


def left_integral(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "integral", span: Span = "auto") -> DataFrame:
    """Left Riemann sum of y dx over the points that are not masked."""
    near = neighbours(df.filter(F.col(y).isNotNull()), by, x, {"__n": (x, 1)}, span=span)
    return near.groupBy(*by).agg(F.sum(F.col(y) * (F.col("__n") - F.col(x))).alias(out))


def trapezoid_integral(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "integral", span: Span = "auto") -> DataFrame:
    """Trapezoid rule over the points that are not masked."""
    near = neighbours(df.filter(F.col(y).isNotNull()), by, x, {"__nx": (x, 1), "__ny": (y, 1)}, span=span)
    return near.groupBy(*by).agg(F.sum((F.col(y) + F.col("__ny")) / 2 * (F.col("__nx") - F.col(x))).alias(out))


def effective_temperature(df: DataFrame, by: Sequence[str], x: str = "wavelength", y: str = "flux",
                          distance_ratio: float = 1.0, si_units: bool = False, span: Span = "auto") -> DataFrame:
    """(left integral of flux / sigma)^(1/4); ``distance_ratio`` is distance / radius."""
    from fluxframe.functions import constants as k

    sigma = k.SIGMA * (1e-3 if si_units else 1.0)
    energy = left_integral(df, by, x, y, "__e", span)
    scale = F.lit(float(distance_ratio) ** 2 / sigma)
    return energy.select(*by, F.pow(F.col("__e") * scale, 0.25).alias("effective_temperature"))
