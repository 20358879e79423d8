"""Grid queries: bin widths, rebinning, interpolation, clipping, generated grids, integrals, smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.operators import detrend, grids, smooth
from fluxframe.plans import views
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql

SPECTRUM = ["order_id", "exposure_id"]
KEYS = "order_id, exposure_id, channel"


@query("a2_bin_widths", sql("series_long", """
SELECT series_id, x, coalesce(lead(x) OVER w - x, x - lag(x) OVER w) bin_width FROM series_long
WINDOW w AS (PARTITION BY series_id ORDER BY x)""", "series_id", "x, bin_width"))
def a2_bin_widths(spark, sf):
    return rounded(grids.with_bin_widths(views.series_long(spark, sf), ["series_id"], "x").select("series_id", "x", "bin_width"))


_EDGES = """SELECT *, coalesce(t - (t - lag(t) OVER w)/2, t - (lead(t) OVER w - t)/2) lo,
    coalesce(lead(t) OVER w - (lead(t) OVER w - t)/2, t + (t - lag(t) OVER w)/2) hi FROM {0}
    WINDOW w AS (PARTITION BY {1} ORDER BY t)"""


@query("f5_bin_edges", sql("series_long", """
SELECT series_id, t x, lo bin_low, hi bin_high,
  round(coalesce(r, lead(r) OVER w, lag(r) OVER w), 3) resolving_power FROM (
  SELECT *, t/((lead(t) OVER w - lag(t) OVER w)/2) r FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t))
WINDOW w AS (PARTITION BY series_id ORDER BY t)""", "series_id", "x, bin_low, bin_high, resolving_power", 7,
    s="SELECT series_id, x t FROM series_long", e=_EDGES.format("s", "series_id")))
def f5_bin_edges(spark, sf):
    df = views.series_long(spark, sf).select("series_id", "x")
    span = grids.resolve_span(df, ["series_id"], "x", "auto")
    got = grids.bin_resolving_power(grids.bin_edges(df, ["series_id"], "x", span), ["series_id"], "x", span=span)
    return rounded(got.select("series_id", "x", "bin_low", "bin_high", F.round("resolving_power", 3).alias("resolving_power")), 7)


_SEGMENTS = """SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM {0} WINDOW w AS (PARTITION BY {1} ORDER BY x)"""
_AREA = """sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))
    / sum(least(x1,hi)-greatest(x,lo))"""


@query("d1_rebin_shared_grid", sql("spectra_long", f"""
SELECT order_id, exposure_id, t wavelength, {_AREA} flux
FROM seg JOIN bins USING (order_id) WHERE x1 > lo AND x < hi GROUP BY order_id, exposure_id, t""",
    "order_id, exposure_id", "wavelength, flux",
    seg=_SEGMENTS.format("(SELECT order_id, exposure_id, wavelength x, flux y FROM spectra_long)", "order_id, exposure_id"),
    tg="""SELECT DISTINCT order_id, 1.02::DOUBLE + 0.013::DOUBLE*i + 0.0001::DOUBLE*(order_id%7) t
        FROM spectra_long, range(0, 43) r(i)""",
    bins=_EDGES.format("tg", "order_id")))
def d1_rebin_shared_grid(spark, sf):
    df = views.spectra_long(spark, sf)
    step = F.explode(F.sequence(F.lit(0), F.lit(42)))
    target = df.select("order_id").distinct().withColumn("i", step).select(
        "order_id", (F.lit(1.02) + F.lit(0.013) * F.col("i") + F.lit(0.0001) * (F.col("order_id") % 7)).alias("wavelength"))
    got = grids.rebin(df, target, SPECTRUM, target_by=["order_id"])
    return rounded(got.select("order_id", "exposure_id", "wavelength", "flux"))


def _step_numbers(size, first, last, closed):
    """SQL of the step numbers of ``_steps``: one column i."""
    low = f"least({first}, min(floor(x / {size}::DOUBLE)))"
    high = f"greatest({last}, max(ceil(x / {size}::DOUBLE)) - {closed})"
    return f"(SELECT unnest(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT) + 1)) i FROM series_long)"


_DAYS = f"""SELECT series_id, (i + 0.5::DOUBLE)*86400 t, i*86400::DOUBLE lo, (i+1)*86400::DOUBLE hi
    FROM (SELECT DISTINCT series_id FROM series_long), {_step_numbers(86400, 0, 29, 1)}"""


def _steps(df, size, first, last, closed):
    """Numbers of steps of ``size`` for every series: ``first`` to ``last``, and further where some x lies outside. With ``closed`` 1 the last step is the one that ends behind all x, with 0 the one that begins there."""
    x = F.col("x") / F.lit(size)
    low, high = F.least(F.lit(first).cast("bigint"), F.min(F.floor(x))), F.greatest(F.lit(last).cast("bigint"), F.max(F.ceil(x)) - closed)
    return df.select("series_id").distinct().withColumn("i", F.explode(df.agg(F.sequence(low, high)).scalar()))


@query("d1_rebin_daily", sql("series_long", f"""
SELECT series_id, t x, CASE WHEN mn < lo AND mx > hi THEN v END y FROM days LEFT JOIN (
  SELECT series_id, t, {_AREA} v FROM seg JOIN days USING (series_id) WHERE x1 > lo AND x < hi GROUP BY series_id, t
) USING (series_id, t) JOIN (SELECT series_id, min(x) mn, max(x) mx FROM series_long GROUP BY 1) USING (series_id)""",
    "series_id", "x, y", seg=_SEGMENTS.format("series_long", "series_id"), days=_DAYS))
def d1_rebin_daily(spark, sf):
    df = views.series_long(spark, sf)
    days = _steps(df, k.DAY, 0, 29, 1)
    days = days.select("series_id", ((F.col("i") + F.lit(0.5)) * F.lit(k.DAY)).alias("x"), F.lit(k.DAY).alias("w"))
    got = grids.rebin(df, days, ["series_id"], "x", "y", target="x", widths="w", strict=False)
    return rounded(got.select("series_id", "x", "y"))


@query("d2_interpolation_join", sql("series_long", """
SELECT g.series_id, g.x, CASE WHEN lo.x IS NULL THEN up.y WHEN up.x IS NULL THEN lo.y WHEN lo.x = up.x THEN lo.y
   ELSE lo.y + (up.y-lo.y)/(up.x-lo.x)*(g.x-lo.x) END y_clamped,
  CASE WHEN lo.x IS NOT NULL AND up.x IS NOT NULL THEN
   CASE WHEN lo.x = up.x THEN lo.y ELSE lo.y + (up.y-lo.y)/(up.x-lo.x)*(g.x-lo.x) END END y_inside
FROM pts g ASOF LEFT JOIN series_long lo ON g.series_id = lo.series_id AND g.x >= lo.x
ASOF LEFT JOIN series_long up ON g.series_id = up.series_id AND g.x <= up.x""", "series_id", "x, y_clamped, y_inside",
    pts=f"SELECT series_id, i*21600::DOUBLE x FROM (SELECT DISTINCT series_id FROM series_long), {_step_numbers(21600, 0, 120, 0)}"))
def d2_interpolation_join(spark, sf):
    knots = views.series_long(spark, sf)
    points = _steps(knots, 21600.0, 0, 120, 0)
    points = points.select("series_id", (F.col("i") * F.lit(21600.0)).alias("x"))
    span = grids.resolve_span(knots, ["series_id"], "x", "auto")
    first = grids.interp_join(points, knots, ["series_id"], "x", "y", outside="clamp", span=span)
    inside = grids.interp_join(points, knots, ["series_id"], "x", "y", outside="null", span=span)
    both = first.withColumnRenamed("y", "y_clamped").join(inside.withColumnRenamed("y", "y_inside"), ["series_id", "x"])
    return rounded(both)


@query("d14_band_average", sql("spectra_long", f"""
SELECT order_id, exposure_id, band, {_AREA} flux FROM seg JOIN bands ON x1 > lo AND x < hi GROUP BY 1, 2, 3""",
    "order_id, exposure_id, band", "flux",
    seg=_SEGMENTS.format("(SELECT order_id, exposure_id, wavelength x, flux y FROM spectra_long)", "order_id, exposure_id"),
    bands="SELECT * FROM (VALUES ('b1', 1.013::DOUBLE, 1.107::DOUBLE), ('b2', 1.1::DOUBLE, 1.333::DOUBLE), ('b3', 1.25::DOUBLE, 1.6::DOUBLE)) t(band, lo, hi)"))
def d14_band_average(spark, sf):
    bands = spark.createDataFrame([("b1", 1.013, 1.107), ("b2", 1.1, 1.333), ("b3", 1.25, 1.6)], "band string, w_low double, w_high double")
    return rounded(grids.band_average(views.spectra_long(spark, sf), bands, SPECTRUM))


@query("a10_clip_grid", sql("spectra_long", """
SELECT order_id, exposure_id, wavelength, flux FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id, exposure_id ORDER BY wavelength) - 1 r FROM (
    SELECT *, max(CASE WHEN wavelength <= 1.1234 THEN wavelength END) OVER p a,
      min(CASE WHEN wavelength >= 1.4567 THEN wavelength END) OVER p b FROM spectra_long WINDOW p AS (PARTITION BY order_id, exposure_id))
  WHERE wavelength >= a) WHERE r % 3 = 0 AND r <= 2 + (SELECT count(*) - 1 FROM range(0, 64) t(i) WHERE 1+0.01*i >= 1.12 - 1e-9 AND 1+0.01*i <= 1.46 + 1e-9)""",
    "order_id, exposure_id", "wavelength, flux"))
def a10_clip_grid(spark, sf):
    got = grids.clip_grid(views.spectra_long(spark, sf), SPECTRUM, 1.1234, 1.4567, stride=3)
    return rounded(got.select("order_id", "exposure_id", "wavelength", "flux"))


@query("c1_range_filter", sql("spectra_long", f"""
SELECT {KEYS}, wavelength, flux FROM spectra_long WHERE wavelength BETWEEN 1.1::DOUBLE*0.99999999::DOUBLE AND 1.3::DOUBLE*1.00000001::DOUBLE""",
    KEYS, "wavelength, flux"))
def c1_range_filter(spark, sf):
    got = grids.in_range(views.spectra_long(spark, sf), 1.1, 1.3)
    return rounded(got.select("order_id", "exposure_id", "channel", "wavelength", "flux"))


@query("c2_grid_overlap", sql("series_long", """
SELECT series_id, x FROM series_long JOIN (SELECT series_id, min(x)*0.9+1e5 a, max(x)*0.8 b FROM series_long GROUP BY 1) USING (series_id)
WHERE x >= a*(1-1e-15::DOUBLE) AND x <= b*(1+1e-15::DOUBLE)""", "series_id", "x"))
def c2_grid_overlap(spark, sf):
    df = views.series_long(spark, sf)
    ends = df.groupBy("series_id").agg((F.min("x") * 0.9 + 1e5).alias("lo"), (F.max("x") * 0.8).alias("hi"))
    other = ends.select("series_id", F.explode(F.array("lo", "hi")).alias("x"))
    return rounded(grids.grid_overlap(df, other, ["series_id"], "x").select("series_id", "x"))


@query("c3_drop_masked", sql("spectra_long", f"SELECT {KEYS}, flux FROM spectra_long WHERE flux >= 0.9", KEYS, "flux"))
def c3_drop_masked(spark, sf):
    df = views.spectra_long(spark, sf).withColumn("flux", F.when(F.col("flux") >= 0.9, F.col("flux")))
    kept, _ = detrend.drop_masked(df)
    return rounded(kept.select("order_id", "exposure_id", "channel", "flux"))


@query("c3_mask_table", sql("spectra_long", f"SELECT {KEYS} FROM spectra_long WHERE NOT flux >= 0.9"))
def c3_mask_table(spark, sf):
    df = views.spectra_long(spark, sf).withColumn("flux", F.when(F.col("flux") >= 0.9, F.col("flux")))
    return detrend.drop_masked(df)[1].select("order_id", "exposure_id", "channel")


_LIMITS = "SELECT series_id, 1+min(y) a, 2+max(y) b FROM series_long GROUP BY 1"


@query("h1_grid_exponential", sql("series_long", """
SELECT series_id, i, a*exp(i/25::DOUBLE) wavelength FROM (
  SELECT series_id, a, unnest(range(0, greatest(1, ceil(25*ln(b/a) - 1e-9))::BIGINT + 1)) i FROM lim)""",
    "series_id, i", "wavelength", lim=_LIMITS))
def h1_grid_exponential(spark, sf):
    lim = views.series_long(spark, sf).groupBy("series_id").agg((1 + F.min("y")).alias("a"), (2 + F.max("y")).alias("b"))
    return rounded(grids.group_grid(lim, "a", "b", 25, multiplicative=False).select("series_id", "i", "wavelength"))


@query("h2_grid_multiplicative", sql("series_long", """
SELECT series_id, i, a*power(1.04::DOUBLE, i) wavelength FROM (
  SELECT series_id, a, unnest(range(0, floor(ln(b/a)/ln(1.04::DOUBLE) + 1e-9)::BIGINT + 1)) i FROM lim)""",
    "series_id, i", "wavelength", lim=_LIMITS))
def h2_grid_multiplicative(spark, sf):
    lim = views.series_long(spark, sf).groupBy("series_id").agg((1 + F.min("y")).alias("a"), (2 + F.max("y")).alias("b"))
    return rounded(grids.group_grid(lim, "a", "b", 25).select("series_id", "i", "wavelength"))


def _doppler(w: str, v: str) -> str:
    return f"{w}*sqrt((1+({v})/{k.C!r}::DOUBLE)/(1-({v})/{k.C!r}::DOUBLE))"


@query("h4_required_range", sql("spectra_long", f"""
SELECT order_id, {_doppler('lo', '-greatest(vmax, 0)')} range_low, {_doppler('hi', '-least(vmin, 0)')} range_high FROM (
  SELECT order_id, 1-0.005::DOUBLE lo, 1.635::DOUBLE hi, min(v) vmin, max(v) vmax
  FROM (SELECT order_id, 3e7::DOUBLE*sin(exposure_id) v FROM spectra_long) GROUP BY 1)""", "order_id", "range_low, range_high", 9))
def h4_required_range(spark, sf):
    df = views.spectra_long(spark, sf)
    speeds = df.groupBy("order_id").agg(
        F.min(F.lit(3e7) * F.sin("exposure_id")).alias("v_low"), F.max(F.lit(3e7) * F.sin("exposure_id")).alias("v_high"))
    grid = df.select("order_id", "wavelength").distinct().join(speeds, "order_id")
    return rounded(grids.required_range(grid, ["order_id"], "v_low", "v_high"), 9)


@query("e20_effective_temperature", sql("spectra_long", f"""
SELECT order_id, exposure_id, power(e*1e9::DOUBLE*power(2::DOUBLE,2)/{k.SIGMA!r}::DOUBLE, 0.25::DOUBLE) effective_temperature, trapz FROM (
  SELECT order_id, exposure_id, sum(y*(x1-x)) e, sum((y+y1)/2*(x1-x)) trapz FROM seg GROUP BY 1, 2)""",
    "order_id, exposure_id", "effective_temperature, trapz",
    seg=_SEGMENTS.format("(SELECT order_id, exposure_id, wavelength x, flux y FROM spectra_long)", "order_id, exposure_id")))
def e20_effective_temperature(spark, sf):
    df = views.spectra_long(spark, sf)
    span = grids.resolve_span(df, SPECTRUM, "wavelength", "auto")
    hot = grids.effective_temperature(df.withColumn("flux", F.col("flux") * 1e9), SPECTRUM, distance_ratio=2.0, span=span)
    norm = grids.trapezoid_integral(df, SPECTRUM, "wavelength", "flux", "trapz", span=span)
    return rounded(hot.join(norm, SPECTRUM))


@query("e27_mean_resolving_power", sql("series_long", """
SELECT series_id, avg(x/(x1-x) + 0.5::DOUBLE) resolving_power FROM seg WHERE x1 IS NOT NULL GROUP BY 1""", "series_id", "resolving_power", 4,
    seg=_SEGMENTS.format("series_long", "series_id")))
def e27_mean_resolving_power(spark, sf):
    return rounded(grids.mean_resolving_power(views.series_long(spark, sf), ["series_id"], "x"), 4)


@query("f12_min_max_scale", sql("spectra_long", f"""
SELECT {KEYS}, -1 + (flux - min(flux) OVER w)*3/(max(flux) OVER w - min(flux) OVER w) scaled FROM spectra_long
WINDOW w AS (PARTITION BY order_id, exposure_id)""", KEYS, "scaled"))
def f12_min_max_scale(spark, sf):
    got = grids.min_max_scale(views.spectra_long(spark, sf), SPECTRUM, "flux", -1.0, 2.0)
    return rounded(got.select("order_id", "exposure_id", "channel", "scaled"))


@query("f1_running_mean", sql("spectra_long", f"""
SELECT {KEYS}, avg(flux) OVER (PARTITION BY order_id, exposure_id ORDER BY channel ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) mean
FROM spectra_long QUALIFY channel >= 4""", KEYS, "mean"))
def f1_running_mean(spark, sf):
    got = smooth.running_mean(views.spectra_long(spark, sf), SPECTRUM, "channel", "flux", 5)
    return rounded(got.select("order_id", "exposure_id", "channel", "mean"))


@query("f2_boxcar", sql("spectra_long", f"""
SELECT a.order_id, a.exposure_id, a.channel, avg(b.flux) smooth FROM (
  SELECT *, CASE WHEN channel >= 3 AND channel+3 <= 65 THEN channel-3 WHEN channel+3 > 65 THEN channel - least(3, 65-channel) ELSE 0 END f,
    CASE WHEN channel >= 3 AND channel+3 <= 65 THEN channel+3 WHEN channel+3 > 65 THEN channel + least(3, 65-channel) ELSE greatest(2*channel, 1) END t
  FROM spectra_long) a JOIN spectra_long b ON a.order_id = b.order_id AND a.exposure_id = b.exposure_id AND b.channel >= f AND b.channel < t
GROUP BY 1, 2, 3""", KEYS, "smooth"))
def f2_boxcar(spark, sf):
    got = smooth.boxcar(views.spectra_long(spark, sf), SPECTRUM, "channel", "flux", 6)
    return rounded(got.select("order_id", "exposure_id", "channel", "smooth"))


def _gauss_sql(edge: str, sigma: float, radius: int) -> str:
    at = {
        "nearest": "greatest(0, least(63, a.channel + d))",
        "reflect": "CASE WHEN a.channel+d < 0 THEN -1-a.channel-d WHEN a.channel+d > 63 THEN 127-a.channel-d ELSE a.channel+d END",
    }[edge]
    return f"""SELECT a.order_id, a.exposure_id, a.channel,
      sum(exp(-0.5::DOUBLE*power(d/{sigma!r}::DOUBLE, 2))*b.flux)/sum(exp(-0.5::DOUBLE*power(d/{sigma!r}::DOUBLE, 2))) smooth
    FROM spectra_long a JOIN range(-{radius}, {radius + 1}) r(d) ON true JOIN spectra_long b
      ON a.order_id = b.order_id AND a.exposure_id = b.exposure_id AND b.channel = {at} GROUP BY 1, 2, 3"""


@query("f3_gauss_nearest", sql("spectra_long", _gauss_sql("nearest", 1.7, 7), KEYS, "smooth"))
def f3_gauss_nearest(spark, sf):
    got = smooth.gauss_smooth(views.spectra_long(spark, sf), SPECTRUM, "channel", "flux", 1.7, "nearest")
    return rounded(got.select("order_id", "exposure_id", "channel", "smooth"))


@query("f3_gauss_reflect", sql("spectra_long", _gauss_sql("reflect", 1.7, 7), KEYS, "smooth"))
def f3_gauss_reflect(spark, sf):
    got = smooth.gauss_smooth(views.spectra_long(spark, sf), SPECTRUM, "channel", "flux", 1.7, "reflect")
    return rounded(got.select("order_id", "exposure_id", "channel", "smooth"))


@query("f4_gauss_full", sql("spectra_long", """
SELECT a.order_id, a.exposure_id, a.channel,
  sum(exp(-power(b.wavelength-a.wavelength,2)/(2*power(s,2)))*b.flux)/sum(exp(-power(b.wavelength-a.wavelength,2)/(2*power(s,2)))) smooth
FROM (SELECT *, wavelength/(30+channel)/2.355::DOUBLE s FROM spectra_long) a JOIN spectra_long b USING (order_id, exposure_id) GROUP BY 1, 2, 3""",
    KEYS, "smooth"))
def f4_gauss_full(spark, sf):
    got = smooth.gauss_smooth_full(views.spectra_long(spark, sf), SPECTRUM, "wavelength", "flux", F.col("channel") + 30)
    return rounded(got.select("order_id", "exposure_id", "channel", "smooth"))


@query("f4_gauss_running", sql("spectra_long", """
SELECT a.order_id, a.exposure_id, a.channel, CASE WHEN a.channel < 8 OR a.channel > 55 THEN max(a.flux) ELSE
  sum(exp(-0.5::DOUBLE*power((b.channel-a.channel)/(1+a.channel/64::DOUBLE),2))*b.flux)
  /sum(exp(-0.5::DOUBLE*power((b.channel-a.channel)/(1+a.channel/64::DOUBLE),2))) END smooth
FROM spectra_long a JOIN spectra_long b ON a.order_id = b.order_id AND a.exposure_id = b.exposure_id AND abs(b.channel-a.channel) <= 8
GROUP BY 1, 2, 3""", KEYS, "smooth"))
def f4_gauss_running(spark, sf):
    sigma = 1 + F.col("channel") / F.lit(64.0)
    got = smooth.gauss_smooth_running(views.spectra_long(spark, sf), SPECTRUM, "channel", "flux", sigma, max_sigma=2.0)
    return rounded(got.select("order_id", "exposure_id", "channel", "smooth"))
