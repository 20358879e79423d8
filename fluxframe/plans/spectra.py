"""Detrending and cross-correlation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions import physics
from fluxframe.operators import correlate, detrend, observe, packed, smooth
from fluxframe.plans import views
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql

KEYS = "order_id, exposure_id, channel"
VALS = "flux, uncertainty, matrix"
COLS = ["order_id", "exposure_id", "channel", "flux", "uncertainty", "matrix"]


def masked_spectra(spark, sf) -> DataFrame:
    """Spectra with deep points masked and some zero uncertainties."""
    df = views.spectra_long(spark, sf)
    return df.withColumns({
        "flux": F.when(F.col("flux") >= 0.75, F.col("flux")),
        "uncertainty": F.when((F.col("exposure_id") + F.col("channel")) % 17 != 0, F.col("uncertainty")).otherwise(F.lit(0.0)),
    })


MASKED = """SELECT * REPLACE (CASE WHEN flux >= 0.75 THEN flux END AS flux,
    CASE WHEN (exposure_id+channel) % 17 <> 0 THEN uncertainty ELSE 0 END AS uncertainty) FROM spectra_long"""


def _mean_sql(source: str, group: str, weighted: bool, threshold: float | None = None) -> str:
    w = "1/uncertainty" if weighted else "1"
    ok = "m IS NOT NULL" if threshold is None else f"m >= {threshold!r}"
    return f"""SELECT * EXCLUDE (m) REPLACE (CASE WHEN {ok} THEN flux/m END AS flux,
      CASE WHEN {ok} THEN uncertainty/abs(m) END AS uncertainty, CASE WHEN {ok} THEN matrix/m END AS matrix) FROM (
      SELECT *, sum(w*flux) OVER (PARTITION BY {group}) / sum(w) OVER (PARTITION BY {group}) m FROM (
        SELECT *, CASE WHEN flux IS NOT NULL AND uncertainty <> 0 THEN {w} END w FROM {source}) ) q0"""


def _plain(text: str) -> str:
    return text.replace("* EXCLUDE (m) REPLACE", "* EXCLUDE (m, w) REPLACE")


_START = "SELECT *, 1::DOUBLE matrix FROM msk"
_ROW, _COL = "order_id, exposure_id", "order_id, channel"


@query("g1_throughput_mean", sql("spectra_long", "SELECT * FROM g1", KEYS, VALS, msk=MASKED, s0=_START, g1=_plain(_mean_sql("s0", _ROW, True))))
def g1_throughput_mean(spark, sf):
    return rounded(detrend.remove_throughput_mean(detrend.with_matrix(masked_spectra(spark, sf))).select(*COLS))


@query("g2_tellurics_mean", sql("spectra_long", "SELECT * FROM g2", KEYS, VALS, msk=MASKED, s0=_START, g2=_plain(_mean_sql("s0", _COL, False, 0.99))))
def g2_tellurics_mean(spark, sf):
    got = detrend.remove_tellurics_mean(detrend.with_matrix(masked_spectra(spark, sf)), weighted=False, threshold=0.99)
    return rounded(got.select(*COLS))


def _fit_sql(source: str, group: str, x: str, y: str, w: str, degree: int) -> str:
    """Weighted polynomial on the axis scaled to [-1, 1]: adds fit ``p`` and ``used``."""
    m = 2 * degree
    sums = ", ".join([f"sum(w2*u^{i}) OVER g s{i}" for i in range(m + 1)] + [f"sum(w2*u^{i}*yy) OVER g t{i}" for i in range(degree + 1)])
    if degree == 1:
        coef = """(t0*s2-t1*s1)/nullif(s0*s2-s1*s1,0) c0, (s0*t1-s1*t0)/nullif(s0*s2-s1*s1,0) c1"""
        val = "c0 + c1*u"
    else:
        det = "nullif(s0*(s2*s4-s3*s3)-s1*(s1*s4-s2*s3)+s2*(s1*s3-s2*s2),0)"
        coef = f"""(t0*(s2*s4-s3*s3)-t1*(s1*s4-s2*s3)+t2*(s1*s3-s2*s2))/{det} c0,
          (-t0*(s1*s4-s2*s3)+t1*(s0*s4-s2*s2)-t2*(s0*s3-s1*s2))/{det} c1,
          (t0*(s1*s3-s2*s2)-t1*(s0*s3-s1*s2)+t2*(s0*s2-s1*s1))/{det} c2"""
        val = "c0 + c1*u + c2*u*u"
    drop = ", ".join(["u", "w2", "yy"] + [f"s{i}" for i in range(m + 1)] + [f"t{i}" for i in range(degree + 1)] + [f"c{i}" for i in range(degree + 1)])
    return f"""SELECT * EXCLUDE ({drop}), {val} p FROM (SELECT *, {coef} FROM (
      SELECT *, {sums}, count(CASE WHEN w2 > 0 THEN 1 END) OVER g used FROM (
        SELECT *, CASE WHEN max({x}) OVER g = min({x}) OVER g THEN 0 ELSE ({x} - (min({x}) OVER g + max({x}) OVER g)/2)/((max({x}) OVER g - min({x}) OVER g)/2) END u,
          CASE WHEN ({y}) IS NOT NULL AND ({w}) IS NOT NULL THEN power({w},2) ELSE 0 END w2,
          CASE WHEN ({y}) IS NOT NULL AND ({w}) IS NOT NULL THEN {y} ELSE 0 END yy
        FROM {source} WINDOW g AS (PARTITION BY {group})) WINDOW g AS (PARTITION BY {group})))"""


def _apply_sql(source: str, ok: str, group: str, lost: int | None) -> str:
    divided = f"""SELECT * REPLACE (CASE WHEN {ok} THEN flux/f END AS flux, CASE WHEN {ok} THEN matrix/f END AS matrix,
       CASE WHEN {ok} THEN uncertainty/abs(f) END AS uncertainty) FROM {source}"""
    if lost is None:
        return f"SELECT order_id, exposure_id, channel, wavelength, airmass, flux, uncertainty, matrix FROM ({divided})"
    return f"""SELECT order_id, exposure_id, channel, wavelength, airmass, flux, matrix,
      CASE WHEN v - {lost} > 0 THEN uncertainty*sqrt((v - {lost})/n::DOUBLE) END uncertainty FROM (
      SELECT *, count(uncertainty) OVER (PARTITION BY {group}) v, count(*) OVER (PARTITION BY {group}) n FROM ({divided}))"""


def _throughput_fit_sql(source: str, w: str, degree: int, threshold: str, lost: int | None) -> str:
    fit = _fit_sql(source, _ROW, "wavelength", "flux", w, degree)
    f = f"(SELECT *, CASE WHEN used = 0 THEN 1 ELSE p END f FROM ({fit}))"
    return _apply_sql(f, f"flux IS NOT NULL AND f >= {threshold}", _ROW, lost)


def _tellurics_fit_sql(source: str, weighted: bool, degree: int, threshold: str, lost: int | None) -> str:
    w = "CASE WHEN flux > 0 AND uncertainty <> 0 THEN " + ("abs(flux/uncertainty)" if weighted else "1") + " END"
    fit = _fit_sql(source, _COL, "airmass", "CASE WHEN flux > 0 THEN ln(flux) END", w, degree)
    f = f"""(SELECT *, min(f) OVER (PARTITION BY {_COL}) lowest FROM (SELECT *, exp(CASE WHEN used > {degree + 1} THEN p ELSE 0 END) f FROM ({fit})))"""
    return _apply_sql(f, f"flux > 0 AND lowest >= {threshold}", _COL, lost)


_INV = "CASE WHEN uncertainty <> 0 THEN 1/uncertainty END"
_ONE = "CASE WHEN uncertainty IS NOT NULL THEN 1 END"
FIT = {"msk": MASKED, "s0": _START}


@query("g3_throughput_fit", sql("spectra_long", "SELECT * FROM g3", KEYS, VALS, 5, **FIT, g3=_throughput_fit_sql("s0", _INV, 2, "0.9", 3)))
def g3_throughput_fit(spark, sf):
    got = detrend.remove_throughput_fit(detrend.with_matrix(masked_spectra(spark, sf)), 2, "inverse", threshold=0.9)
    return rounded(got.select(*COLS), 5)


@query("g3_throughput_fit_sigma", sql("spectra_long", "SELECT * FROM g3", KEYS, VALS, 5, **FIT, g3=_throughput_fit_sql("s0", "nullif(uncertainty, 0)", 1, "1e-16", None)))
def g3_throughput_fit_sigma(spark, sf):
    got = detrend.remove_throughput_fit(detrend.with_matrix(masked_spectra(spark, sf)), 1, "sigma", correct=False)
    return rounded(got.select(*COLS), 5)


@query("g4_tellurics_fit", sql("spectra_long", "SELECT * FROM g4", KEYS, VALS, 5, **FIT, g4=_tellurics_fit_sql("s0", True, 2, "0.9", 3)))
def g4_tellurics_fit(spark, sf):
    got = detrend.remove_tellurics_fit(detrend.with_matrix(masked_spectra(spark, sf)), 2, True, threshold=0.9)
    return rounded(got.select(*COLS), 5)


@query("g5_polyfit_detrend", sql("spectra_long", "SELECT * FROM g5", KEYS, VALS, 5, **FIT,
    g3=_throughput_fit_sql("s0", _ONE, 2, "2.2250738585072014e-308", 3), g5=_tellurics_fit_sql("g3", False, 1, "0.1", 2)))
def g5_polyfit_detrend(spark, sf):
    return rounded(detrend.polyfit_detrend(detrend.with_matrix(masked_spectra(spark, sf))).select(*COLS), 5)


@query("g5_mean_detrend", sql("spectra_long", "SELECT * FROM g5", KEYS, VALS, **FIT,
    g1=_plain(_mean_sql("s0", _ROW, True)), g5=_plain(_mean_sql("g1", _COL, True, 0.1))))
def g5_mean_detrend(spark, sf):
    got = detrend.polyfit_detrend(detrend.with_matrix(masked_spectra(spark, sf)), wavelengths=False, airmass=False, weighted=True)
    return rounded(got.select(*COLS))


@query("c4_noisy_channels", sql("spectra_long", """
SELECT order_id, exposure_id, channel, flux - m flux, 1 - m matrix FROM (
  SELECT *, avg(flux) OVER (PARTITION BY order_id, exposure_id) m FROM (
    SELECT * REPLACE (CASE WHEN NOT coalesce(sd > 1.02::DOUBLE*sdo, false) THEN flux END AS flux) FROM (
      SELECT *, stddev_pop(flux) OVER (PARTITION BY order_id, channel) sd, stddev_pop(flux) OVER (PARTITION BY order_id) sdo FROM msk)))""",
    KEYS, "flux, matrix", msk=MASKED))
def c4_noisy_channels(spark, sf):
    got = detrend.mask_noisy_channels(detrend.with_matrix(masked_spectra(spark, sf)), 1.02, subtract_mean=True)
    return rounded(got.select("order_id", "exposure_id", "channel", "flux", "matrix"))


@query("c5_trim_spectrum", sql("spectra_long", """
SELECT order_id, exposure_id, channel, CASE WHEN med >= 0.99 AND med <= 1.01 THEN o.flux END flux FROM msk o
JOIN (SELECT order_id, channel, quantile_cont(flux, 0.5) med FROM g3 WHERE flux IS NOT NULL GROUP BY 1, 2) USING (order_id, channel)""",
    KEYS, "flux", **FIT, g3=_throughput_fit_sql("s0", _INV, 2, "1e-16", None)))
def c5_trim_spectrum(spark, sf):
    got = detrend.trim_spectrum(masked_spectra(spark, sf), 0.99, 1.01)
    return rounded(got.select("order_id", "exposure_id", "channel", "flux"))


_OUT = "CASE WHEN NOT coalesce(abs(flux - avg(flux) OVER ())/(stddev_pop(flux) OVER ()) > 2, false) THEN flux END"


@query("c5_trim_outliers", sql("spectra_long", f"""
SELECT o.order_id, o.exposure_id, o.channel, CASE WHEN z.flux IS NOT NULL THEN o.flux END flux FROM msk o
JOIN (SELECT order_id, exposure_id, channel, {_OUT} flux FROM g4) z USING (order_id, exposure_id, channel)""",
    KEYS, "flux", **FIT, g3=_throughput_fit_sql("s0", _INV, 2, "1e-16", None),
    md="SELECT order_id, channel, quantile_cont(flux, 0.5) med FROM g3 WHERE flux IS NOT NULL GROUP BY 1, 2",
    t1="SELECT g3.* REPLACE (CASE WHEN med >= 0.98 AND med <= 1.02 THEN flux END AS flux) FROM g3 JOIN md USING (order_id, channel)",
    t2=f"SELECT * REPLACE ({_OUT} AS flux) FROM t1",
    t3="SELECT * REPLACE (CASE WHEN flux IS NOT NULL THEN uncertainty END AS uncertainty) FROM t2",
    g4=_tellurics_fit_sql("t3", True, 2, "1e-16", None)))
def c5_trim_outliers(spark, sf):
    got = detrend.trim_spectrum(masked_spectra(spark, sf), 0.98, 1.02, outlier=2.0)
    return rounded(got.select("order_id", "exposure_id", "channel", "flux"))


def _alternate_sql(i: int) -> dict[str, str]:
    a = "1" if i == 0 else "a"
    src = "d" if i == 0 else f"d JOIN a{i - 1} USING (order_id, exposure_id)"
    return {
        f"c{i}": f"SELECT order_id, channel, sum({a}*s)/sum({a}*{a}*v) c FROM {src} GROUP BY ALL",
        f"a{i}": f"SELECT order_id, exposure_id, sum(c*s)/sum(c*c*v) a FROM d JOIN c{i} USING (order_id, channel) GROUP BY ALL",
    }


_SYS = {"b0": """SELECT *, flux - avg(flux) OVER (PARTITION BY order_id, exposure_id) fm FROM (
            SELECT * REPLACE (CASE WHEN flux >= 0.8 THEN flux END AS flux) FROM spectra_long)""",
        "d": """SELECT *, coalesce(fm/power(uncertainty,2), 0) s, CASE WHEN fm IS NOT NULL THEN 1/power(uncertainty,2) ELSE 0 END v FROM b0""",
        **_alternate_sql(0), **_alternate_sql(1)}


@query("g6_sysrem", sql("spectra_long", """
SELECT order_id, exposure_id, channel, CASE WHEN a*c <> 0 THEN fm - a*c END flux, CASE WHEN a*c <> 0 THEN 1 - a*c END matrix
FROM d JOIN a1 USING (order_id, exposure_id) JOIN c1 USING (order_id, channel)""", KEYS, "flux, matrix", **_SYS))
def g6_sysrem(spark, sf):
    got = detrend.sysrem(detrend.with_matrix(views.spectra_long(spark, sf)), passes=1, max_iterations=2, epsilon=0.0)
    return rounded(got.select("order_id", "exposure_id", "channel", "flux", "matrix"))


@query("g6_sysrem_converged")
def g6_sysrem_converged(spark, sf):
    got = detrend.sysrem(detrend.with_matrix(views.spectra_long(spark, sf)), passes=2, max_iterations=5)
    return rounded(got.select("order_id", "exposure_id", "channel", "flux", "matrix"), 4)


@query("b22_bias_metric", sql("spectra_long", f"""
SELECT {KEYS}, 1 - (m - uncertainty*sin(exposure_id+channel)*channel/64::DOUBLE)/flux bias
FROM spectra_long JOIN (SELECT order_id, channel, avg(flux) m FROM spectra_long GROUP BY ALL) USING (order_id, channel)""", KEYS, "bias"))
def b22_bias_metric(spark, sf):
    df = views.spectra_long(spark, sf)
    keys = ["order_id", "exposure_id", "channel"]
    template = df.groupBy("order_id", "channel").agg(F.avg("flux").alias("m"))
    model = df.select(*keys).join(template, ["order_id", "channel"]).select(*keys, F.col("m").alias("flux"))
    noise = df.select(*keys, (F.col("uncertainty") * F.sin(F.col("exposure_id") + F.col("channel"))).alias("noise"))
    matrix = df.select(*keys, (F.col("channel") / F.lit(64.0)).alias("matrix"))
    return rounded(observe.bias_metric(model, df, matrix, noise))


# Cross-correlation ------------------------------------------------------------------------------

_DETRENDED = {"msk": "SELECT * FROM spectra_long", "s0": _START, "g1": _plain(_mean_sql("s0", _ROW, True)),
              "g2": _plain(_mean_sql("g1", _COL, True, 1e-16))}
_TEMPLATE = "SELECT order_id, channel, avg(flux) flux FROM spectra_long GROUP BY ALL"
_SHIFTED = "SELECT order_id, channel + s channel, s v_index, flux FROM tpl, range(-5, 6) r(s)"


def _ccf_sql(data: str, models: str, keys: str) -> str:
    return f"""SELECT {keys}, v_index, coalesce(sum(a.flux*b.flux)/nullif(sqrt(sum(a.flux*a.flux)*sum(b.flux*b.flux)), 0), 0) ccf
    FROM {data} a JOIN {models} b USING (order_id, channel) WHERE a.flux IS NOT NULL AND b.flux IS NOT NULL GROUP BY {keys}, v_index"""


def shifted_templates(df: DataFrame) -> DataFrame:
    """Mean spectrum per order, moved by -5..5 channels."""
    template = df.groupBy("order_id", "channel").agg(F.avg("flux").alias("flux"))
    moved = template.withColumn("v_index", F.explode(F.sequence(F.lit(-5).cast("bigint"), F.lit(5).cast("bigint"))))
    return moved.withColumn("channel", F.col("channel") + F.col("v_index"))


_PEAK = sql("spectra_long", """
SELECT order_id, max(ccf) peak, arg_max(v_index, (ccf, -v_index)) peak_v_index, count(CASE WHEN ccf >= 0.68*mx THEN 1 END) n_around_peak
FROM (SELECT *, max(ccf) OVER (PARTITION BY order_id) mx FROM (SELECT order_id, v_index, sum(ccf) ccf FROM cc GROUP BY 1, 2)) GROUP BY 1""",
    "order_id, peak_v_index, n_around_peak", "peak", 5, **_DETRENDED, tpl=_TEMPLATE, mdl=_SHIFTED, cc=_ccf_sql("g2", "mdl", "order_id, exposure_id"))


def packed_templates(df: DataFrame) -> DataFrame:
    """Mean spectrum per order as an array, moved by -5..5 channels, NULL where nothing moved in."""
    mean = packed.channel_table(df, ["order_id"], F.avg("f"), "mean")
    moved = mean.withColumn("v_index", F.explode(F.sequence(F.lit(-5), F.lit(5))))
    shift, n = F.col("v_index"), F.size("mean")
    left = F.array_repeat(F.lit(None).cast("double"), F.greatest(shift, F.lit(0)))
    right = F.array_repeat(F.lit(None).cast("double"), F.greatest(-shift, F.lit(0)))
    kept = F.slice("mean", F.greatest(-shift, F.lit(0)) + 1, n - F.abs(shift))
    return moved.select("order_id", shift.cast("bigint").alias("v_index"), F.concat(left, kept, right).alias("model"))


@query("detrended_ccf_peak", _PEAK)
def detrended_ccf_peak(spark, sf):
    """The flagship on packed spectra: no point is shuffled, only per-channel and per-velocity partial sums."""
    df = views.spectra_packed(spark, sf)
    clean = packed.remove_tellurics_mean(packed.remove_throughput_mean(df))
    ccf = packed.cross_correlate(clean, packed_templates(df))
    summed = ccf.groupBy("order_id", "v_index").agg(F.sum("ccf").alias("ccf"))
    return rounded(correlate.ccf_peak(summed, ["order_id"], ["v_index"], ["v_index"], 0.68), 5)


@query("detrended_ccf_peak_long", _PEAK)
def detrended_ccf_peak_long(spark, sf):
    df = views.spectra_long(spark, sf)
    clean = detrend.remove_tellurics_mean(detrend.remove_throughput_mean(df))
    ccf = correlate.cross_correlate(clean, shifted_templates(df), ["order_id", "channel"], ["order_id", "exposure_id"])
    summed = ccf.groupBy("order_id", "v_index").agg(F.sum("ccf").alias("ccf"))
    return rounded(correlate.ccf_peak(summed, ["order_id"], ["v_index"], ["v_index"], 0.68), 5)


@query("e21_cross_correlation", sql("spectra_long", "SELECT * FROM cc", "order_id, exposure_id, v_index", "ccf",
    tpl=_TEMPLATE, mdl=_SHIFTED, cc=_ccf_sql("spectra_long", "mdl", "order_id, exposure_id")))
def e21_cross_correlation(spark, sf):
    df = views.spectra_long(spark, sf)
    return rounded(correlate.cross_correlate(df, shifted_templates(df), ["order_id", "channel"], ["order_id", "exposure_id"]))


@query("e21_packed_correlation", sql("spectra_long", "SELECT * FROM cc", "order_id, exposure_id, v_index", "ccf",
    tpl=_TEMPLATE, mdl=_SHIFTED, cc=_ccf_sql("spectra_long", "mdl", "order_id, exposure_id")))
def e21_packed_correlation(spark, sf):
    df = views.spectra_packed(spark, sf)
    return rounded(packed.cross_correlate(df, packed_templates(df)))


@query("g1_g2_packed", sql("spectra_long", "SELECT order_id, exposure_id, channel, flux, uncertainty FROM g2", KEYS, "flux, uncertainty", **_DETRENDED))
def g1_g2_packed(spark, sf):
    df = views.spectra_packed(spark, sf)
    clean = packed.remove_tellurics_mean(packed.remove_throughput_mean(packed.pack(packed.unpack(df))))
    return rounded(packed.unpack(clean))


@query("e21_cross_correlation_normalized", sql("spectra_long", "SELECT * FROM cc", "order_id, exposure_id, v_index", "ccf",
    tpl=_TEMPLATE, mdl=_SHIFTED, dm="SELECT order_id, exposure_id, channel, flux - avg(flux) OVER (PARTITION BY order_id, exposure_id) flux FROM spectra_long",
    mm="SELECT order_id, channel, v_index, flux - avg(flux) OVER (PARTITION BY order_id, v_index) flux FROM mdl",
    cc=_ccf_sql("dm", "mm", "order_id, exposure_id")))
def e21_cross_correlation_normalized(spark, sf):
    df = views.spectra_long(spark, sf)
    got = correlate.cross_correlate(df, shifted_templates(df), ["order_id", "channel"], ["order_id", "exposure_id"],
                                    normalize=True, model_by=["order_id", "v_index"])
    return rounded(got)


V_STEP, V_HALF, KP = 2e8, 5, 3e8


def exposures_of(df: DataFrame) -> DataFrame:
    """System velocity and orbital longitude of every exposure."""
    return df.select("order_id", "exposure_id").distinct().select(
        "order_id", "exposure_id", (F.lit(5e7) * F.sin("exposure_id")).alias("system_velocity"),
        (F.lit(-30.0) + 60 * (F.col("exposure_id") % 101) / F.lit(101.0)).alias("longitude"))


_EXPOSURES = """SELECT DISTINCT order_id, exposure_id, 5e7::DOUBLE*sin(exposure_id) sys,
    -30 + 60*(exposure_id % 101)/101::DOUBLE lon FROM spectra_long"""


def wide_template(df: DataFrame) -> DataFrame:
    """Mean spectrum per order, carried on beyond both ends so that shifted copies cover the data."""
    template = df.groupBy("order_id", "channel").agg(F.avg("flux").alias("flux"))
    reach = F.lit(12).cast("bigint")
    at = F.when(F.col("channel") == 0, F.sequence(-reach, F.lit(0).cast("bigint")))
    at = at.when(F.col("channel") == 63, F.sequence(F.lit(63).cast("bigint"), 63 + reach)).otherwise(F.array("channel"))
    spread = template.withColumn("at", F.explode(at))
    return spread.select("order_id", (F.lit(1.0) + F.lit(0.01) * F.col("at")).alias("wavelength"), "flux")


def doppler_ccf(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = views.spectra_long(spark, sf)
    grid = df.select("order_id", "channel", "wavelength").distinct()
    speeds = F.array(*[F.lit(float(i) * V_STEP) for i in range(-V_HALF, V_HALF + 1)])
    models = correlate.shifted_models(wide_template(df), grid, speeds, ["order_id"], bucket=0.02, span=None)
    models = models.select("order_id", "v_index", F.round((F.col("wavelength") - 1) * 100).cast("bigint").alias("channel"), "flux")
    return df, correlate.cross_correlate(df, models, ["order_id", "channel"], ["order_id", "exposure_id"])


_C = f"{k.C!r}::DOUBLE"
_WIDE = """SELECT order_id, 1.0::DOUBLE + 0.01::DOUBLE*c w, flux FROM tpl JOIN (SELECT c, greatest(0, least(63, c)) channel FROM range(-12, 76) r(c)) USING (channel)"""
_MOVED = f"""SELECT order_id, i + {V_HALF} v_index, w*sqrt((1+v/{_C})/(1-v/{_C})) x, flux y FROM wide, (SELECT i, {V_STEP!r}::DOUBLE*i v FROM range(-{V_HALF}, {V_HALF + 1}) r(i))"""
_SEG = "SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM moved WINDOW w AS (PARTITION BY order_id, v_index ORDER BY x)"
_BINS = "SELECT DISTINCT order_id, channel, 1.0::DOUBLE + 0.01::DOUBLE*channel - 0.005::DOUBLE lo, 1.0::DOUBLE + 0.01::DOUBLE*channel + 0.005::DOUBLE hi FROM spectra_long"
_MODEL = """SELECT order_id, v_index, channel, sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))
    / sum(least(x1,hi)-greatest(x,lo)) flux FROM seg JOIN bins USING (order_id) WHERE x1 > lo AND x < hi GROUP BY 1, 2, 3"""
_DOPPLER = {"tpl": _TEMPLATE, "wide": _WIDE, "moved": _MOVED, "seg": _SEG, "bins": _BINS, "mdl": _MODEL,
            "cc": _ccf_sql("spectra_long", "mdl", "order_id, exposure_id")}


@query("e21_doppler_ccf", sql("spectra_long", "SELECT * FROM cc", "order_id, exposure_id, v_index", "ccf", **_DOPPLER))
def e21_doppler_ccf(spark, sf):
    return rounded(doppler_ccf(spark, sf)[1])


N_KP, N_VR, KP_FACTOR = 9, 7, 1.5
_TOP = KP * KP_FACTOR
_CUBE = {
    "ex": _EXPOSURES,
    "g0": f"""SELECT *, sys + kp*sin(radians(lon)) v FROM (SELECT *, {-_TOP!r}::DOUBLE + i*{2 * _TOP / (N_KP - 1)!r}::DOUBLE kp, i kp_index FROM ex, range(0, {N_KP}) r(i))""",
    "ends": f"""SELECT order_id, greatest({-_TOP!r}::DOUBLE, {-V_HALF * V_STEP!r}::DOUBLE - min(v)) lo, least({_TOP!r}::DOUBLE, {V_HALF * V_STEP!r}::DOUBLE - max(v)) hi FROM g0 GROUP BY 1""",
    "cube": f"""SELECT order_id, exposure_id, kp_index, kp, j vr_index, lo + j*((hi-lo)/{N_VR - 1}) v_rest, lo + j*((hi-lo)/{N_VR - 1}) + v velocity
      FROM g0 JOIN ends USING (order_id), range(0, {N_VR}) r(j)""",
}


def make_cube(df: DataFrame) -> DataFrame:
    ex = exposures_of(df)
    limits = ex.select("order_id").distinct().withColumns({"v_min": F.lit(-V_HALF * V_STEP), "v_max": F.lit(V_HALF * V_STEP)})
    return correlate.velocity_cube(ex, ["order_id"], KP, limits, KP_FACTOR, N_KP, N_VR)


@query("d12_velocity_cube", sql("spectra_long", "SELECT * REPLACE (kp/1e5 AS kp, v_rest/1e5 AS v_rest, velocity/1e5 AS velocity) FROM cube",
    "order_id, exposure_id, kp_index, vr_index", "kp, v_rest, velocity", 5, **_CUBE))
def d12_velocity_cube(spark, sf):
    cube = make_cube(views.spectra_long(spark, sf))
    return rounded(cube.withColumns({c: F.col(c) / 1e5 for c in ("kp", "v_rest", "velocity")}), 5)


_COADD = """SELECT order_id, kp_index, vr_index, max(v_rest) v_rest, sum(ccf + (nx - ccf)*f) ccf FROM (
    SELECT *, spot - v_index f FROM (SELECT *, (velocity + {h!r}::DOUBLE*{s!r}::DOUBLE)/{s!r}::DOUBLE spot,
      least(greatest(floor((velocity + {h!r}::DOUBLE*{s!r}::DOUBLE)/{s!r}::DOUBLE + 1e-9), 0), {m})::BIGINT v_index FROM cube)
    JOIN (SELECT *, lead(ccf) OVER (PARTITION BY order_id, exposure_id ORDER BY v_index) nx FROM cc) USING (order_id, exposure_id, v_index))
    GROUP BY 1, 2, 3""".format(h=float(V_HALF), s=V_STEP, m=2 * V_HALF - 1)


def co_added(spark, sf) -> DataFrame:
    df, ccf = doppler_ccf(spark, sf)
    return correlate.co_add(ccf, make_cube(df), ["order_id"], F.lit(-V_HALF * V_STEP), F.lit(V_STEP), F.lit(2 * V_HALF + 1))


@query("e22_co_add", sql("spectra_long", "SELECT order_id, kp_index, vr_index, ccf FROM co", "order_id, kp_index, vr_index", "ccf", 5, **_DOPPLER, **_CUBE, co=_COADD))
def e22_co_add(spark, sf):
    return rounded(co_added(spark, sf).select("order_id", "kp_index", "vr_index", "ccf"), 5)


_SNR = """SELECT *, ccf/(SELECT stddev_pop(b.ccf) FROM co b WHERE b.order_id = a.order_id AND b.kp_index = a.kp_index AND abs(b.v_rest - a.top) > 1e8) snr
    FROM (SELECT *, first_value(v_rest) OVER (PARTITION BY order_id, kp_index ORDER BY ccf DESC, vr_index) top FROM co) a"""


@query("e23_ccf_snr", sql("spectra_long", "SELECT order_id, kp_index, vr_index, snr FROM sn", "order_id, kp_index, vr_index", "snr", 2, **_DOPPLER, **_CUBE, co=_COADD, sn=_SNR))
def e23_ccf_snr(spark, sf):
    got = correlate.ccf_snr(co_added(spark, sf), ["order_id", "kp_index"], 1e8)
    return rounded(got.select("order_id", "kp_index", "vr_index", "snr"), 2)


@query("e24_ccf_peak", sql("spectra_long", """
SELECT order_id, max(ccf) peak, arg_max(kp_index, (ccf, -kp_index, -vr_index)) peak_kp_index, arg_max(vr_index, (ccf, -kp_index, -vr_index)) peak_vr_index,
  count(CASE WHEN ccf >= 0.999*mx THEN 1 END) n_around_peak FROM (SELECT *, max(ccf) OVER (PARTITION BY order_id) mx FROM co) GROUP BY 1""",
    "order_id, peak_kp_index, peak_vr_index, n_around_peak", "peak", 5, **_DOPPLER, **_CUBE, co=_COADD))
def e24_ccf_peak(spark, sf):
    got = correlate.ccf_peak(co_added(spark, sf), ["order_id"], ["kp_index", "vr_index"], ["kp_index", "vr_index"], 0.999)
    return rounded(got, 5)


@query("h3_ccf_velocities", sql("spectra_long", """
SELECT order_id, i - a v_index, i*650 velocity FROM (SELECT order_id, a, unnest(range(a, b+1)) i FROM (
  SELECT order_id, floor((lo - 0.25*(hi-lo))/650)::BIGINT a, ceil((hi + 0.25*(hi-lo))/650)::BIGINT b FROM (
    SELECT order_id, min(sys)/1e3 - 3e5 lo, max(sys)/1e3 + 3e5 hi FROM ex GROUP BY 1)))""", "order_id, v_index", "velocity", ex=_EXPOSURES))
def h3_ccf_velocities(spark, sf):
    ex = exposures_of(views.spectra_long(spark, sf)).withColumn("system_velocity", F.col("system_velocity") / 1e3)
    return rounded(correlate.ccf_velocities(ex, ["order_id"], "system_velocity", 3e5, 1300.0, 2.0))


@query("d11_broadcast_template", sql("spectra_long", """
SELECT order_id, exposure_id, channel, sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))
  / sum(least(x1,hi)-greatest(x,lo)) template FROM sg JOIN bins USING (order_id) WHERE x1 > lo AND x < hi GROUP BY 1, 2, 3""",
    KEYS, "template", tpl=_TEMPLATE, wide=_WIDE, ex=_EXPOSURES, bins=_BINS,
    mv=f"SELECT order_id, exposure_id, w*sqrt((1+sys/{_C})/(1-sys/{_C})) x, flux y FROM wide JOIN ex USING (order_id)",
    sg="SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM mv WINDOW w AS (PARTITION BY order_id, exposure_id ORDER BY x)"))
def d11_broadcast_template(spark, sf):
    return rounded(exposure_templates(spark, sf))


def exposure_templates(spark, sf) -> DataFrame:
    """The order's template on the grid of each exposure, shifted by its system velocity."""
    from fluxframe.operators import grids

    df = views.spectra_long(spark, sf)
    moved = observe.shift_spectrum(wide_template(df).join(exposures_of(df), "order_id"), "system_velocity")
    grid = df.select("order_id", "channel", "wavelength").distinct()
    got = grids.rebin(moved, grid, ["order_id", "exposure_id"], target_by=["order_id"], bucket=0.02, span=None)
    return got.select("order_id", "exposure_id", F.round((F.col("wavelength") - 1) * 100).cast("bigint").alias("channel"), F.col("flux").alias("template"))


@query("g7_apply_tellurics", sql("spectra_long", f"""
SELECT {KEYS}, flux*exp(airmass*ln(least(0.999::DOUBLE, 0.9::DOUBLE*t))) flux FROM spectra_long JOIN (
  SELECT order_id, exposure_id, channel, sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))
    / sum(least(x1,hi)-greatest(x,lo)) t FROM sg JOIN bins USING (order_id) WHERE x1 > lo AND x < hi GROUP BY 1, 2, 3) USING ({KEYS})""",
    KEYS, "flux", tpl=_TEMPLATE, wide=_WIDE, ex=_EXPOSURES, bins=_BINS,
    mv=f"SELECT order_id, exposure_id, w*sqrt((1+sys/{_C})/(1-sys/{_C})) x, flux y FROM wide JOIN ex USING (order_id)",
    sg="SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM mv WINDOW w AS (PARTITION BY order_id, exposure_id ORDER BY x)"))
def g7_apply_tellurics(spark, sf):
    df = views.spectra_long(spark, sf)
    keys = ["order_id", "exposure_id", "channel"]
    base = exposure_templates(spark, sf).withColumn("t", F.least(F.lit(0.999), F.lit(0.9) * F.col("template")))
    air = df.select(*keys, "airmass")
    scaled = base.join(air, keys).select(*keys, physics.airmass_law("t", "airmass").alias("transmittance"))
    return rounded(observe.multiply_tellurics(df, scaled, keys).select(*keys, "flux"))


_G7_GRID = """SELECT t, coalesce(t - (t - lag(t) OVER w)/2, t - (lead(t) OVER w - t)/2) lo, coalesce(lead(t) OVER w - (lead(t) OVER w - t)/2, t + (t - lag(t) OVER w)/2) hi
    FROM (SELECT 1.08::DOUBLE*power(1.01::DOUBLE, i) t FROM range(0, 35) r(i) WHERE 1.08::DOUBLE*power(1.01::DOUBLE, i) <= 1.52) WINDOW w AS (ORDER BY t)"""
_SHARE = "sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))/sum(least(x1,hi)-greatest(x,lo))"


@query("g7_telluric_model", sql("spectra_long", f"""
SELECT order_id, exposure_id, t wavelength, f*exp(airmass*ln(tr)) flux FROM (
  SELECT order_id, exposure_id, t, max(airmass) airmass, {_SHARE} f FROM ss JOIN b ON x1 > lo AND x < hi GROUP BY 1, 2, 3)
JOIN (SELECT t, {_SHARE} tr FROM st JOIN b ON x1 > lo AND x < hi GROUP BY 1) USING (t)""", "order_id, exposure_id", "wavelength, flux", ex=_EXPOSURES, b=_G7_GRID,
    ss=f"""SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM (SELECT order_id, exposure_id, airmass, wavelength*sqrt((1+sys/{_C})/(1-sys/{_C})) x, flux y
      FROM spectra_long JOIN ex USING (order_id, exposure_id)) WINDOW w AS (PARTITION BY order_id, exposure_id ORDER BY x)""",
    st="""SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM (SELECT wavelength x, 0.8::DOUBLE*avg(flux) y FROM spectra_long GROUP BY 1) WINDOW w AS (ORDER BY x)"""))
def g7_telluric_model(spark, sf):
    df = views.spectra_long(spark, sf)
    moved = observe.shift_spectrum(df.join(exposures_of(df), ["order_id", "exposure_id"]), "system_velocity")
    sky = df.groupBy("wavelength").agg((F.lit(0.8) * F.avg("flux")).alias("transmittance"))
    got = observe.apply_tellurics(moved, sky, 1.10, 1.50, 0.02, resolving_power=100.0, bucket=0.02, span=None)
    return rounded(got)


@query("h4_velocity_range", sql("spectra_long", """
SELECT order_id, min(kp*sin(radians(360*(p0 - floor(p0) - CASE WHEN p0 < 0 THEN 1 ELSE 0 END))) + sys - 100)/1e5 velocity_min,
  max(kp*sin(radians(360*(p1 - floor(p1) - CASE WHEN p1 < 0 THEN 1 ELSE 0 END))) + sys + 250)/1e5 velocity_max
FROM (SELECT order_id, 2e7::DOUBLE kp, sys, (exposure_id - 20)/2000::DOUBLE p0, (exposure_id - 40)/2000::DOUBLE p1 FROM ex) GROUP BY 1""",
    "order_id", "velocity_min, velocity_max", 5, ex=_EXPOSURES))
def h4_velocity_range(spark, sf):
    from fluxframe.operators import grids

    ex = exposures_of(views.spectra_long(spark, sf)).withColumn("time", F.col("exposure_id").cast("double"))
    got = grids.velocity_range(ex, ["order_id"], "time", "system_velocity", 2000.0, (-1e7, 2e7), (-100.0, 250.0), (20.0, 40.0))
    return rounded(got.select("order_id", *[(F.col(c) / 1e5).alias(c) for c in ("velocity_min", "velocity_max")]), 5)


@query("g8_observe")
def g8_observe(spark, sf):
    """Scale, light loss, tellurics, smoothing, deformation and preparation in the chain's fixed order."""
    df = views.spectra_long(spark, sf).withColumn("flux", F.col("flux") * 0.1)
    df = df.withColumn("longitude", F.lit(-3.0) + 6 * (F.col("exposure_id") % 101) / F.lit(101.0))
    keys = ["order_id", "exposure_id", "channel"]
    bend = df.select(*keys, (1 + F.lit(0.05) * F.cos(F.col("exposure_id") + F.col("channel"))).alias("deformation"))
    air = df.select(*keys, physics.airmass_law(F.lit(0.95) - F.lit(0.001) * F.col("channel"), "airmass").alias("transmittance"))
    steps = {
        "scale": lambda d: observe.scale_spectrum(d, "transmission", star_radius=1.0),
        "light_loss": lambda d: observe.apply_light_loss(d, 0.2, "longitude", 0.1, 2.5),
        "tellurics": lambda d: observe.multiply_tellurics(d, air, keys),
        "smooth": lambda d: smooth.gauss_smooth(d, ["order_id", "exposure_id"], "channel", "flux", 1.2, out="__s").withColumn("flux", F.col("__s")).drop("__s"),
        "deformation": lambda d: observe.apply_deformation(d, bend),
        "prepare": lambda d: detrend.polyfit_detrend(d, telluric_threshold=0.01),
    }
    return rounded(observe.observe(detrend.with_matrix(df), steps).select(*COLS))
