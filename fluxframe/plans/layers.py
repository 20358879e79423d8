"""Queries on layers, lookups, chemistry and profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.functions import physics, solar
from fluxframe.operators import chemistry, fits, layers, lookup, profiles
from fluxframe.operators.axis import resolve_span
from fluxframe.operators.lookup import Axis
from fluxframe.plans import views
from fluxframe.plans.columns import num
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql

COL = ["col_id"]
W = "WINDOW w AS (PARTITION BY col_id ORDER BY pressure)"


def spanned(spark, sf) -> tuple[DataFrame, float | None]:
    df = views.layers(spark, sf)
    return df, resolve_span(df, COL, "layer", "auto")


_TAU = f"""SELECT *, sum(coalesce(inc, 0)) OVER (PARTITION BY col_id ORDER BY pressure ROWS UNBOUNDED PRECEDING) tau FROM (
    SELECT *, (kappa + lag(kappa) OVER w)/2/0.05::DOUBLE*(pressure - lag(pressure) OVER w) inc FROM layers {W})"""


@query("f6_cumulative_trapz", sql("layers", "SELECT col_id, layer, tau FROM ta", "col_id, layer", "tau", ta=_TAU))
def f6_cumulative_trapz(spark, sf):
    df, span = spanned(spark, sf)
    return rounded(layers.cumulative_trapz(df, COL, factor=20.0, span=span).select("col_id", "layer", "tau"))


@query("f6_cumulative_trapz_chunked", sql("layers", "SELECT col_id, layer, tau FROM ta", "col_id, layer", "tau", ta=_TAU))
def f6_cumulative_trapz_chunked(spark, sf):
    """The same integral with every column cut into chunks, as for columns too large for one task."""
    got = layers.cumulative_trapz(views.layers(spark, sf), COL, factor=20.0, span=0.01)
    return rounded(got.select("col_id", "layer", "tau"))


def _parabola(x, y, z, fx, fy, fz, a, b) -> str:
    c3 = f"((({fz})-({fy}))/(({z})-({y}))-(({fz})-({fx}))/(({z})-({x})))/(({y})-({x}))"
    return f"""((({fx}) - ((({fz})-({fx}))/(({z})-({x})) - {c3}*(({z})+({x})))*({x}) - {c3}*power({x},2))*(({b})-({a}))
      + ((({fz})-({fx}))/(({z})-({x})) - {c3}*(({z})+({x})))*(power({b},2)-power({a},2))/2 + {c3}*(power({b},3)-power({a},3))/3)"""


def _hydro_sql(variable: bool) -> str:
    scale = "(1/0.001::DOUBLE/1e10)" if variable else "(-1/0.001::DOUBLE)"
    final = "1/(s + 1/1e5::DOUBLE - coalesce(anchor, 0))" if variable else "s + 1e5 - coalesce(anchor, 0)"
    return f"""SELECT col_id, layer, {final} radius FROM (
      SELECT *, max(lvl) OVER (PARTITION BY col_id) anchor FROM (
        SELECT *, CASE WHEN y > 1e-4 AND x <= 1e-4 THEN s - coalesce(stp, 0) - CASE WHEN z IS NOT NULL THEN {_parabola('x', 'y', 'z', 'fx', 'fy', 'fz', '1e-4', 'y')}
             ELSE (fx+fy)*(y-1e-4)/2 END*{scale} END lvl FROM (
          SELECT *, sum(coalesce(stp, 0)) OVER (PARTITION BY col_id ORDER BY pressure DESC ROWS UNBOUNDED PRECEDING) s FROM (
            SELECT *, -CASE WHEN z IS NOT NULL THEN {_parabola('x', 'y', 'z', 'fx', 'fy', 'fz', 'x', 'y')} WHEN y IS NOT NULL THEN (fx+fy)*(y-x)/2 END*{scale} stp FROM (
              SELECT *, pressure x, lead(pressure) OVER w y, lead(pressure, 2) OVER w z, f fx, lead(f) OVER w fy, lead(f, 2) OVER w fz
              FROM (SELECT *, 1/(pressure/temperature*1000) f FROM layers) {W})))))"""


def _densities(spark, sf):
    df, span = spanned(spark, sf)
    return df.withColumn("density", F.col("pressure") / F.col("temperature") * 1000), span


@query("f7_hydrostatic_variable", sql("layers", _hydro_sql(True), "col_id, layer", "radius", 4))
def f7_hydrostatic_variable(spark, sf):
    df, span = _densities(spark, sf)
    return rounded(layers.hydrostatic_radius(df, COL, 1e-4, 0.001, 1e5, span=span).select("col_id", "layer", "radius"), 4)


@query("f7_hydrostatic_constant", sql("layers", _hydro_sql(False), "col_id, layer", "radius", 4))
def f7_hydrostatic_constant(spark, sf):
    df, span = _densities(spark, sf)
    return rounded(layers.hydrostatic_radius(df, COL, 1e-4, 0.001, 1e5, variable_gravity=False, span=span).select("col_id", "layer", "radius"), 4)


@query("f7_pressure_from_radius")
def f7_pressure_from_radius(spark, sf):
    df, span = _densities(spark, sf)
    radii = layers.hydrostatic_radius(df, COL, 1e-4, 0.001, 1e5, span=span)
    got = layers.pressure_from_radius(radii, COL, 1e-3, 1e3, 7e9, lambda p: F.lit(1000.0) + 10 * F.log10(p), lambda p: F.lit(2.3),
                                      radius="radius")
    return rounded(got, 6)


@query("f8_curvature_prior", sql("layers", f"""
SELECT col_id, -0.5::DOUBLE*coalesce(sum(power(n - 2*temperature + p, 2)), 0)/2.5e5::DOUBLE - 0.5::DOUBLE*ln(2*pi()*2.5e5) log_prior FROM (
  SELECT *, lead(temperature) OVER w n, lag(temperature) OVER w p FROM layers {W}) GROUP BY 1""", "col_id", "log_prior"))
def f8_curvature_prior(spark, sf):
    df, span = spanned(spark, sf)
    return rounded(layers.curvature_prior(df, COL, 2.5e5, span=span))


@query("f9_level_crossing", sql("layers", f"""
SELECT col_id, log10(coalesce(arg_max(mid, pressure) FILTER (d*pd < 0), min(pressure))) level FROM (
  SELECT *, lag(d) OVER w pd, (pressure + lag(pressure) OVER w)/2 mid FROM (SELECT *, 800 + 100*layer - temperature d FROM layers) {W}) GROUP BY 1""", "col_id", "level"))
def f9_level_crossing(spark, sf):
    df, span = spanned(spark, sf)
    df = df.withColumn("curve", F.lit(800.0) + 100 * F.col("layer"))
    got = layers.level_crossing(df, COL, "curve", "temperature", span=span)
    return rounded(got.withColumn("level", F.log10("level")))


@query("f9_photosphere", sql("layers", f"""
SELECT col_id, CASE WHEN max(tau) > 2/3::DOUBLE THEN coalesce(arg_min(v, pressure) FILTER (pd < 2/3::DOUBLE AND tau >= 2/3::DOUBLE), arg_max(temperature, pressure))
  ELSE arg_max(temperature, pressure) END level FROM (
  SELECT *, lag(tau) OVER w pd, lag(temperature) OVER w + (temperature - lag(temperature) OVER w)*(2/3::DOUBLE - lag(tau) OVER w)/nullif(tau - lag(tau) OVER w, 0) v FROM ta {W}) GROUP BY 1""",
    "col_id", "level", ta=_TAU))
def f9_photosphere(spark, sf):
    df, span = spanned(spark, sf)
    deep = layers.cumulative_trapz(df, COL, factor=20.0, span=span)
    return rounded(layers.level_of(deep, COL, "tau", "temperature", span=span))


@query("f10_cloud_profile", sql("layers", """
SELECT col_id, layer, CASE WHEN pressure < b THEN 0.01::DOUBLE*power(pressure/b, 1.5::DOUBLE) ELSE 0 END cloud FROM layers
JOIN (SELECT col_id, avg(pressure) b FROM layers GROUP BY 1) USING (col_id)""", "col_id, layer", "cloud", 9))
def f10_cloud_profile(spark, sf):
    df = views.layers(spark, sf)
    base = df.groupBy("col_id").agg(F.avg("pressure").alias("base"))
    got = df.join(base, "col_id").withColumn("cloud", layers.cloud_profile("pressure", "base", 0.01, 1.5))
    return rounded(got.select("col_id", "layer", "cloud"), 9)


@query("e32_contribution_share", sql("layers", "SELECT col_id, layer, kappa/sum(kappa) OVER (PARTITION BY col_id) share FROM layers", "col_id, layer", "share"))
def e32_contribution_share(spark, sf):
    return rounded(layers.contribution_share(views.layers(spark, sf), COL, "kappa").select("col_id", "layer", "share"))


_STEPS = """SELECT order_id, exposure_id, coalesce(lead(v) OVER w - v, v - lag(v) OVER w) d, {0} FROM ({1})
    WINDOW w AS (PARTITION BY order_id, exposure_id ORDER BY {0})"""


@query("e32_layer_weights", sql("spectra_long", """
SELECT order_id, exposure_id, layer, c/sum(c) OVER (PARTITION BY order_id, exposure_id) layer_weight FROM (
  SELECT order_id, exposure_id, layer, sum(contribution/lw*cw) c FROM base JOIN (
    SELECT order_id, exposure_id, channel, e/sum(e) OVER (PARTITION BY order_id, exposure_id) cw FROM (
      SELECT order_id, exposure_id, channel, abs(d)*f e FROM ch JOIN (SELECT order_id, exposure_id, channel, max(flux) f FROM base GROUP BY ALL) USING (order_id, exposure_id, channel))) USING (order_id, exposure_id, channel)
  JOIN (SELECT order_id, exposure_id, layer, abs(d)/sum(abs(d)) OVER (PARTITION BY order_id, exposure_id) lw FROM lv) USING (order_id, exposure_id, layer) GROUP BY 1, 2, 3)""",
    "order_id, exposure_id, layer", "layer_weight",
    base="""SELECT order_id, exposure_id, channel % 16 channel, channel // 16 layer, power(10::DOUBLE, -4 + power(channel // 16 + 1, 1.2::DOUBLE)) pressure,
       1 + 0.01::DOUBLE*(channel % 16) wavelength, 1 + 0.1::DOUBLE*(channel % 16) flux, flux contribution FROM spectra_long""",
    ch=_STEPS.format("channel", f"SELECT DISTINCT order_id, exposure_id, channel, {num(k.C)}/wavelength v FROM base"),
    lv=_STEPS.format("layer", "SELECT DISTINCT order_id, exposure_id, layer, log10(pressure) v FROM base")))
def e32_layer_weights(spark, sf):
    df = views.spectra_long(spark, sf)
    c, lay = F.col("channel") % 16, F.floor(F.col("channel") / 16)
    base = df.select("order_id", "exposure_id", c.alias("channel"), lay.alias("layer"),
                     F.pow(F.lit(10.0), F.lit(-4.0) + F.pow(lay + 1, F.lit(1.2))).alias("pressure"),
                     (1 + F.lit(0.01) * c).alias("wavelength"), (1 + F.lit(0.1) * c).alias("flux"), F.col("flux").alias("contribution"))
    return rounded(layers.layer_weights(base, ["order_id", "exposure_id"]))


@query("e33_linear_fit", sql("series_long", "SELECT series_id, regr_intercept(y, x/1e6) intercept, regr_slope(y, x/1e6) slope FROM series_long GROUP BY 1", "series_id", "intercept, slope"))
def e33_linear_fit(spark, sf):
    df = views.series_long(spark, sf).withColumn("x", F.col("x") / 1e6)
    return rounded(fits.linear_fit(df, ["series_id"], "x", "y"))


@query("e29_g_average", sql("spectra_long", """
SELECT order_id, exposure_id, bin, product(t) transmission FROM (
  SELECT order_id, exposure_id, channel // 16 bin, (channel // 4) % 4 species, sum(0.25::DOUBLE*exp(-flux/0.7::DOUBLE)) t FROM spectra_long GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
    "order_id, exposure_id, bin", "transmission", 9))
def e29_g_average(spark, sf):
    df = views.spectra_long(spark, sf).withColumns({
        "bin": F.floor(F.col("channel") / 16), "species": F.floor(F.col("channel") / 4) % 4, "weight": F.lit(0.25), "tau": F.col("flux")})
    return rounded(layers.g_average(df, ["order_id", "exposure_id", "bin"], mu=0.7), 9)


_EDGE = f"{num(k.C)}/((1+0.04::DOUBLE*({{0}}))*1e-4)"


def _pk(nu: str) -> str:
    return f"(power({nu},3)/(exp({num(k.H / k.KB)}*({nu})/t)-1))"


_BINS = f"SELECT order_id, exposure_id, flux kappa, 0.25::DOUBLE w, 800+10*(exposure_id%50) t, {_EDGE.format('channel//4')} fh, {_EDGE.format('channel//4+1')} fl FROM spectra_long"
_MEANS = f"""SELECT order_id, exposure_id, sum(b*(fh-fl)*w*kappa)/sum(b*(fh-fl)*w) planck_mean, sum(db*(fh-fl)*w)/sum(db*(fh-fl)*w/kappa) rosseland_mean FROM (
    SELECT *, (7*{_pk('fl')}+32*{_pk('(fl+(fh-fl)*0.25)')}+12*{_pk('(fl+(fh-fl)*0.5)')}+32*{_pk('(fl+(fh-fl)*0.75)')}+7*{_pk('fh')})/90 b,
      power((fl+fh)/2,4)/power(exp({num(k.H / k.KB)}*(fl+fh)/2/t/2)-exp(-{num(k.H / k.KB)}*(fl+fh)/2/t/2),2)/power(t,2) db FROM bins) GROUP BY 1, 2"""


@query("e30_mean_opacities", sql("spectra_long", _MEANS, "order_id, exposure_id", "planck_mean, rosseland_mean", bins=_BINS))
def e30_mean_opacities(spark, sf):
    df = views.spectra_long(spark, sf)
    step = F.floor(F.col("channel") / 4)

    def edge(i):
        return physics.reciprocal_c((1 + F.lit(0.04) * i) * F.lit(1e-4))

    df = df.select("order_id", "exposure_id", F.col("flux").alias("kappa"), F.lit(0.25).alias("weight"),
                   (F.lit(800.0) + 10 * (F.col("exposure_id") % 50)).alias("temperature"), edge(step).alias("f_high"), edge(step + 1).alias("f_low"))
    keys = ["order_id", "exposure_id"]
    return rounded(layers.planck_mean(df, keys).join(layers.rosseland_mean(df, keys), keys))


_Q16 = [(i + 0.5) / 16 for i in range(16)]


def _summed(pair: str) -> str:
    """Quantiles (vec_id, node, value) of the sums of two lists a and b of 16 quantiles each."""
    return f"""SELECT vec_id, j node, y0 + (y1-y0)/(x1-x0)*((j+0.5::DOUBLE)/16 - x0) AS value FROM (
  SELECT vec_id, j, arg_max(m, rn) FILTER (m <= (j+0.5::DOUBLE)/16 OR rn = 1) x0, arg_max(s, rn) FILTER (m <= (j+0.5::DOUBLE)/16 OR rn = 1) y0,
    arg_max(nm, rn) FILTER (m <= (j+0.5::DOUBLE)/16 OR rn = 1) x1, arg_max(ns, rn) FILTER (m <= (j+0.5::DOUBLE)/16 OR rn = 1) y1 FROM (
    SELECT *, lead(m) OVER w nm, lead(s) OVER w ns FROM (
      SELECT vec_id, s, (rn - 0.5::DOUBLE)/256 m, rn FROM (SELECT vec_id, x + y s, row_number() OVER (PARTITION BY vec_id ORDER BY x + y) rn
        FROM (SELECT vec_id, unnest(a) x, b FROM {pair}), unnest(b) u(y))
      UNION ALL SELECT vec_id, a[16] + b[16], 1, 257 FROM {pair}) WINDOW w AS (PARTITION BY vec_id ORDER BY rn)), range(0, 16) r(j) WHERE rn < 257 GROUP BY 1, 2)"""


def _part(k: int) -> str:
    return f"list_sort(list_transform(embedding[{16 * k + 1}:{16 * k + 16}], lambda v: 1 + v::DOUBLE))"


_SUMS = {"ab0": f"SELECT vec_id, {_part(0)} a, {_part(1)} b FROM embeddings"}
for _k in (2, 3):
    _SUMS[f"t{_k}"] = f"SELECT vec_id, list(value ORDER BY node) a FROM ({_summed('ab0' if _k == 2 else 'ab2')}) GROUP BY 1"
    _SUMS[f"ab{_k}"] = f"SELECT vec_id, a, {_part(_k)} b FROM t{_k} JOIN embeddings USING (vec_id)"


@query("e31_combine_quantiles", sql("", _summed("ab3"), "vec_id, node", "value", **_SUMS))
def e31_combine_quantiles(spark, sf):
    """The sum of four distributions, the quarters of each vector."""
    emb = views.table(spark, sf, "embeddings")
    parts = [F.array_sort(F.transform(F.slice("embedding", start, 16), lambda v: 1 + v.cast("double"))) for start in (1, 17, 33, 49)]
    got = layers.combine_quantiles(emb.select("vec_id", F.array(*parts).alias("parts")), "parts", _Q16, [1 / 16] * 16)
    return rounded(got.select("vec_id", F.posexplode("combined").alias("node", "value")).withColumn("node", F.col("node").cast("bigint")))


# Lookups ------------------------------------------------------------------------------------


def grid2(spark) -> DataFrame:
    base = spark.range(90).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"))
    return base.select((F.lit(500.0) + 250 * F.col("i")).alias("temperature"), F.pow(F.lit(10.0), F.col("j") - 6).alias("pressure"),
                       (F.sin("i") + F.lit(0.1) * F.col("j")).alias("value"))


_D3 = """SELECT col_id, layer, sum((CASE dp WHEN 1 THEN fp ELSE 1-fp END)*(CASE dt WHEN 1 THEN ft ELSE 1-ft END)*(sin(i+dt) + 0.1::DOUBLE*(j+dp))) AS value FROM (
   SELECT *, least(greatest((temperature - (500+250*i))/250, 0), 1) ft, least(greatest((pressure - power(10::DOUBLE,j-6))/(power(10::DOUBLE,j-5)-power(10::DOUBLE,j-6)), 0), 1) fp FROM (
     SELECT *, greatest(0, least(8, floor((temperature-500)/250)))::BIGINT i, greatest(0, least(7, floor(log10(pressure)+6+1e-9)))::BIGINT j FROM layers)),
   range(0, 2) a(dp), range(0, 2) b(dt) GROUP BY 1, 2"""


@query("d3_bilinear_lookup", sql("layers", _D3, "col_id, layer", "value"))
def d3_bilinear_lookup(spark, sf):
    axes = [Axis("temperature", "temperature"), Axis("pressure", "pressure")]
    got = lookup.grid_lookup(views.layers(spark, sf), grid2(spark), axes, "value")
    return rounded(got.select("col_id", "layer", "value"))


_G4 = {"metallicity": [-1.0, 0.0, 1.0], "co_ratio": [0.25, 0.55, 1.0], "pressure": [10.0 ** (i - 6) for i in range(9)], "temperature": [500.0 + 250 * i for i in range(7)]}


def grid4(spark) -> DataFrame:
    n = [len(v) for v in _G4.values()]
    ids = spark.range(2 * math.prod(n))
    parts, rest = [], F.col("id")
    for size in [*n, 2]:
        parts.append(rest % size)
        rest = F.floor(rest / size)
    z, c, p, t, s = parts
    value = F.lit(-3.0) + F.lit(0.2) * z * c - F.lit(0.05) * p * t / 7 + F.lit(0.3) * s + F.sin(t + p) / 10
    axes = [F.element_at(F.array(*[F.lit(v) for v in vals]), (i + 1).cast("int")).alias(name) for (name, vals), i in zip(_G4.items(), parts)]
    return ids.select(F.when(s == 0, "CH4").otherwise("H2O").alias("species"), *axes, value.alias("log10_value"))


_D4_POINTS = "SELECT col_id, layer, pressure, temperature, -1.2::DOUBLE+0.1::DOUBLE*(col_id%25) z, 0.2::DOUBLE+0.01::DOUBLE*(col_id%90) c FROM layers"


def _clamped(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} <= {lo!r}::DOUBLE THEN {lo + 1e-6!r}::DOUBLE WHEN {x} >= {hi!r}::DOUBLE THEN {hi - 1e-6!r}::DOUBLE ELSE {x} END"


_D4 = f"""SELECT col_id, layer, species, power(10::DOUBLE, sum(
    (CASE dz WHEN 1 THEN z-iz+1 ELSE iz-z END)*(CASE dc WHEN 1 THEN fc ELSE 1-fc END)*(CASE dp WHEN 1 THEN fp ELSE 1-fp END)*(CASE dt WHEN 1 THEN ft ELSE 1-ft END)
    *(-3 + 0.2::DOUBLE*(iz+dz)*(ic+dc) - 0.05::DOUBLE*(ip+dp)*(it+dt)/7 + 0.3::DOUBLE*sp + sin(it+dt+ip+dp)/10))) AS value FROM (
  SELECT *, (pressure-power(10::DOUBLE,ip-6))/(power(10::DOUBLE,ip-5)-power(10::DOUBLE,ip-6)) fp, (temperature-500-250*it)/250 ft,
    CASE ic WHEN 0 THEN (c-0.25::DOUBLE)/0.3::DOUBLE ELSE (c-0.55::DOUBLE)/0.45::DOUBLE END fc FROM (
    SELECT *, least(1, floor(z+1))::BIGINT iz, CASE WHEN c < 0.55 THEN 0 ELSE 1 END ic, least(7, floor(log10(pressure)+6+1e-9))::BIGINT ip, least(5, floor((temperature-500)/250))::BIGINT it FROM (
      SELECT col_id, layer, {_clamped('z', -1.0, 1.0)} z, {_clamped('c', 0.25, 1.0)} c, {_clamped('pressure', 1e-6, 100.0)} pressure, {_clamped('temperature', 500.0, 2000.0)} temperature FROM pts))),
  range(0,2) q1(dz), range(0,2) q2(dc), range(0,2) q3(dp), range(0,2) q4(dt), (VALUES ('CH4', 0), ('H2O', 1)) s(species, sp) GROUP BY 1, 2, 3"""


@query("d4_chemistry_lookup", sql("layers", _D4.replace("(CASE dz WHEN 1 THEN z-iz+1 ELSE iz-z END)", "(CASE dz WHEN 1 THEN z+1-iz ELSE iz-z END)"), "col_id, layer, species", "value", 8, pts=_D4_POINTS))
def d4_chemistry_lookup(spark, sf):
    points = views.layers(spark, sf).withColumns({
        "z": F.lit(-1.2) + F.lit(0.1) * (F.col("col_id") % 25), "c": F.lit(0.2) + F.lit(0.01) * (F.col("col_id") % 90)})
    axes = [Axis("metallicity", "z", 1e-6), Axis("co_ratio", "c", 1e-6), Axis("pressure", "pressure", 1e-6), Axis("temperature", "temperature", 1e-6)]
    got = lookup.grid_lookup(points, grid4(spark), axes, "log10_value", payload=["species"], log10=True)
    return rounded(got.select("col_id", "layer", "species", "value"), 8)


def cia_table(spark) -> DataFrame:
    base = spark.range(2 * 8 * 7).select((F.col("id") % 2).alias("pair"), (F.floor(F.col("id") / 2) % 8).alias("i"), F.floor(F.col("id") / 16).alias("j"))
    alpha = F.pow(F.lit(10.0), F.lit(-1.0) + F.sin(F.col("i") + F.col("pair")) + F.lit(0.2) * F.col("j"))
    return base.select("pair", (F.lit(200.0) + 400 * F.col("i")).alias("temperature"), (F.lit(1.0) + F.col("j") / F.lit(10.0)).alias("wavelength"), alpha.alias("alpha"))


def _cia_node(dj: int) -> str:
    def e(di: int) -> str:
        return f"(-1 + sin(i+{di}+pair) + 0.2::DOUBLE*(j+{dj}))"
    return f"power(10::DOUBLE, {e(0)} + ({e(1)}-{e(0)})*ft)"


@query("d5_pair_absorption", sql("spectra_long", f"""
SELECT order_id, exposure_id, channel, CASE WHEN wavelength > 1+6/10::DOUBLE THEN 0 ELSE {_cia_node(0)} + ({_cia_node(1)}-{_cia_node(0)})*fw END*0.3::DOUBLE/8*2.3::DOUBLE*1000/temperature opacity
FROM (SELECT *, (least(temperature, 3000)-200-400*i)/400 ft, (wavelength - (1+j/10::DOUBLE))*10 fw FROM (
  SELECT *, order_id % 2 pair, least(6, floor((temperature-200)/400))::BIGINT i, least(5, channel // 10)::BIGINT j FROM (SELECT *, 500+2000*flux temperature FROM spectra_long)))""",
    "order_id, exposure_id, channel", "opacity", 7))
def d5_pair_absorption(spark, sf):
    points = views.spectra_long(spark, sf).withColumns({"temperature": F.lit(500.0) + 2000 * F.col("flux"), "pair": F.col("order_id") % 2})
    got = lookup.cia_lookup(points, cia_table(spark))
    unit = k.AMU * lookup.LOSCHMIDT**2 * k.KB * 1000
    opacity = lookup.cia_opacity(F.col("alpha"), F.lit(0.3), F.lit(8.0), F.lit(2.3), F.lit(unit), F.col("temperature"))
    return rounded(got.select("order_id", "exposure_id", "channel", opacity.alias("opacity")), 7)


_STAR_GRID = "SELECT 3.55::DOUBLE + 0.03::DOUBLE*order_id lt, order_id i, channel, (1+0.01::DOUBLE*channel)*1e-4 wl, avg(flux) f, 1 + 0.1::DOUBLE*order_id r FROM spectra_long GROUP BY order_id, channel"


@query("d6_star_lookup", sql("planets spectra_long", f"""
SELECT planet_id, channel, f/norm*{num(k.SIGMA)}*power(star_teff, 4)*1e6 flux, r radius FROM (
  SELECT *, sum((f + nf)/2*abs(nu - nnu)) OVER (PARTITION BY planet_id) norm FROM (
    SELECT *, lead(f) OVER w nf, lead(nu) OVER w nnu FROM (
      SELECT planet_id, star_teff, g0.channel, g0.f + (g1.f - g0.f)*w f, g0.r + (g1.r - g0.r)*w r, {num(k.C)}/g0.wl nu FROM (
        SELECT *, least(greatest((lt - (3.55::DOUBLE+0.03::DOUBLE*i))/0.03::DOUBLE, 0), 1) w FROM (
          SELECT *, least(8, greatest(0, floor((lt-3.55::DOUBLE)/0.03::DOUBLE)))::BIGINT i FROM (SELECT *, log10(star_teff) lt FROM planets)))
      JOIN g g0 USING (i) JOIN g g1 ON g1.i = g0.i + 1 AND g1.channel = g0.channel) WINDOW w AS (PARTITION BY planet_id ORDER BY channel)))""",
    "planet_id, channel", "flux, radius", 5, g=_STAR_GRID))
def d6_star_lookup(spark, sf):
    df = views.spectra_long(spark, sf)
    grid = df.groupBy("order_id", "channel").agg(F.avg("flux").alias("flux")).select(
        (F.lit(3.55) + F.lit(0.03) * F.col("order_id")).alias("log10_teff"), ((1 + F.lit(0.01) * F.col("channel")) * F.lit(1e-4)).alias("wavelength"),
        "flux", (1 + F.lit(0.1) * F.col("order_id")).alias("radius"))
    stars = views.planets(spark, sf).select("planet_id", F.col("star_teff").alias("teff"))
    got = lookup.star_lookup(stars, grid)
    channel = F.round((F.col("wavelength") * 1e4 - 1) * 100).cast("bigint")
    return rounded(got.select("planet_id", channel.alias("channel"), (F.col("flux") * 1e6).alias("flux"), "radius"), 5)


# Chemistry ----------------------------------------------------------------------------------

_NAMES = ["H2", "He", "H2O", "CH4", "CO", "Na.R100", "Mg2SiO4(s)"]
_MASSES = {"H2": 2.0, "He": 4.0, "H2O": 18.0, "CH4": 16.0, "CO": 28.0, "Na": 23.0, "Mg2SiO4(s)": 140.0}


def named(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _NAMES])
    return views.abundances(spark, sf).select("col_id", "layer", F.get(names, F.col("species_id").cast("int")).alias("species"), "mass_fraction")


def masses(spark) -> DataFrame:
    return spark.createDataFrame(list(_MASSES.items()), "species string, molar_mass double")


_NAMED = f"SELECT col_id, layer, ({_NAMES!r})[species_id+1] species, mass_fraction FROM abundances"
_MASS = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {m!r}::DOUBLE)" for s, m in _MASSES.items()) + ") t(base, m)"
CHEM = {"nm": _NAMED, "ms": _MASS, "gas": "SELECT *, split_part(species, '.R', 1) base FROM nm WHERE species NOT LIKE '%(s)%'"}


@query("e17_mean_molar_mass", sql("abundances", """
SELECT col_id, layer, 1/sum(mass_fraction/m) mmw, sum(mass_fraction*m) mmw_vmr FROM gas JOIN ms USING (base) GROUP BY 1, 2""", "col_id, layer", "mmw, mmw_vmr", **CHEM))
def e17_mean_molar_mass(spark, sf):
    df, m = named(spark, sf), masses(spark)
    a = chemistry.mean_molar_mass(df, m, "mmr", out="mmw")
    b = chemistry.mean_molar_mass(df, m, "vmr", out="mmw_vmr")
    return rounded(a.join(b, ["col_id", "layer"]))


@query("e18_mixing_ratios", sql("abundances", """
SELECT col_id, layer, species, mass_fraction/m*mmw vmr, mass_fraction*m/mmv mmr FROM (SELECT *, split_part(species, '.R', 1) base FROM nm) JOIN ms USING (base)
LEFT JOIN (SELECT col_id, layer, 1/sum(mass_fraction/m) mmw, sum(mass_fraction*m) mmv FROM gas JOIN ms USING (base) GROUP BY 1, 2) USING (col_id, layer)""",
    "col_id, layer, species", "vmr, mmr", **CHEM))
def e18_mixing_ratios(spark, sf):
    df, m = named(spark, sf), masses(spark)
    v = chemistry.mmr_to_vmr(df, m).select("col_id", "layer", "species", F.col("volume_mixing_ratio").alias("vmr"))
    x = chemistry.vmr_to_mmr(df.withColumnRenamed("mass_fraction", "volume_mixing_ratio"), m).select("col_id", "layer", "species", F.col("mass_fraction").alias("mmr"))
    return rounded(v.join(x, ["col_id", "layer", "species"]))


_ELEMENTS = "SELECT * FROM (VALUES ('H2','H',2),('He','He',1),('H2O','H',2),('H2O','O',1),('CH4','C',1),('CH4','H',4),('CO','C',1),('CO','O',1),('Na.R100','Na',1),('Mg2SiO4(s)','Mg',2),('Mg2SiO4(s)','Si',1),('Mg2SiO4(s)','O',4)) t(species, element, n)"
_SUN = "SELECT * FROM (VALUES " + ", ".join(f"('{e}', {a!r}::DOUBLE)" for _, e, a in solar.solar_rows()) + ") t(element, ab)"


def element_counts(spark) -> DataFrame:
    formulas = spark.createDataFrame([(n,) for n in _NAMES], "species string")
    formulas = formulas.withColumn("formula", F.regexp_replace(chemistry.base_name("species"), r"\(s\)", ""))
    return chemistry.explode_elements(formulas, keep=["species"])


_AMOUNT = "SELECT col_id, layer, element, sum(n*mass_fraction) amount FROM nm JOIN el USING (species) GROUP BY 1, 2, 3"
METAL = {"nm": _NAMED, "el": _ELEMENTS, "sun": _SUN, "am": _AMOUNT}


@query("e19_metallicity", sql("abundances", """
SELECT col_id, layer, zl/zs metallicity, zl2/zs2 metallicity_h FROM (SELECT col_id, layer,
   coalesce(sum(amount) FILTER (element NOT IN ('H','He')), 0)/sum(amount) FILTER (element IN ('H','He')) zl,
   coalesce(sum(amount) FILTER (element NOT IN ('H','He')), 0)/sum(amount) FILTER (element = 'H') zl2 FROM am GROUP BY 1, 2),
 (SELECT sum(ab) FILTER (element NOT IN ('H','He'))/sum(ab) FILTER (element IN ('H','He')) zs FROM sun),
 (SELECT sum(ab) FILTER (element NOT IN ('H','He'))/sum(ab) FILTER (element = 'H') zs2 FROM sun WHERE element IN (SELECT element FROM am))""",
    "col_id, layer", "metallicity, metallicity_h", 4, **METAL))
def e19_metallicity(spark, sf):
    amounts = chemistry.element_abundances(named(spark, sf), element_counts(spark), value="mass_fraction")
    sun = solar.solar_abundances(spark)
    a = chemistry.metallicity(amounts, sun)
    b = chemistry.metallicity(amounts, sun, neglect_helium=True, only_present=True, out="metallicity_h")
    return rounded(a.join(b, ["col_id", "layer"]), 4)


@query("e19_hydrogen_ratios", sql("abundances", """
SELECT col_id, layer, element, amount/h h_ratio, log10(amount/h/(ab/sh)) relative_to_solar FROM am JOIN (SELECT col_id, layer, amount h FROM am WHERE element = 'H') USING (col_id, layer)
JOIN sun USING (element), (SELECT ab sh FROM sun WHERE element = 'H') WHERE element <> 'H'""", "col_id, layer, element", "h_ratio, relative_to_solar", **METAL))
def e19_hydrogen_ratios(spark, sf):
    amounts = chemistry.element_abundances(named(spark, sf), element_counts(spark), value="mass_fraction")
    got = chemistry.hydrogen_ratios(amounts, solar.solar_abundances(spark))
    return rounded(got.withColumn("relative_to_solar", F.log10("relative_to_solar")))


@query("f13_fill_to_one", sql("abundances", """
SELECT col_id, layer, species, mass_fraction FROM sc WHERE species NOT IN ('H2', 'He') UNION ALL
SELECT col_id, layer, s, r*w/49 FROM (SELECT col_id, layer, 1 - coalesce(sum(mass_fraction) FILTER (species NOT IN ('H2','He') AND species NOT LIKE '%(s)%'), 0) r FROM sc GROUP BY 1, 2),
  (VALUES ('H2', 37), ('He', 12)) f(s, w)""", "col_id, layer, species", "mass_fraction", 9,
    nm=_NAMED, sc="SELECT * REPLACE (0.9::DOUBLE*mass_fraction AS mass_fraction) FROM nm"))
def f13_fill_to_one(spark, sf):
    df = named(spark, sf).withColumn("mass_fraction", F.lit(0.9) * F.col("mass_fraction"))
    return rounded(chemistry.fill_to_one(df, {"H2": 37.0, "He": 12.0}).select("col_id", "layer", "species", "mass_fraction"), 9)


@query("d10_override_abundances", sql("abundances", """
SELECT col_id, layer, species, CASE WHEN NOT imp AND i+t > 1 AND t > 0 THEN x*(1-i)/t ELSE x END mass_fraction FROM (
  SELECT *, coalesce(sum(x) FILTER (imp) OVER w, 0) i, coalesce(sum(x) FILTER (NOT imp) OVER w, 0) t FROM al WINDOW w AS (PARTITION BY col_id, layer))""",
    "col_id, layer, species", "mass_fraction", 9, nm=_NAMED,
    im="SELECT DISTINCT col_id, layer, 'H2O' species, 0.1::DOUBLE + 0.05::DOUBLE*layer x FROM nm",
    b="SELECT *, true imp FROM im UNION ALL SELECT col_id, layer, species, 1.1::DOUBLE*mass_fraction, false FROM nm WHERE species <> 'H2O'",
    al="""SELECT * FROM b UNION ALL SELECT col_id, layer, s, 2.2250738585072014e-308::DOUBLE, false FROM (SELECT DISTINCT col_id, layer FROM nm), (VALUES ('CO'), ('K')) r(s)
      WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.col_id = nm.col_id AND z.layer = nm.layer AND z.species = s)""".replace("FROM nm), (VALUES", "FROM nm) nm, (VALUES")))
def d10_override_abundances(spark, sf):
    df = named(spark, sf).withColumn("mass_fraction", F.lit(1.1) * F.col("mass_fraction"))
    imposed = df.select("col_id", "layer").distinct().select("col_id", "layer", F.lit("H2O").alias("species"), (F.lit(0.1) + F.lit(0.05) * F.col("layer")).alias("mass_fraction"))
    got = chemistry.override_abundances(df, imposed, requested=["CO", "K"])
    return rounded(got.select("col_id", "layer", "species", "mass_fraction"), 9)


@query("d13_quench", sql("abundances", """
SELECT col_id, layer, species, CASE WHEN species IN ('CH4','CO','H2O') AND p < 1e-2 THEN q ELSE mass_fraction END mass_fraction FROM (
  SELECT *, coalesce(arg_min(mass_fraction, p) FILTER (p >= 1e-2) OVER w, arg_max(mass_fraction, p) OVER w) q FROM (SELECT *, power(10::DOUBLE, layer - 6) p FROM nm) WINDOW w AS (PARTITION BY col_id, species))""",
    "col_id, layer, species", "mass_fraction", nm=_NAMED))
def d13_quench(spark, sf):
    df = named(spark, sf).withColumn("pressure", F.pow(F.lit(10.0), F.col("layer") - 6))
    return rounded(lookup.quench(df, COL, 1e-2).select("col_id", "layer", "species", "mass_fraction"))


@query("e28_mix_opacity", sql("abundances", """
SELECT col_id, layer, ch, sum(mass_fraction*(1+species_id)*(2+sin(ch))) + 0.1::DOUBLE*ch kappa FROM abundances, range(0, 4) r(ch) GROUP BY 1, 2, 3""", "col_id, layer, ch", "kappa"))
def e28_mix_opacity(spark, sf):
    grid = spark.range(28).select((F.col("id") % 7).alias("species_id"), F.floor(F.col("id") / 7).alias("ch"))
    grid = grid.select("species_id", "ch", ((1 + F.col("species_id")) * (2 + F.sin("ch"))).alias("kappa"), (F.lit(0.1) * F.col("ch")).alias("continuum"))
    return rounded(layers.mix_opacity(grid, views.abundances(spark, sf), ["species_id"], ["col_id", "layer", "ch"], "continuum"))


_FORMULA = "SELECT p_partkey, 'C' || (1 + p_partkey % 12) || 'H' || (2 + p_size) || CASE WHEN p_partkey % 3 = 0 THEN 'O' ELSE 'NaCl2H' END formula FROM part"


def formulas(spark, sf) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("C"), 1 + key % 12, F.lit("H"), 2 + size, F.when(key % 3 == 0, "O").otherwise("NaCl2H"))
    return views.table(spark, sf, "part").select("p_partkey", text.alias("formula"))


_ELEMENT_MASSES = [("H", 1.0), ("C", 12.0), ("O", 16.0), ("Na", 23.0), ("Cl", 35.0)]


@query("a14_elements", sql("", """
SELECT p_partkey, element, sum(n)::BIGINT n FROM (SELECT p_partkey, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 1)) element,
  unnest(list_transform(regexp_extract_all(formula, '([A-Z][a-z]?)(\\d*)', 2), lambda v: CASE WHEN v = '' THEN 1 ELSE v::BIGINT END)) n FROM fm) GROUP BY 1, 2""", fm=_FORMULA))
def a14_elements(spark, sf):
    return chemistry.explode_elements(formulas(spark, sf), keep=["p_partkey"]).select("p_partkey", "element", "n")


@query("a14_molar_mass", sql("", """
SELECT p_partkey, 12::DOUBLE*(1 + p_partkey % 12) + 2 + p_size + CASE WHEN p_partkey % 3 = 0 THEN 16 ELSE 94 END molar_mass FROM part""", "p_partkey", "molar_mass"))
def a14_molar_mass(spark, sf):
    table = spark.createDataFrame(_ELEMENT_MASSES, "element string, mass double")
    return rounded(chemistry.molar_mass(formulas(spark, sf), table, keep=["p_partkey"]))


@query("a11_mass_opacity", sql("abundances", f"""
SELECT col_id, layer, species_id, greatest(mass_fraction - 0.1::DOUBLE, 0)*1e-22/((1 + 2*species_id)*{num(k.AMU)}) kappa FROM abundances""", "col_id, layer, species_id", "kappa"))
def a11_mass_opacity(spark, sf):
    df = views.abundances(spark, sf).withColumn("cross_section", (F.col("mass_fraction") - F.lit(0.1)) * 1e-22)
    dim = spark.range(7).select(F.col("id").alias("species_id"), (F.lit(1.0) + 2 * F.col("id")).alias("molar_mass"))
    return rounded(lookup.to_mass_opacity(df, dim, species="species_id").select("col_id", "layer", "species_id", "kappa"))


# Profiles -----------------------------------------------------------------------------------

N_LAYERS = 10


def profile_samples(spark, sf) -> DataFrame:
    """Profile parameters of every posterior draw on ten layers from 1e-6 to 1e3 bar."""
    df = views.samples(spark, sf).select("run_id", "sample_id", (F.col("p1") / 1000).alias("a"), (F.col("p2") % 100).alias("b"))
    return profiles.over_pressures(df, -6.0, 3.0, N_LAYERS)


PROFILE = {"pr": f"""SELECT run_id, sample_id, p1/1000 a, p2 % 100 b, l layer, -6 + l*1.0::DOUBLE lp, power(10::DOUBLE, -6 + l*1.0::DOUBLE) p
    FROM samples, range(0, {N_LAYERS}) r(l)"""}
PKEYS = "run_id, sample_id, layer"
PCOLS = ["run_id", "sample_id", "layer"]


@query("i1_simple_profiles", sql("samples", f"SELECT {PKEYS}, 1000 + a isothermal, (500+a)*power(p/1e-6, 0.001::DOUBLE*(1+b)) power_law FROM pr", PKEYS, "isothermal, power_law", 5, **PROFILE))
def i1_simple_profiles(spark, sf):
    df = profile_samples(spark, sf)
    return rounded(df.select(*PCOLS, profiles.isothermal(F.lit(1000.0) + F.col("a")).alias("isothermal"),
                             profiles.power_law("pressure", 1e-6, F.lit(500.0) + F.col("a"), F.lit(0.001) * (1 + F.col("b"))).alias("power_law")), 5)


def _guillot_sql(tau: str, gamma: str, ti: str, te: str, share: str) -> str:
    return f"""power(0.75*power({ti},4)*(2/3::DOUBLE+{tau}) + 0.75*power({te}*sqrt(2),4)*{share}*(2/3::DOUBLE + 1/({gamma})/sqrt(3)
      + (({gamma})/sqrt(3) - 1/sqrt(3)/({gamma}))*exp(-({gamma})*({tau})*sqrt(3))), 0.25)"""


_GK, _GG, _GTI, _GTE = "(0.01::DOUBLE+0.0001::DOUBLE*b)", "(0.4::DOUBLE+0.005::DOUBLE*b)", "200::DOUBLE", "(1000+a)"


@query("i2_guillot_profiles", sql("samples", f"""SELECT {PKEYS}, {_guillot_sql(f'{_GK}*p*1e6/2500', _GG, _GTI, _GTE, '0.25')} global_mean,
  {_guillot_sql(f'{_GK}*p*1e6/2500', _GG, _GTI, _GTE, '0.5')} dayside, {_guillot_sql('p*1e6*1e-5', _GG, _GTI, _GTE, '0.25')} delta_form,
  {_guillot_sql(f'{_GK}*3*p*1e6/2500', _GG, _GTI, _GTE, '0.25')} metallic, {_guillot_sql('p*1e6*1e-5', _GG, _GTI, _GTE, '0.25')}*(1 - 0.2::DOUBLE/(1+p/0.01::DOUBLE)) modified FROM pr""",
    PKEYS, "global_mean, dayside, delta_form, metallic, modified", 5, **PROFILE))
def i2_guillot_profiles(spark, sf):
    df = profile_samples(spark, sf)
    kappa, gamma, te = F.lit(0.01) + F.lit(0.0001) * F.col("b"), F.lit(0.4) + F.lit(0.005) * F.col("b"), F.lit(1000.0) + F.col("a")
    return rounded(df.select(
        *PCOLS,
        profiles.guillot_global("pressure", kappa, gamma, 2500.0, 200.0, te).alias("global_mean"),
        profiles.guillot_dayside("pressure", kappa, gamma, 2500.0, 200.0, te).alias("dayside"),
        profiles.guillot_delta("pressure", -1e-5, gamma, 200.0, te).alias("delta_form"),
        profiles.guillot_metallic("pressure", gamma, 2500.0, 200.0, te, kappa, 3.0).alias("metallic"),
        profiles.guillot_modified("pressure", 1e-5, gamma, 200.0, te, 0.01, 0.2).alias("modified"),
    ), 5)


_NODES = profiles.even_nodes(-6.0, 3.0, 2)  # -6, -3, 0, 3
_VALUES = ["500+a", "600+5*b", "900+a*0.5", "1000+10*b"]


def _node_values():
    a, b = F.col("a"), F.col("b")
    return [F.lit(500.0) + a, F.lit(600.0) + 5 * b, F.lit(900.0) + a * 0.5, F.lit(1000.0) + 10 * b]


def _linear_sql() -> str:
    parts = [f"WHEN lp <= {_NODES[i + 1]!r} THEN ({_VALUES[i]}) + (({_VALUES[i + 1]})-({_VALUES[i]}))/3::DOUBLE*(lp - ({_NODES[i]!r}))" for i in range(3)]
    return "CASE " + " ".join(parts) + " END"


@query("i3_linear_spline", sql("samples", f"SELECT {PKEYS}, {_linear_sql()} temperature, power(10::DOUBLE, ({_linear_sql()})/-200) abundance FROM pr", PKEYS, "temperature, abundance", 6, **PROFILE))
def i3_linear_spline(spark, sf):
    t = profiles.linear_spline("log_pressure", _NODES, _node_values())
    x = profiles.linear_spline("log_pressure", _NODES, [v / -200 for v in _node_values()])
    return rounded(profile_samples(spark, sf).select(*PCOLS, t.alias("temperature"), F.pow(F.lit(10.0), x).alias("abundance")))


def _pchip_sql() -> str:
    d = [f"((({_VALUES[i + 1]})-({_VALUES[i]}))/3::DOUBLE)" for i in range(3)]
    inner = [f"CASE WHEN {d[i]}*{d[i + 1]} > 0 THEN 2/(1/{d[i]} + 1/{d[i + 1]}) ELSE 0 END" for i in range(2)]

    def end(d0: str, d1: str) -> str:
        s = f"((3*{d0} - {d1})/2)"
        return f"CASE WHEN sign({s}) <> sign({d0}) THEN 0 WHEN sign({d0}) <> sign({d1}) AND abs({s}) > 3*abs({d0}) THEN 3*{d0} ELSE {s} END"

    slopes = [end(d[0], d[1]), *inner, end(d[2], d[1])]
    cases = []
    for i in range(3):
        t = f"((lp - ({_NODES[i]!r}))/3)"
        cases.append(f"""WHEN lp < {_NODES[i + 1]!r} OR {i} = 2 THEN (2*power({t},3)-3*power({t},2)+1)*({_VALUES[i]}) + (power({t},3)-2*power({t},2)+{t})*3*({slopes[i]})
          + (3*power({t},2)-2*power({t},3))*({_VALUES[i + 1]}) + (power({t},3)-power({t},2))*3*({slopes[i + 1]})""")
    return "CASE " + " ".join(cases) + " END"


@query("i4_monotone_cubic", sql("samples", f"SELECT {PKEYS}, {_pchip_sql()} temperature FROM pr", PKEYS, "temperature", 7, **PROFILE))
def i4_monotone_cubic(spark, sf):
    got = profiles.with_pchip(profile_samples(spark, sf), "log_pressure", _NODES, _node_values(), "temperature")
    return rounded(got.select(*PCOLS, "temperature"), 7)


@query("i5_stepped_profile", sql("samples", f"""SELECT {PKEYS}, power(10::DOUBLE, CASE WHEN lp >= 0 THEN -2 - 0.01::DOUBLE*b WHEN lp >= -3 THEN -4 + 0.001::DOUBLE*a ELSE -5 END) abundance FROM pr""",
    PKEYS, "abundance", 9, **PROFILE))
def i5_stepped_profile(spark, sf):
    values = [F.lit(-2.0) - F.lit(0.01) * F.col("b"), F.lit(-4.0) + F.lit(0.001) * F.col("a"), -5.0]
    return rounded(profile_samples(spark, sf).select(*PCOLS, profiles.stepped("log_pressure", [3.0, 0.0, -3.0, -6.0], values).alias("abundance")), 9)


@query("i6_three_region", sql("samples", f"""
SELECT {PKEYS}, CASE WHEN lp < -4 THEN t0 + power((lp+6)/al,2) WHEN lp < 1 THEN t2 + power((lp+1.5)/0.3::DOUBLE,2) ELSE t3 END temperature FROM (
  SELECT *, CASE WHEN ps = -5 THEN ts - power((ps+6)/al,2) ELSE t1 - power(2/al,2) END t0, CASE WHEN ps >= 1 THEN ts ELSE t2 + power(2.5/0.3::DOUBLE,2) END t3 FROM (
    SELECT *, t2 + power(-2.5/0.3::DOUBLE,2) t1 FROM (
      SELECT *, CASE WHEN ps >= 1 THEN ts - power(2.5/0.3::DOUBLE,2) WHEN ps >= -4 THEN ts - power((ps+1.5)/0.3::DOUBLE,2)
         ELSE ts - power((ps+6)/al,2) + power(2/al,2) - power(-2.5/0.3::DOUBLE,2) END t2 FROM (
        SELECT *, 1000+a ts, 0.7::DOUBLE+0.0123::DOUBLE*b al, CASE sample_id % 3 WHEN 0 THEN 2 WHEN 1 THEN -2 ELSE -5 END ps FROM pr))))""", PKEYS, "temperature", 6, **PROFILE))
def i6_three_region(spark, sf):
    df = profile_samples(spark, sf)
    at = F.when(F.col("sample_id") % 3 == 0, F.lit(2.0)).when(F.col("sample_id") % 3 == 1, F.lit(-2.0)).otherwise(F.lit(-5.0))
    got = profiles.three_region(df, [-6.0, -4.0, -1.5, 1.0, at], F.lit(1000.0) + F.col("a"), (F.lit(0.7) + F.lit(0.0123) * F.col("b"), 0.3),
                                by=["run_id", "sample_id"], levels=[-6.0 + i for i in range(N_LAYERS)])
    return rounded(got.select(*PCOLS, "temperature"), 6)


@query("i7_gradient_profile")
def i7_gradient_profile(spark, sf):
    df = profile_samples(spark, sf)
    slopes = [F.lit(0.05) + F.lit(0.001) * F.col("b"), 0.1, F.lit(0.1) + F.lit(0.0002) * F.col("a"), 0.2, 0.25, 0.3]
    got = profiles.gradient_profile(df, slopes, F.lit(2000.0) + F.col("a"), ["run_id", "sample_id"], span=None)
    return rounded(got.select(*PCOLS, "temperature"), 5)


@query("i2_smoothed_grid")
def i2_smoothed_grid(spark, sf):
    """Modified profile on 260 levels, running means of 25, every second level from 1e-6 to 1e3 bar."""
    df = views.samples(spark, sf).groupBy("run_id").agg(F.avg("p1").alias("t"))
    got = profiles.smoothed_grid(df, lambda p: profiles.guillot_modified(p, 1e-5, 0.4, 200.0, F.col("t") / 200, 0.01, 0.2), ["run_id"])
    return rounded(got.select("run_id", "layer", F.log10("pressure").alias("log_pressure"), "temperature"), 5)
