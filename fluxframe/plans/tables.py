"""Queries on sources, sinks and catalogues. Text and Parquet inputs are written from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.functions import constants as k
from fluxframe.operators import catalog, fitting, grids, posterior
from fluxframe.plans import views
from fluxframe.plans.columns import num
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql
from fluxframe.session import shared_folder
from fluxframe.sources import tables, text

KEYS = "order_id, exposure_id, channel"


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/fluxframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("a1_read_spectra_three_columns", sql("spectra_long", """
SELECT round(wavelength*1000)::BIGINT + 10000*exposure_id point, flux, uncertainty FROM spectra_long""", "point", "flux, uncertainty"))
def a1_read_spectra_three_columns(spark, sf):
    path = scratch(spark, "spectra")
    df = views.spectra_long(spark, sf).withColumn("wavelength", F.round(F.col("wavelength") * 1000) + 10000 * F.col("exposure_id"))
    tables.write_text(df, path, ["wavelength", "flux", "uncertainty"], comment="wavelength flux sigma")
    got = text.read_spectra(spark, path)
    return rounded(got.select(F.col("wavelength").cast("bigint").alias("point"), "flux", "uncertainty"))


@query("a1_read_spectra_four_columns", sql("spectra_long", """
SELECT round(wavelength*1000)::BIGINT + 10000*exposure_id point, 0.01::DOUBLE bin_width, CASE WHEN flux >= 0.8 THEN flux END flux, uncertainty FROM spectra_long""",
    "point", "bin_width, flux, uncertainty"))
def a1_read_spectra_four_columns(spark, sf):
    path = scratch(spark, "spectra")
    df = views.spectra_long(spark, sf).withColumn("wavelength", F.round(F.col("wavelength") * 1000) + 10000 * F.col("exposure_id"))
    df = df.withColumns({"width": F.lit(0.01), "flux": F.when(F.col("flux") >= 0.8, F.col("flux").cast("string")).otherwise("nan")})
    tables.write_text(df, path, ["wavelength", "width", "flux", "uncertainty"], separator=", ")
    got = text.read_spectra(spark, path)
    return rounded(got.select(F.col("wavelength").cast("bigint").alias("point"), "bin_width", "flux", "uncertainty"))


@query("a3_read_photometry", sql("", """
SELECT 'band/' || p_partkey AS name, 1 + 0.1::DOUBLE*p_size w_low, 1.3::DOUBLE + 0.11::DOUBLE*p_size w_high, p_retailprice flux,
  0.95::DOUBLE*(1 + 0.1::DOUBLE*p_size) model_low, 1.05::DOUBLE*(1.3::DOUBLE + 0.11::DOUBLE*p_size) model_high,
  (2.3::DOUBLE + 0.21::DOUBLE*p_size)/2/(0.3::DOUBLE + 0.01::DOUBLE*p_size) resolution FROM part""", "name", "w_low, w_high, flux, model_low, model_high, resolution"))
def a3_read_photometry(spark, sf):
    path = scratch(spark, "photometry")
    part = views.table(spark, sf, "part")
    name, size = F.concat(F.lit("band/"), F.col("p_partkey")), F.col("p_size")
    points = part.select(name.alias("name"), (F.lit(1.0) + F.lit(0.1) * size).alias("lo"), (F.lit(1.3) + F.lit(0.11) * size).alias("hi"), "p_retailprice", F.lit(0.5).alias("err"))
    tables.write_text(points, path, ["name", "lo", "hi", "p_retailprice", "err"], ", ", "name, w_low, w_high, flux, error")
    return rounded(text.read_photometry(spark, path).drop("err"))


_ARCHIVE = {"pl_orbper": "period", "pl_orbpererr1": "rel_upper", "pl_orbpererr2": "rel_lower", "pl_radj": "radius_j", "pl_bmassj": "mass_j", "pl_orbsmax": "axis_au",
            "pl_orbsmaxlim": "flag", "st_rad": "star_r", "st_mass": "star_m", "st_teff": "star_teff", "st_logg": "logg", "st_age": "age", "sy_dist": "dist", "sy_vmag": "vmag", "sy_kepmag": "kepmag"}


def archive(spark, sf) -> DataFrame:
    """Planets under the archive's column names and units."""
    df = views.planets(spark, sf).withColumns({
        "radius_j": F.col("radius") / k.R_JUP, "mass_j": F.col("mass") / k.M_JUP, "axis_au": F.col("axis") / k.AU, "star_r": F.col("star_radius") / k.R_SUN,
        "star_m": F.col("star_mass") / k.M_SUN, "logg": F.lit(4.0) + F.lit(0.01) * (F.col("planet_id") % 60), "age": F.col("star_age") / (1e9 * k.YEAR),
        "dist": F.lit(10.0) + F.col("planet_id") % 90, "vmag": F.lit(8.0) + F.lit(0.1) * (F.col("planet_id") % 30), "kepmag": F.lit(9.0) + F.lit(0.1) * (F.col("planet_id") % 30),
        "flag": F.lit(0)})
    return df.select(F.concat(F.lit("planet "), F.col("planet_id")).alias("pl_name"), F.lit("host").alias("hostname"), *[F.col(v).alias(n) for n, v in _ARCHIVE.items()])


_NORMAL = f"""SELECT 'planet ' || planet_id AS name, period*86400 orbital_period, rel_upper*86400 orbital_period_error_upper, radius/1e9 radius, mass/1e30 mass, axis/1e12 orbit_semi_major_axis,
   star_radius/1e10 star_radius, star_mass/1e33 star_mass, power(10::DOUBLE, 4 + 0.01::DOUBLE*(planet_id%60)) star_reference_gravity, star_age/1e15 star_age,
   (10 + planet_id % 90)*{num(k.PC)}/1e18 system_distance, 8 + 0.1::DOUBLE*(planet_id%30) system_apparent_magnitude_v, 9 + 0.1::DOUBLE*(planet_id%30) system_apparent_magnitude_kepler FROM planets"""
_NORMAL_COLS = "orbital_period, orbital_period_error_upper, radius, mass, orbit_semi_major_axis, star_radius, star_mass, star_reference_gravity, star_age, system_distance, system_apparent_magnitude_v, system_apparent_magnitude_kepler"


def _normal(df: DataFrame) -> DataFrame:
    scale = {"radius": 1e9, "mass": 1e30, "orbit_semi_major_axis": 1e12, "star_radius": 1e10, "star_mass": 1e33, "star_age": 1e15, "system_distance": 1e18}
    return rounded(df.select("name", *[(F.col(c).cast("double") / scale.get(c, 1.0)).alias(c) for c in _NORMAL_COLS.split(", ")]), 5)


@query("a5_normalize_catalog", sql("planets", _NORMAL, "name", _NORMAL_COLS, 5))
def a5_normalize_catalog(spark, sf):
    return _normal(catalog.normalize_catalog(archive(spark, sf), best_mass=True))


@query("a4_read_catalog", sql("planets", _NORMAL, "name", _NORMAL_COLS, 5))
def a4_read_catalog(spark, sf):
    """Write a tab-separated archive file, read it and convert it."""
    path = scratch(spark, "catalog")
    archive(spark, sf).write.option("sep", "\t").option("header", "true").option("nullValue", "").csv(path)
    return _normal(catalog.normalize_catalog(text.read_catalog(spark, path), best_mass=True))


@query("a6_read_posterior", sql("samples", "SELECT 'fit' run_id, p1, p2, log_l log_likelihood FROM samples", "run_id", "p1, p2, log_likelihood", 5))
def a6_read_posterior(spark, sf):
    folder = scratch(spark, "posterior")
    tables.write_text(views.samples(spark, sf), f"{folder}/out_PMN/fit_post_equal_weights.dat", ["p1", "p2", "log_l"], separator="   ")
    spark.createDataFrame([('["p1", "p2"]',)], "value string").coalesce(1).write.text(f"{folder}/out_PMN/fit_params.json")
    return rounded(text.read_posterior(spark, folder, "fit"), 5)


def opacity_table(spark, sf) -> DataFrame:
    df = views.spectra_long(spark, sf)
    return df.select(F.concat(F.lit("s"), F.col("order_id")).alias("species"), F.col("exposure_id").alias("temperature"), "wavelength", F.col("flux").alias("kappa"))


_GRID = "SELECT 's' || order_id species, exposure_id temperature, wavelength, flux kappa FROM spectra_long WHERE order_id IN (2, 7) AND wavelength BETWEEN 1.1 AND 1.3"


@query("a9_read_grid", sql("spectra_long", _GRID, "species, temperature", "wavelength, kappa"))
def a9_read_grid(spark, sf):
    path = scratch(spark, "opacity")
    tables.write_table(opacity_table(spark, sf), path, ["species"], ["wavelength"], files_per_partition=2)
    return rounded(tables.read_grid(spark, path, ["s2", "s7"], (1.1, 1.3)).select("species", "temperature", "wavelength", "kappa"))


@query("a17_write_table", sql("spectra_long", "SELECT order_id, count(*) n, sum(flux) total FROM spectra_long GROUP BY 1", "order_id, n", "total", 5))
def a17_write_table(spark, sf):
    """Write spectra partitioned by order and read them back."""
    path = scratch(spark, "sink")
    tables.write_table(views.spectra_long(spark, sf), path, ["order_id"], ["exposure_id", "channel"], files_per_partition=4)
    back = spark.read.parquet(path)
    return rounded(back.groupBy(F.col("order_id").cast("bigint").alias("order_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("flux").alias("total")), 5)


@query("a18_ingest_opacities", sql("spectra_long", """
SELECT 's' || order_id species, temperature, b wavelength_index, sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))/sum(least(x1,hi)-greatest(x,lo)) cross_section FROM (
  SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM (SELECT order_id, exposure_id % 5 temperature, wavelength*1e-4 x, avg(flux) y FROM spectra_long GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY order_id, temperature ORDER BY x)),
  (SELECT b, (1.03::DOUBLE + 0.02::DOUBLE*b - 0.01::DOUBLE)*1e-4 lo, (1.03::DOUBLE + 0.02::DOUBLE*b + 0.01::DOUBLE)*1e-4 hi FROM range(0, 27) r(b)) WHERE x1 > lo AND x < hi GROUP BY 1, 2, 3""",
    "species, temperature, wavelength_index", "cross_section"))
def a18_ingest_opacities(spark, sf):
    """Write one wavenumber file per species and temperature, convert the folder, read the table."""
    source, target = scratch(spark, "xsec"), scratch(spark, "ingested")
    df = views.spectra_long(spark, sf).groupBy("order_id", (F.col("exposure_id") % 5).alias("t"), "wavelength").agg(F.avg("flux").alias("y"))
    line = F.concat_ws(" ", (1 / (F.col("wavelength") * 1e-4)).cast("string"), F.col("y").cast("string"))
    folders = df.select(F.concat(F.lit("s"), F.col("order_id"), F.lit("_"), F.col("t"), F.lit("_1")).alias("case"), line.alias("value"))
    folders.repartition("case").write.partitionBy("case").text(source)
    files = text.read_cross_sections(spark, f"{source}/*", r"case=(s\d+)_(\d+)_(\d+)/")
    grid = spark.range(27).select(((F.lit(1.03) + F.lit(0.02) * F.col("id")) * 1e-4).alias("wavelength"))
    tables.ingest_opacities(files, grid, target, bucket=2e-6)
    got = tables.read_grid(spark, target)
    index = F.round((F.col("wavelength") * 1e4 - 1.03) / 0.02).cast("bigint")
    return rounded(got.select("species", F.col("temperature").cast("bigint").alias("temperature"), index.alias("wavelength_index"), "cross_section"))


@query("e25_best_measurement", sql("measurements", """
SELECT entity_id, parameter, value, err_upper, err_lower, n_sources FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, parameter) n_sources FROM measurements)
QUALIFY row_number() OVER (PARTITION BY entity_id, parameter ORDER BY abs(err_upper) + abs(err_lower), source_order) = 1""",
    "entity_id, parameter, n_sources", "value, err_upper, err_lower"))
def e25_best_measurement(spark, sf):
    return rounded(catalog.best_measurement(views.measurements(spark, sf)))


@query("e25_best_without_errors", sql("measurements", """
SELECT entity_id, parameter, value FROM (SELECT entity_id, parameter, value, row_number() OVER (PARTITION BY entity_id, parameter ORDER BY source_order) r,
  count(*) OVER (PARTITION BY entity_id, parameter) n FROM measurements) WHERE r = least(2, n)""", "entity_id, parameter", "value"))
def e25_best_without_errors(spark, sf):
    df = views.measurements(spark, sf).withColumns({"err_upper": F.lit(None).cast("double"), "err_lower": F.lit(None).cast("double")})
    return rounded(catalog.best_measurement(df).select("entity_id", "parameter", "value"))


_POP = """SELECT planet_id, greatest(abs(0.9::DOUBLE*rel_upper), abs(rel_lower), abs(1.1::DOUBLE*rel_upper), abs(0.5::DOUBLE*rel_lower)) u, mass, radius FROM planets"""


def _population(spark, sf) -> DataFrame:
    df = views.planets(spark, sf)
    return df.withColumns({
        "mass_upper": F.col("mass") * F.col("rel_upper") * 0.9, "mass_lower": F.col("mass") * F.col("rel_lower"),
        "radius_upper": F.col("radius") * F.col("rel_upper") * 1.1, "radius_lower": F.col("radius") * F.col("rel_lower") * 0.5})


@query("c6_select_population", sql("planets", f"SELECT planet_id, u max_uncertainty FROM ({_POP}) WHERE mass IS NOT NULL AND radius IS NOT NULL AND u <= 0.043", "planet_id", "max_uncertainty"))
def c6_select_population(spark, sf):
    return rounded(catalog.select_population(_population(spark, sf), 0.043).select("planet_id", "max_uncertainty"))


@query("c6_population_counts", sql("planets", f"""SELECT count(*) n_table, count(mass) n_mass, count(radius) n_radius,
  count(*) FILTER (mass IS NOT NULL AND radius IS NOT NULL AND u <= 0.043) n_scatter FROM ({_POP})"""))
def c6_population_counts(spark, sf):
    return catalog.population_counts(_population(spark, sf), 0.043)


@query("h7_top_choice", sql("measurements", "SELECT entity_id, max(value) top FROM measurements GROUP BY 1", "entity_id", "top"))
def h7_top_choice(spark, sf):
    """Default choice: the row with the highest value per entity."""
    got = posterior.best_sample(views.measurements(spark, sf).drop("source_order").withColumn("tie", F.lit(0)), ["entity_id"], "value", "tie")
    return rounded(got.select("entity_id", F.col("value").alias("top")))


@query("h8_sorted_grid", sql("spectra_long", """
SELECT order_id, exposure_id, channel, row_number() OVER (PARTITION BY order_id, exposure_id ORDER BY 1/wavelength) AS rank FROM spectra_long"""))
def h8_sorted_grid(spark, sf):
    """Rank by frequency, ascending, within each spectrum."""
    from fluxframe.operators.axis import running_total

    df = views.spectra_long(spark, sf).withColumns({"one": F.lit(1.0), "nu": 1 / F.col("wavelength")})
    got = running_total(df, ["order_id", "exposure_id"], "nu", {"r": "one"})
    return got.select("order_id", "exposure_id", "channel", F.col("r").cast("bigint").alias("rank"))


@query("h9_set_operations", sql("samples", """
SELECT 'both' side, sample_id FROM samples WHERE p1 > 250000 AND p2 > 500 UNION ALL SELECT 'first', sample_id FROM samples WHERE p1 > 250000 AND NOT p2 > 500
UNION ALL SELECT 'any', sample_id FROM samples WHERE p1 > 250000 OR p2 > 500"""))
def h9_set_operations(spark, sf):
    df = views.samples(spark, sf)
    a, b = df.filter("p1 > 250000").select("sample_id"), df.filter("p2 > 500").select("sample_id")
    parts = {"both": a.intersect(b), "first": a.join(b, "sample_id", "left_anti"), "any": a.union(b).distinct()}
    return parts["both"].withColumn("side", F.lit("both")).unionByName(parts["first"].withColumn("side", F.lit("first"))).unionByName(
        parts["any"].withColumn("side", F.lit("any"))).select("side", "sample_id")


_DATA = """SELECT dataset, w wavelength, 0.04::DOUBLE bin_width, f flux, 0.05::DOUBLE uncertainty, w-0.02::DOUBLE lo, w+0.02::DOUBLE hi FROM (
    SELECT (order_id % 2)::VARCHAR dataset, 1.04::DOUBLE + 0.04::DOUBLE*(channel // 4) w, avg(flux) f FROM spectra_long GROUP BY 1, 2)"""


def _model(df: DataFrame) -> DataFrame:
    """Straight-line model spectra of the parameters on 69 wavelengths."""
    at = F.lit(1.0) + F.lit(0.01) * F.col("i")
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(68)))).select(
        "sample_id", at.alias("wavelength"), (F.col("a") + F.col("b") * (at - 1) + F.lit(0.05) * F.sin(F.col("i"))).alias("flux"))


@query("k1_fit_chain", sql("spectra_long", f"""
SELECT sample_id, sum(-0.5::DOUBLE*power((m-flux)/uncertainty,2) - 0.5::DOUBLE*ln(2*pi()*uncertainty*uncertainty)) log_l FROM (
  SELECT sample_id, dataset, wavelength, flux, uncertainty, sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))/sum(least(x1,hi)-greatest(x,lo)) m
  FROM (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM mdl WINDOW w AS (PARTITION BY sample_id ORDER BY x)) JOIN dat ON x1 > lo AND x < hi GROUP BY 1, 2, 3, 4, 5) GROUP BY 1""",
    "sample_id", "log_l", 5, dat=_DATA,
    mdl="""SELECT sample_id, 1 + 0.01::DOUBLE*i x, a + b*(1 + 0.01::DOUBLE*i - 1) + 0.05::DOUBLE*sin(i) y FROM (
      SELECT exposure_id sample_id, avg(flux) a, avg(flux - 1) b FROM spectra_long GROUP BY 1), range(0, 69) r(i)"""))
def k1_fit_chain(spark, sf):
    """A user model per sample, shared by two datasets, binned, scored and summed."""
    df = views.spectra_long(spark, sf)
    step = F.floor(F.col("channel") / 4)
    data = df.groupBy((F.col("order_id") % 2).cast("string").alias("dataset"), (F.lit(1.04) + F.lit(0.04) * step).alias("wavelength")).agg(F.avg("flux").alias("flux"))
    data = data.withColumns({"bin_width": F.lit(0.04), "uncertainty": F.lit(0.05)})
    parameters = df.groupBy(F.col("exposure_id").alias("sample_id")).agg(F.avg("flux").alias("a"), F.avg(F.col("flux") - 1).alias("b"))
    mapping = spark.createDataFrame([("0", "0"), ("1", "0")], "dataset string, source_dataset string")
    return rounded(fitting.score_samples(parameters, {"0": _model}, data, mapping), 5)


@query("k6_mix_columns", sql("spectra_long", """
SELECT order_id, wavelength, sum(flux*(1 + exposure_id % 3)) flux FROM spectra_long GROUP BY 1, 2""", "order_id", "wavelength, flux"))
def k6_mix_columns(spark, sf):
    df = views.spectra_long(spark, sf).withColumn("column_weight", 1 + F.col("exposure_id") % 3)
    return rounded(fitting.mix_columns(df, ["order_id"]).select("order_id", "wavelength", "flux"))


@query("k5_weighted_band", sql("spectra_long", """
SELECT order_id, exposure_id, 'b1' band, sum((y + (y1-y)/(x1-x)*((greatest(x,1.013)+least(x1,1.307))/2 - x))*(least(x1,1.307)-greatest(x,1.013)))/sum(least(x1,1.307)-greatest(x,1.013)) flux FROM (
  SELECT *, lead(x) OVER w x1, lead(y) OVER w y1 FROM (SELECT order_id, exposure_id, wavelength x, flux*(wavelength - 0.5) y FROM spectra_long) WINDOW w AS (PARTITION BY order_id, exposure_id ORDER BY x))
WHERE x1 > 1.013 AND x < 1.307 GROUP BY 1, 2""", "order_id, exposure_id, band", "flux"))
def k5_weighted_band(spark, sf):
    bands = spark.createDataFrame([("b1", 1.013, 1.307)], "band string, w_low double, w_high double")
    got = grids.band_average(views.spectra_long(spark, sf), bands, ["order_id", "exposure_id"], transform=lambda f, x: f * (x - 0.5))
    return rounded(got)
