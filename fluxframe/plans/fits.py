"""Queries of the fit chain: one per option, over a user model that is evaluated per sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fluxframe.operators import fitting, smooth
from fluxframe.plans import views
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql

POINTS = 69


def _kernel(columns: int):
    """Lines with a ripple on 69 wavelengths, in one or two atmospheric columns; the second one is brighter. The extra log-likelihood is -a^2 / 2 per column."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = np.arange(POINTS)
        x = 1.0 + 0.01 * i
        rows = []
        for sample, a, b in zip(*[batch.column(c).to_pylist() for c in ("sample_id", "a", "b")]):
            line = a + b * (x - 1) + 0.05 * np.sin(i)
            rows += [(sample, "m", k, (0.7, 0.3)[k] if columns == 2 else 1.0, x.tolist(), (line * (1 + 0.1 * k)).tolist(), -0.5 * a * a if columns == 2 else None) for k in range(columns)]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
        names = ["sample_id", "model", "column_id", "column_weight", "wavelength", "flux", "extra_log_l"]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    return run


def _tables(spark, sf, columns: int = 1):
    """Parameters, packed models and two datasets of 16 bins each."""
    df = views.spectra_long(spark, sf)
    step = F.floor(F.col("channel") / 4)
    data = df.groupBy((F.col("order_id") % 2).cast("string").alias("dataset"), step.alias("i")).agg(F.avg("flux").alias("flux"))
    data = data.withColumns({"wavelength": F.lit(1.04) + F.lit(0.04) * F.col("i"), "bin_width": F.lit(0.04), "uncertainty": F.lit(0.05)})
    parameters = df.groupBy(F.col("exposure_id").alias("sample_id")).agg(F.avg("flux").alias("a"), F.avg(F.col("flux") - 1).alias("b"))
    return parameters, fitting.model_spectra(parameters, _kernel(columns)), data


def _named(parameters, **values):
    """Parameter rows (sample_id, name, value)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    return parameters.select("sample_id", F.explode(pairs).alias("p")).select("sample_id", "p.name", "p.value")


def _datasets(spark, *rows, columns):
    return spark.createDataFrame(list(rows), f"dataset string, source string, {columns}")


def _score(spark, sf, datasets, named=None, columns: int = 1, covariances=None, photometry=None):
    parameters, models, data = _tables(spark, sf, columns)
    names = _named(parameters, none=F.lit(0.0)) if named is None else _named(parameters, **named)
    per = fitting.score_models(models, data if covariances is not None else data.drop("i"), datasets, names, covariances=covariances, photometry=photometry)
    return per, models


# SQL: parameters, models (two columns if asked), resolution, bins, residuals, score.
_PAR = "SELECT exposure_id sample_id, avg(flux) a, avg(flux - 1) b FROM spectra_long GROUP BY 1"
_DAT = """SELECT dataset, k, 1.04::DOUBLE + 0.04::DOUBLE*k w, f flux, 0.05::DOUBLE u, 1.04::DOUBLE + 0.04::DOUBLE*k - 0.02::DOUBLE lo, 1.04::DOUBLE + 0.04::DOUBLE*k + 0.02::DOUBLE hi FROM (
    SELECT (order_id % 2)::VARCHAR dataset, channel // 4 k, avg(flux) f FROM spectra_long GROUP BY 1, 2)"""


def _chain(columns: int = 1, power: str | None = None, weight: str = "1::DOUBLE") -> dict[str, str]:
    """CTEs up to obs: (sample_id, dataset, k, flux, u, m). ``power`` is an expression of dataset."""
    model = f"""SELECT sample_id, dataset, c, i, 1 + 0.01::DOUBLE*i x, (a + b*(0.01::DOUBLE*i) + 0.05::DOUBLE*sin(i))*(1 + 0.1::DOUBLE*c) y0
      FROM par, range(0, {POINTS}) r(i), range(0, {columns}) q(c), (SELECT unnest(['0', '1']) dataset)"""
    parts = {"par": _PAR, "dat": _DAT, "mdl": model}
    if power is None:
        parts["seen"] = "SELECT sample_id, dataset, c, x, y0 y FROM mdl"
    else:
        parts["sg"] = f"""SELECT dataset, 1/({power})/(2*sqrt(2*ln(2::DOUBLE)))/st s FROM (SELECT unnest(['0', '1']) dataset),
          (SELECT avg(2*0.01::DOUBLE/(2 + 0.01::DOUBLE*(2*i+1))) st FROM range(0, {POINTS - 1}) r(i))"""
        parts["seen"] = f"""SELECT a.sample_id, a.dataset, a.c, a.x, sum(exp(-0.5::DOUBLE*power(d/s, 2))*b.y0)/sum(exp(-0.5::DOUBLE*power(d/s, 2))) y
          FROM mdl a JOIN sg USING (dataset) JOIN range(-40, 41) r(d) ON abs(d) <= floor(4*s + 0.5)
          JOIN mdl b ON a.sample_id = b.sample_id AND a.dataset = b.dataset AND a.c = b.c AND b.i = greatest(0, least({POINTS - 1}, a.i + d)) GROUP BY 1, 2, 3, 4"""
    parts["seg"] = "SELECT *, lead(x) OVER v x1, lead(y) OVER v y1 FROM seen WINDOW v AS (PARTITION BY sample_id, dataset, c ORDER BY x)"
    parts["bin"] = """SELECT sample_id, dataset, c, k, flux, u, sum((y + (y1-y)/(x1-x)*((greatest(x,lo)+least(x1,hi))/2 - x))*(least(x1,hi)-greatest(x,lo)))/sum(least(x1,hi)-greatest(x,lo)) m
      FROM seg JOIN dat USING (dataset) WHERE x1 > lo AND x < hi GROUP BY 1, 2, 3, 4, 5, 6"""
    parts["obs"] = f"SELECT sample_id, dataset, k, flux, u, sum(m*({weight})) m FROM bin GROUP BY 1, 2, 3, 4, 5"
    return parts


def _scored(residual: str, variance: str) -> str:
    return f"SELECT sample_id, dataset, sum(-0.5::DOUBLE*(power({residual}, 2)/({variance}) + ln(2*pi()*({variance})))) log_l FROM obs GROUP BY 1, 2"


KEYS = "sample_id, dataset"


@query("k1_resolution", sql("spectra_long", _scored("m - flux", "u*u"), KEYS, "log_l", 5, **_chain(power="CASE dataset WHEN '0' THEN 40::DOUBLE ELSE 15::DOUBLE END")))
def k1_resolution(spark, sf):
    """Two datasets that see one model at resolving powers of their own."""
    datasets = _datasets(spark, ("0", "m", 40.0), ("1", "m", 15.0), columns="resolving_power double")
    return rounded(_score(spark, sf, datasets)[0], 5)


@query("k1_scale", sql("spectra_long", _scored("m - CASE dataset WHEN '0' THEN flux*f ELSE flux END", "u*u*CASE dataset WHEN '0' THEN f*f ELSE 1 END").replace(
    "FROM obs", "FROM (SELECT obs.*, 1 + 0.1::DOUBLE*a f FROM obs JOIN par USING (sample_id)) obs"), KEYS, "log_l", 5, **_chain()))
def k1_scale(spark, sf):
    """A scale factor per sample for data and uncertainties of one dataset."""
    datasets = _datasets(spark, ("0", "m", True, True), ("1", "m", None, None), columns="scaled boolean, scaled_uncertainty boolean")
    return rounded(_score(spark, sf, datasets, {"0_scale_factor": 1 + F.lit(0.1) * F.col("a"), "1_scale_factor": F.lit(9.0)})[0], 5)


@query("k1_offset", sql("spectra_long", _scored("m - flux + CASE dataset WHEN '1' THEN 0.03::DOUBLE ELSE 0 END", "u*u"), KEYS, "log_l", 5, **_chain()))
def k1_offset(spark, sf):
    datasets = _datasets(spark, ("0", "m", None), ("1", "m", 0.03), columns="offset double")
    return rounded(_score(spark, sf, datasets)[0], 5)


@query("k1_inflation", sql("spectra_long", _scored("m - flux", "u*u + power(10::DOUBLE, CASE dataset WHEN '0' THEN a - 3 ELSE -2 END)").replace(
    "FROM obs", "FROM (SELECT obs.*, a FROM obs JOIN par USING (sample_id)) obs"), KEYS, "log_l", 5, **_chain()))
def k1_inflation(spark, sf):
    """Error inflation by an exponent per sample, and by a shared one."""
    datasets = spark.createDataFrame([("0", "m"), ("1", "m")], "dataset string, source string")
    return rounded(_score(spark, sf, datasets, {"0_b": F.col("a") - 3, "uncertainty_scaling_b": F.lit(-2.0)})[0], 5)


@query("k1_photometry", sql("spectra_long", _scored("m - flux", "u*u"), KEYS, "log_l", 5, **_chain() | {
    "seen": "SELECT sample_id, dataset, c, x, CASE dataset WHEN '1' THEN y0*(x - 0.5::DOUBLE) ELSE y0 END y FROM mdl"}))
def k1_photometry(spark, sf):
    """One dataset of bands, in which the flux is weighted, beside a spectrum."""
    datasets = _datasets(spark, ("0", "m", None), ("1", "m", "photometry"), columns="kind string")
    return rounded(_score(spark, sf, datasets, photometry=lambda flux, x: flux * (x - 0.5))[0], 5)


@query("k1_equal_grid", sql("spectra_long", _scored("m - flux", "u*u"), KEYS, "log_l", 5, **_chain() | {
    "bin": "SELECT sample_id, dataset, c, k, flux, u, y0 m FROM mdl JOIN dat USING (dataset) WHERE i = 4*k + 4 AND dataset = '1'"}))
def k1_equal_grid(spark, sf):
    """Data on the model's own wavelengths: nothing is rebinned."""
    parameters, models, data = _tables(spark, sf)
    on_grid = data.filter("dataset = '1'").withColumn("wavelength", F.lit(1.0) + F.lit(0.01) * (4 * F.col("i") + 4)).drop("i")
    datasets = _datasets(spark, ("1", "m", "grid"), columns="kind string")
    return rounded(fitting.score_models(models, on_grid, datasets, _named(parameters, none=F.lit(0.0))), 5)


@query("k1_columns", sql("spectra_long", """SELECT sample_id, log_l - a*a log_l FROM (SELECT sample_id, sum(log_l) log_l FROM (
    SELECT sample_id, dataset, sum(-0.5::DOUBLE*(power(m - flux, 2)/(u*u) + ln(2*pi()*u*u))) log_l FROM obs GROUP BY 1, 2) GROUP BY 1) JOIN par USING (sample_id)""",
    "sample_id", "log_l", 5, **_chain(2, weight="CASE c WHEN 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END")))
def k1_columns(spark, sf):
    """Two atmospheric columns mixed by their weights, with the models' extra log-likelihood, summed over datasets."""
    datasets = spark.createDataFrame([("0", "m"), ("1", "m")], "dataset string, source string")
    per, models = _score(spark, sf, datasets, columns=2)
    return rounded(fitting.total_score(per, models), 5)


# C = 0.0025 (1/2)^|i-j|: its inverse has three diagonals and its determinant is 0.0025^16 0.75^15.
@query("k1_covariance", sql("spectra_long", """
SELECT sample_id, dataset, CASE dataset WHEN '0' THEN -0.5::DOUBLE*sum(d*g)/0.0025::DOUBLE - 0.5::DOUBLE*(16*ln(2*pi()*0.0025::DOUBLE) + 15*ln(0.75::DOUBLE)) - 16*ln(max(f))
    ELSE sum(-0.5::DOUBLE*(d*d/(u*u) + ln(2*pi()*u*u))) END log_l FROM (
  SELECT *, (CASE WHEN k IN (0, 15) THEN 1 ELSE 1.25::DOUBLE END*d - 0.5::DOUBLE*coalesce(lag(d) OVER v, 0) - 0.5::DOUBLE*coalesce(lead(d) OVER v, 0))/0.75::DOUBLE g FROM (
    SELECT sample_id, dataset, k, u, CASE dataset WHEN '0' THEN 1 + 0.1::DOUBLE*a ELSE 1 END f, (m - CASE dataset WHEN '0' THEN flux*(1 + 0.1::DOUBLE*a) ELSE flux END)
      /CASE dataset WHEN '0' THEN 1 + 0.1::DOUBLE*a ELSE 1 END d FROM obs JOIN par USING (sample_id))
  WINDOW v AS (PARTITION BY sample_id, dataset ORDER BY k)) GROUP BY 1, 2""", KEYS, "log_l", 5, **_chain()))
def k1_covariance(spark, sf):
    """A full covariance, scaled with its data, for one dataset; independent errors for the other."""
    datasets = _datasets(spark, ("0", "m", True, True), ("1", "m", None, None), columns="scaled boolean, scaled_uncertainty boolean")
    cells = spark.range(16).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    cov = cells.select(F.lit("0").alias("dataset"), "i", "j", (F.lit(0.0025) * F.pow(F.lit(0.5), F.abs(F.col("i") - F.col("j")))).alias("c"))
    return rounded(_score(spark, sf, datasets, {"0_scale_factor": 1 + F.lit(0.1) * F.col("a")}, covariances=cov)[0], 5)


@query("k1_inflated_covariance", sql("spectra_long", _scored("m - flux", "CASE dataset WHEN '0' THEN 0.0025::DOUBLE ELSE u*u END + 0.001::DOUBLE"), KEYS, "log_l", 5, **_chain()))
def k1_inflated_covariance(spark, sf):
    """With an exponent only the diagonal of a covariance counts."""
    datasets = spark.createDataFrame([("0", "m"), ("1", "m")], "dataset string, source string")
    cells = spark.range(16).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")))
    cov = cells.select(F.lit("0").alias("dataset"), "i", "j", (F.lit(0.0025) * F.pow(F.lit(0.5), F.abs(F.col("i") - F.col("j")))).alias("c"))
    return rounded(_score(spark, sf, datasets, {"uncertainty_scaling_b": F.lit(-3.0)}, covariances=cov)[0], 5)


@query("f3_two_widths", sql("spectra_long", """
SELECT a.order_id, a.exposure_id, a.channel, sum(w*b.flux) FILTER (WHERE b.channel % 7 <> 3)/sum(w) FILTER (WHERE b.channel % 7 <> 3) smooth FROM (
  SELECT *, 1 + 0.7::DOUBLE*(order_id % 2) s FROM spectra_long) a JOIN (SELECT d, s, exp(-0.5::DOUBLE*power(d/s, 2)) w FROM range(-7, 8) r(d), (SELECT unnest([1::DOUBLE, 1.7::DOUBLE]) s)
    WHERE abs(d) <= floor(4*s + 0.5)) r ON r.s = a.s
  JOIN spectra_long b ON a.order_id = b.order_id AND a.exposure_id = b.exposure_id AND b.channel = greatest(0, least(63, a.channel + d)) GROUP BY 1, 2, 3""",
    "order_id, exposure_id, channel", "smooth"))
def f3_two_widths(spark, sf):
    """A width per spectrum, with every seventh point masked."""
    df = views.spectra_long(spark, sf).withColumn("flux", F.when(F.col("channel") % 7 != 3, F.col("flux")))
    got = smooth.gauss_smooth(df, ["order_id", "exposure_id"], "channel", "flux", F.lit(1.0) + F.lit(0.7) * (F.col("order_id") % 2), "nearest")
    return rounded(got.select("order_id", "exposure_id", "channel", "smooth"))
