"""Scoring, posterior and model-comparison queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.functions.stats import clean_loglik, sigma_to_bayes_factor
from fluxframe.operators import covariance, loo, posterior, score
from fluxframe.plans import views
from fluxframe.plans.registry import query, rounded
from fluxframe.plans.views import sql
from fluxframe.session import staged

KEYS = "order_id, exposure_id, channel"
SPECTRUM = ["order_id", "exposure_id"]
TWO_PI = f"{2 * math.pi!r}::DOUBLE"

_TEMPLATE = "SELECT order_id, channel, avg(flux) model FROM spectra_long GROUP BY ALL"
_ALIGNED = "SELECT * FROM spectra_long LEFT JOIN tpl USING (order_id, channel)"
BASE = {"tpl": _TEMPLATE, "al": _ALIGNED}


def aligned(spark, sf) -> DataFrame:
    """Spectra beside the mean spectrum of their order."""
    df = views.spectra_long(spark, sf)
    model = df.groupBy("order_id", "channel").agg(F.avg("flux").alias("flux"))
    return score.align(df, model, ["order_id", "channel"])


@query("d7_align", sql("spectra_long", f"SELECT {KEYS}, flux, model FROM al", KEYS, "flux, model", **BASE))
def d7_align(spark, sf):
    return rounded(aligned(spark, sf).select("order_id", "exposure_id", "channel", "flux", "model"))


@query("e1_chi2", sql("spectra_long", """
SELECT order_id, exposure_id, sum(power((flux-model)/uncertainty,2)) chi2, sum(power((flux-model)/uncertainty,2))/(count(*)-3) reduced_chi2, count(*) n_points
FROM al GROUP BY 1, 2""", "order_id, exposure_id, n_points", "chi2, reduced_chi2", **BASE))
def e1_chi2(spark, sf):
    return rounded(score.chi2(aligned(spark, sf), SPECTRUM, dof=3))


@query("e2_gaussian_loglik", sql("spectra_long", f"""
SELECT order_id, exposure_id, -0.5::DOUBLE*sum(power((model - flux*1.05::DOUBLE + 0.01::DOUBLE)/s,2)) - 0.5::DOUBLE*sum(ln({TWO_PI}*s*s)) log_l
FROM (SELECT *, sqrt(power(uncertainty,2) + power(10::DOUBLE,-3+0.1::DOUBLE*(order_id%3)))*1.05::DOUBLE s FROM al) GROUP BY 1, 2""",
    "order_id, exposure_id", "log_l", **BASE))
def e2_gaussian_loglik(spark, sf):
    df = aligned(spark, sf)
    wide = F.sqrt(F.pow("uncertainty", 2) + F.pow(F.lit(10.0), F.lit(-3.0) + F.lit(0.1) * (F.col("order_id") % 3))) * 1.05
    df = df.withColumn("s", wide)
    return rounded(score.gaussian_loglik(df, SPECTRUM, score.residual(scale=1.05, offset=0.01), "s"))


_DIFF = "(flux-model)"


@query("e3_hires_loglik", sql("spectra_long", f"""
SELECT order_id, exposure_id, -0.5::DOUBLE*count(*)*ln(sum(power({_DIFF}/uncertainty,2))/count(*)) optimised,
  -0.5::DOUBLE*sum(power({_DIFF}/(1.3::DOUBLE*uncertainty),2)) - count(*)*ln(1.3::DOUBLE) multiplied,
  -0.5::DOUBLE*sum(power({_DIFF}/(0.02::DOUBLE+uncertainty),2)) - sum(ln(0.02::DOUBLE+uncertainty)) added
FROM al GROUP BY 1, 2""", "order_id, exposure_id", "optimised, multiplied, added", **BASE))
def e3_hires_loglik(spark, sf):
    df = aligned(spark, sf)
    a = score.hires_loglik(df, SPECTRUM, out="optimised")
    b = score.hires_loglik(df, SPECTRUM, "multiply", 1.3, out="multiplied")
    c = score.hires_loglik(df, SPECTRUM, "add", 0.02, out="added")
    return rounded(a.join(b, SPECTRUM).join(c, SPECTRUM))


@query("e5_pointwise_loglik", sql("spectra_long", f"""
SELECT {KEYS}, -0.5::DOUBLE*ln({TWO_PI}*uncertainty*uncertainty) - 0.5::DOUBLE*power((model-flux)/uncertainty,2) log_lik FROM al""", KEYS, "log_lik", **BASE))
def e5_pointwise_loglik(spark, sf):
    return rounded(score.pointwise_loglik(aligned(spark, sf)).select("order_id", "exposure_id", "channel", "log_lik"))


def b_parameters(spark) -> DataFrame:
    """Inflation exponents: one dataset's own, one prefix, one for all."""
    return spark.createDataFrame([("inst_3_b", -3.0), ("inst_1_b", -2.5), ("inst_b", -2.0), ("uncertainty_scaling_b", -1.5), ("slope", 9.0)], "name string, value double")


_B = """SELECT *, CASE WHEN dataset IN ('inst_3') THEN -3 WHEN dataset = 'inst_1' THEN -2.5 WHEN dataset LIKE 'inst\\_%' ESCAPE '\\' THEN -2 ELSE -1.5 END b
    FROM (SELECT *, CASE WHEN order_id % 2 = 1 THEN 'inst_' || order_id ELSE 'solo' || order_id END dataset FROM spectra_long)"""


@query("b19_inflate_sigma", sql("spectra_long", f"SELECT {KEYS}, dataset, sqrt(power(uncertainty,2) + power(10::DOUBLE, b)) uncertainty FROM bb",
    KEYS + ", dataset", "uncertainty", bb=_B))
def b19_inflate_sigma(spark, sf):
    df = views.spectra_long(spark, sf)
    name = F.when(F.col("order_id") % 2 == 1, F.concat(F.lit("inst_"), F.col("order_id"))).otherwise(F.concat(F.lit("solo"), F.col("order_id")))
    got = score.inflate_sigma(df.withColumn("dataset", name), b_parameters(spark))
    return rounded(got.select("order_id", "exposure_id", "channel", "dataset", "uncertainty"))


@query("d8_share_models", sql("spectra_long", """
SELECT dataset, channel, model FROM (SELECT DISTINCT order_id dataset, order_id % 3 source FROM spectra_long) m JOIN tpl ON tpl.order_id = source""",
    "dataset, channel", "model", tpl=_TEMPLATE))
def d8_share_models(spark, sf):
    df = views.spectra_long(spark, sf)
    models = df.groupBy(F.col("order_id").alias("dataset"), "channel").agg(F.avg("flux").alias("model"))
    mapping = df.select(F.col("order_id").alias("dataset"), (F.col("order_id") % 3).alias("source_dataset")).distinct()
    return rounded(score.share_models(models, mapping).select("dataset", "channel", "model"))


_PER = f"""SELECT exposure_id % 50 sample_id, order_id dataset, sum(-0.5::DOUBLE*ln({TWO_PI}*uncertainty*uncertainty) - 0.5::DOUBLE*power((model-flux)/uncertainty,2)) log_l
    FROM al GROUP BY 1, 2"""


@query("e6_total_loglik", sql("spectra_long", """
SELECT sample_id, CASE WHEN sample_id % 10 = 9 THEN -1e99::DOUBLE ELSE l END log_l FROM (
SELECT sample_id, sum(log_l) + CASE WHEN sample_id % 2 = 0 THEN -0.25 ELSE 0 END l FROM per GROUP BY 1)""", "sample_id", "log_l", 5, **BASE, per=_PER))
def e6_total_loglik(spark, sf):
    df = aligned(spark, sf).withColumn("sample_id", F.col("exposure_id") % 50)
    per = score.gaussian_loglik(df, ["sample_id", "order_id"])
    prior = per.select("sample_id").distinct().select(
        "sample_id", F.when(F.col("sample_id") % 10 == 9, F.lit(float("-inf"))).when(F.col("sample_id") % 2 == 0, F.lit(-0.25)).otherwise(F.lit(0.0)).alias("log_prior"))
    return rounded(score.total_loglik(per, ["sample_id"], prior), 5)


@query("c7_clean_loglik", sql("loglik_long", """
SELECT dataset, sample_id, point_id, log10(-x) log_cost FROM (SELECT dataset, sample_id, point_id,
  CASE WHEN log_lik > -0.01 THEN -1e99::DOUBLE WHEN log_lik < -4 THEN -1e99::DOUBLE ELSE log_lik END x FROM loglik_long)""",
    "dataset, sample_id, point_id", "log_cost"))
def c7_clean_loglik(spark, sf):
    df = views.loglik_long(spark, sf)
    bad = F.when(F.col("log_lik") > -0.01, F.lit(None).cast("double")).when(F.col("log_lik") < -4, F.lit(-1e120)).otherwise(F.col("log_lik"))
    return rounded(df.select("dataset", "sample_id", "point_id", F.log10(-clean_loglik(bad)).alias("log_cost")))


@query("e7_chi2_from_loglik", sql("samples spectra_long", f"""
SELECT run_id, sample_id, c chi2, c/n chi2_per_point, c/(n-2) chi2_per_dof FROM (SELECT run_id, sample_id, 2*(-log_l - norm) c, n FROM samples,
  (SELECT 0.5::DOUBLE*sum(ln({TWO_PI}*power(0.001::DOUBLE*uncertainty,2))) norm, count(*) n FROM spectra_long))""", "run_id, sample_id", "chi2, chi2_per_point, chi2_per_dof", 2))
def e7_chi2_from_loglik(spark, sf):
    data = views.spectra_long(spark, sf).withColumn("uncertainty", F.col("uncertainty") * 0.001)
    got = score.chi2_from_loglik(views.samples(spark, sf), data, n_free=2)
    return rounded(got.select("run_id", "sample_id", "chi2", "chi2_per_point", "chi2_per_dof"), 2)


@query("e8_best_sample", sql("samples", """
SELECT run_id, sample_id, p1, p2, log_l FROM samples QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY log_l DESC, sample_id) = 1""",
    "run_id, sample_id", "p1, p2, log_l", 8))
def e8_best_sample(spark, sf):
    return rounded(posterior.best_sample(views.samples(spark, sf)).select("run_id", "sample_id", "p1", "p2", "log_l"), 8)


_LONG = "SELECT run_id, sample_id, 'p1' param, p1 AS value FROM samples UNION ALL SELECT run_id, sample_id, 'p2', p2 FROM samples"


def long_samples(spark, sf) -> DataFrame:
    return posterior.to_long(views.samples(spark, sf).drop("log_l"), ["run_id", "sample_id"], ["p1", "p2"])


@query("e9_posterior_quantiles", sql("samples", """
SELECT run_id, param, quantile_cont(value, 0.16) q16, quantile_cont(value, 0.5) median, quantile_cont(value, 0.84) q84 FROM lg GROUP BY 1, 2""",
    "run_id, param", "q16, median, q84", 4, lg=_LONG))
def e9_posterior_quantiles(spark, sf):
    return rounded(posterior.posterior_quantiles(long_samples(spark, sf)), 4)


@query("k7_extract_median", sql("samples", "SELECT run_id, quantile_cont(p1, 0.5) p1, quantile_cont(p2, 0.5) p2 FROM samples GROUP BY 1", "run_id", "p1, p2", 4))
def k7_extract_median(spark, sf):
    return rounded(posterior.extract_sample(views.samples(spark, sf), "median", ["p1", "p2"]), 4)


def declared(spark) -> DataFrame:
    rows = [("p1", True, None, "uniform", 1000.0, 450000.0, 0.001, 1.0), ("p2", True, None, "uniform", 0.0, 14000.0, 1.0, 0.0),
            ("radius", False, 1.25, None, None, None, None, None), ("offset", False, -3.0, None, None, None, None, None)]
    return spark.createDataFrame(rows, "name string, is_free boolean, value double, prior_type string, prior_a double, prior_b double, figure_coefficient double, figure_offset double")


@query("e10_parameter_ranges", sql("samples", """
SELECT param, min(greatest((m-4*s)*k+o, a*k+o)) low, max(least((m+4*s)*k+o, b*k+o)) high FROM (
  SELECT run_id, param, avg(value) m, stddev_pop(value) s FROM lg GROUP BY 1, 2)
JOIN (VALUES ('p1', 1000, 450000, 0.001::DOUBLE, 1), ('p2', 0, 14000, 1, 0)) p(param, a, b, k, o) USING (param) GROUP BY 1""", "param", "low, high", 5, lg=_LONG))
def e10_parameter_ranges(spark, sf):
    return rounded(posterior.parameter_ranges(long_samples(spark, sf), declared(spark)), 5)


@query("d9_resolve_parameters", sql("samples", """
SELECT run_id, sample_id, param, value FROM lg UNION ALL
SELECT run_id, sample_id, name, v FROM samples, (VALUES ('radius', 1.25::DOUBLE), ('offset', -3)) f(name, v)""", "run_id, sample_id, param", "value", 4, lg=_LONG))
def d9_resolve_parameters(spark, sf):
    return rounded(posterior.resolve_params(long_samples(spark, sf), declared(spark), ["run_id", "sample_id"]), 4)


@query("a7_union_runs", sql("samples", """
SELECT run_id, sample_id, p1, CASE WHEN run_id <> '5-LOW' THEN p2 END p2, log_l FROM samples""",
    "run_id, sample_id", "p1, p2, log_l", 4))
def a7_union_runs(spark, sf):
    df = views.samples(spark, sf)
    names = [r.run_id for r in df.select("run_id").distinct().collect()]  # one table per run, as they are stored
    runs = {r: df.filter(F.col("run_id").eqNullSafe(F.lit(r))).drop("run_id", *(["p2"] if r == "5-LOW" else [])) for r in names}
    return rounded(posterior.union_runs(runs).select("run_id", "sample_id", "p1", "p2", "log_l"), 4)


@query("e11_hist1d", sql("samples", """
SELECT run_id, param, b bin, lo + b*(hi-lo)/15 edge_low, count(*) n, count(*)/(t*(hi-lo)/15) density FROM (
  SELECT *, least(floor((value-lo)/(hi-lo)*15), 14)::BIGINT b FROM (
    SELECT *, min(value) OVER w lo, max(value) OVER w hi, count(*) OVER w t FROM lg WINDOW w AS (PARTITION BY run_id, param))) GROUP BY run_id, param, b, lo, hi, t""",
    "run_id, param, bin, n", "edge_low, density", 7, lg=_LONG))
def e11_hist1d(spark, sf):
    return rounded(posterior.hist1d(long_samples(spark, sf), ["run_id", "param"]), 7)


@query("e11_hist2d", sql("samples", """
SELECT run_id, 'p1' param_x, 'p2' param_y, bx bin_x, by_ bin_y, count(*) n FROM (
  SELECT run_id, least(floor((p1-l1)/(h1-l1)*20), 19)::BIGINT bx, least(floor((p2-l2)/(h2-l2)*20), 19)::BIGINT by_ FROM (
    SELECT *, min(p1) OVER w l1, max(p1) OVER w h1, min(p2) OVER w l2, max(p2) OVER w h2 FROM samples WINDOW w AS (PARTITION BY run_id))) GROUP BY ALL"""))
def e11_hist2d(spark, sf):
    return posterior.hist2d(views.samples(spark, sf), ["run_id"], [("p1", "p2")])


_EVIDENCE = "SELECT run_id, ln(avg(exp(log_l))) ln_z FROM samples GROUP BY 1"


def evidence(spark, sf) -> DataFrame:
    return posterior.log_mean_exp(views.samples(spark, sf), ["run_id"], out="ln_z")


@query("e12_run_summary", sql("samples", f"""
SELECT run_id, param, q16, median, q84, (q84-q16)/2 sigma, greatest(0, -floor(log10((q84-q16)/2)) + 1)::BIGINT digits, ln_z, ln_z/{math.log(10)!r}::DOUBLE log10_z FROM (
SELECT run_id, param, quantile_cont(value, 0.16) q16, quantile_cont(value, 0.5) median, quantile_cont(value, 0.84) q84 FROM lg GROUP BY 1, 2) JOIN ev USING (run_id)""",
    "run_id, param, digits", "q16, median, q84, sigma, ln_z, log10_z", 6, lg=_LONG, ev=_EVIDENCE))
def e12_run_summary(spark, sf):
    return rounded(posterior.run_summary(long_samples(spark, sf), evidence(spark, sf)), 6)


@query("e13_bayes_factors", sql("samples", """
SELECT a.run_id, b.run_id reference_run, b.ln_z - a.ln_z delta_ln_z, exp(b.ln_z - a.ln_z) bayes_factor FROM ev a, (SELECT * FROM ev ORDER BY ln_z DESC LIMIT 1) b""",
    "run_id, reference_run", "delta_ln_z, bayes_factor", ev=_EVIDENCE))
def e13_bayes_factors(spark, sf):
    return rounded(posterior.compare_runs(evidence(spark, sf)).drop("sigma"))


@query("e13_compare_runs")
def e13_compare_runs(spark, sf):
    got = posterior.compare_runs(evidence(spark, sf).withColumn("ln_z", F.col("ln_z") * 300))
    return rounded(got.withColumn("back", F.log(sigma_to_bayes_factor(F.col("sigma") + 1))), 5)


def profiles(spark, sf) -> DataFrame:
    df = views.layers(spark, sf)
    return df.select("layer", F.col("col_id").alias("sample_id"), F.col("temperature").alias("value"))


@query("e14_envelope_rank", sql("layers", """
SELECT layer, n, v[1] all_low, v[n] all_high, v[floor(n*(0.5::DOUBLE-0.68::DOUBLE/2))::BIGINT+1] low_1, v[floor(n*(0.5::DOUBLE+0.68::DOUBLE/2))::BIGINT+1] high_1,
  v[floor(n*(0.5::DOUBLE-0.95::DOUBLE/2))::BIGINT+1] low_2, v[floor(n*(0.5::DOUBLE+0.95::DOUBLE/2))::BIGINT+1] high_2,
  v[floor(n*(0.5::DOUBLE-0.997::DOUBLE/2))::BIGINT+1] low_3, v[floor(n*(0.5::DOUBLE+0.997::DOUBLE/2))::BIGINT+1] high_3
FROM (SELECT layer, count(*) n, list(temperature ORDER BY temperature) v FROM layers GROUP BY 1)""",
    "layer, n", "all_low, all_high, low_1, high_1, low_2, high_2, low_3, high_3"))
def e14_envelope_rank(spark, sf):
    return rounded(posterior.profile_envelope(profiles(spark, sf), ["layer"]))


@query("e14_envelope_quantile", sql("layers", """
SELECT layer, quantile_cont(temperature, 0.159) low, quantile_cont(temperature, 0.5) median, quantile_cont(temperature, 0.841) high FROM layers GROUP BY 1""",
    "layer", "low, median, high", 8))
def e14_envelope_quantile(spark, sf):
    return rounded(posterior.profile_envelope(profiles(spark, sf), ["layer"], mode="quantile"), 8)


@query("e15_logsumexp", sql("loglik_long", "SELECT dataset, point_id, ln(sum(exp(log_lik))) logsumexp FROM loglik_long GROUP BY 1, 2", "dataset, point_id", "logsumexp"))
def e15_logsumexp(spark, sf):
    return rounded(posterior.logsumexp(views.loglik_long(spark, sf), ["dataset", "point_id"], "log_lik"))


@query("e16_plain_loo", sql("loglik_long", "SELECT dataset, point_id, ln(count(*)) - ln(sum(exp(-log_lik))) elpd FROM loglik_long GROUP BY 1, 2", "dataset, point_id", "elpd"))
def e16_plain_loo(spark, sf):
    return rounded(loo.plain_loo(views.loglik_long(spark, sf)))


@query("e16_psis_loo")
def e16_psis_loo(spark, sf):
    return rounded(loo.psis_loo(views.loglik_long(spark, sf)), 5)


@query("e16_elpd_difference")
def e16_elpd_difference(spark, sf):
    """Two models of the same data, scored point by point, summed per dataset."""
    df = views.loglik_long(spark, sf)
    a, b = staged(loo.psis_loo(df)), loo.psis_loo(df.withColumn("log_lik", F.col("log_lik") * 0.5))
    gain = loo.elpd_difference(a, b).groupBy("dataset").agg(F.sum("delta_elpd").alias("delta_elpd"))
    return rounded(loo.elpd_totals(a).join(gain, "dataset"), 4)


@query("h6_sample_posterior")
def h6_sample_posterior(spark, sf):
    return rounded(posterior.sample_posterior(views.samples(spark, sf), 200, seed=7).select("run_id", "draw", "sample_id", "p1", "p2"), 4)


@query("e26_mean_sigma", sql("measurements", """
SELECT entity_id, parameter, sqrt(sum(power(s,2)))/count(*) mean_sigma,
  CASE WHEN count(*) > 1 THEN sqrt(sum(power(s,2)))/count(*)*sqrt(pi()*count(*)/(2*(count(*)-1))) END median_sigma
FROM (SELECT *, 0.01::DOUBLE + err_upper s FROM measurements) GROUP BY 1, 2""", "entity_id, parameter", "mean_sigma, median_sigma", 8))
def e26_mean_sigma(spark, sf):
    df = views.measurements(spark, sf).withColumn("s", F.lit(0.01) + F.col("err_upper"))
    return rounded(posterior.mean_sigma(df, ["entity_id", "parameter"], "s"), 8)


def prior_table(spark) -> DataFrame:
    rows = [("0", "uniform", 2.0, 5.0), ("1", "log", -3.0, 1.0), ("2", "delta", 7.5, 0.0), ("3", "inverse_gamma", 2.5, 1.5), ("4", "custom_square", 1.0, 3.0)]
    return spark.createDataFrame(rows, "name string, prior_type string, prior_a double, prior_b double")


def unit_draws(spark, sf) -> DataFrame:
    return views.samples(spark, sf).select("run_id", "sample_id", (F.col("sample_id") % 5).cast("string").alias("name"), ((F.col("p2") % 997 + 0.5) / 997).alias("u"))


@query("b16_prior_transform", sql("samples", """
SELECT run_id, sample_id, name, CASE name WHEN '0' THEN 2 + u*3 WHEN '1' THEN power(10::DOUBLE, -3 + u*4) WHEN '2' THEN 7.5::DOUBLE
  WHEN '3' THEN power(1.5::DOUBLE, 2.5::DOUBLE)/gamma(2.5::DOUBLE)*power(1/u, 3.5::DOUBLE)*exp(-1.5::DOUBLE/u) ELSE 1 + 3*u*u END AS value
FROM (SELECT run_id, sample_id, (sample_id % 5)::VARCHAR AS name, (p2 % 997 + 0.5::DOUBLE)/997 u FROM samples)""", "run_id, sample_id, name", "value", 7))
def b16_prior_transform(spark, sf):
    got = posterior.prior_transform(unit_draws(spark, sf), prior_table(spark), {"custom_square": lambda u, a, b: a + b * u * u})
    return rounded(got.select("run_id", "sample_id", "name", "value"), 7)


@query("b16_gaussian_priors")
def b16_gaussian_priors(spark, sf):
    rows = [(str(i), "gaussian" if i % 2 else "log_gaussian", 2.0, 0.3) for i in range(5)]
    table = spark.createDataFrame(rows, "name string, prior_type string, prior_a double, prior_b double")
    return rounded(posterior.prior_transform(unit_draws(spark, sf), table).select("run_id", "sample_id", "name", "value"), 7)


# Covariance: C_ij = s^2 rho^|i-j| per dataset, whose inverse and determinant are known in closed form.

RHO = 0.5


def residuals(spark, sf) -> DataFrame:
    return aligned(spark, sf).select("order_id", "exposure_id", F.col("channel").alias("i"), (F.col("model") - F.col("flux")).alias("d"))


def covariances(spark, sf) -> DataFrame:
    """One matrix per order over its channels; the scale depends on the order."""
    channels = views.spectra_long(spark, sf).select("order_id", F.col("channel").alias("i")).distinct()
    cells = channels.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))))
    s2 = F.pow(F.lit(0.1) + F.lit(0.01) * F.col("order_id"), 2)
    return cells.withColumn("c", s2 * F.pow(F.lit(RHO), F.abs(F.col("i") - F.col("j"))))


_COV = {
    **BASE,
    "rs": "SELECT order_id, exposure_id, channel i, model - flux d FROM al",
    "nb": "SELECT *, lag(d) OVER w dp, lead(d) OVER w dn FROM rs WINDOW w AS (PARTITION BY order_id, exposure_id ORDER BY i)",
    "gg": """SELECT *, ((CASE WHEN dp IS NULL OR dn IS NULL THEN 1 ELSE 1.25::DOUBLE END)*d - 0.5::DOUBLE*(coalesce(dp,0)+coalesce(dn,0)))/(s2*0.75::DOUBLE) g,
       (CASE WHEN dp IS NULL OR dn IS NULL THEN 1 ELSE 1.25::DOUBLE END)/(s2*0.75::DOUBLE) ii FROM (SELECT *, power(0.1::DOUBLE+0.01::DOUBLE*order_id,2) s2 FROM nb)""",
}


@query("e4_covariance_loglik", sql("spectra_long", f"""
SELECT order_id, exposure_id, -0.5::DOUBLE*sum(d*g) - 0.5::DOUBLE*(count(*)*ln({TWO_PI}*max(s2)) + (count(*)-1)*ln(0.75::DOUBLE)) log_l FROM gg GROUP BY 1, 2""",
    "order_id, exposure_id", "log_l", 5, **_COV))
def e4_covariance_loglik(spark, sf):
    inverse, logdet = covariance.invert_covariance(covariances(spark, sf), ["order_id"])
    return rounded(covariance.cov_loglik(residuals(spark, sf), inverse, logdet, ["order_id"], ["exposure_id"]), 5)


@query("e4_diagonal_inflated", sql("spectra_long", f"""
SELECT order_id, exposure_id, -0.5::DOUBLE*sum(d*d/v + ln({TWO_PI}*v)) log_l FROM (SELECT *, s2 + 0.01::DOUBLE v FROM gg) GROUP BY 1, 2""", "order_id, exposure_id", "log_l", 5, **_COV))
def e4_diagonal_inflated(spark, sf):
    return rounded(covariance.diagonal_loglik(residuals(spark, sf), covariances(spark, sf), ["order_id"], ["exposure_id"], -2.0), 5)


@query("e5_pointwise_covariance", sql("spectra_long", f"""
SELECT order_id, exposure_id, i, 0.5::DOUBLE*ln(ii/{TWO_PI}) - 0.5::DOUBLE*g*g/ii log_lik FROM gg""", "order_id, exposure_id, i", "log_lik", 5, **_COV))
def e5_pointwise_covariance(spark, sf):
    inverse, _ = covariance.invert_covariance(covariances(spark, sf), ["order_id"])
    return rounded(covariance.pointwise_cov_loglik(residuals(spark, sf), inverse, ["order_id"], ["exposure_id"]), 5)
