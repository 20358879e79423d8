"""Models against data: chi square, likelihoods, error inflation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions.expr import ColumnLike, col
from fluxframe.functions.stats import clean_loglik
from fluxframe.operators.groups import with_scalars


def align(data: DataFrame, model: DataFrame, on: Sequence[str], y: str = "flux", out: str = "model") -> DataFrame:
    """Model flux beside the data on equal keys; every data row stays."""
    return data.join(model.select(*on, F.col(y).alias(out)), list(on), "left")


def share_models(models: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give each dataset of ``mapping`` (dataset, source_dataset) its source's model spectra."""
    source = models.withColumnRenamed("dataset", "source_dataset")
    return source.join(mapping, "source_dataset")


def residual(data: ColumnLike = "flux", model: ColumnLike = "model", scale: ColumnLike = 1.0, offset: ColumnLike = 0.0) -> Column:
    return col(model) - col(data) * col(scale) + col(offset)


def rescale_distance(df: DataFrame, old: ColumnLike, new: ColumnLike, columns: Sequence[str] = ("flux", "uncertainty")) -> DataFrame:
    factor = F.pow(col(old) / col(new), 2)
    return df.withColumns({c: F.col(c) * factor for c in columns})


def inflate_sigma(df: DataFrame, params: DataFrame, dataset: str = "dataset", sigma: str = "uncertainty",
                  out: str = "uncertainty", by: Sequence[str] = ()) -> DataFrame:
    """sqrt(sigma^2 + 10^b); b is looked up as <dataset>_b, <prefix>_b, then uncertainty_scaling_b.

    ``params`` has name, value and the columns of ``by`` (for example a sample
    id). The prefix is the dataset name up to its last underscore. Only ``_b``
    parameters take part, so the three lookups join a handful of names. Parameters
    of samples grow with them and are exchanged, never broadcast.
    """
    by = list(by)
    b = params.filter(F.col("name").endswith("_b")).select(*by, "name", "value")
    name = F.col(dataset).cast("string")
    got = df.withColumn("__own", F.concat(name, F.lit("_b"))).withColumn(
        "__prefix", F.concat(F.regexp_replace(name, r"_[^_]*$", ""), F.lit("_b")))
    for key, value in (("__own", "__b1"), ("__prefix", "__b2")):
        found = b.select(*by, F.col("name").alias(key), F.col("value").alias(value))
        got = got.join(found.hint("merge") if by else found, [*by, key], "left")
    shared = b.filter(F.col("name") == "uncertainty_scaling_b")
    if by:
        got = got.join(shared.select(*by, F.col("value").alias("__b3")).hint("merge"), by, "left")
    else:
        got = with_scalars(got, shared, {"__b3": F.max("value")})
    power = F.coalesce("__b1", "__b2", "__b3")
    wide = F.when(power.isNotNull(), F.sqrt(F.pow(F.col(sigma), 2) + F.pow(F.lit(10.0), power))).otherwise(F.col(sigma))
    return got.withColumn(out, wide).select(*df.columns, *([] if out in df.columns else [out]))


def chi2(df: DataFrame, by: Sequence[str], data: str = "flux", model: str = "model", sigma: str = "uncertainty", dof: int = 0) -> DataFrame:
    term = F.pow((F.col(data) - F.col(model)) / F.col(sigma), 2)
    n = F.count(term)
    return df.groupBy(*by).agg(
        F.sum(term).alias("chi2"), F.try_divide(F.sum(term), n - F.lit(dof)).alias("reduced_chi2"), n.alias("n_points"))


def pointwise_loglik(df: DataFrame, resid: Column | None = None, sigma: ColumnLike = "uncertainty", out: str = "log_lik") -> DataFrame:
    r, s = residual() if resid is None else resid, col(sigma)
    return df.withColumn(out, F.lit(-0.5) * F.log(F.lit(2 * math.pi) * s * s) - F.lit(0.5) * F.pow(r / s, 2))


def gaussian_loglik(df: DataFrame, by: Sequence[str], resid: Column | None = None, sigma: ColumnLike = "uncertainty", out: str = "log_l") -> DataFrame:
    """Normalised Gaussian log-likelihood per group."""
    r, s = residual() if resid is None else resid, col(sigma)
    return df.groupBy(*by).agg(
        (F.lit(-0.5) * F.sum(F.pow(r / s, 2)) - F.lit(0.5) * F.sum(F.log(F.lit(2 * math.pi) * s * s))).alias(out))


def hires_loglik(df: DataFrame, by: Sequence[str], mode: str = "optimise", beta: ColumnLike = 1.0, data: str = "flux",
                 model: str = "model", sigma: str = "uncertainty", out: str = "log_l") -> DataFrame:
    """High-resolution log-likelihood without constant terms.

    ``optimise`` uses the best noise scaling, ``multiply`` and ``add`` apply beta
    to the uncertainties. ``beta`` must be constant within a group.
    """
    diff, s, b = F.col(data) - F.col(model), F.col(sigma), col(beta)
    n = F.count(diff / s).cast("double")
    if mode == "optimise":
        score = F.lit(-0.5) * n * F.log(F.sum(F.pow(diff / s, 2)) / n)
    elif mode == "multiply":
        score = F.lit(-0.5) * F.sum(F.pow(diff / (s * b), 2)) - F.sum(F.when(diff.isNotNull() & s.isNotNull(), F.log(b)))
    elif mode == "add":
        score = F.lit(-0.5) * F.sum(F.pow(diff / (s + b), 2)) - F.sum(F.when(diff.isNotNull(), F.log(s + b)))
    else:
        raise ValueError(f"mode must be optimise, multiply or add, not {mode!r}")
    return df.groupBy(*by).agg(score.alias(out))


def total_loglik(per_dataset: DataFrame, by: Sequence[str], extra: DataFrame | None = None, log_l: str = "log_l") -> DataFrame:
    """Sum over datasets plus extra log-prior terms; an invalid part makes the total the worst score."""
    valid = F.count(log_l) == F.count(F.lit(1))
    got = per_dataset.groupBy(*by).agg(F.when(valid, F.sum(log_l)).alias("__l"))
    value = F.col("__l")
    if extra is not None:
        got = got.join(extra.select(*by, F.col("log_prior").alias("__p")).hint("merge"), list(by), "left")
        value = value + F.coalesce("__p", F.lit(0.0))
    return got.select(*by, clean_loglik(value).alias(log_l))


def _normalisation(sigma: ColumnLike) -> dict[str, Column]:
    s = col(sigma)
    return {"normalisation": F.lit(0.5) * F.sum(F.log(F.lit(2 * math.pi) * s * s)), "n_data": F.count(F.lit(1))}


def chi2_normalisation(data: DataFrame, by: Sequence[str], sigma: ColumnLike = "uncertainty") -> DataFrame:
    return data.groupBy(*by).agg(*[c.alias(n) for n, c in _normalisation(sigma).items()])


def chi2_from_loglik(samples: DataFrame, data: DataFrame, n_free: int = 0, sigma: ColumnLike = "uncertainty", log_l: str = "log_l",
                     by: Sequence[str] = ()) -> DataFrame:
    """chi^2 of stored scores by removing the normalisation of the data, and both reduced forms."""
    if by:
        joined = samples.join(chi2_normalisation(data, by, sigma), list(by))
    else:
        joined = with_scalars(samples, data, _normalisation(sigma))
    value = F.lit(2.0) * (-F.col(log_l) - F.col("normalisation"))
    return joined.withColumn("chi2", value).withColumn("chi2_per_point", value / F.col("n_data")).withColumn(
        "chi2_per_dof", value / (F.col("n_data") - n_free)).drop("normalisation", "n_data")
