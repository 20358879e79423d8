"""Posterior samples: runs, parameters, quantiles, ranges, histograms, summaries, model comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.functions.priors import CustomPrior, gamma_function, prior_value
from fluxframe.functions.stats import bayes_factor_to_sigma, rounding_digits
from fluxframe.operators.axis import running_total
from fluxframe.operators.groups import order_statistics, quantiles, with_group_stats, with_scalars
from fluxframe.session import in_parts

RUN = ["run_id"]


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Samples of several runs under one schema; parameters a run lacks are NULL."""
    tagged = [df.withColumn("run_id", F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def to_long(df: DataFrame, ids: Sequence[str], params: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(params), "param", "value")


def undeclared(samples_long: DataFrame, parameters: DataFrame) -> DataFrame:
    """Sampled parameters without a declaration."""
    return samples_long.select("param").distinct().join(parameters.select(F.col("name").alias("param")), "param", "left_anti")


def resolve_params(samples_long: DataFrame, parameters: DataFrame, ids: Sequence[str]) -> DataFrame:
    """All parameters of every sample: the sampled ones and the fixed ones.

    ``parameters`` has name, is_free, value. The fixed ones travel as one array
    row, so no product of tables is formed. An undeclared parameter is an error.
    """
    strange = [r["param"] for r in undeclared(samples_long, parameters).limit(5).collect()]
    if strange:
        raise ValueError(f"sampled parameters without declaration: {strange}")
    free = samples_long.join(parameters.filter("is_free").select(F.col("name").alias("param")), "param", "left_semi")
    fixed = parameters.filter("NOT is_free").agg(F.collect_list(F.struct(F.col("name").alias("param"), "value"))).scalar()
    every = samples_long.select(*ids)
    rest = in_parts(every, ids, every.count()).distinct().select(*ids, F.inline(fixed))
    return free.select(*ids, "param", "value").unionByName(rest)


def prior_transform(draws: DataFrame, parameters: DataFrame, custom: dict[str, CustomPrior] | None = None) -> DataFrame:
    """Unit-cube draws (name, u) to parameter values by the declared prior."""
    p = parameters.select("name", "prior_type", "prior_a", "prior_b")
    p = p.withColumn("__g", gamma_function(F.when(F.col("prior_type") == "inverse_gamma", F.col("prior_a"))))
    got = draws.join(p, "name")
    return got.withColumn("value", prior_value("prior_type", "u", "prior_a", "prior_b", "__g", custom)).drop("__g")


def best_sample(df: DataFrame, by: Sequence[str] = RUN, log_l: str = "log_l", tie: str = "sample_id") -> DataFrame:
    """The whole row with the highest score, the lowest ``tie`` among equals, combined map-side."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(log_l), -F.col(tie)))
    return df.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def posterior_quantiles(samples_long: DataFrame, by: Sequence[str] = ("run_id", "param"),
                        qs: dict[str, float] | None = None) -> DataFrame:
    return quantiles(samples_long, by, "value", qs or {"q16": 0.16, "median": 0.5, "q84": 0.84})


def prior_mid_values(parameters: DataFrame) -> DataFrame:
    """Each free parameter at the middle of its prior."""
    return prior_transform(parameters.filter("is_free").select("name", F.lit(0.5).alias("u")), parameters)


def extract_sample(df: DataFrame, method: str | Callable[[DataFrame], DataFrame], params: Sequence[str], by: Sequence[str] = RUN) -> DataFrame:
    """One parameter set per run: ``median``, ``best`` or a function of the samples."""
    if callable(method):
        return method(df)
    if method == "best":
        return best_sample(df, by)
    if method == "median":
        mid = quantiles(to_long(df, by, params), [*by, "param"], "value", {"value": 0.5})
        return mid.groupBy(*by).pivot("param", list(params)).agg(F.first("value"))
    raise ValueError(f"method must be median, best or a function, not {method!r}")


def parameter_ranges(samples_long: DataFrame, parameters: DataFrame) -> DataFrame:
    """Widest over runs of: mean -+ 4 standard deviations, within the scaled prior range.

    ``parameters`` has name, prior_a, prior_b and optionally figure_coefficient and figure_offset.
    """
    scale = F.coalesce("figure_coefficient", F.lit(1.0)) if "figure_coefficient" in parameters.columns else F.lit(1.0)
    shift = F.coalesce("figure_offset", F.lit(0.0)) if "figure_offset" in parameters.columns else F.lit(0.0)
    p = parameters.select(F.col("name").alias("param"), "prior_a", "prior_b", scale.alias("__k"), shift.alias("__o"))
    moments = samples_long.groupBy("run_id", "param").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    k, o = F.col("__k"), F.col("__o")
    low = F.greatest((F.col("__m") - 4 * F.col("__s")) * k + o, F.col("prior_a") * k + o)
    high = F.least((F.col("__m") + 4 * F.col("__s")) * k + o, F.col("prior_b") * k + o)
    return moments.join(p, "param").groupBy("param").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of an even grid, the last bin closed."""
    return F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1).cast("bigint"))


def hist1d(df: DataFrame, by: Sequence[str], value: str = "value", bins: int = 15) -> DataFrame:
    """Density histogram between the group's extremes."""
    half = F.when(F.min(value) == F.max(value), F.lit(0.5)).otherwise(F.lit(0.0))  # a constant lies in a range of width 1
    got = with_group_stats(df, by, {"__lo": F.min(value) - half, "__hi": F.max(value) + half, "__n": F.count(value)})
    width = (F.col("__hi") - F.col("__lo")) / bins
    counted = got.filter(F.col(value).isNotNull()).withColumn("bin", _bin(F.col(value), F.col("__lo"), F.col("__hi"), bins))
    return counted.groupBy(*by, "bin", "__lo", "__hi", "__n").agg(F.count(F.lit(1)).alias("n")).select(
        *by, "bin", (F.col("__lo") + F.col("bin") * width).alias("edge_low"), "n", (F.col("n") / (F.col("__n") * width)).alias("density"))


def hist2d(df: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str]], bins: int = 20,
           ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Joint histogram of parameter pairs of wide samples.

    The bins of all parameters are computed once per row; a row then counts once
    per listed pair. ``ranges`` fixes the axis of a parameter (values outside
    are left out), otherwise the extremes of the group.
    """
    names = sorted({n for pair in pairs for n in pair})
    fixed = ranges or {}
    free = [n for n in names if n not in fixed]
    half = {n: F.when(F.min(n) == F.max(n), F.lit(0.5)).otherwise(F.lit(0.0)) for n in free}  # a constant lies in a range of width 1
    got = with_group_stats(df, by, {**{f"__lo_{n}": F.min(n) - half[n] for n in free}, **{f"__hi_{n}": F.max(n) + half[n] for n in free}}) if free else df
    index = {}
    for n in names:
        low = F.lit(float(fixed[n][0])) if n in fixed else F.col(f"__lo_{n}")
        high = F.lit(float(fixed[n][1])) if n in fixed else F.col(f"__hi_{n}")
        index[n] = F.when((F.col(n) >= low) & (F.col(n) <= high), _bin(F.col(n), low, high, bins))
    cells = F.array(*[
        F.struct(F.lit(a).alias("param_x"), F.lit(b).alias("param_y"), index[a].alias("bin_x"), index[b].alias("bin_y"))
        for a, b in pairs
    ])
    flat = got.select(*by, F.inline(cells))
    return flat.filter("bin_x IS NOT NULL AND bin_y IS NOT NULL").groupBy(*by, "param_x", "param_y", "bin_x", "bin_y").agg(
        F.count(F.lit(1)).alias("n"))


def log_mean_exp(df: DataFrame, by: Sequence[str], value: str = "log_l", out: str = "log_mean") -> DataFrame:
    got = logsumexp(df, by, value, "__lse", count="__n")
    return got.select(*by, (F.col("__lse") - F.log("__n")).alias(out))


def logsumexp(df: DataFrame, by: Sequence[str], value: str, out: str = "logsumexp", count: str | None = None) -> DataFrame:
    """log(sum(exp(x))) per group, by the group maximum first."""
    got = with_group_stats(df, by, {"__top": F.max(value)})
    agg = [(F.log(F.sum(F.exp(F.col(value) - F.col("__top")))) + F.max("__top")).alias(out)]
    if count:
        agg.append(F.count(value).alias(count))
    return got.groupBy(*by).agg(*agg)


def run_summary(samples_long: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per run and parameter: median, sigma and digits worth printing; per run: ln Z and log10 Z."""
    q = posterior_quantiles(samples_long)
    sigma = (F.col("q84") - F.col("q16")) / 2
    z = evidence.select("run_id", "ln_z", (F.col("ln_z") / F.lit(math.log(10))).alias("log10_z"))
    return q.withColumn("sigma", sigma).withColumn("digits", rounding_digits("sigma")).join(z, "run_id")


def compare_runs(evidence: DataFrame, reference: str | None = None) -> DataFrame:
    """Each run against one reference run (by name, else the highest evidence): Bayes factor and sigma."""
    pool = evidence if reference is None else evidence.filter(F.col("run_id") == reference)
    best = F.struct("ln_z", "run_id")
    got = with_scalars(evidence, pool, {"reference_run": F.max_by("run_id", best), "__ref": F.max_by("ln_z", best)})
    delta = F.col("__ref") - F.col("ln_z")
    return got.select("run_id", "reference_run", delta.alias("delta_ln_z"), F.exp(delta).alias("bayes_factor"),
                      bayes_factor_to_sigma(F.exp(delta)).alias("sigma"))


# The shares of samples inside one, two and three sigma.
SIGMA_SHARES = {"1": 0.68, "2": 0.95, "3": 0.997}


def profile_envelope(df: DataFrame, by: Sequence[str], value: str = "value", mode: str = "rank", span: float | str | None = "auto") -> DataFrame:
    """Envelope of many profiles per layer.

    ``rank``: minimum, maximum and the order statistics at int(n (0.5 -+ share/2)).
    ``quantile``: 0.159, 0.5 and 0.841.
    """
    if mode == "quantile":
        return quantiles(df, by, value, {"low": 0.159, "median": 0.5, "high": 0.841}, span)
    ranks = {"all_low": F.lit(0.0), "all_high": F.col("n") - 1}
    for name, share in SIGMA_SHARES.items():
        ranks[f"low_{name}"] = F.floor(F.col("n") * F.lit(0.5 - share / 2))
        ranks[f"high_{name}"] = F.floor(F.col("n") * F.lit(0.5 + share / 2))
    return order_statistics(df, by, value, ranks, span)


def sample_posterior(df: DataFrame, n: int, seed: int, by: Sequence[str] = RUN, key: str = "sample_id", span: float | str | None = "auto") -> DataFrame:
    """``n`` draws with replacement per run, the same for the same seed.

    Rows are ranked along ``key``; each draw is a hash of (seed, run, draw
    number) taken modulo the run's size and looked up by rank.
    """
    ranked = running_total(df.withColumn("__i", F.lit(1.0)), by, key, {"__rank": "__i"}, span=span).drop("__i")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))))
    draws = draws.select(*by, "draw", (F.pmod(F.xxhash64(F.lit(seed), *by, "draw"), F.col("__n")) + 1).cast("double").alias("__rank"))
    return draws.join(ranked, [*by, "__rank"]).drop("__rank")


def mean_sigma(df: DataFrame, by: Sequence[str], sigma: str) -> DataFrame:
    """Uncertainty of the mean and of the median of each group."""
    n = F.count(sigma).cast("double")
    mean = F.sqrt(F.sum(F.pow(sigma, 2))) / n
    return df.groupBy(*by).agg(
        mean.alias("mean_sigma"), F.when(n > 1, mean * F.sqrt(F.lit(math.pi) * n / (2 * (n - 1)))).alias("median_sigma"))
