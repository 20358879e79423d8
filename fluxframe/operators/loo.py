"""Leave-one-out predictive densities from per-point log-likelihoods.

Only the upper tail of the importance weights needs a fit: 3 sqrt(n) values of n.
Everything else is sums, so the samples stay distributed and the Python kernel
sees just the tail of one data point at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxframe.operators.groups import order_statistics, with_group_stats

POINT = ["dataset", "point_id"]
LOG_TINY = float(np.log(np.finfo(float).tiny))
# Below this tail index the raw weights are kept.
SMOOTH_FROM = 1 / 3


def plain_loo(df: DataFrame, by: Sequence[str] = POINT, log_lik: str = "log_lik") -> DataFrame:
    """Importance-sampling LOO without smoothing: ln n - ln sum exp(-log_lik)."""
    got = with_group_stats(df, by, {"__top": F.max(-F.col(log_lik))})
    raised = F.exp(-F.col(log_lik) - F.col("__top"))
    return got.groupBy(*by).agg((F.log(F.count(log_lik).cast("double")) - F.log(F.sum(raised)) - F.max("__top")).alias("elpd"))


def fit_tail(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution (empirical Bayes over a grid of profiles).

    ``excess`` is sorted and positive. The shape is pulled towards 0.5 with the weight of ten points.
    """
    n = excess.size
    grid = 30 + int(np.sqrt(n))
    quartile = excess[int(n / 4 + 0.5) - 1]
    theta = 1 / excess[-1] + (1 - np.sqrt(grid / (np.arange(grid) + 0.5))) / (3 * quartile)
    shape = np.log1p(-theta[:, None] * excess[None, :]).mean(axis=1)
    score = n * (np.log(-theta / shape) - shape - 1)
    with np.errstate(over="ignore"):  # an infinite sum is a zero weight
        weight = 1 / np.exp(score[None, :] - score[:, None]).sum(axis=1)
    keep = weight >= 10 * np.finfo(float).eps
    weight, theta = weight[keep] / weight[keep].sum(), theta[keep]
    best = float((theta * weight).sum())
    k = float(np.log1p(-best * excess).mean())
    return k * n / (n + 10) + 5 / (n + 10), -k / best


def _tail_sums(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Sums over one point's tail after smoothing: of the weights, and of new over old weights."""
    first = pdf.iloc[[0]][by].reset_index(drop=True)
    x = np.sort(pdf["__x"].to_numpy(dtype=float))
    floor = float(np.exp(pdf["__cut"].iloc[0]))
    new, k = x, float("inf")
    if x.size > 4:
        k, sigma = fit_tail(np.exp(x) - floor)
        if k >= SMOOTH_FROM and np.isfinite(k):
            p = (np.arange(x.size) + 0.5) / x.size
            bent = -np.log1p(-p) if abs(k) < np.finfo(float).eps else np.expm1(-k * np.log1p(-p)) / k
            new = np.minimum(np.log(sigma * bent + floor), 0.0)
    first["pareto_k"] = k
    first["tail_weight"] = float(np.exp(new).sum())
    first["tail_ratio"] = float(np.exp(new - x).sum())
    return first


def psis_loo(df: DataFrame, by: Sequence[str] = POINT, log_lik: str = "log_lik", r_eff: float = 1.0,
             span: float | str | None = "auto") -> DataFrame:
    """Pareto-smoothed LOO per data point: elpd and tail index k (unreliable above 0.7)."""
    by = list(by)
    raw = df.select(*by, (-F.col(log_lik)).alias("__w"))
    size = F.ceil(F.least(F.lit(0.2) * F.col("n"), F.lit(3.0) * F.sqrt(F.col("n") / F.lit(float(r_eff)))))
    marks = order_statistics(raw, by, "__w", {"__edge": F.greatest(F.col("n") - 1 - size, F.lit(0)), "__top": F.col("n") - 1}, span)
    marks = marks.select(*by, "__top", F.greatest(F.col("__edge") - F.col("__top"), F.lit(LOG_TINY)).alias("__cut"), "n")
    x = raw.join(marks, by).withColumn("__x", F.col("__w") - F.col("__top"))
    in_tail = F.col("__x") > F.col("__cut")
    body = x.groupBy(*by).agg(
        F.sum(F.when(~in_tail, F.exp("__x")).otherwise(0.0)).alias("__body"), F.count_if(~in_tail).alias("__n_body"), F.max("__top").alias("__top"))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", pareto_k double, tail_weight double, tail_ratio double"

    tail_rows = x.filter(in_tail).select(*by, "__x", "__cut")
    tails = tail_rows.groupBy(*by).applyInPandas(lambda pdf: _tail_sums(pdf, by), schema)
    got = body.join(tails, by, "left")
    weight = F.col("__body") + F.coalesce("tail_weight", F.lit(0.0))
    ratio = F.col("__n_body") + F.coalesce("tail_ratio", F.lit(0.0))
    elpd = F.log(ratio) - F.log(weight) - F.col("__top")
    return got.select(*by, elpd.alias("elpd"), F.coalesce("pareto_k", F.lit(float("inf"))).alias("pareto_k"))


def elpd_totals(loo: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return loo.groupBy(*by).agg(F.sum("elpd").alias("elpd"), F.count_if(F.col("pareto_k") > 0.7).alias("n_unreliable"))


def elpd_difference(a: DataFrame, b: DataFrame, by: Sequence[str] = POINT) -> DataFrame:
    """Per-point elpd of run a minus run b."""
    left, right = a.select(*by, F.col("elpd").alias("__a")), b.select(*by, F.col("elpd").alias("__b"))
    return left.join(right, list(by)).select(*by, (F.col("__a") - F.col("__b")).alias("delta_elpd"))
