"""Removal of throughput and telluric trends. A NULL flux is a masked point.

Rows are (order_id, exposure_id, channel, flux, uncertainty, matrix ...); the
``matrix`` column collects all divisions and subtractions, as the flux does.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.operators.fits import with_poly_fit
from fluxframe.operators.groups import quantiles, with_group_stats
from fluxframe.session import staged

ROW = ["order_id", "exposure_id"]
COLUMN = ["order_id", "channel"]


def with_matrix(df: DataFrame) -> DataFrame:
    return df if "matrix" in df.columns else df.withColumn("matrix", F.lit(1.0))


def drop_masked(df: DataFrame, y: str = "flux") -> tuple[DataFrame, DataFrame]:
    """The valid rows and the mask table (rows left out)."""
    gone = F.col(y).isNull() | F.isnan(y)
    return df.filter(~gone), df.filter(gone)


def mask_noisy_channels(df: DataFrame, factor: float = 3.0, subtract_mean: bool = False) -> DataFrame:
    """Mask channels whose scatter in time exceeds ``factor`` times the scatter of their order."""
    df = with_matrix(df)
    # Moments of the order come from those of its channels, so the points are read once.
    per = df.groupBy(*COLUMN).agg(
        F.stddev_pop("flux").alias("__sd"), F.count("flux").cast("double").alias("__k"), F.avg("flux").alias("__m"))
    total = per.groupBy("order_id").agg(
        F.sum("__k").alias("__points"), (F.sum(F.col("__k") * F.col("__m")) / F.sum("__k")).alias("__mean"))
    spread = (
        per.join(total, "order_id")
        .groupBy("order_id")
        .agg(F.sqrt(F.sum(F.col("__k") * (F.pow("__sd", 2) + F.pow(F.col("__m") - F.col("__mean"), 2))) / F.max("__points")).alias("__spread"))
    )
    bad = per.join(spread, "order_id").select(*COLUMN, (F.col("__sd") > F.lit(float(factor)) * F.col("__spread")).alias("__bad"))
    got = df.join(bad, COLUMN).withColumn("flux", F.when(~F.coalesce("__bad", F.lit(False)), F.col("flux"))).drop("__bad")
    if subtract_mean:
        got = with_group_stats(got, ROW, {"__m": F.avg("flux")})
        got = got.withColumns({"flux": F.col("flux") - F.col("__m"), "matrix": F.col("matrix") - F.col("__m")}).drop("__m")
    return got.select(*df.columns)


def _mean_weight(weighted: bool) -> Column:
    """1/sigma (or 1), nothing where sigma is 0 or masked."""
    valid = F.col("uncertainty") != 0
    return F.when(valid, 1 / F.col("uncertainty") if weighted else F.lit(1.0))


def _divide(df: DataFrame, by: str, mask: Column | None = None) -> DataFrame:
    ok = F.col(by).isNotNull() if mask is None else mask
    return df.withColumns({
        "flux": F.when(ok, F.try_divide("flux", F.col(by))),
        "matrix": F.when(ok, F.try_divide("matrix", F.col(by))),
        "uncertainty": F.when(ok, F.try_divide("uncertainty", F.abs(by))),
    })


def remove_throughput_mean(df: DataFrame, weighted: bool = True) -> DataFrame:
    """Divide each (order, exposure) by its weighted mean over channels."""
    df = with_matrix(df)
    w = F.when(F.col("flux").isNotNull(), _mean_weight(weighted))
    got = with_group_stats(df, ROW, {"__mean": F.try_divide(F.sum(w * F.col("flux")), F.sum(w))})
    return _divide(got, "__mean").select(*df.columns)


def remove_tellurics_mean(df: DataFrame, weighted: bool = True, threshold: float = 1e-16) -> DataFrame:
    """Divide each (order, channel) by its weighted mean over exposures; mask it if the mean is too low."""
    df = with_matrix(df)
    w = F.when(F.col("flux").isNotNull(), _mean_weight(weighted))
    got = with_group_stats(df, COLUMN, {"__mean": F.try_divide(F.sum(w * F.col("flux")), F.sum(w))})
    return _divide(got, "__mean", F.col("__mean") >= threshold).select(*df.columns)


def _shrink_sigma(df: DataFrame, by: list[str], lost: int) -> DataFrame:
    """Shrink the uncertainties by the points left valid in each group."""
    return _shrunk(with_group_stats(df, by, {"__valid": F.count("uncertainty"), "__all": F.count(F.lit(1))}), lost)


def _shrunk(got: DataFrame, lost: int) -> DataFrame:
    """sigma sqrt(max(valid - lost, 0) / N): the fit took ``lost`` degrees of freedom."""
    left = F.greatest(F.col("__valid") - lost, F.lit(0))
    return got.withColumn("uncertainty", F.when(left > 0, F.col("uncertainty") * F.sqrt(left / F.col("__all"))))


def remove_throughput_fit(
    df: DataFrame, degree: int = 2, weights: str = "inverse", threshold: float = 1e-16, correct: bool = True
) -> DataFrame:
    """Divide each (order, exposure) by a weighted polynomial in wavelength.

    ``weights``: ``inverse`` 1/sigma, ``sigma`` the uncertainty itself, ``none``.
    A fully masked exposure gets the factor 1; points where the fit is below
    ``threshold`` are masked.
    """
    df = with_matrix(df)
    sigma = F.col("uncertainty")
    weight = {"inverse": F.when(sigma != 0, 1 / sigma), "sigma": sigma, "none": F.when(sigma.isNotNull(), F.lit(1.0))}[weights]
    got = with_poly_fit(df, ROW, "wavelength", F.col("flux"), weight, degree)
    fit = F.when(F.col("__used") == 0, F.lit(1.0)).otherwise(F.col("__fit"))
    got = got.withColumn("__fit", F.when(F.col("flux").isNotNull() & (fit >= threshold), fit))
    got = _divide(got, "__fit")
    return (_shrink_sigma(got, ROW, degree + 1) if correct else got).select(*df.columns)


def remove_tellurics_fit(
    df: DataFrame, degree: int = 2, weighted: bool = True, threshold: float = 1e-16, correct: bool = True
) -> DataFrame:
    """Divide each (order, channel) by exp(polynomial of ln flux in airmass).

    Fluxes <= 0 are masked. A channel with degree + 1 valid points or fewer gets
    the factor 1; one whose fit falls below ``threshold`` anywhere is masked.
    """
    df = with_matrix(df)
    positive = F.col("flux") > 0
    sigma = F.col("uncertainty")
    weight = F.when(positive & (sigma != 0), F.abs(F.col("flux") / sigma) if weighted else F.lit(1.0))
    # A channel is masked as a whole or keeps all positive fluxes, so its valid points are known with the sums.
    counts = {"__valid": F.count(F.when(positive, sigma)), "__all": F.count(F.lit(1))}
    got = with_poly_fit(df, COLUMN, "airmass", F.when(positive, F.log("flux")), weight, degree, extra=counts)
    got = got.withColumn("__fit", F.exp(F.when(F.col("__used") > degree + 1, F.col("__fit")).otherwise(F.lit(0.0))))
    if degree == 1:  # a straight line is lowest at one end of the unit axis
        ends = [F.col("__c0") - F.col("__c1"), F.col("__c0") + F.col("__c1")]
        got = got.withColumn("__lowest", F.exp(F.when(F.col("__used") > 2, F.least(*ends)).otherwise(F.lit(0.0))))
    else:
        got = with_group_stats(got, COLUMN, {"__lowest": F.min("__fit")})
    got = got.withColumn("__fit", F.when(positive & (F.col("__lowest") >= threshold), F.col("__fit")))
    got = _divide(got, "__fit")
    return (_shrunk(got, degree + 1) if correct else got).select(*df.columns)


def polyfit_detrend(
    df: DataFrame, wavelengths: bool = True, airmass: bool = True, telluric_threshold: float = 0.1, degree: int = 1,
    throughput: bool = True, tellurics: bool = True, correct: bool = True, weighted: bool = False,
    throughput_weights: str | None = None,
) -> DataFrame:
    """Throughput removal (degree-2 fit, or mean without wavelengths), then telluric removal (fit, or mean without airmass).

    The two fits are separate stages with a written table between them: each
    reads its input several times, and the second must not repeat the first.
    """
    if throughput:
        if wavelengths:
            mode = throughput_weights or ("inverse" if weighted else "none")
            df = remove_throughput_fit(df, 2, mode, sys.float_info.min, correct)
            df = staged(df) if tellurics else df
        else:
            df = remove_throughput_mean(df, weighted)
    if tellurics:
        if airmass:
            df = remove_tellurics_fit(df, degree, weighted, telluric_threshold, correct)
        else:
            df = remove_tellurics_mean(df, weighted, telluric_threshold)
    return df


def _outliers(df: DataFrame, ref: str, limit: float) -> DataFrame:
    """Mask ``ref`` farther than ``limit`` standard deviations from the mean of everything."""
    got = with_group_stats(df, [], {"__m": F.avg(ref), "__sd": F.stddev_pop(ref)})
    far = F.try_divide(F.abs(F.col(ref) - F.col("__m")), F.col("__sd")) > limit  # nothing lies far from a constant
    return got.withColumn(ref, F.when(~F.coalesce(far, F.lit(False)), F.col(ref))).drop("__m", "__sd")


def trim_spectrum(
    df: DataFrame, low: float = 0.8, high: float = 1.2, outlier: float | None = None, degree: int = 2,
    relative: bool = True, weights: str = "inverse",
) -> DataFrame:
    """Mask channels whose time median leaves [low, high] after continuum division, then outliers in two rounds."""
    keys = ["order_id", "exposure_id", "channel"]
    start = with_matrix(df)
    ref = staged(remove_throughput_fit(start, degree, weights, correct=False)) if relative else start
    middle = quantiles(ref.filter("flux IS NOT NULL"), COLUMN, "flux", {"__median": 0.5})
    outside = (F.col("__median") < low) | (F.col("__median") > high)
    ref = ref.join(middle, COLUMN, "left").withColumn("flux", F.when(~F.coalesce(outside, F.lit(True)), F.col("flux"))).drop("__median")
    if outlier is not None:
        ref = _outliers(ref, "flux", outlier)
        ref = ref.withColumn("uncertainty", F.when(F.col("flux").isNotNull(), F.col("uncertainty")))
        ref = staged(remove_tellurics_fit(staged(ref), degree, True, correct=False))
        ref = _outliers(ref, "flux", outlier)
    kept = ref.select(*keys, F.col("flux").isNotNull().alias("__ok"))
    return df.join(kept, keys).withColumn("flux", F.when(F.col("__ok"), F.col("flux"))).select(*df.columns)


def _rank_one(data: DataFrame, rows: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One alternation: column factors from row factors, then row factors from the new column factors."""
    start = data.withColumn("__a", F.lit(1.0)) if rows is None else data.join(rows, ROW)
    a, v, s = F.col("__a"), F.col("__v"), F.col("__s")
    columns = start.groupBy(*COLUMN).agg(F.try_divide(F.sum(a * s), F.sum(a * a * v)).alias("__c"))
    c = F.col("__c")
    new_rows = data.join(columns, COLUMN).groupBy(*ROW).agg(F.try_divide(F.sum(c * s), F.sum(c * c * v)).alias("__a"))
    return new_rows, columns


def _systematics(data: DataFrame, rows: DataFrame, columns: DataFrame, out: str) -> DataFrame:
    product = F.col("__a") * F.col("__c")
    got = data.join(rows, ROW).join(columns, COLUMN)
    return got.withColumn(out, F.coalesce(F.when(~F.isnan(product), product), F.lit(0.0))).drop("__a", "__c")


def sysrem(
    df: DataFrame, passes: int = 1, max_iterations: int = 10, epsilon: float = 1e-3, subtract: bool = True,
    threshold: float | None = 0.8, remove_mean: bool = True, weighted_mean: bool = False,
) -> DataFrame:
    """Iterative removal of rank-one systematics a(exposure) c(channel) per order.

    Every alternation is two partial aggregations over the points; only the
    factor tables change, and they are written out, so the plan of iteration n
    does not contain the n-1 before it. A channel or exposure that is masked
    throughout has no systematics. With ``epsilon`` 0 a fixed number of
    iterations runs without any look at the data in between.
    """
    df = with_matrix(df)
    if threshold is not None:
        df = df.withColumn("flux", F.when(F.col("flux") >= threshold, F.col("flux")))
    if remove_mean and subtract:
        w = F.when(F.col("flux").isNotNull() & F.col("uncertainty").isNotNull(),
                   F.col("uncertainty") if weighted_mean else F.lit(1.0))
        df = with_group_stats(df, ROW, {"__m": F.try_divide(F.sum(w * F.col("flux")), F.sum(w))})
        df = df.withColumn("flux", F.col("flux") - F.col("__m")).drop("__m")
    for _ in range(passes):
        sigma2 = F.pow("uncertainty", 2)
        valid = F.col("flux").isNotNull() & (sigma2 > 0)
        data = df.withColumns({
            "__s": F.when(valid, F.col("flux") / sigma2).otherwise(F.lit(0.0)),
            "__v": F.when(valid, 1 / sigma2).otherwise(F.lit(0.0)),
        })
        slim = staged(data.select(*ROW, "channel", "__s", "__v"))
        rows: DataFrame | None = None
        before: tuple[DataFrame, DataFrame] | None = None
        for i in range(max_iterations):
            rows, columns = _rank_one(slim, rows)
            if epsilon > 0 or i < max_iterations - 1:
                columns, rows = staged(columns), staged(rows)
            if epsilon > 0:
                now = _systematics(slim, rows, columns, "__new")
                if before is None:
                    now = now.withColumn("__old", F.lit(0.0))
                else:
                    now = _systematics(now, before[0], before[1], "__old")
                change = now.agg(F.sum(F.abs(F.col("__old") - F.col("__new"))).alias("d"), F.sum(F.abs("__old")).alias("o")).first()
                before = (rows, columns)
                if (change["d"] or 0.0) <= epsilon * (change["o"] or 0.0):
                    break
        got = _systematics(data.drop("__s", "__v"), rows, columns, "__sys")
        hit = F.col("__sys") != 0
        for c in ("flux", "matrix"):
            new = F.col(c) - F.col("__sys") if subtract else F.col(c) / F.col("__sys")
            got = got.withColumn(c, F.when(hit, new))
        if not subtract:
            got = got.withColumn("uncertainty", F.col("uncertainty") * F.abs("matrix"))
        df = got.select(*df.columns)
    return df
