"""The fit chain on tables: parameters -> model spectra -> data grids -> scores -> summaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.operators import covariance, grids, score, smooth
from fluxframe.session import staged

# A model function turns parameter rows into spectra rows: (sample keys, wavelength, flux).
ModelFunction = Callable[[DataFrame], DataFrame]
# A mixer turns the column spectra of a sample into one: an aggregate over the rows of a wavelength.
Mixer = Callable[[Column, Column], Column]


def weighted_columns(flux: Column, weight: Column) -> Column:
    return F.sum(flux * weight)


def mix_columns(spectra: DataFrame, by: Sequence[str], weight: str = "column_weight", mixer: Mixer = weighted_columns) -> DataFrame:
    """Combine the spectra of several atmospheric columns, wavelength by wavelength."""
    return spectra.groupBy(*by, "wavelength").agg(mixer(F.col("flux"), F.col(weight)).alias("flux"))


def score_samples(
    parameters: DataFrame, models: dict[str, ModelFunction], data: DataFrame, mapping: DataFrame | None = None,
    sample: Sequence[str] = ("sample_id",), extra: DataFrame | None = None, strict: bool = True,
) -> DataFrame:
    """Log-likelihood of every sample over all datasets.

    ``models`` holds one function per dataset that has its own model; ``mapping``
    (dataset, source_dataset) lets further datasets share it. ``data`` has
    dataset, wavelength, bin_width, flux, uncertainty. The model spectra are
    written once, then binned to every dataset that uses them.
    """
    sample = list(sample)
    spectra: DataFrame | None = None
    for name, model in models.items():
        part = model(parameters).select(*sample, "wavelength", "flux").withColumn("dataset", F.lit(name))
        spectra = part if spectra is None else spectra.unionByName(part)
    spectra = staged(spectra)
    if mapping is not None:
        spectra = score.share_models(spectra, mapping).select(*sample, "dataset", "wavelength", "flux")
    binned = grids.rebin(spectra, data, [*sample, "dataset"], target_by=["dataset"], widths="bin_width", strict=strict)
    # The bins carry the data's own wavelengths, so the match is exact.
    joined = binned.select(*sample, "dataset", "wavelength", F.col("flux").alias("model")).join(
        data.select("dataset", "wavelength", "flux", "uncertainty"), ["dataset", "wavelength"])
    per = score.gaussian_loglik(joined, [*sample, "dataset"])
    return score.total_loglik(per, sample, extra)


# ---- models that give several outputs, and scores built from a table of options

#: What a model kernel returns beside the sample keys: one row per atmospheric column of a model.
MODEL_COLUMNS = "model string, column_id int, column_weight double, wavelength array<double>, flux array<double>, extra_log_l double"
# A kernel turns a batch of parameter rows into a batch of model rows.
Kernel = Callable[[pa.RecordBatch], pa.RecordBatch]
#: Columns of a table of datasets and what counts where one is missing or NULL.
OPTIONS = {"source": None, "kind": "spectrum", "resolving_power": None, "offset": 0.0, "scaled": False, "scaled_uncertainty": False}
KINDS = ("spectrum", "grid", "photometry")


def model_spectra(parameters: DataFrame, kernel: Kernel, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Packed spectra of every sample, batch by batch, where the parameters lie.

    ``kernel`` gets Arrow batches of ``parameters`` and returns the sample keys and
    the columns of MODEL_COLUMNS: a sample may have several models and several
    columns of one, each with a weight, and an extra log-likelihood (NULL for none).
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                yield kernel(batch)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parameters.select(*sample).schema)
    return parameters.mapInArrow(run, f"{keys}, {MODEL_COLUMNS}")


def with_options(datasets: DataFrame) -> DataFrame:
    """``datasets`` (dataset and any of OPTIONS) with all options; a dataset's source is the model of its own name unless another is given."""
    have = set(datasets.columns)
    kinds = {"resolving_power": "double", "offset": "double", "scaled": "boolean", "scaled_uncertainty": "boolean", "kind": "string", "source": "string"}
    values = {name: (F.col(name).cast(kinds[name]) if name in have else F.lit(None).cast(kinds[name])) for name in OPTIONS}
    defaults = {name: F.col("dataset").cast("string") if name == "source" else F.lit(value) for name, value in OPTIONS.items()}
    return datasets.select("dataset", *[(F.coalesce(values[n], defaults[n]) if n != "resolving_power" else values[n]).alias(n) for n in OPTIONS])


def observed_models(
    models: DataFrame, data: DataFrame, datasets: DataFrame, sample: Sequence[str] = ("sample_id",), mixer: Mixer = weighted_columns,
    photometry: Callable[[Column, Column], Column] | None = None, strict: bool = True,
) -> DataFrame:
    """Model value at every data point: (sample, dataset, wavelength, model).

    Each dataset gets its source's spectra, seen at its own resolving power where
    it has one. Then ``spectrum`` datasets are rebinned to the data's bins,
    ``photometry`` datasets averaged over them (``photometry(flux, wavelength)``
    may weight the flux), and ``grid`` datasets taken where wavelengths are equal.
    Atmospheric columns are mixed last, point by point; a point that is masked in
    one of them is masked. One plan serves any number of datasets.
    """
    sample = list(sample)
    options = with_options(datasets)
    asked = options.agg(F.collect_set("kind").alias("kinds"), F.count("resolving_power").alias("convolved")).first()
    if set(asked["kinds"]) - set(KINDS):
        raise ValueError(f"datasets are of the kinds {', '.join(KINDS)}, not {asked['kinds']}")
    points = models.select(*sample, F.col("model").alias("source"), "column_id", "column_weight", F.explode(F.arrays_zip("wavelength", "flux")).alias("point"))
    points = points.select(*sample, "source", "column_id", "column_weight", "point.wavelength", "point.flux")
    by = [*sample, "dataset", "column_id", "column_weight"]
    # Spectra are far larger than Spark's estimate of a kernel's output; left alone, it may broadcast them and not the options.
    spectra = points.join(F.broadcast(options.select("dataset", "source", "kind", "resolving_power")), "source").drop("source")
    if asked["convolved"]:
        apart = spectra.filter("resolving_power IS NULL")
        seen = smooth.convolve_to_resolution(spectra.filter("resolving_power IS NOT NULL"), by, "resolving_power")
        spectra = staged(seen.unionByName(apart))
    parts = []
    for kind in sorted(asked["kinds"]):
        these = spectra.filter(F.col("kind") == kind).select(*by, "wavelength", "flux")
        bins = data.join(F.broadcast(options.filter(F.col("kind") == kind).select("dataset")), "dataset")
        if kind == "spectrum":
            got = grids.rebin(these, bins, by, target_by=["dataset"], widths="bin_width", strict=strict).select(*by, "wavelength", "flux")
        elif kind == "photometry":
            half = F.col("bin_width") / 2
            bands = bins.select("dataset", F.col("wavelength").alias("band"), (F.col("wavelength") - half).alias("w_low"), (F.col("wavelength") + half).alias("w_high"))
            got = grids.band_average(these, bands, by, transform=photometry, band_by=["dataset"]).select(*by, F.col("band").alias("wavelength"), "flux")
        else:
            got = these.join(bins.select("dataset", "wavelength"), ["dataset", "wavelength"]).select(*by, "wavelength", "flux")
        parts.append(got)
    observed = parts[0]
    for part in parts[1:]:
        observed = observed.unionByName(part)
    whole = F.count("flux") == F.count(F.lit(1))
    return observed.groupBy(*sample, "dataset", "wavelength").agg(F.when(whole, mixer(F.col("flux"), F.coalesce("column_weight", F.lit(1.0)))).alias("model"))


def score_models(
    models: DataFrame, data: DataFrame, datasets: DataFrame, parameters: DataFrame, sample: Sequence[str] = ("sample_id",),
    covariances: DataFrame | None = None, mixer: Mixer = weighted_columns, photometry: Callable[[Column, Column], Column] | None = None, strict: bool = True,
) -> DataFrame:
    """(sample, dataset, log_l): every dataset scored by its own options.

    ``models`` is as from ``model_spectra``, ``data`` has dataset, wavelength,
    bin_width, flux, uncertainty and, for datasets of ``covariances`` (dataset, i,
    j, c), the point's index i. ``parameters`` (sample, name, value) hold
    <dataset>_scale_factor, which multiplies the data of scaled datasets, and the
    uncertainties of those with scaled uncertainties, and exponents b, looked up as
    <dataset>_b, <prefix>_b, uncertainty_scaling_b, by which variances grow by
    10^b. With both a covariance and an exponent only the diagonal counts. A
    scaled dataset without its factor, and one with a masked point, has no score.
    """
    sample, options = list(sample), with_options(datasets)
    names = parameters.select(*sample, "name", "value")
    observed = observed_models(models, data, datasets, sample, mixer, photometry, strict)
    index = ["i"] if covariances is not None else []
    rows = observed.join(data.select("dataset", "wavelength", "flux", "uncertainty", *index), ["dataset", "wavelength"])
    rows = rows.join(F.broadcast(options.select("dataset", "offset", "scaled", "scaled_uncertainty")), "dataset")
    factors = names.filter(F.col("name").endswith("_scale_factor")).select(*sample, F.regexp_replace("name", "_scale_factor$", "").alias("__scaled"), F.col("value").alias("__factor"))
    rows = rows.withColumn("__scaled", F.when(F.col("scaled") | F.col("scaled_uncertainty"), F.col("dataset").cast("string"))).join(factors.hint("merge"), [*sample, "__scaled"], "left")
    scale, widen = (F.when(F.col(c), F.col("__factor")).otherwise(F.lit(1.0)) for c in ("scaled", "scaled_uncertainty"))
    rows = rows.withColumns({"d": score.residual(scale=scale, offset="offset"), "s": widen})
    rows = score.inflate_sigma(rows.withColumn("__zero", F.lit(0.0)), names, sigma="__zero", out="grown", by=sample)  # sqrt(10^b), 0 without b
    own = [*sample, "dataset"]
    if covariances is None:
        return _independent(rows, F.pow("uncertainty", 2) + F.pow("grown", 2), own)
    correlated = covariances.select("dataset").distinct().withColumn("__correlated", F.lit(True))
    diagonal = covariances.filter("i = j").select("dataset", "i", F.col("c").alias("__c"))
    rows = staged(rows.join(correlated, "dataset", "left").join(diagonal, ["dataset", "i"], "left"))
    full = rows.filter("__correlated AND grown = 0")
    variance = F.when(F.col("__correlated"), F.col("__c")).otherwise(F.pow("uncertainty", 2)) + F.pow("grown", 2)
    plain = _independent(rows.filter("__correlated IS NULL OR grown > 0"), variance, own)
    inverse, logdet = covariance.invert_covariance(covariances, ["dataset"])
    # A scaled matrix s^2 C is C for residuals divided by s; its determinant has ln s once per point.
    whole = full.groupBy(*own).agg(F.when(F.count("d") == F.count(F.lit(1)), F.sum(F.log("s"))).alias("__stretch"))
    scored = covariance.cov_loglik(full.select(*own, "i", (F.col("d") / F.col("s")).alias("d")), inverse, logdet, ["dataset"], sample)
    return plain.unionByName(scored.join(whole, own).select(*own, (F.col("log_l") - F.col("__stretch")).alias("log_l")))


def _independent(rows: DataFrame, variance: Column, by: list[str]) -> DataFrame:
    """Gaussian log-likelihood of residuals d with the given variance, stretched by s; NULL where a residual is."""
    total = variance * F.pow("s", 2)
    term = F.lit(-0.5) * (F.pow("d", 2) / total + F.log(F.lit(2 * math.pi) * total))
    return rows.groupBy(*by).agg(F.when(F.count(term) == F.count(F.lit(1)), F.sum(term)).alias("log_l"))


def total_score(per_dataset: DataFrame, models: DataFrame, sample: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(sample, log_l): sum over datasets and the models' extra log-likelihoods; an invalid part makes it the worst score."""
    extra = models.groupBy(*sample).agg(F.sum("extra_log_l").alias("log_prior"))
    return score.total_loglik(per_dataset, sample, extra)
