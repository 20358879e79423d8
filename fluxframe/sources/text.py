"""Text readers: spectra, photometry, catalogues, posterior samples, cross-section files.

Every reader is a projection over ``spark.read.text``: files split across tasks,
and nothing passes through the driver but names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PathLike = str | Sequence[str]


def _lines(spark: SparkSession, paths: PathLike, comment: str = "#") -> DataFrame:
    """Non-empty lines without comments, with their file."""
    raw = spark.read.text(paths if isinstance(paths, str) else list(paths))
    text = F.trim(F.regexp_replace(F.col("value"), f"{comment}.*$", ""))
    return raw.select(F.input_file_name().alias("file"), text.alias("line")).filter(F.col("line") != "")


def file_stem(file: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(file), r"^.*/", ""), r"\.[^.]*$", "")


def _number(text: Column) -> Column:
    """DOUBLE; NaN, text and empty fields become NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def _fields(line: Column) -> Column:
    """Commas if there are any, else white space."""
    return F.when(line.contains(","), F.split(line, r"\s*,\s*")).otherwise(F.split(line, r"\s+"))


def read_spectra(spark: SparkSession, paths: PathLike, dataset: Column | None = None) -> DataFrame:
    """Spectra of 3 columns (wavelength, flux, sigma) or 4 (wavelength, bin width, flux, sigma).

    Fewer columns fail the job. With more than 4 the file counts as 3 columns
    and the rest is ignored; ``extra_columns`` shows it. The dataset is the file name.
    """
    got = _lines(spark, paths).withColumn("f", _fields(F.col("line"))).withColumn("n", F.size("f"))
    short = F.raise_error(F.concat(F.lit("a spectrum needs at least 3 columns: "), F.col("line"))).cast("double")

    def at(i: int) -> Column:
        return _number(F.get("f", F.lit(i)))

    four = F.col("n") == 4
    name = file_stem(F.col("file")) if dataset is None else dataset
    return got.select(
        name.alias("dataset"),
        F.when(F.col("n") < 3, short).otherwise(at(0)).alias("wavelength"),
        F.when(four, at(1)).alias("bin_width"),
        F.when(four, at(2)).otherwise(at(1)).alias("flux"),
        F.when(four, at(3)).otherwise(at(2)).alias("uncertainty"),
        (F.col("n") > 4).alias("extra_columns"),
    )


def read_photometry(spark: SparkSession, paths: PathLike) -> DataFrame:
    """Photometric points (name, w_low, w_high, flux, err) with the model range and resolution they ask for."""
    f = F.split("line", r"\s*,\s*")
    got = _lines(spark, paths).select(F.get(f, F.lit(0)).alias("name"), *[_number(F.get(f, F.lit(i + 1))).alias(c) for i, c in enumerate(("w_low", "w_high", "flux", "err"))])
    return photometry_ranges(got)


def photometry_ranges(points: DataFrame) -> DataFrame:
    low, high = F.col("w_low"), F.col("w_high")
    return points.withColumns({"model_low": 0.95 * low, "model_high": 1.05 * high, "resolution": (low + high) / 2 / (high - low)})


def read_catalog(spark: SparkSession, paths: PathLike) -> DataFrame:
    """Tab-separated catalogue: comment lines, a line of names, values; empty fields are NULL.

    Columns stay strings; ``operators.catalog`` converts what it uses.
    """
    return spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t", comment="#", header=True, nullValue="", inferSchema=False)


def read_posterior(spark: SparkSession, folder: str, run: str) -> DataFrame:
    """Samples of one run: a white-space matrix whose last column is the log-likelihood, names in a JSON list.

    A single sample row is fine; ``count`` tells.
    """
    names = [r["value"] for r in spark.read.text(f"{folder}/out_PMN/{run}_params.json", wholetext=True).select(
        F.explode(F.from_json("value", "array<string>")).alias("value")).collect()]
    lines = _lines(spark, f"{folder}/out_PMN/{run}_post_equal_weights.dat")
    f = F.split("line", r"\s+")
    return lines.select(
        F.lit(run).alias("run_id"), *[_number(F.get(f, F.lit(i))).alias(n) for i, n in enumerate(names)],
        _number(F.element_at(f, -1)).alias("log_likelihood"))


def read_cross_sections(spark: SparkSession, paths: PathLike, pattern: str, spectral: str = "wavenumber") -> DataFrame:
    """Two-column files, one per (species, temperature, pressure) taken from the path.

    ``pattern`` has three groups in that order. The first column is a wavenumber
    (cm^-1), a wavelength in cm or in um.
    """
    f = F.split("line", r"[\s,]+")
    stem = F.url_decode(F.col("file"))
    x = _number(F.get(f, F.lit(0)))
    wavelength = {"wavenumber": 1 / x, "cm": x, "um": x * F.lit(1e-4)}[spectral]
    return _lines(spark, paths).select(
        F.regexp_extract(stem, pattern, 1).alias("species"),
        F.regexp_extract(stem, pattern, 2).cast("double").alias("temperature"),
        F.regexp_extract(stem, pattern, 3).cast("double").alias("pressure"),
        wavelength.alias("wavelength"), _number(F.get(f, F.lit(1))).alias("cross_section"))
