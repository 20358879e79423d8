"""Gridded tables and sinks in Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.operators.grids import rebin


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "errorifexists", files_per_partition: int | None = None) -> None:
    """Write a result table. Rows are sorted within files, so range filters skip row groups.

    ``files_per_partition`` spreads each partition value over that many files by
    a hash of the sort columns: a value that holds a large part of the table is
    then not written by one task.
    """
    out = df
    if partition_by and files_per_partition:
        spread = F.pmod(F.xxhash64(*(sort_by or df.columns)), F.lit(files_per_partition))
        out = out.repartition(*partition_by, spread)
    if sort_by:
        out = out.sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", "true").format(fmt).save(path)


def read_grid(spark: SparkSession, path: str, species: Sequence[str] | None = None, wavelengths: tuple[float, float] | None = None) -> DataFrame:
    """Gridded table; species prune partitions, the wavelength range reaches the Parquet filter."""
    df = spark.read.parquet(path)
    if species is not None:
        df = df.filter(F.col("species").isin(list(species)))
    if wavelengths is not None:
        df = df.filter(F.col("wavelength").between(*wavelengths))
    return df


def ingest_opacities(cross_sections: DataFrame, grid: DataFrame, path: str, masses: DataFrame | None = None,
                     bucket: float | None = None, files_per_partition: int = 8) -> None:
    """Cross-sections of many (species, temperature, pressure) files on one wavelength grid, sorted and partitioned by species."""
    keys = ["species", "temperature", "pressure"]
    got = rebin(cross_sections, grid, keys, x="wavelength", y="cross_section", target_by=[], bucket=bucket).select(*keys, "wavelength", "cross_section")
    if masses is not None:
        from fluxframe.operators.lookup import to_mass_opacity

        got = to_mass_opacity(got, masses)
    write_table(got, path, ["species"], ["temperature", "pressure", "wavelength"], files_per_partition=files_per_partition)


def write_text(df: DataFrame, path: str, columns: Sequence[str | Column], separator: str = " ", comment: str | None = None) -> None:
    """Plain text columns, one file per task; ``comment`` goes into a file of its own as a comment line."""
    line = F.concat_ws(separator, *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns])
    lines = df.select(line.alias("value"))
    if comment is not None:
        head = df.sparkSession.createDataFrame([(f"# {comment}",)], "value string").coalesce(1)
        lines = head.union(lines)
    lines.write.text(path)
