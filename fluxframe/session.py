"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition that aggregates hold in memory.
ROWS_PER_TASK = 250_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fluxframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def in_parts(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """``df`` dealt by ``by`` into as many partitions as ``rows`` need, ROWS_PER_TASK in each, so that a task's memory does not grow with the table."""
    tasks = max(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a fresh local one only for a local session without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    return spark.conf.get("spark.checkpoint.dir")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage between the stages of a chain: later plans start from a
    columnar table with known size, and losing an executor costs no rework of
    earlier stages. Shuffle files of the write, which nothing reads again, go as
    it ends. One folder per application, so it can be dropped afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fluxframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
