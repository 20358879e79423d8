"""The corpus pipeline: keep good documents, one of each group of near duplicates, hide personal data, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from fluxframe.llm import nearjoin, packing, pii, quality
from fluxframe.session import shared_folder

#: Rows that Spark hands to a Python worker at once, in bytes: documents are whole texts, 10,000 of which have no bound.
BATCH_BYTES = "2m"
#: Words whose ids a packing worker keeps.
REMEMBER = 150_000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. All labels are trusted here; texts alone are scored."""
    _bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit_quality(docs, quality.trusted_ids(labels)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id. Different texts under one id are judged apart; texts without words all stay."""
    _bounded(spark)
    return nearjoin.one_per_class(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences."""
    _bounded(spark)
    pieces = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), remember=REMEMBER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id")


STAGES = [("quality", good_documents), ("near_duplicates", one_of_each), ("personal_data", without_personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_folder(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: A trained classifier and connected components are not for SQL; the tests compare the stages with brute force.
ORACLE_SQL = None
