"""The registered queries of this subpackage, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_path

from fluxframe.llm import align, lm, nearjoin, ordermin, packing, pii, quality, repair, spm, tokenio, topk, urls, warc
from fluxframe.llm.text import fold
from fluxframe.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.url_verdicts(read(spark, sf, "pages"), rules)


SQL["op1_url_filter"] = """
WITH parts AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
    FROM parts
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
    FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


@query
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    learned = fold("doc_id", 3) != 1
    model = quality.fit_quality(docs, quality.trusted_ids(read(spark, sf, "labels").filter(learned)), learned)
    return quality.score_quality(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op3_shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    return nearjoin.shingle_classes(read(spark, sf, "documents"))


@query
def op4_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(fold("doc_id", 5) == 1, 0).when(fold("doc_id", 5) == 4, 2).otherwise(1)
    scored = lm.lm_scores(read(spark, sf, "documents"), part)
    return scored.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_pack(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id")


@query
def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    files = tokenio.write_token_files(read(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))
    return tokenio.read_token_files(files, shared_folder(spark)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.pii_spans(read(spark, sf, "documents"))
    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = {i})) AS bigint) AS n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined().alias("spans"))


@query
def op8_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return ordermin.compare_with_next(read(spark, sf, "documents"))


@query
def op10_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(read(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


SQL["op10_exact_top_k"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scores
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    encoded = spm.encode_documents(read(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")


@query
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair_conversations(repair.damaged(read(spark, sf, "conversations")))


@query
def op12_legacy_archives(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op12_legacy_archives"] = """
WITH payloads AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS payload FROM pages
), kept AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS last FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to FROM kept
"""


@query
def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.align_documents(read(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
