"""The query of each operator, beside its DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, decontaminate, jaccard, lm, passages, pii, quality, sharding, suffixes, urls, warc, whitening
from .common import prepare
from .oracles import ORACLES  # noqa: F401 - beside the queries they describe

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> list[bytes]:
    return bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents"))
    return measured.select("doc_id", *(c.split()[0] for c in quality.MEASURES.split(", ")), "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches. The contract has no column for the latter, which `near_benchmark_items` returns; here they
    bear out the former, as an item that stands in a text word for word is near too."""
    found = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.when(F.col("n_near") >= F.col("n_items"), F.col("n_items")).otherwise(F.raise_error(F.lit("an exact match is not near")))
    return found.select("doc_id", "n_words", "n_hit", n_items.cast("bigint").alias("n_items"), "items_sha256", "contaminated")


def near_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of operator 6, whose contract has no column for them."""
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_near")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = {s: 1.0 for s in range(SHARDS)}
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards, shards | {SHARDS: 1.0})
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN, ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    back = warc.read(archive, spark)
    checked = F.when(F.col("verified"), F.col("digest")).otherwise(F.raise_error(F.lit("a stored payload has another digest")))
    return back.select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to"
    )


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii, op2_lm_score, op3_url_filter, op4_ngram_jaccard, op5_quality, op6_decontamination, op7_suffix_dedup,
        op8_sharding, op9_bpe, op10_warc, op11_clusters, op12_whitening, op13_passages, near_benchmark_items,
    )
}
