"""A corpus in five steps: quality rules, near duplicates, benchmark passages, personal data, tokens.

Each stage takes what the one before it kept, written as Parquet and read again, and applies its operator's decisions to all of it.
All stages but the last return the columns of `documents`, in their order, and any others that come with them: a column's name never
matters, be it one a stage uses itself. Texts may be of any length. A null text counts as empty; repeated rows and rows that share an
id are rows of their own unless a stage says otherwise; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millpond.llm import bpe, decontaminate, jaccard, pii, quality
from millpond.llm.common import content_key, cut, prepare, unused
from millpond.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines. Null, empty and blank texts are rejected, as too short; equal rows
    get equal verdicts."""
    prepare(spark)
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id (null last), then the smallest key of its text.

    A document is known by its id and text together, so other texts under its id are judged in their own components. Of rows equal
    in both one stays. Texts without words link with nothing and all stay.
    """
    prepare(spark)
    linked, alone = jaccard.classes(docs)
    linked = cut(linked, "classes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")).alias("least")
    chosen = linked.groupBy("comp").agg(least).select("least.doc_id", "least.k1", "least.k2", F.lit(True).alias("words"))
    kept = chosen.union(alone.select("doc_id", "k1", "k2", F.lit(False)).distinct())
    named = unused(docs, "id", "k1", "k2", "words")
    kept = kept.toDF(*named)
    own_id, own_k1, own_k2, has_words = named
    k1, k2 = content_key(docs["text"].cast("string"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(own_id)) & (k1 == F.col(own_k1)) & (k2 == F.col(own_k2))
    one = docs.join(kept, same)
    # Only if a row comes twice is there anything to drop, and only then are texts grouped by it.
    if linked.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        one = one.where(F.col(has_words)).dropDuplicates([own_id, own_k1, own_k2]).union(one.where(~F.col(has_words)))
    return one.select(*(docs[c] for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, by exact matches, which alone decide that. Null and empty texts and texts
    without words are not; equal texts are judged alike, whatever their ids."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    named = unused(docs, "k1", "k2")
    found = decontaminate.contaminated_texts(docs, benchmark).toDF(*named)
    same = [key == F.col(name) for key, name in zip(content_key(docs["text"].cast("string")), named)]
    return docs.join(found, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Null texts stay null; equal texts are masked alike."""
    prepare(spark)
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token ids, with digests of the ids and of the bytes they decode to; null and empty texts have no ids."""
    prepare(spark)
    keep = tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns)
    return bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN, keep=keep)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

# Line rules with 64-bit window hashes, estimated reliabilities and merges by rank have no SQL form; tests compare every stage
# with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
