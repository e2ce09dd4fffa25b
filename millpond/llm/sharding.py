"""Weighted rendezvous hashing (operator 8): a record goes to the shard with the highest score for its key.

The score of shard s for a key is `weight / -ln(u)`, u being a hash of the key and s as a fraction between 0 and 1. So shards
get rows in proportion to their weights, the place depends on the key and the shards alone, and one more shard takes rows
only into itself: no other score changes. Everything is expressions over single rows; no row meets another to be placed.

The shards are an array that one small expression goes through, so the code Spark makes for a row does not grow with them.

`slot` numbers a shard's rows from 0 without gaps. No shard is numbered in one task: equal rows are counted before the
shuffle, counts are added up per (shard, bucket) with buckets by a hash of the row, the few totals are summed over the
buckets of a shard, and each bucket numbers its rows from its own offset. A row that comes very often is a single count.

Null ids are a key like any other. A null text has size 1 (no bytes, plus 1) and the check sum of the empty text. Repeated
rows get the same shard and neighbouring slots. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets of a shard: the first three hex digits of a row's hash.
BUCKET_DIGITS = 3
# Slots of equal rows made at once.
RUN = 1 << 12


def fraction(key: Column, shard: Column) -> Column:
    """A number in (0, 1) from a key and a shard: 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard of a key (a string): the highest score, the smaller number of two equal ones."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need positive weights")
    shards = F.array(*(F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in sorted(weights.items())))
    scored = F.transform(
        shards, lambda s: F.struct((s["weight"] / -F.log(fraction(key, s["shard"]))).alias("score"), (-s["shard"]).alias("shard"))
    )
    return (-F.array_max(scored)["shard"]).cast("int")


def assign(docs: DataFrame, weights: dict[int, float], grown: dict[int, float]) -> DataFrame:
    """One row per document: `doc_id`, `size`, `text_crc32`, `shard`, `slot`, and the shard under `grown`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Equal rows are one row with a count from here on.
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    row = F.concat_ws(":", key, F.col("size"), F.col("text_crc32"))
    placed = equal.select(
        "*",
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        F.substring(F.md5(row), 1, BUCKET_DIGITS).alias("bucket"),
    )
    totals = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.join(offsets, ["shard", "bucket"]).withColumn(
        "first", F.col("offset") + F.coalesce(F.sum("copies").over(inside), F.lit(0))
    )
    # A row that comes very often is written out again in runs of bounded length.
    runs = numbered.select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("first") + F.col("copies")).alias("end"), "first",
        F.posexplode(F.array_repeat(F.lit(0), F.ceil(F.col("copies") / RUN).cast("int"))).alias("run", "_"),
    )
    begin = F.col("first") + F.col("run") * F.lit(RUN).cast("bigint")
    runs = runs.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "end", begin.alias("begin"))
    length = F.least(F.lit(RUN), F.col("end") - F.col("begin")).cast("int")
    return runs.select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", "begin", F.posexplode(F.array_repeat(F.lit(0), length)).alias("k", "_")
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("k")).alias("slot"), "grown_shard")
