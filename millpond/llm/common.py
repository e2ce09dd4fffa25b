"""What several operators share: Arrow batches in bounded pieces, sorted groups, packed postings, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

# Bytes of text handled at once by vector code: arrays of eight bytes per text byte then stay in the cache.
CHUNK = 1 << 20
# Rows per Arrow batch: even rows of 100 kB stay far below a worker's memory.
BATCH_ROWS = 1000
# Spark's setting that shuffle files are deleted when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A document id where a join needs one that is never null.
NO_ID = -(1 << 63)


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings the operators count on."""
    session.tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, then let go of what it was made from.

    Once the table is written nothing reads the shuffle files behind it, so Spark is told to delete them with the end of the write;
    if `df` is run again they are made again. Files of other steps, as counts, go when the driver's garbage is collected, which on
    an idle driver may take half an hour; asking for it keeps the disk a job needs to one step's.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        written = session.cut(df, label)
    finally:
        conf.set(CLEANUP, before)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """All bytes of a text column."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two hashes with different seeds. Null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2")]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of `df` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value, without decoding (null: empty)."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `limit` text bytes; a longer text comes alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(sizes):
        return
    bin_of = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(bin_of)) + 1), len(sizes)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by `key` as one table per key, across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def shard_cuts(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted unsigned 64-bit keys pass from one of `shards` equal ranges to the next."""
    bounds = np.array([((s << 64) + shards - 1) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, bounds), [len(sorted_keys)]])


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    first = np.ones(len(sorted_values), dtype=bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return first


def run_lengths(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run, from the marks of `starts_of`."""
    start = np.flatnonzero(first)
    return start, np.diff(np.append(start, len(first)))


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one range after the other."""
    total = int(length.sum())
    base = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) if len(start) else np.zeros(0, dtype=np.int64)
    return base + np.arange(total)


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """Connected components of undirected links `a`-`b`: every linked node with the smallest node it reaches.

    Alternates the large-star and small-star steps until the links are stars, a number of rounds that grows with the
    logarithm of a component's size. No step gathers a node's neighbours: a minimum per node is joined back, and a node with
    very many links is split by AQE. Each round is written to the shared folder. Null ends and loops are ignored.
    Returns `node`, `component`; nodes without links are not listed.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    oriented = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = cut(oriented.distinct(), label)
    before = mark(now)
    while before[0]:
        # Large star: each larger neighbour is linked to the smallest node around.
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), label)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
