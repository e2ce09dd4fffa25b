"""Merge targets: one row, or one history, per key, in folders by a hash of the key. A merge writes only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import FILE
from ..session import cut
from .loads import exists, merge_history, merge_latest

BUCKET = "_bucket"
Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


@dataclass(frozen=True)
class Keyed:
    """A table partitioned by a hash of its keys. One writer at a time; readers between its runs.

    `buckets` is fixed for a table's life: some hundred megabytes of rows each, so that a small batch rewrites little and a large
    one has tasks enough. A merge reads the buckets that its batch has keys of, and replaces their folders by dynamic partition
    overwrite: files of other buckets are neither read nor written. A run that dies may leave some of its buckets new and some old;
    run again it comes to the same table, as a batch merged twice changes nothing the second time.
    """

    spark: SparkSession
    root: str
    keys: Sequence[str]
    buckets: int = 64

    def _bucket(self, df: DataFrame) -> Column:
        # By the text of a key, so that a batch of another number type falls into the same bucket.
        return F.pmod(F.xxhash64(*[df[k].cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    @property
    def rows(self) -> str:
        return f"{self.root}/rows"

    def read(self) -> DataFrame | None:
        return self.spark.read.parquet(self.rows).drop(BUCKET) if exists(self.spark, self.rows) else None

    def _write(self, df: DataFrame, mode: str) -> None:
        # Rebalanced by bucket: small ones share a task, a large one is several files.
        dealt = df.withColumn(BUCKET, self._bucket(df)).hint("rebalance", F.col(BUCKET))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(BUCKET).parquet(self.rows)

    def replace(self, df: DataFrame) -> DataFrame:
        """All rows anew."""
        self._write(df, "static")
        return self.read()

    def merge(self, batch: DataFrame, how: Merge) -> DataFrame:
        """`how` makes the new rows of the touched buckets from their old ones and the batch."""
        batch = cut(batch, "batch")
        if not exists(self.spark, self.rows):
            return self.replace(how(None, batch))
        # At most as many numbers as there are buckets.
        touched = [r[0] for r in batch.select(self._bucket(batch).alias(BUCKET)).distinct().collect()]
        held = self.spark.read.parquet(self.rows).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        # Written apart first: the folders are replaced by rows that were read from them.
        self._write(cut(how(held, batch), "merged"), "dynamic")
        return self.read()

    def upsert(self, batch: DataFrame, order: str = FILE) -> DataFrame:
        """One row per key: the batch's latest file before its older ones and before the table."""
        return self.merge(batch, lambda held, rows: merge_latest(held, rows, self.keys, order))

    def add_versions(self, batch: DataFrame, order: str = FILE) -> DataFrame:
        """A history per key: the versions that the batch begins and ends."""
        return self.merge(batch, lambda held, rows: merge_history(held, rows, self.keys, order))
