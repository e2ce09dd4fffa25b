"""Load modes over Parquet folders: replace, append, merge, history, and the cursors between runs.

A table is a folder of versions and a folder of commits. A version is written whole before its commit, so a reader sees
the old table or the new one, and a run that dies between the two changes nothing. A commit names the first and the last
version that make up the table: one after a replace, one more after each append.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import Contract, ContractError
from ..operators import validate
from ..operators.validate import FILE
from ..plans.marts import latest
from ..session import cut


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


@dataclass(frozen=True)
class Table:
    """A replaceable table. One writer at a time."""

    spark: SparkSession
    root: str

    def _commit(self) -> tuple[int, int]:
        """The first and the last version of the table, or (1, 0)."""
        commits = f"{self.root}/commits"
        if not exists(self.spark, commits):
            return 1, 0
        seen = self.spark.read.schema("version bigint, first bigint").parquet(commits)
        first, last = seen.agg(F.max_by(F.coalesce("first", "version"), "version"), F.max("version")).first()
        return (first, last) if last else (1, 0)

    def version(self) -> int:
        return self._commit()[1]

    def batch(self) -> int:
        """The last stream batch committed to this table, or -1."""
        commits = f"{self.root}/commits"
        if not exists(self.spark, commits):
            return -1
        seen = self.spark.read.schema("version bigint, batch bigint").parquet(commits).agg(F.max("batch")).first()[0]
        return -1 if seen is None else seen

    def read(self) -> DataFrame | None:
        first, last = self._commit()
        return self.spark.read.parquet(*[self._folder(v) for v in range(first, last + 1)]) if last else None

    def _folder(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}"

    def append(self, df: DataFrame) -> DataFrame:
        """Add the rows as a version of their own; what the table holds is not written again."""
        first, last = self._commit()
        return self._write(df, first if last else 1, last + 1, None)

    def replace(self, df: DataFrame, comments: dict[str, str] | None = None, batch: int | None = None) -> DataFrame:
        """Write the next version and commit it. Column comments travel in the Parquet schema. `batch` is the stream
        batch the version holds, so that a batch run again can be told from a new one."""
        version = self.version() + 1
        for name, comment in (comments or {}).items():
            df = df.withMetadata(name, {"comment": comment})
        return self._write(df, version, version, batch)

    def _write(self, df: DataFrame, first: int, version: int, batch: int | None) -> DataFrame:
        df.write.mode("overwrite").parquet(self._folder(version))
        commit = self.spark.range(version, version + 1).select(
            F.col("id").alias("version"),
            F.lit(batch).cast("bigint").alias("batch"),
            F.lit(first).cast("bigint").alias("first"),
        )
        commit.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return self.read()


def save_bucketed(df: DataFrame, name: str, folder: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A catalog table clustered by its join keys, so that joins of tables with the same buckets shuffle neither side.

    For keys whose rows spread evenly: a bucket is one task, and AQE does not split it.
    """
    df.write.mode("overwrite").option("path", folder).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def load_full(df: DataFrame, folder: str) -> None:
    """A full resource replaces its files."""
    df.write.mode("overwrite").parquet(folder)


def load_incremental(df: DataFrame, folder: str, cursor: str, last: Any, load_id: int) -> bool:
    """Append the rows past the cursor as the files of one load. Nothing new writes no file.

    Loads are folders whose names sort by load, so `_file` puts the batches oldest first.
    """
    fresh = df if last is None else df.where(F.col(cursor) > cursor_value(df, cursor, last))
    if fresh.isEmpty():
        return False
    fresh.write.mode("error").parquet(f"{folder}/load_id={load_id:010d}")
    return True


def cursor_value(df: DataFrame, cursor: str, last: Any) -> Column:
    """A saved cursor as a value of its column's type."""
    kind = df.schema[cursor].dataType
    if isinstance(kind, T.TimestampType) and isinstance(last, int):
        return F.timestamp_micros(F.lit(last))
    return F.lit(last).cast(kind) if isinstance(last, str) else F.lit(last)


def last_cursor(df: DataFrame, cursor: str, smallest: bool = False) -> int | str | None:
    """The largest, or `smallest`, cursor as a number or as text that `cursor_value` reads back whatever the session's time zone: instants
    count microseconds, dates, local times, decimals and doubles are text."""
    kind = df.schema[cursor].dataType
    top = F.min(cursor) if smallest else F.max(cursor)
    if isinstance(kind, T.TimestampType):
        top = F.unix_micros(top)
    elif not isinstance(kind, T.IntegralType):
        top = top.cast("string")
    return df.agg(top).first()[0]


@dataclass(frozen=True)
class Cursors:
    """The last loaded cursor of each stage, source and resource. A stage reads and moves only its own."""

    spark: SparkSession
    root: str

    def last(self, stage: str, source: str, resource: str) -> tuple[int, int | str | None]:
        """The load number and cursor of the last saved load, or (0, None)."""
        if not exists(self.spark, self.root):
            return 0, None
        mine = self.spark.read.parquet(self.root).where(
            (F.col("stage") == stage) & (F.col("source") == source) & (F.col("resource") == resource)
        )
        load_id, cursor, number = mine.agg(
            F.max("load_id"), F.max_by("cursor", "load_id"), F.max_by("number", "load_id")
        ).first()
        return load_id or 0, int(cursor) if number else cursor

    def save(self, stage: str, source: str, resource: str, load_id: int, cursor: int | str) -> None:
        """Call after the load is written: a run killed before this reads the same rows again and skips none."""
        self.spark.sql(
            "select :stage as stage, :source as source, :resource as resource, cast(:load_id as bigint) as load_id, "
            ":cursor as cursor, :number as number",
            args={
                "stage": stage, "source": source, "resource": resource, "load_id": load_id, "cursor": str(cursor),
                "number": isinstance(cursor, int),
            },
        ).write.mode("append").parquet(self.root)


def run_incremental(
    df: DataFrame, folder: str, cursors: Cursors, stage: str, source: str, resource: str, cursor: str
) -> bool:
    """One incremental run: read the stage's cursor, land what is past it, then save the landed maximum.

    A row without a cursor is past none, on the first run as on later ones."""
    load_id, last = cursors.last(stage, source, resource)
    df = df.where(F.col(cursor).isNotNull())
    if not load_incremental(df, folder, cursor, last, load_id + 1):
        return False
    landed = df.sparkSession.read.parquet(f"{folder}/load_id={load_id + 1:010d}")
    cursors.save(stage, source, resource, load_id + 1, last_cursor(landed, cursor))
    return True


def append(df: DataFrame, folder: str, contract: Contract) -> None:
    if contract.load.mode == "full":
        raise ContractError(f"{contract.name}: append would add every row of a full resource again on each run")
    df.write.mode("append").parquet(folder)


def merge_latest(
    target: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: str = FILE
) -> DataFrame:
    """Upsert: one row per key, the batch's latest file before its older ones and before the target.

    Several files are merged at once. Two rows of a key in one file are told apart by their values.
    """
    columns = [c for c in batch.columns if c != order]
    rows = batch.withColumns({"_new": F.lit(1), "_order": F.col(order)}).drop(order)
    if target is not None:
        held = target.select(*columns).withColumns({"_new": F.lit(0), "_order": F.lit(None).cast(rows.schema["_order"].dataType)})
        rows = held.unionByName(rows)
    ties = [F.col(c).asc() for c in columns if c not in keys]
    return latest(rows, keys, [F.desc("_new"), F.desc("_order"), *ties]).drop("_new", "_order")


def superseded(batch: DataFrame, keys: Sequence[str], order: str = FILE) -> DataFrame:
    """The duplicates report of a merge: per repeated key the file that won and the copies it replaced."""
    return (
        batch.groupBy(*keys)
        .agg(F.max(order).alias("kept_from"), (F.count(F.lit(1)) - 1).alias("rejected_copies"))
        .where("rejected_copies > 0")
    )


def history(versions: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Version history: one row per change of the non-key columns, with `valid_from`, `valid_to`, `is_current`.

    `order` is the load a version came with, and a key has one version per load after the first step, so a key's window
    holds no more rows than there were loads.
    """
    values = [c for c in versions.columns if c not in (*keys, order)]
    per_load = latest(versions, [*keys, order], [F.col(c).asc() for c in values])
    same = F.lit(True)
    by_key = Window.partitionBy(*keys).orderBy(order)
    for name in values:
        same = same & F.col(name).eqNullSafe(F.lag(name).over(by_key))
    first = F.lag(F.lit(1)).over(by_key).isNull()
    changed = per_load.withColumn("_changed", first | ~same).where("_changed").drop("_changed")
    return changed.withColumns(
        {
            "valid_from": F.col(order),
            "valid_to": F.lead(order).over(by_key),
            "is_current": F.lead(F.lit(1)).over(by_key).isNull(),
        }
    ).drop(order)


def merge_history(
    held: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """Add a batch to a history. Closed versions stay as they are; the open ones meet the batch."""
    if held is None:
        return history(batch, keys, order)
    columns = batch.columns
    closed = held.where(~F.col("is_current"))
    opened = held.where("is_current").withColumn(order, F.col("valid_from")).select(*columns)
    return closed.unionByName(history(opened.unionByName(batch), keys, order))


class RefreshRefused(RuntimeError):
    """A version history holds what its inputs no longer do, so it cannot be rebuilt from them."""


def full_refresh(
    spark: SparkSession, bronze: str, silver: Table, contract: Contract, scope: str
) -> DataFrame | None:
    """Scope `bronze` rebuilds the Silver table from every landed batch, checked against the contract as on any run; `gold`
    leaves Silver as it is. Neither reads the source again, so cursors and Bronze files stay. What Gold builds on Silver is
    rebuilt by `product.run_product`."""
    if scope not in ("bronze", "gold"):
        raise ValueError(f"refresh scope {scope!r} is neither bronze nor gold")
    if scope == "gold":
        return silver.read()
    if contract.write_mode == "merge_scd2":
        raise RefreshRefused(f"{contract.name} keeps a version history")
    batches = spark.read.parquet(bronze).withColumn(FILE, F.col("_metadata.file_path")).drop("load_id")
    checked = validate.check(batches, contract, cut)
    rebuilt = checked.accepted_from()
    if contract.write_mode == "merge_scd1":
        rebuilt = merge_latest(None, rebuilt, contract.load.primary_key or contract.primary_key)
    table = silver.replace(rebuilt.drop(FILE))
    checked.enforce()
    return table


def history_sink(records: DataFrame, folder: str, at: str | Column) -> None:
    """Append records as JSON under `date=YYYY-MM-DD`."""
    moment = F.col(at) if isinstance(at, str) else at
    records.withColumn("date", F.date_format(moment, "yyyy-MM-dd")).write.partitionBy("date").mode("append").json(folder)


