"""Streams that read each landed file once: merges into Silver, log lines without replays, series per step."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.validate import FILE
from ..plans.logs import DAY, first_copies
from ..plans.series import run_status
from ..sources.keyed import Keyed
from ..sources.loads import exists


def new_files(
    spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    """Landed Parquet files, each read once across runs, with the file of each row."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder).select(*schema.names, F.col("_metadata.file_path").alias(FILE))


def drain(writer: Callable[..., None], stream: DataFrame, checkpoint: str, mode: str = "append") -> None:
    """Process every file that waits, batch by batch, then stop."""
    query: StreamingQuery = (
        stream.writeStream.foreachBatch(writer)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def merge_into(target: Keyed) -> Callable[[DataFrame, int], None]:
    """A batch writer that upserts new files: the latest file's row of a key wins. A batch run again after a failure comes to the
    same table, and rewrites only the buckets it has keys of."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            target.upsert(batch)

    return write


def incremental_merge(
    spark: SparkSession, bronze: str, schema: T.StructType, target: Keyed, checkpoint: str
) -> None:
    """One run of an incremental Silver entity: the files landed since the last run, merged by key."""
    drain(merge_into(target), new_files(spark, bronze, schema), checkpoint)


def unreplayed(lines: DataFrame, delay: str, time: str = "event_time", key: str = "dedup_key") -> DataFrame:
    """A stream of log lines without replays. A line without a key is never a replay.

    State is kept for `delay` only, which must exceed the time a collector can hold lines back. Lines later than that are
    dropped here and come back through `late_lines`.
    """
    keyed = lines.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return keyed.unionByName(lines.where(F.col(key).isNull()))


def late_lines(
    archive: DataFrame, ingested: DataFrame, days: Sequence[date] | None = None, key: str = "dedup_key", day: str = DAY
) -> DataFrame:
    """The lines the stream was too late for: in the archive by key, not among the ingested, the first copy of each.

    A key holds its line's time, so all copies of a line are of one day: where both tables lie in folders by `day`, the files
    of other days than `days` are opened on neither side, and rows meet by day and key. A line without a day is in every run.
    """
    if days is not None:
        touched = F.col(day).isNull() | F.col(day).isin(*days)
        archive, ingested = archive.where(touched), ingested.where(touched)
    keyed, held = archive.where(F.col(key).isNotNull()), ingested.where(F.col(key).isNotNull()).select(day, key).distinct()
    return first_copies(keyed.join(held, [keyed[day].eqNullSafe(held[day]), keyed[key] == held[key]], "left_anti"))


def touched_days(archive: DataFrame, since: datetime | None, slack: timedelta = timedelta(minutes=15), day: str = DAY) -> list[date]:
    """The days that files landed since a time have lines of; all without one. Read off the files' names and times: no row is
    read where `day` is a folder. Clocks may differ by `slack`; a day too many changes nothing."""
    files = archive if since is None else archive.where(F.col("_metadata.file_modification_time") >= F.lit(since - slack))
    # One row per day of the archive's life.
    return sorted(r[0] for r in files.select(day).where(F.col(day).isNotNull()).distinct().collect())


@dataclass(frozen=True)
class Ingest:
    """Log lines from a landed archive, each once, however late. Archive and lines lie in folders by day.

    A run takes the files that wait through the stream, then adds the lines the stream was too late for, which are looked up only
    in the days those files touch. A run that died is run again with the same number: its lines replace those it left.
    """

    spark: SparkSession
    archive: str
    lines: str
    checkpoint: str
    schema: T.StructType
    delay: str

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(folder)

    def read(self) -> DataFrame:
        return self._read(self.lines)

    def run(self, number: int, since: datetime | None, slack: timedelta = timedelta(minutes=15)) -> None:
        """`since`: when the run before this one began; None for the first."""
        stream = new_files(self.spark, self.archive, self.schema).drop(FILE)
        drain(append_to(self.lines, (DAY,)), unreplayed(stream, self.delay), self.checkpoint)
        archive = self._read(self.archive)
        # What this run itself left before it died is not yet ingested.
        own = F.col("_metadata.file_path").contains(f"/batch=late_{number}/")
        ingested = self.read().where(~own) if exists(self.spark, self.lines) else archive.where(F.lit(False))
        late = late_lines(archive, ingested, touched_days(archive, since, slack))
        late.write.mode("overwrite").partitionBy(DAY).parquet(f"{self.lines}/batch=late_{number}")


def append_to(folder: str, by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A batch writer with one folder per batch: a batch run again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/batch={batch_id}")

    return write


def step_counts(runs: DataFrame, step: str, delay: str, time: str = "created_at") -> DataFrame:
    """Runs per step, job and status as a stream. Spark's windows hold their start and not their end; a step of the
    series holds its end, so times move back by a microsecond first."""
    shifted = (F.col(time) - F.expr("interval 1 microsecond")).alias("_at")
    named = runs.select(shifted, "stage", "job_name", run_status(F.col("status")).alias("status"))
    counted = (
        named.withWatermark("_at", delay)
        .groupBy(F.window("_at", step), "stage", "job_name", "status")
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return counted.select("stage", "job_name", "status", F.col("window.end").alias("t"), "value")


def upsert_into(target: Keyed) -> Callable[[DataFrame, int], None]:
    """A batch writer for aggregates in update mode: the newest value of a key replaces the older one."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            target.upsert(batch.withColumn("_batch", F.lit(batch_id)), "_batch")

    return write
