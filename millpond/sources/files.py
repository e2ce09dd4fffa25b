"""File scans: CSV as text, landed Parquet batches, gzipped NDJSON, run manifests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import Contract
from ..operators.validate import FILE

LOAD = "load_id"


class EmptySource(ValueError):
    """A source file without a data row."""


def csv_scan(
    spark: SparkSession,
    folder: str,
    *,
    separator: str = ",",
    encoding: str = "utf-8",
    glob: str = "*.{csv,csv.gz}",
    multiline: bool = True,
) -> DataFrame:
    """Every CSV file of a folder, plain or gzipped, as text columns, named by the header, with the file each row came from.

    A quoted field may hold line breaks, so a file is one task; a source that never quotes a line break can say so with
    `multiline=False` and have its large files split.
    """
    scan = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", encoding)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        # Files whose headers differ are refused instead of read by position.
        .option("enforceSchema", False)
        .option("pathGlobFilter", glob)
        .csv(folder)
    )
    return scan.withColumn(FILE, F.col("_metadata.file_path"))


def csv_row_count(spark: SparkSession, folder: str, **options: object) -> int:
    """Records, not lines: the header and blank lines are left out. No record at all is an error."""
    rows = csv_scan(spark, folder, **options).count()
    if not rows:
        raise EmptySource(f"{folder} holds no data row")
    return rows


def parquet_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Landed batches with the file of each row. File paths sort oldest first, so `_file` is the batch order."""
    return spark.read.parquet(folder).withColumn(FILE, F.col("_metadata.file_path"))


def ndjson_lines(spark: SparkSession, folder: str, pattern: str = "*.ndjson.gz") -> DataFrame:
    """Records of gzipped NDJSON as JSON text; objects of other names than `pattern` are none. Only a line feed ends a record; blank lines are no record.

    `namespace`, `date` and `hour` come from the path of an object, at whatever depth it lies: one under its date alone has no hour,
    and one under no such folder has none of them. They are expressions of a hidden column of the file, so a filter on them,
    or on `uploaded_at`, leaves out files before any is opened.
    """
    path = F.col("_metadata.file_path")
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(folder)
        .select(
            F.col("value").alias("record"),
            *[_folder_value(path, name).alias(name) for name in ("namespace", "date")],
            _folder_value(path, "hour").try_cast("int").alias("hour"),
            path.alias(FILE),
            F.col("_metadata.file_modification_time").alias("uploaded_at"),
        )
    )
    return lines.where(F.col("record").rlike(r"\S"))


def _folder_value(path: Column, name: str) -> Column:
    """What the innermost folder `name=value` of a path says."""
    return F.nullif(F.regexp_extract(path, f"^.*/{name}=([^/]+)/", 1), F.lit(""))


def window_partitions(since: datetime, until: datetime, lookback: timedelta = timedelta(0)) -> Column:
    """The objects by `date` and `hour` that can hold an event of [since, until), widened by `lookback` at the end for
    a layout that is partitioned by when a line was copied. An object without an hour can hold any of its day."""
    last = until + lookback - timedelta(microseconds=1)
    days = [(since + timedelta(days=n)).date().isoformat() for n in range((last.date() - since.date()).days + 1)]
    first, final = F.col("date") == days[0], F.col("date") == days[-1]
    hour, inside, any_hour = F.col("hour"), F.col("date").isin(*days), F.col("hour").isNull()
    return inside & (~first | any_hour | (hour >= since.hour)) & (~final | any_hour | (hour <= last.hour))


def uploaded_since(since: datetime, slack: timedelta = timedelta(minutes=15)) -> Column:
    """Files that can hold a line written at or after `since`: one uploaded before it cannot. Clocks may differ by
    `slack`. There is no upper bound, as a late upload can hold early lines."""
    return F.col("uploaded_at") >= F.lit(since - slack)


MANIFEST = """version string, stage string, domain string, product string, run_id string, complete boolean,
results array<struct<identity string, engine string, stage string, domain string, product string, table_name string,
column_name string, check_id string, outcome string, pipeline_outcome string, observed_us bigint, run_id string,
metrics map<string, double>>>, _corrupt string"""


def manifest_scan(
    spark: SparkSession, folder: str, version: str = "1", lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Quality manifests as (readable, refused), one row per document: a file each, or with `lines` a line each.

    Refused: not JSON, another version, or a result of another stage or run than the manifest it is filed under.
    """
    documents = (
        spark.read.schema(MANIFEST)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(folder)
        .withColumn(FILE, F.col("_metadata.file_path"))
    )
    foreign = F.exists(
        "results",
        lambda r: ~(r["stage"].eqNullSafe(F.col("stage")) & r["run_id"].eqNullSafe(F.col("run_id"))),
    )
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "not valid JSON")
        .when(~F.col("version").eqNullSafe(F.lit(version)), "unknown version")
        .when(F.coalesce(foreign, F.lit(False)), "result of another run")
    )
    judged = documents.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason", "_corrupt"), judged.where("reason is not null")


def manifest_results(manifests: DataFrame) -> DataFrame:
    """One row per result, with the manifest's completeness."""
    return manifests.select("complete", F.explode("results").alias("result")).select("complete", "result.*")


def write_manifests(
    results: DataFrame, folder: str, keys: Sequence[str] = ("stage", "domain", "product", "run_id"), per_file: int = 1
) -> None:
    """One JSON document per run, its results sorted by identity so that the same results give the same document.

    `manifest_scan` reads what this writes: a document is one line, and a file holds `per_file` of them at most, so many runs
    need not be as many files. A run's results are as many as it has checks, and are gathered for its document.
    """
    fields = [
        "identity", "engine", "stage", "domain", "product", "table_name", "column_name", "check_id", "outcome",
        "pipeline_outcome", "observed_us", "run_id", "metrics",
    ]
    by_identity = F.array_sort(
        F.collect_list(F.struct(*fields)),
        lambda a, b: F.when(a["identity"] < b["identity"], -1).when(a["identity"] > b["identity"], 1).otherwise(0),
    )
    documents = results.groupBy(*keys).agg(F.bool_or("complete").alias("complete"), by_identity.alias("results"))
    documents.withColumn("version", F.lit("1")).write.mode("overwrite").option("maxRecordsPerFile", per_file).json(folder)


def raw_view(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns as text, the form a source file holds."""
    return df.select(*[F.col(n).cast("string").alias(n) for n in contract.names])


def land_csv(rows: DataFrame, folder: str, per_file: int = 1_000_000) -> None:
    """Source files as they land: gzipped CSV. A file is read by one task, so each holds `per_file` rows at most."""
    out = rows.write.option("header", True).option("escape", '"').option("compression", "gzip")
    out.option("maxRecordsPerFile", per_file).csv(folder)
