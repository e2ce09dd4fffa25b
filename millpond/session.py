"""Session settings and the shared scratch folder every job writes its intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runtime SQL settings the plans rely on. A fact side that holds a hot key is split by AQE; forcing the split matters
# where the join is followed by an aggregate on the same key, which would otherwise switch the split off.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # What is cut, landed in Silver or built in Gold is written once per step: a third fewer bytes than the default.
    "spark.sql.parquet.compression.codec": "zstd",
}

_LOCAL_DIRS: dict[str, str] = {}
_SIZES: dict[str, int] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Shuffles start with one partition per so many input bytes, within a bound that keeps map outputs manageable; AQE then
# merges the small ones. Rows of text are ten times their Parquet files in a shuffle, and a task's sorts must stay in its memory.
SHUFFLE_BYTES = 32 << 20
MAX_SHUFFLE_PARTITIONS = 40_000


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """Raise the number of shuffle partitions to what the folder's size asks for; never lower it."""
    if folder not in _SIZES:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        _SIZES[folder] = int(files.getContentSummary(path).getLength())
    wanted = min(_SIZES[folder] // SHUFFLE_BYTES, MAX_SHUFFLE_PARTITIONS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))


def build(app: str = "millpond", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; a temporary one only for an unset local session."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="millpond-")
    return _LOCAL_DIRS[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared root, so no run reads or overwrites another run's files."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Its schema is read from the files once per application."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def present(df: DataFrame) -> DataFrame:
    """Engine-neutral output types: exact decimals as doubles, dates and timestamps as ISO text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def cut(df: DataFrame, label: str = "cut", by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    What follows reads the written files, so several uses cost one computation, and a lost executor costs a re-read
    instead of the whole lineage. Rows that differ in the columns `by` are in different folders, which filters on them prune.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
