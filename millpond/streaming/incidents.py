"""Live incidents: each landing of evaluations adds its transitions to a history that equals the batch timeline.

The rows are the strongest observations of an evaluation (`plans.incidents.strongest`). What is held per fingerprint is its state after each
chunk of evaluations (`plans.chunks`). A micro-batch stores its observations by chunk, finds the first chunk it touches of each
scope (closures it reaches touch theirs too), and evaluates from the states held before that chunk. So it reads the observations of
the chunk that is being filled, whatever the length of the history; rows that arrive late make it read on from their chunk. It
appends what the history changes by: transitions not written yet, and written ones to be taken back, as when a cause reaches the
stream after what it suppresses. So an evaluation may come in any number of micro-batches, in any order. Everything is joins and
folds inside Spark; no row is handled in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import chunks, incidents
from ..session import cut

EVENTS = ("fingerprint", "number", "eval", "event", "kind", "severity", "reason", "run_id", "opened_at")
SCOPE = ("stage", "domain", "product")


def _from(rows: DataFrame, scopes: DataFrame, back: int = 0) -> DataFrame:
    """Rows of the scopes from their first touched chunk on, or `back` evaluations before it, with that chunk's start as `since`."""
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SCOPE]
    return rows.join(scopes, [*same, F.col("eval") >= F.col("since") - back]).select(*rows.columns, "since")


def _net(changes: DataFrame) -> DataFrame:
    """Transitions with the sum of their changes, without those that cancel out."""
    return changes.groupBy(*EVENTS, *SCOPE).agg(F.sum("change").cast("int").alias("change")).where("change <> 0")


def transitions_into(folder: str, observations: DataFrame, closures: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer of live transitions; `observations` names the columns that land. A batch run again replaces its own rows."""
    names = [c for c in observations.columns if c not in ("batch", "chunk")]
    fields = observations.select(*names).schema.fields
    parts = [T.StructField("batch", T.LongType()), T.StructField("chunk", T.LongType())]
    identity = [f for f in fields if f.name in incidents.IDENTITY]
    state = T.StructType([*identity, T.StructField("state", T._parse_datatype_string(chunks.STATE)), *parts])
    kinds = {f.name: f for f in fields} | {"severity": T.StructField("severity", T.StringType())}
    longs = {name: T.StructField(name, T.LongType()) for name in ("number", "opened_at")}
    texts = {"event": T.StructField("event", T.StringType())}
    moves = T.StructType([*((kinds | longs | texts)[c] for c in (*EVENTS, *SCOPE)), T.StructField("change", T.IntegerType()), *parts])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        by_chunk = batch.select(*names).withColumn("chunk", chunks.chunk_of(F.col("eval")))
        by_chunk.write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/observations/batch={batch_id}")

        def held(table: str, schema: T.StructType, upto: int) -> DataFrame:
            path = f"{folder}/{table}"
            found = spark.read.schema(schema).parquet(path) if upto >= 0 else spark.createDataFrame([], schema)
            return found.where(F.col("batch") <= upto)

        seen = held("observations", T.StructType([*fields, *parts]), batch_id)
        landed = seen.where(F.col("batch") == batch_id)
        # Two numbers: the last evaluation before this batch, of which every batch has left a note, and the last in it.
        before = batch_id - 1
        notes = T.StructType([T.StructField("eval", T.LongType()), parts[0]])
        low = held("reached", notes, before).agg(F.max("eval")).first()[0]
        high = landed.agg(F.max("eval")).first()[0]
        spark.createDataFrame([(high,)], "eval long").write.mode("overwrite").parquet(f"{folder}/reached/batch={batch_id}")
        scopes = landed.select(*SCOPE, "chunk")
        reached = max((n for n in (low, high) if n is not None), default=None)
        ended = None
        if closures is not None and reached is not None:
            ended = closures.where(F.col("eval") <= reached)
            fresh = ended if low is None else ended.where(F.col("eval") > low)
            scopes = scopes.union(fresh.select(*SCOPE, chunks.chunk_of(F.col("eval"))))
        # One row per scope the batch touches.
        touched = scopes.groupBy(*[F.col(c).alias(f"_{c}") for c in SCOPE]).agg((F.min("chunk") * chunks.CHUNK).alias("since"))
        touched = cut(touched, "touched")
        first = touched.agg(F.min("since")).first()[0]
        if first is None:
            first, ended = 0, None
        # Chunks are folders, so older observations are not opened; the one before is, for unknowns in a row that go on.
        back = incidents.UNREADABLE_THRESHOLD - 1
        recent = seen.where(F.col("chunk") >= (first - back) // chunks.CHUNK).select(*names)
        history = incidents.count_unreadable(_from(recent, touched, back)).where("eval >= since").drop("since")
        states = held("states", state, before)
        states = states.join(touched, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SCOPE]).where(F.col("chunk") * chunks.CHUNK < F.col("since"))
        # The state a fingerprint had before its first chunk: after the last chunk until then, as last written.
        entering = cut(
            states.groupBy(*incidents.IDENTITY).agg(
                F.max_by("state", F.struct("chunk", "batch")).alias("state"), F.first("since").alias("since")
            ),
            "entering",
        )
        if ended is not None:
            ended = _from(ended, touched).drop("since")
        rows, after = incidents.evaluate_from(history, ended, entering, cut)
        after.write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/states/batch={batch_id}")
        changes = incidents.timeline(rows).select(*EVENTS, *SCOPE, F.lit(1).alias("change"))
        written = held("events", moves, before).where(F.col("chunk") >= first // chunks.CHUNK).drop("batch", "chunk")
        again = _from(written, touched).select(*EVENTS, *SCOPE, (-F.col("change")).alias("change"))
        net = _net(changes.union(again)).withColumn("chunk", chunks.chunk_of(F.col("eval")))
        net.write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/events/batch={batch_id}")

    return write


def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """All transitions so far."""
    return _net(spark.read.parquet(f"{folder}/events")).select(*EVENTS)
