"""Analytics over quality results: one row per check of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_ascii

OUTCOMES = ("passed", "warn", "error", "not_run", "unknown")
IDENTITY = (
    "stage", "domain", "product", "table_name", "column_name", "engine", "check_id", "run_id", "engine_run_id",
)
# Metric names that could carry row data, and health states from the mildest to the worst. Unknown ranks
# above healthy, so a missing observation is never hidden by a green neighbour.
FORBIDDEN_METRICS = tuple(
    "row rows sample samples sample_values value values payload record records secret password token credential "
    "credentials access_key secret_key".split()
)
STATES = ("disabled", "healthy", "unknown", "warning", "critical")


def identity(parts: Sequence[str] = IDENTITY) -> Column:
    """A stable id of one check execution. What it found and when is left out, so a re-read gives the same id.

    A JSON array keeps nulls and separators apart, so two different lists of parts never give one text.
    """
    listed = F.concat_ws(",", *[json_ascii(F.col(p).cast("string")) for p in parts])
    return F.sha2(F.concat(F.lit("["), listed, F.lit("]")), 256)


def record_problems(metrics: str = "metrics") -> Column:
    """Why a result record is refused; empty for a good one."""
    required = ("engine", "stage", "check_id", "engine_severity", "run_id")
    names = F.transform(F.map_keys(metrics), lambda k: F.lower(k))
    numbers = F.map_values(metrics)
    unsafe = F.col("artifact_uri").rlike(r"[?#]|//[^/]*@")
    found = [
        F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"missing {name}")) for name in required
    ]
    found += [
        F.when(F.col("observed_us").isNull(), F.lit("missing observed_at")),
        F.when(~F.coalesce(F.col("outcome"), F.lit("")).isin(*OUTCOMES), F.lit("unknown outcome word")),
        F.when(F.col("column_name").isNotNull() & F.col("table_name").isNull(), F.lit("column without table")),
        F.when(unsafe, F.lit("unsafe artifact uri")),
        F.when(F.arrays_overlap(names, F.array(*[F.lit(k) for k in FORBIDDEN_METRICS])), F.lit("row data in metrics")),
        F.when(
            F.exists(numbers, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
            F.lit("metric is not finite"),
        ),
    ]
    return F.array_compact(F.array(*found))


def outcome_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    blocking = (F.col("outcome") == "error") & (F.col("pipeline_outcome") == "blocked")
    return results.groupBy(*keys).agg(
        *[F.count_if(F.col("outcome") == word).alias(word) for word in OUTCOMES],
        F.count_if(blocking).alias("blocking"),
    )


def stage_totals(counts: DataFrame, known: Column) -> DataFrame:
    """Totals over the jobs whose counts are known. A stage where none is known has null totals, never zero."""
    words = (*OUTCOMES, "blocking")
    return counts.groupBy("stage").agg(*[F.sum(F.when(known, F.col(word))).alias(word) for word in words])


def merge_results(fresh: DataFrame, published: DataFrame, key: str = "identity") -> DataFrame:
    """The fresh result of a check, unless it says `unknown` where the published one knew more. The time of the first
    observation stays, and a manifest once complete stays complete."""
    tagged = fresh.withColumn("_fresh", F.lit(1)).unionByName(published.withColumn("_fresh", F.lit(0)))
    knows = (F.col("outcome") != "unknown").cast("int")
    # A known outcome outranks an unknown one; between equals the fresh one wins.
    columns = [c for c in fresh.columns if c not in (key, "observed_us", "complete")]
    ranked = F.struct(knows.alias("knows"), F.col("_fresh"), "observed_us", *columns)
    return (
        tagged.groupBy(key)
        .agg(
            F.max(ranked).alias("kept"),
            F.min(F.when(F.col("_fresh") == 0, F.col("observed_us"))).alias("first_us"),
            F.bool_or("complete").alias("complete"),
        )
        .select(
            key,
            *[F.col(f"kept.{c}").alias(c) for c in columns],
            F.coalesce("first_us", "kept.observed_us").alias("observed_us"),
            "complete",
        )
    )


def row_totals(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accepted and rejected rows of a run. An entity repeats its counts on each of its checks, so they are taken once
    per table, then added."""
    counted = results.where(
        (F.col("engine") == "contract") & F.col("rejected_rows").isNotNull() & F.col("accepted_rows").isNotNull()
    )
    per_table = counted.groupBy(*keys, "table_name").agg(
        F.max("rejected_rows").alias("rejected"), F.max("accepted_rows").alias("accepted")
    )
    return per_table.groupBy(*keys).agg(F.sum("rejected").alias("rejected"), F.sum("accepted").alias("accepted"))


def state_rank(state: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), state)


def worst_state(states: Column) -> Column:
    """Aggregate: the most severe state; nothing observed is unknown."""
    return F.coalesce(F.max_by(states, state_rank(states)), F.lit("unknown"))


def health_fields(outcome: Column, effect: Column) -> tuple[Column, Column]:
    """What health sees of a result: its outcome, and whether it blocks. A check that did not run gives nothing."""
    reported = ~outcome.isin("not_run", "unknown")
    return F.when(reported, outcome), F.when(reported, effect == "blocked")


def quality_state(outcome: Column, blocking: Column) -> Column:
    return (
        F.when(outcome == "passed", "healthy")
        .when(outcome == "warn", "warning")
        .when(outcome == "error", F.when(blocking, "critical").otherwise("warning"))
        .otherwise("unknown")
    )


def quality_signal(
    results: DataFrame, keys: Sequence[str], *, now_us: int, max_age_us: int, level: str = "warn"
) -> DataFrame:
    """One health signal per run: the worst of its checks.

    A pass needs every check to have reported and the manifest to be complete; a failure stands anyway. Where warnings
    and non-blocking errors meet, the error speaks. `level="error"` reads a warning as a pass. All of it is one
    aggregate, so a run with very many checks folds map-side.
    """
    outcome, blocking = health_fields(F.col("outcome"), F.col("pipeline_outcome"))
    seen = results.withColumns({"_outcome": outcome, "_blocking": blocking})
    if level == "error":
        seen = seen.withColumn("_outcome", F.when(F.col("_outcome") == "warn", "passed").otherwise(F.col("_outcome")))
    stale = F.lit(now_us) >= F.col("observed_us") + F.lit(max_age_us)
    state = F.when(
        F.col("_outcome").isNotNull(),
        F.when(stale, "unknown").otherwise(quality_state(F.col("_outcome"), F.col("_blocking"))),
    )
    failing = (F.col("_state") == "warning") & (F.col("_outcome") == "error")
    folded = (
        seen.withColumn("_state", state)
        .groupBy(*keys)
        .agg(
            worst_state(F.col("_state")).alias("worst"),
            F.bool_or(F.col("_outcome").isNull()).alias("unreported"),
            F.bool_or(failing).alias("soft_error"),
            F.bool_or("complete").alias("complete"),
        )
    )
    proven = (F.col("worst") != "healthy") | (~F.col("unreported") & F.col("complete"))
    settled = F.when(proven, F.col("worst")).otherwise("unknown")
    said = (
        F.when(settled == "critical", "error")
        .when(settled == "warning", F.when(F.col("soft_error"), "error").otherwise("warn"))
        .when(settled == "healthy", "passed")
    )
    return folded.select(*keys, settled.alias("state"), said.alias("outcome"))


def data_test_outcome(
    status: Column, severity: Column, selected: Column, build_failed: Column, has_results: Column
) -> tuple[Column, Column]:
    """Outcome and run effect of one declared data test. A selected test without a result is `not_run`, unless the build
    broke or reported nothing at all. A test that was neither selected nor reported gets nulls."""
    outcome = (
        F.when(status == "pass", "passed")
        .when(status == "warn", "warn")
        .when(status.isin("fail", "error"), "error")
        .when(status == "skipped", "not_run")
        .when(status.isNotNull(), "unknown")
        .when(selected, F.when(build_failed | ~has_results, "unknown").otherwise("not_run"))
    )
    effect = (
        F.when(status.isin("pass", "warn"), "continued")
        .when(status == "error", "blocked")
        .when((status == "fail") & (F.lower(severity) == "error"), "blocked")
        .when(outcome.isNotNull(), "unknown")
    )
    return outcome, effect


def data_test_results(tests: DataFrame, results: DataFrame) -> DataFrame:
    """Declared tests joined to their results. `tests` holds run_id, test_id, severity, selected, build_failed,
    attached_table, parent_tables; the table of a test is the one it is attached to, else its only parent."""
    reported = results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_reported"))
    outcome, effect = data_test_outcome(
        F.col("status"), F.col("severity"), F.col("selected"), F.col("build_failed"),
        F.coalesce("n_reported", F.lit(0)) > 0,
    )
    table_name = F.coalesce("attached_table", F.when(F.size("parent_tables") == 1, F.get("parent_tables", F.lit(0))))
    return (
        tests.join(results, ["run_id", "test_id"], "left")
        .join(reported, "run_id", "left")
        .select(
            "run_id",
            "test_id",
            table_name.alias("table_name"),
            outcome.alias("outcome"),
            effect.alias("pipeline_outcome"),
        )
        .where("outcome is not null")
    )
