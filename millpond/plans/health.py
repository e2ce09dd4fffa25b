"""Health states from runs and schedules. Every rule is a column; `now` is an argument, never the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import worst_state
from .series import DAY, latest_due, run_status

RUN_MAX_AGE = 7 * DAY
NOT_YET_DUE = "no scheduled run due yet"


def rules(*cases: tuple[Column, str, str], otherwise: tuple[str, str]) -> tuple[Column, Column]:
    """State and reason of the first case that holds. A condition that cannot be told does not hold."""
    state, reason = F.lit(otherwise[0]), F.lit(otherwise[1])
    for condition, word, why in reversed(cases):
        met = F.coalesce(condition, F.lit(False))
        state, reason = F.when(met, word).otherwise(state), F.when(met, why).otherwise(reason)
    return state, reason


def latest_runs(runs: DataFrame) -> DataFrame:
    """Per job: the latest run, the latest success, and when a run was last created. One aggregate, folded map-side."""
    ended = (F.col("created_us") + F.coalesce(F.round(F.col("duration_s") * 1_000_000), F.lit(0))).cast("bigint")
    seen = runs.select(
        "stage", "job_name", "run_id", "created_us", run_status(F.col("status")).alias("status"), ended.alias("observed_us")
    )
    newest = F.max(F.struct("created_us", "run_id", "status", "observed_us"))
    success = F.max(
        F.when(F.col("status") == "succeeded", F.struct("created_us", "run_id", "observed_us"))
    )
    return (
        seen.groupBy("stage", "job_name")
        .agg(newest.alias("run"), success.alias("ok"))
        .select(
            "stage",
            "job_name",
            F.col("run.run_id").alias("run_id"),
            F.col("run.status").alias("status"),
            F.col("run.observed_us").alias("observed_us"),
            F.col("run.created_us").alias("last_created_us"),
            F.col("ok.run_id").alias("success_run_id"),
            F.col("ok.observed_us").alias("success_us"),
        )
    )


# The states and reasons in the rules below, which policies and incidents refer to.


def stale(observed: Column, now: int, max_age: Column) -> Column:
    return F.lit(now) >= observed + max_age


def execution(status: Column, observed: Column, now: int, max_age: Column) -> tuple[Column, Column]:
    """The latest run's outcome. A run in progress has not failed."""
    return rules(
        (status.isNull(), "unknown", "no observation"),
        (stale(observed, now, max_age), "unknown", "observation is stale"),
        (status == "succeeded", "healthy", "latest run succeeded"),
        (status == "failed", "critical", "latest run failed"),
        (status == "canceled", "warning", "latest run was canceled"),
        otherwise=("healthy", "latest run in progress"),
    )


def latest_success(success: Column, now: int, max_age: Column) -> tuple[Column, Column]:
    """A job that never succeeded is unknown, not failed."""
    return rules(
        (success.isNull(), "unknown", "no observation"),
        (stale(success, now, max_age), "unknown", "observation is stale"),
        otherwise=("healthy", "a successful run is on record"),
    )


def expected_run(
    schedule: Column, declared_running: Column, due: Column, last_started: Column, now: int, grace: int,
    read: Column | None = None, max_age: int | None = None,
) -> tuple[Column, Column]:
    """A due run that never started is critical by itself: a scheduler that is down reports nothing.

    `read` is when the schedule was read; what was read `max_age` ago or earlier says nothing any more.
    """
    old = F.lit(False) if read is None or max_age is None else stale(read, now, F.lit(max_age))
    return rules(
        (schedule.isNull(), "unknown", "no observation"),
        (old, "unknown", "observation is stale"),
        (
            (schedule == "stopped") & declared_running,
            "warning",
            "schedule is stopped but its cadence declares it running",
        ),
        (schedule == "stopped", "disabled", "schedule is stopped"),
        (schedule != "running", "disabled", "schedule is absent"),
        (due.isNull(), "healthy", "no run is due yet"),
        (last_started >= due, "healthy", "the expected run started"),
        (F.lit(now) < due + grace, "healthy", "the expected run is within its grace period"),
        otherwise=("critical", "an expected run did not start"),
    )


def freshness(
    schedule: Column, owed: Column, not_yet_due: Column, success: Column, now: int, grace: int, unreadable: Column | None = None
) -> tuple[Column, Column]:
    """Whether the job kept its cadence: a success since the owed due time, or that time still inside its grace.

    A job without a running schedule has no cadence to keep. A missing success is unknown: the runs read are a window, so
    never and long ago look alike. `unreadable` marks a cadence that nobody could read.
    """
    return rules(
        (schedule == "stopped", "disabled", "schedule is stopped"),
        (schedule.isNull() | (schedule != "running"), "disabled", "schedule is absent"),
        (F.lit(False) if unreadable is None else unreadable, "unknown", "the cadence could not be read"),
        (not_yet_due, "healthy", NOT_YET_DUE),
        (owed.isNull(), "unknown", "nothing shows the schedule was on at its latest due time"),
        (success.isNull(), "unknown", "no successful run on record"),
        (success >= owed, "healthy", "a run succeeded since the previous due time"),
        (F.lit(now) < owed + grace, "healthy", "the previous due run is within its grace period"),
        otherwise=("critical", "no run succeeded since the previous due time plus its grace"),
    )


def freshness_age(
    success: Column, now: int, warn_after: int | None, critical_after: int | None
) -> tuple[Column, Column]:
    """The age of the last success against declared bounds, whatever the schedule's state."""
    if warn_after is None and critical_after is None:
        raise ValueError("give at least one bound of the age")
    age = F.lit(now) - success
    cases = [(success.isNull(), "unknown", "no successful run on record")]
    if critical_after is not None:
        cases.append((age >= critical_after, "critical", "the last success is older than its critical bound"))
    if warn_after is not None:
        cases.append((age >= warn_after, "warning", "the last success is older than its warning bound"))
    return rules(*cases, otherwise=("healthy", "the last success is within its bounds"))


def job_evidence(runs: DataFrame, schedules: DataFrame, now: int, grace: int) -> DataFrame:
    """Schedules beside the runs they asked for, with the due times the rules speak about.

    `due` is the latest due time, `owed` the latest whose grace has elapsed. A due time before the schedule was started
    was never owed. A run stays evidence until the due time after the owed one plus the grace, or seven days without a
    running schedule.
    """
    running = F.col("schedule_state") == "running"
    due = latest_due(F.col("anchor_us"), F.col("interval_us"), F.lit(now).cast("bigint"))
    owed = latest_due(F.col("anchor_us"), F.col("interval_us"), F.lit(now - grace).cast("bigint"))
    since_start = F.col("started_us").isNull()
    joined = schedules.join(latest_runs(runs), ["stage", "job_name"], "full")
    return joined.select(
        "*",
        F.when(running & (since_start | (due >= F.col("started_us"))), due).alias("due"),
        F.when(running & (since_start | (owed >= F.col("started_us"))), owed).alias("owed"),
        F.coalesce(running & (owed.isNull() | (owed < F.col("started_us"))), F.lit(False)).alias("not_yet_due"),
        F.when(running & owed.isNotNull(), F.col("interval_us") + grace).otherwise(F.lit(RUN_MAX_AGE)).alias("max_age"),
    )


def job_signals(
    runs: DataFrame,
    schedules: DataFrame,
    now: int,
    grace: int,
    warn_after: int | None = None,
    critical_after: int | None = None,
    schedule_max_age: int | None = None,
) -> DataFrame:
    """Every health signal of every job: stage, job, kind, state, reason, run.

    Schedules may say in `read_us` when they were read; with `schedule_max_age`, older readings are stale. A running schedule without an
    interval is one whose cadence could not be read.
    """
    seen = job_evidence(runs, schedules, now, grace)
    c = F.col
    signals = {
        "execution": (execution(c("status"), c("observed_us"), now, c("max_age")), c("run_id")),
        "latest_success": (latest_success(c("success_us"), now, c("max_age")), c("success_run_id")),
        "expected_run": (
            expected_run(
                c("schedule_state"), c("declared_running"), c("due"), c("last_created_us"), now, grace,
                c("read_us") if "read_us" in schedules.columns else None, schedule_max_age,
            ),
            F.lit(None).cast("bigint"),
        ),
        "freshness": (
            freshness(
                c("schedule_state"), c("owed"), c("not_yet_due"), c("success_us"), now, grace,
                (c("schedule_state") == "running") & c("interval_us").isNull(),
            ),
            c("success_run_id"),
        ),
    }
    if warn_after is not None or critical_after is not None:
        signals["freshness_age"] = (
            freshness_age(c("success_us"), now, warn_after, critical_after),
            c("success_run_id"),
        )
    listed = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), state.alias("state"), reason.alias("reason"), run.alias("run"))
            for kind, ((state, reason), run) in signals.items()
        ]
    )
    return seen.select("stage", "job_name", F.inline(listed))


def rollup_by_stage(*signals: DataFrame) -> DataFrame:
    """The worst state of each stage. Stages never meet, so one cannot colour another."""
    every = reduce(DataFrame.unionByName, [s.select("stage", "state") for s in signals])
    return every.groupBy("stage").agg(worst_state(F.col("state")).alias("state"))
