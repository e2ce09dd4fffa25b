"""Run and metric series: one value per step of a bounded grid.

Times are epoch microseconds. A step is left-open and right-closed and is named by its end. Zero or null filling is one
aggregate: the grid and the samples are added together, so a point without samples keeps the grid's value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import exact
from .marts import latest

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
MAX_RANGE = 7 * DAY
RUN_CAP = 500
RUN_WINDOW = 25
# How a run status reads, and the ranges a chart may ask for (length, step).
RUN_STATUS = {"SUCCESS": "succeeded", "FAILURE": "failed", "CANCELED": "canceled", "CANCELING": "canceled"}
STATUSES = ("succeeded", "failed", "canceled", "running")
RANGES = {"1h": (HOUR, MINUTE), "6h": (6 * HOUR, MINUTE), "24h": (DAY, 5 * MINUTE), "7d": (7 * DAY, 30 * MINUTE)}


@dataclass(frozen=True)
class Grid:
    """The steps of (end - duration, end]."""

    end: int
    duration: int
    step: int

    def __post_init__(self) -> None:
        if not 0 < self.duration <= MAX_RANGE:
            raise ValueError("a series covers more than nothing and at most seven days")
        if self.step <= 0 or self.duration % self.step:
            raise ValueError("the step must divide the range")

    @classmethod
    def of(cls, name: str, now: int) -> Grid:
        """A named range that ends at the last step boundary at or before `now`."""
        duration, step = RANGES[name]
        return cls(now // step * step, duration, step)

    @property
    def start(self) -> int:
        return self.end - self.duration

    def holds(self, ts: Column) -> Column:
        return (ts > self.start) & (ts <= self.end)

    def point(self, ts: Column) -> Column:
        """The end of the step a time falls in."""
        return step_end(ts, self.step, self.start)

    def points(self) -> Column:
        first = F.lit(self.start + self.step).cast("bigint")
        return F.explode(F.sequence(first, F.lit(self.end).cast("bigint"), F.lit(self.step).cast("bigint")))


def step_end(ts: Column, step: int, start: int = 0) -> Column:
    """ceil((ts - start) / step) steps after the start, in whole numbers."""
    offset = ts.cast("bigint") - F.lit(start).cast("bigint")
    return F.lit(start).cast("bigint") + offset + F.pmod(-offset, F.lit(step).cast("bigint"))


def run_status(status: Column) -> Column:
    mapped = None
    for word, meaning in RUN_STATUS.items():
        mapped = F.when(status == word, meaning) if mapped is None else mapped.when(status == word, meaning)
    return mapped.otherwise("running")


def job_set(runs: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Declared jobs and jobs seen, without the engine's own (`__`)."""
    seen = runs.select("stage", "job_name")
    both = seen if declared is None else seen.unionByName(declared.select("stage", "job_name"))
    return both.where(~F.col("job_name").startswith("__")).distinct()


def newest_runs(runs: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The newest runs of each key. Each task keeps at most `n` of a key before the shuffle."""
    by_key = Window.partitionBy(*keys).orderBy(F.desc("created_us"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(by_key)).where(F.col("_n") <= n).drop("_n")


def coverage(runs: DataFrame, cap: int = RUN_CAP) -> DataFrame:
    """Per stage: whether a read of at most `cap` runs held all, and from when it is complete if it did not."""
    read = runs.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("created_us").alias("oldest"))
    full = F.col("n") < cap
    return read.select("stage", full.alias("complete"), F.when(~full, F.col("oldest")).alias("covered_from"))


def run_counts(runs: DataFrame, grid: Grid, declared: DataFrame | None = None) -> DataFrame:
    """Runs created in each step by job and status; zero where there was none. Unfinished runs count as running."""
    inside = runs.where(grid.holds(F.col("created_us")))
    counted = inside.where(~F.col("job_name").startswith("__")).select(
        "stage", "job_name", run_status(F.col("status")).alias("status"), grid.point(F.col("created_us")).alias("t"),
        F.lit(1).cast("bigint").alias("n"),
    )
    zeros = (
        job_set(inside, declared)
        .withColumn("status", F.explode(F.array(*[F.lit(s) for s in STATUSES])))
        .select("stage", "job_name", "status", grid.points().alias("t"), F.lit(0).cast("bigint").alias("n"))
    )
    return zeros.unionByName(counted).groupBy("stage", "job_name", "status", "t").agg(F.sum("n").alias("value"))


def run_durations(runs: DataFrame, grid: Grid, declared: DataFrame | None = None) -> DataFrame:
    """The longest finished run of each job and step; null where none finished."""
    inside = runs.where(grid.holds(F.col("created_us")))
    finished = inside.where(F.col("duration_s").isNotNull() & ~F.col("job_name").startswith("__")).select(
        "stage", "job_name", grid.point(F.col("created_us")).alias("t"), "duration_s"
    )
    empty = job_set(inside, declared).select(
        "stage", "job_name", grid.points().alias("t"), F.lit(None).cast("double").alias("duration_s")
    )
    return empty.unionByName(finished).groupBy("stage", "job_name", "t").agg(F.max("duration_s").alias("value"))


def capped_counts(runs: DataFrame, grid: Grid, cap: int = RUN_CAP) -> DataFrame:
    """Counts from the newest `cap` runs of a stage. A step that starts before the oldest run read is null, as runs of it
    may be missing, and the stage says it is not complete."""
    read = newest_runs(runs.where(F.col("created_us") > grid.start), ["stage"], cap)
    bound = coverage(read, cap)
    whole = F.col("covered_from").isNull() | (F.col("t") - grid.step >= F.col("covered_from"))
    # One coverage row per stage, joined to the grid's points.
    return run_counts(read, grid).join(bound, "stage").select(
        "stage", "job_name", "status", "t", F.when(whole, F.col("value")).alias("value"), "complete"
    )


def failed_runs(
    runs: DataFrame, since: int, window: int = RUN_WINDOW, cap: int = RUN_CAP, *, stage_readable: bool = True
) -> DataFrame:
    """Failed runs per job since a time, from the job's newest runs and, where these stop short, the stage's.

    `failed` is null when neither read reaches back far enough to say; `covered_from` is set when only a part could be
    counted.
    """
    own = newest_runs(runs, ["stage", "job_name"], window)
    reach = own.groupBy("stage", "job_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_us").alias("own_oldest")
    ).withColumn("reaches", (F.col("n") < window) | (F.col("own_oldest") <= since))
    staged = newest_runs(runs.where(F.col("created_us") > since), ["stage"], cap)
    stage_bound = staged.groupBy("stage").agg(
        F.count(F.lit(1)).alias("stage_n"), F.min("created_us").alias("stage_oldest")
    )
    columns = ["stage", "job_name", "run_id", "status", "created_us"]
    failed = (
        own.select(*columns, F.lit(0).alias("wide"))
        .unionByName(staged.select(*columns, F.lit(1).alias("wide")))
        .where((F.col("status") == "FAILURE") & (F.col("created_us") > since))
        .groupBy("stage", "job_name", "run_id")
        .agg(F.min("wide").alias("wide"))
        .groupBy("stage", "job_name")
        .agg(F.count_if(F.col("wide") == 0).alias("own_failed"), F.count(F.lit(1)).alias("all_failed"))
    )
    oldest = F.least("own_oldest", "stage_oldest")
    cut = ~F.col("reaches") & (F.coalesce("stage_n", F.lit(0)) >= cap)
    count = F.when(F.col("reaches"), F.coalesce("own_failed", F.lit(0))).when(
        F.lit(stage_readable), F.coalesce("all_failed", F.lit(0))
    )
    return (
        reach.join(failed, ["stage", "job_name"], "left")
        .join(stage_bound, "stage", "left")
        .select(
            "stage",
            "job_name",
            count.cast("bigint").alias("failed"),
            F.when(F.lit(stage_readable) & cut & (oldest > since), oldest).alias("covered_from"),
        )
    )


def due_times(schedules: DataFrame, until: int) -> DataFrame:
    """Every due time of each schedule from its anchor up to `until`."""
    return schedules.withColumn(
        "due", F.explode(F.sequence(F.col("anchor_us"), F.lit(until).cast("bigint"), F.col("interval_us")))
    )


def latest_due(anchor: Column, interval: Column, at: Column) -> Column:
    """The latest due time at or before a time; null before the first."""
    return F.when(at >= anchor, at - F.pmod(at - anchor, interval))


# Metric samples: series, labels, ts_us, value.


def gauge(samples: DataFrame, grid: Grid, keys: Sequence[str], value: str = "gauge") -> DataFrame:
    """The last value of each step; null where a step has no sample. Two samples of one time: the larger."""
    inside = samples.where(grid.holds(F.col("ts_us")))
    last = inside.groupBy(*keys, grid.point(F.col("ts_us")).alias("t")).agg(
        F.max(F.struct("ts_us", F.col(value).alias("v")))["v"].alias("value")
    )
    return on_grid(last, grid, keys)


def on_grid(points: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """Points aligned to the grid, absent ones null."""
    empty = points.select(*keys).distinct().select(
        *keys, grid.points().alias("t"), F.lit(None).cast(points.schema["value"].dataType).alias("value")
    )
    return empty.unionByName(points.select(*keys, "t", "value")).groupBy(*keys, "t").agg(F.max("value").alias("value"))


def sum_over_time(samples: DataFrame, grid: Grid, keys: Sequence[str], value: str = "gauge") -> DataFrame:
    inside = samples.where(grid.holds(F.col("ts_us")))
    return inside.groupBy(*keys, grid.point(F.col("ts_us")).alias("t")).agg(F.sum(value).alias("value"))


def increase(samples: DataFrame, grid: Grid, keys: Sequence[str], value: str = "counter") -> DataFrame:
    """A counter's increase over each step of the grid, as PromQL's `increase` over a range of one step defines it: from the samples
    inside the step alone, restarts added back, stretched towards the step's edges. A step with fewer than two has no point."""
    inside = samples.where(grid.holds(F.col("ts_us")))
    times = inside.groupBy(*keys, "ts_us").agg(F.max(value).alias("v")).withColumn("t", grid.point(F.col("ts_us")))
    return _stretched(times, keys, grid.step)


def increments(
    samples: DataFrame, keys: Sequence[str], step: int = MINUTE, value: str = "counter", created: str | None = None,
    new_within: int = 2 * MINUTE,
) -> DataFrame:
    """A counter's increment per step: its highest value in the step less its last value in the step before, never
    negative. A series not seen the step before counts 0, or all of its value while its owner is new.

    A sample speaks for its own step and, as the value before, for the next one, so one aggregate per (series, step)
    pairs them: no join, and no window over a series.
    """
    t = step_end(F.col("ts_us"), step)
    roles = F.explode(F.array(F.struct(t.alias("t"), F.lit(0).alias("ago")), F.struct((t + step).alias("t"), F.lit(1).alias("ago"))))
    born = F.col(created) if created else F.lit(None).cast("bigint")
    spread = samples.select(*keys, "ts_us", F.col(value).alias("v"), born.alias("born"), roles.alias("role"))
    now, before = F.col("role.ago") == 0, F.col("role.ago") == 1
    paired = spread.groupBy(*keys, F.col("role.t").alias("t")).agg(
        F.max(F.when(now, F.col("v"))).alias("high"),
        F.max(F.when(before, F.struct("ts_us", "v")))["v"].alias("last"),
        F.max(F.when(now, F.col("born"))).alias("born"),
    )
    new = F.coalesce(F.col("t") - F.col("born") < new_within, F.lit(False))
    gain = (
        F.when(F.col("last").isNotNull(), F.greatest(F.col("high") - F.col("last"), F.lit(0)))
        .when(new, F.col("high"))
        .otherwise(F.lit(0))
    )
    return paired.where("high is not null").select(*keys, "t", gain.cast("bigint").alias("value"))


def rate(
    samples: DataFrame, keys: Sequence[str], step: int = MINUTE, span: int = 2, value: str = "counter"
) -> DataFrame:
    """A counter's rate per second over the last `span` steps, evaluated at each step, as PromQL's `rate` defines it:
    restarts are added back, and the sampled interval is stretched towards the window's edges, by half a sample
    interval at most where an edge is far and never below zero.

    A sample is sent to the `span` windows it lies in, and a window holds the distinct times of its own steps only.
    """
    t = step_end(F.col("ts_us"), step)
    windows = F.explode(F.transform(F.sequence(F.lit(0), F.lit(span - 1)), lambda i: t + i.cast("bigint") * step))
    times = samples.groupBy(*keys, "ts_us").agg(F.max(value).alias("v")).withColumn("t", windows)
    gain = _stretched(times, keys, span * step)
    return gain.withColumn("value", F.col("value") / F.lit(span * step / 1e6))


def _stretched(times: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The increase over each window (t - width, t] of samples `ts_us`, `v`, extrapolated to its edges; windows of one sample have none.
    A window of the plan holds the distinct times of one such window."""
    by_window = Window.partitionBy(*keys, "t").orderBy("ts_us")
    fallen = F.when(F.col("v") < F.lag("v").over(by_window), F.lag("v").over(by_window)).otherwise(F.lit(0))
    folded = (
        times.withColumn("fallen", fallen)
        .groupBy(*keys, "t")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.min_by("v", "ts_us").alias("first"),
            F.max_by("v", "ts_us").alias("last"),
            F.sum("fallen").alias("restarts"),
        )
        .where("n >= 2")
    )
    seconds = 1e6
    gain = (F.col("last") - F.col("first") + F.col("restarts")).cast("double")
    sampled = (F.col("last_us") - F.col("first_us")) / F.lit(seconds)
    apart = sampled / (F.col("n") - 1)
    head = (F.col("first_us") - (F.col("t") - width)) / F.lit(seconds)
    tail = (F.col("t") - F.col("last_us")) / F.lit(seconds)
    head = F.when(head >= apart * 1.1, apart / 2).otherwise(head)
    # A counter is not taken back below zero. Without a gain there is nothing to stretch.
    zero = F.when(gain > 0, sampled * (F.col("first") / gain))
    head = F.when((gain > 0) & (F.col("first") >= 0) & (zero < head), zero).otherwise(head)
    tail = F.when(tail >= apart * 1.1, apart / 2).otherwise(tail)
    return folded.select(*keys, "t", (gain * ((sampled + head + tail) / sampled)).alias("value"))


def sum_by(points: DataFrame, labels: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Series reduced to labels. A series without a stage is left out. Sums are exact, so the same in any order."""
    rows = points if labels is None else points.join(labels, "series")
    if "stage" in by:
        rows = rows.where(F.col("stage").isNotNull())
    return exact.sums(rows, [*by, "t"], ["value"])


def newest_labels(labels: DataFrame, keys: Sequence[str], at: int, within: int = 2 * MINUTE) -> DataFrame:
    """One label set per owner: of those seen in the last two minutes the newest, ties broken by name."""
    recent = labels.where((F.col("ts_us") > at - within) & (F.col("ts_us") <= at))
    named = recent.withColumn("component", F.coalesce(F.nullif("component", F.lit("")), F.lit("unlabelled")))
    return latest(named, keys, [F.desc("ts_us"), F.asc("component")])


def available(points: DataFrame, up: DataFrame, grid: Grid, keys: Sequence[str]) -> DataFrame:
    """Lines whose target was up at least once in the range. A target down throughout gives no line, not zeros."""
    alive = up.where(grid.holds(F.col("ts_us"))).groupBy(*keys).agg(F.max("up").alias("up")).where("up > 0")
    return points.join(alive.select(*keys), list(keys), "left_semi")
