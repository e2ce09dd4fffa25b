"""Series, health and incidents against small tables and against step-by-step evaluations."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from millpond.plans import health, incidents, quality, semantic, series
from millpond.streaming import incidents as live

MINUTE = series.MINUTE


def test_step_edges(spark):
    """A run created on a boundary belongs to the step that ends there."""
    grid = series.Grid(4 * MINUTE, 4 * MINUTE, MINUTE)
    runs = spark.createDataFrame(
        [("dev", "a", 1, "SUCCESS", t, 1.0) for t in (0, 1, MINUTE, MINUTE + 1, 4 * MINUTE, 4 * MINUTE + 1)]
        + [("dev", "__own", 9, "SUCCESS", 5, 1.0)],
        "stage string, job_name string, run_id int, status string, created_us bigint, duration_s double",
    )
    found = {
        r["t"] // MINUTE: r["value"]
        for r in series.run_counts(runs, grid).where("status = 'succeeded'").collect()
    }
    assert found == {1: 2, 2: 1, 3: 0, 4: 1}
    durations = {r["t"] // MINUTE: r["value"] for r in series.run_durations(runs, grid).collect()}
    assert durations == {1: 1.0, 2: 1.0, 3: None, 4: 1.0}


def test_grid_bounds():
    for bad in ((0, 0, MINUTE), (0, 8 * series.DAY, MINUTE), (0, MINUTE, 7), (0, MINUTE, 0)):
        with pytest.raises(ValueError):
            series.Grid(*bad)
    assert series.Grid.of("24h", 10 * MINUTE + 5).end == 10 * MINUTE
    assert all(duration // step <= 360 for duration, step in series.RANGES.values())


def _prom_increase(points, start, end):
    """A counter's increase over (start, end] by Prometheus's definition, step by step."""
    gained, last = 0.0, points[0][1]
    for _, v in points[1:]:
        gained += v if v < last else v - last
        last = v
    (first_t, first_v), (last_t, _) = points[0], points[-1]
    sampled, to_start, to_end = (last_t - first_t) / 1e6, (first_t - start) / 1e6, (end - last_t) / 1e6
    average = sampled / (len(points) - 1)
    if to_start >= average * 1.1:
        to_start = average / 2
    if gained > 0 and first_v >= 0:
        to_start = min(to_start, sampled * first_v / gained)
    if to_end >= average * 1.1:
        to_end = average / 2
    return gained * (sampled + to_start + to_end) / sampled


def test_increase_does_not_reach_across_steps(spark):
    """Two samples a step, a minute apart: what happens between two steps belongs to neither."""
    data = [("a", 4 * MINUTE, 10), ("a", 5 * MINUTE, 20), ("a", 9 * MINUTE, 60), ("a", 10 * MINUTE, 70), ("b", 3 * MINUTE, 7)]
    df = spark.createDataFrame(data, "series string, ts_us bigint, counter bigint")
    got = {(r["series"], r["t"] // MINUTE): r["value"] for r in series.increase(df, series.Grid(10 * MINUTE, 10 * MINUTE, 5 * MINUTE), ["series"]).collect()}
    assert got == {("a", 5): 15.0, ("a", 10): 15.0}


@pytest.mark.parametrize("seed", range(2))
def test_increase_and_increments_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    grid = series.Grid(30 * MINUTE, 30 * MINUTE, 5 * MINUTE)
    samples = sorted({(s, rng.randrange(1, 30 * MINUTE)) for s in "ab" for _ in range(60)})
    data = [(s, t, rng.randrange(50)) for s, t in samples]
    df = spark.createDataFrame(data, "series string, ts_us bigint, counter bigint")
    steps: dict = {}
    for s, t, v in data:
        steps.setdefault((s, -(-t // (5 * MINUTE)) * 5 * MINUTE), []).append((t, v))
    expected = {key: _prom_increase(points, key[1] - 5 * MINUTE, key[1]) for key, points in steps.items() if len(points) > 1}
    got = {(r["series"], r["t"]): r["value"] for r in series.increase(df, grid, ["series"]).collect()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)
    minutes: dict = {}
    for s, t, v in data:
        minutes.setdefault((s, -(-t // MINUTE)), []).append(v)
    walked = {
        (s, m): max(max(vs) - minutes[s, m - 1][-1], 0) if (s, m - 1) in minutes else 0
        for (s, m), vs in minutes.items()
    }
    got = {(r["series"], r["t"] // MINUTE): r["value"] for r in series.increments(df, ["series"]).collect()}
    assert got == walked


def test_new_pod_counts_its_first_restarts(spark):
    df = spark.createDataFrame(
        [("new", 10 * MINUTE, 3, 9 * MINUTE), ("seen", 10 * MINUTE, 3, MINUTE)],
        "series string, ts_us bigint, counter bigint, born bigint",
    )
    got = {r["series"]: r["value"] for r in series.increments(df, ["series"], created="born").collect()}
    assert got == {"new": 3, "seen": 0}


def test_rate_of_a_steady_counter(spark):
    """One per second sampled every 15 s: the window's edges are filled up to them."""
    df = spark.createDataFrame(
        [("a", t * series.SECOND, t) for t in range(15, 601, 15)], "series string, ts_us bigint, counter bigint"
    )
    steady = [r["value"] for r in series.rate(df, ["series"]).where(f"t between {3 * MINUTE} and {10 * MINUTE}").collect()]
    assert len(steady) == 8 and all(abs(v - 1.0) < 1e-9 for v in steady)


NOW = 100 * MINUTE


@pytest.mark.parametrize(
    "status, seen, state",
    [("succeeded", 99, "healthy"), ("running", 99, "healthy"), ("failed", 99, "critical"), ("canceled", 99, "warning"),
     (None, None, "unknown"), ("failed", 90, "unknown"), ("failed", 91, "critical")],
)
def test_execution(spark, status, seen, state):
    row = spark.createDataFrame([(status, None if seen is None else seen * MINUTE)], "s string, o bigint")
    found, _ = health.execution(F.col("s"), F.col("o"), NOW, F.lit(10 * MINUTE))
    assert row.select(found).first()[0] == state


@pytest.mark.parametrize(
    "schedule, declared, due, last, state",
    [("running", True, 95, 96, "healthy"), ("running", True, 95, 94, "healthy"), ("running", True, 90, 89, "critical"),
     ("running", True, 90, None, "critical"), ("running", True, None, None, "healthy"),
     ("stopped", True, None, None, "warning"), ("stopped", False, None, None, "disabled"),
     ("absent", True, None, None, "disabled"), (None, None, None, None, "unknown")],
)
def test_expected_run(spark, schedule, declared, due, last, state):
    row = spark.createDataFrame([(schedule, declared, due, last)], "s string, d boolean, due bigint, l bigint")
    found, _ = health.expected_run(
        F.col("s"), F.col("d"), F.col("due") * MINUTE, F.col("l") * MINUTE, NOW, 10 * MINUTE
    )
    assert row.select(found).first()[0] == state


def test_stale_schedules_and_unreadable_cadences(spark):
    schedules = spark.createDataFrame(
        [("s", "old", 5 * MINUTE, 10 * MINUTE, "running", True, 50 * MINUTE), ("s", "new", 5 * MINUTE, 10 * MINUTE, "running", True, 99 * MINUTE),
         ("s", "unread", 0, None, "running", True, 99 * MINUTE), ("s", "off", 0, 10 * MINUTE, "stopped", False, 99 * MINUTE),
         ("s", "gone", 0, 10 * MINUTE, "absent", False, 99 * MINUTE)],
        "stage string, job_name string, anchor_us bigint, interval_us bigint, schedule_state string, declared_running boolean, read_us bigint",
    ).withColumn("started_us", F.lit(None).cast("bigint"))
    runs = spark.createDataFrame([], "stage string, job_name string, run_id bigint, created_us bigint, status string, duration_s double")
    found = health.job_signals(runs, schedules, NOW, MINUTE, schedule_max_age=30 * MINUTE)
    got = {(r["job_name"], r["kind"]): (r["state"], r["reason"]) for r in found.collect()}
    assert got["old", "expected_run"] == ("unknown", "observation is stale") and got["new", "expected_run"][0] == "critical"
    assert got["unread", "freshness"] == ("unknown", "the cadence could not be read")
    assert got["off", "freshness"] == ("disabled", "schedule is stopped") and got["gone", "freshness"] == ("disabled", "schedule is absent")


def test_freshness_age_bounds(spark):
    rows = spark.createDataFrame([(m * MINUTE,) for m in (95, 90, 80)], "o bigint")
    state, _ = health.freshness_age(F.col("o"), NOW, 10 * MINUTE, 20 * MINUTE)
    assert [r[0] for r in rows.select(state).collect()] == ["healthy", "warning", "critical"]
    with pytest.raises(ValueError):
        health.freshness_age(F.col("o"), NOW, None, None)


def test_worst_state_of_nothing_is_unknown(spark):
    empty = spark.createDataFrame([], "state string")
    assert empty.agg(quality.worst_state(F.col("state"))).first()[0] == "unknown"


OBSERVED = (
    "fingerprint string, eval bigint, stage string, domain string, product string, table_name string, kind string, "
    "component string, health string, severity string, reason string, grace_due bigint, run_id string"
)
KINDS = ("run_failed", "missed_run", "stale_output", "schedule_mismatch", "quality", "stage_unreadable")


def _random_observations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for number in range(120):
        for product in ("p", "q"):
            for kind in KINDS:
                if rng.random() < 0.35:
                    continue
                word = rng.choice(["critical", "warning", "healthy", "unknown", "disabled"])
                severity = word if word in ("critical", "warning") else None
                if kind == "stage_unreadable":
                    word = rng.choice(["unknown", "unknown", "unknown", "healthy"])
                    severity = "critical" if word == "unknown" else None
                due = number - rng.randrange(0, 25) if kind == "missed_run" and word == "unknown" else None
                rows.append(
                    (f"{product}-{kind}", number, "dev", "sales", product, None, kind, None, word, severity, f"{kind} {word}", due,
                     rng.choice([None, f"r{rng.randrange(40)}"]))
                )
    return rows


CLOSURES = "eval bigint, stage string, domain string, product string, kind string"


@pytest.mark.parametrize("closed", [False, True])
def test_live_transitions_equal_the_timeline(spark, folder, closed):
    """Landings of evaluations, one of them written twice, give the transitions of one evaluation over everything."""
    rows = _random_observations(3)
    gone = [(30, "dev", "sales", "p", None), (61, "dev", "sales", "q", "quality"), (95, "dev", "sales", "p", "run_failed")]
    closures = spark.createDataFrame(gone, CLOSURES) if closed else None
    observed = spark.createDataFrame(rows, OBSERVED)
    write = live.transitions_into(folder, observed, closures)
    for number, (low, high) in enumerate([(0, 40), (40, 41), (41, 41), (41, 120)]):
        for _ in range(1 + (number == 1)):
            write(observed.where(f"eval >= {low} and eval < {high}"), number)
    whole = incidents.evaluate(incidents.count_unreadable(observed.coalesce(4)), closures, keep=lambda df: df.cache())
    expected = incidents.timeline(whole).select(*live.EVENTS).collect()
    got = live.transitions(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str) and len(got) > 50


@pytest.mark.parametrize("split", ["product = 'p'", "crc32(fingerprint) % 2 = 0", "eval >= 20"])
def test_live_transitions_of_a_split_landing(spark, folder, split):
    """One landing reaches the stream in two files: by scope, within scopes, or with its older half last."""
    observed = spark.createDataFrame([r for r in _random_observations(5) if r[1] < 40], OBSERVED)
    closures = spark.createDataFrame([(15, "dev", "sales", "p", None), (31, "dev", "sales", "q", "quality")], CLOSURES)
    write = live.transitions_into(folder, observed, closures)
    for number, condition in enumerate([split, f"not ({split})"]):
        write(observed.where(condition), number)
    whole = incidents.evaluate(incidents.count_unreadable(observed.coalesce(4)), closures, keep=lambda df: df.cache())
    expected = incidents.timeline(whole).select(*live.EVENTS).collect()
    got = live.transitions(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str) and len(got) > 20


def test_last_run_ids_are_bounded(spark):
    rows = [
        ("f", n, "dev", "d", "p", None, "run_failed", None, "critical", "critical", "x", None, f"r{n}") for n in range(30)
    ]
    observed = incidents.count_unreadable(spark.createDataFrame(rows, OBSERVED))
    found = incidents.run_ids(incidents.evaluate(observed)).first()
    assert found["run_ids"] == [f"r{n}" for n in range(10, 30)]


def test_a_retired_scope_closes_silently(spark):
    rows = [
        ("f", n, "dev", "d", "p", None, "run_failed", None, "critical", "critical", "x", None, None) for n in range(4)
    ]
    gone = spark.createDataFrame([(2, "dev", "d", "p", None)], "eval bigint, stage string, domain string, product string, kind string")
    observed = incidents.count_unreadable(spark.createDataFrame(rows, OBSERVED))
    events = incidents.timeline(incidents.evaluate(observed, gone)).orderBy("eval").collect()
    assert [(r["eval"], r["event"]) for r in events] == [(0, "opened"), (2, "resolved_silently"), (3, "opened")]


def test_semantic_model_refuses_what_it_does_not_hold(spark):
    fact = spark.createDataFrame(
        [(1, "fulfilled", 10.0), (2, "pending", 5.0), (1, "fulfilled", 1.0)],
        "account_id int, order_status string, net_amount double",
    )
    accounts = spark.createDataFrame([(1, "x"), (2, "y")], "account_id int, segment string")
    tables = {"fct_order_lines": fact, "dim_account": accounts}
    found = semantic.SALES.metric_by(tables, ["net_revenue"], ["dim_account.segment"])
    assert {r["segment"]: r["net_revenue"] for r in found.collect()} == {"x": 11.0, "y": None}
    with pytest.raises(semantic.ModelError):
        semantic.SALES.metric_by(tables, ["profit"])
    with pytest.raises(semantic.ModelError):
        semantic.SALES.metric_by(tables, ["net_revenue"], ["dim_account.colour"])
    with pytest.raises(semantic.ModelError):
        semantic.SALES.metric_by(tables, ["net_revenue"], ["dim_account.segment@month"])
    tables["dim_account"] = accounts.union(accounts)
    with pytest.raises(semantic.ModelError):
        semantic.SALES.metric_by(tables, ["net_revenue"], ["dim_account.segment"])


def test_metrics_are_folded_before_they_are_joined(spark):
    """The fact is summed to the asked keys below the join, and a dimension brings only its asked fields."""
    fact = spark.range(1000).selectExpr("id % 10 as account_id", "'fulfilled' as order_status", "1.0D as net_amount", "date'2024-01-31' + int(id % 60) as order_date")
    accounts = spark.range(10).selectExpr("id as account_id", "id % 3 as segment", "'x' as account_name")
    found = semantic.SALES.metric_by({"fct_order_lines": fact, "dim_account": accounts}, ["net_revenue"], ["dim_account.segment", "fct_order_lines.order_date@month"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join") < plan.rindex("Aggregate") and "account_name" not in plan
    assert sum(r["net_revenue"] for r in found.collect()) == 1000.0 and found.columns == ["segment", "order_date", "net_revenue"]
