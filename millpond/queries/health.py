"""Health signals of jobs at a fixed time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import health
from ..plans.series import DAY, HOUR, MINUTE
from ..registry import register
from ..shapes import ctes, view

NOW = 1706659200000000 + 30 * MINUTE  # 2024-01-31 00:30 UTC
GRACE = 45 * MINUTE

EVIDENCE = {
    "seen": f"""select stage, job_name, run_id, created_us, case status when 'SUCCESS' then 'succeeded'
    when 'FAILURE' then 'failed' when 'CANCELED' then 'canceled' else 'running' end as status,
    created_us + cast(round(coalesce(duration_s, 0) * 1000000) as bigint) as observed_us from runs_v""",
    "last_run": """select * from (select *, row_number() over (partition by stage, job_name order by created_us desc,
    run_id desc) as n from seen) where n = 1""",
    "last_ok": """select * from (select *, row_number() over (partition by stage, job_name order by created_us desc,
    run_id desc) as n from seen where status = 'succeeded') where n = 1""",
    "evidence": f"""select s.*, r.run_id, r.status, r.observed_us, r.created_us as last_created_us,
    o.run_id as success_run_id, o.observed_us as success_us, schedule_state = 'running' as running,
    case when schedule_state = 'running' then {NOW} - ({NOW} - anchor_us) % interval_us end as due,
    case when schedule_state = 'running' then {NOW - GRACE} - ({NOW - GRACE} - anchor_us) % interval_us end as owed,
    case when schedule_state = 'running' then interval_us + {GRACE} else {7 * DAY} end as max_age
    from schedules_v s left join last_run r using (stage, job_name) left join last_ok o using (stage, job_name)""",
}
SIGNALS = {
    "execution": (
        f"""case when status is null then 'unknown' when {NOW} >= observed_us + max_age then 'unknown'
        when status = 'failed' then 'critical' when status = 'canceled' then 'warning' else 'healthy' end""",
        "run_id",
    ),
    "latest_success": (
        f"case when success_us is null or {NOW} >= success_us + max_age then 'unknown' else 'healthy' end",
        "success_run_id",
    ),
    "expected_run": (
        f"""case when schedule_state = 'stopped' and declared_running then 'warning' when not running then 'disabled'
        when last_created_us >= due or {NOW} < due + {GRACE} then 'healthy' else 'critical' end""",
        "null::bigint",
    ),
    "freshness": (
        f"""case when not running then 'disabled' when success_us is null then 'unknown' when success_us >= owed
        or {NOW} < owed + {GRACE} then 'healthy' else 'critical' end""",
        "success_run_id",
    ),
    "freshness_age": (
        f"""case when success_us is null then 'unknown' when {NOW} - success_us >= {3 * HOUR} then 'critical'
        when {NOW} - success_us >= {HOUR} then 'warning' else 'healthy' end""",
        "success_run_id",
    ),
}
REASONS = {
    "execution": f"""case when status is null then 'no observation' when {NOW} >= observed_us + max_age then 'observation is stale'
    when status = 'succeeded' then 'latest run succeeded' when status = 'failed' then 'latest run failed'
    when status = 'canceled' then 'latest run was canceled' else 'latest run in progress' end""",
    "latest_success": f"""case when success_us is null then 'no observation' when {NOW} >= success_us + max_age
    then 'observation is stale' else 'a successful run is on record' end""",
    "expected_run": f"""case when schedule_state = 'stopped' and declared_running
    then 'schedule is stopped but its cadence declares it running' when not running then 'schedule is ' || schedule_state
    when last_created_us >= due then 'the expected run started' when {NOW} < due + {GRACE}
    then 'the expected run is within its grace period' else 'an expected run did not start' end""",
    "freshness": f"""case when not running then 'schedule is ' || schedule_state when success_us is null
    then 'no successful run on record' when success_us >= owed then 'a run succeeded since the previous due time'
    when {NOW} < owed + {GRACE} then 'the previous due run is within its grace period'
    else 'no run succeeded since the previous due time plus its grace' end""",
    "freshness_age": f"""case when success_us is null then 'no successful run on record' when {NOW} - success_us >= {3 * HOUR}
    then 'the last success is older than its critical bound' when {NOW} - success_us >= {HOUR}
    then 'the last success is older than its warning bound' else 'the last success is within its bounds' end""",
}
EVERY = " union all ".join(
    f"select stage, job_name, '{kind}' as kind, {state} as state, {run} as run from evidence"
    for kind, (state, run) in SIGNALS.items()
)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.job_signals(
        view(spark, sf_dir, "runs_v"), view(spark, sf_dir, "schedules_v"), NOW, GRACE, HOUR, 3 * HOUR
    )


def _kind(kind: str, *covers: str) -> None:
    state, run = SIGNALS[kind]

    @register(
        f"health_{kind}",
        *covers,
        sql=ctes("schedules_v", **EVIDENCE)
        + f"select stage, job_name, '{kind}' as kind, {state} as state, {REASONS[kind]} as reason, {run} as run from evidence",
    )
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _signals(spark, sf_dir).where(F.col("kind") == kind)


_kind("execution", "Q1", "G8")
_kind("latest_success", "Q2", "G8")
_kind("expected_run", "Q3", "E11")
_kind("freshness", "Q4", "E11")
_kind("freshness_age", "Q5")


@register(
    "health_by_stage",
    "Q7",
    "F14",
    sql=ctes("schedules_v", **EVIDENCE, every_signal=EVERY) + """select stage, case max(case state when 'disabled' then 0
    when 'healthy' then 1 when 'unknown' then 2 when 'warning' then 3 else 4 end) when 0 then 'disabled'
    when 1 then 'healthy' when 2 then 'unknown' when 3 then 'warning' else 'critical' end as state from every_signal
    group by 1""",
)
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.rollup_by_stage(_signals(spark, sf_dir))


@register(
    "evidence_bounds",
    "Q8",
    sql=ctes("schedules_v", **EVIDENCE) + "select stage, job_name, owed, max_age from evidence",
)
def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = health.job_evidence(view(spark, sf_dir, "runs_v"), view(spark, sf_dir, "schedules_v"), NOW, GRACE)
    return seen.select("stage", "job_name", "owed", F.col("max_age").cast("bigint").alias("max_age"))
