"""Incident detection over signals made from the events.

The DuckDB text of the timeline walks each fingerprint row by row in a recursive query; the plan finds the same incidents
with windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import incidents
from ..plans.incidents import Rule
from ..registry import register
from ..session import cut
from ..shapes import ctes, view

BOTH = ("dev", "prod")
RULES = (
    Rule(BOTH, "run_failed"),
    Rule(BOTH, "missed_run", severity="warning"),
    Rule(BOTH, "freshness"),
    Rule(BOTH, "quality"),
    Rule(BOTH, "schedule_mismatch", severity="warning"),
    Rule(("prod",), "run_failed", domain="sales", severity="warning"),
    Rule(BOTH, "missed_run", product="product_2", enabled=False),
    Rule(BOTH, "freshness", product="product_1", aged=True),
)


def _text(value: object) -> str:
    return "null" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'"


RULES_SQL = "select * from (values " + ", ".join(
    f"({i}, '{stage}', '{r.condition}', '{r.domain}', '{r.product}', {_text(r.enabled)}, {_text(r.severity)}, {_text(r.aged)})"
    for i, r in enumerate(RULES)
    for stage in r.stages
) + ") as t(rule, stage, condition, rule_domain, rule_product, enabled, rule_severity, aged)"

POLICY_SQL = """select stage, domain, product, condition, enabled, rule_severity, aged from (select s.*, r.condition,
r.enabled, r.rule_severity, r.aged, row_number() over (partition by s.stage, s.domain, s.product, r.condition order by
case when r.rule_product <> '*' then 2 when r.rule_domain <> '*' then 1 else 0 end desc, r.rule) as n
from (select distinct stage, domain, product from signals_v) s join rules r on r.stage = s.stage
and (r.rule_domain = '*' or r.rule_domain = s.domain) and (r.rule_product = '*' or r.rule_product = s.product))
where n = 1"""

SPREAD_SQL = """select *, unnest(case kind when 'execution' then ['run_failed'] when 'freshness' then ['stale_output']
when 'quality' then ['quality'] when 'expected_run' then case state when 'warning' then ['schedule_mismatch']
when 'critical' then ['missed_run'] else ['missed_run', 'schedule_mismatch'] end
else case when component = 'dagster.read-api' then ['stage_unreadable'] else ['service_degraded'] end end) as incident
from signals_v"""

JUDGED_SQL = """select s.seq, s.eval, s.stage, s.domain, s.product, s.table_name, s.incident as kind,
case when s.incident = 'service_degraded' then s.component end as component, s.state, s.reason as said, s.run, s.due,
case s.incident when 'service_degraded' then case when state = 'critical' then 'critical' when state = 'warning'
and s.component = 'trino.workloads' then 'warning' end when 'stage_unreadable' then case when state = 'unknown'
then 'critical' end when 'quality' then case when state in ('warning', 'critical') then state end
when 'schedule_mismatch' then case when state = 'warning' then rule_severity end
when 'stale_output' then case when aged then case when state in ('warning', 'critical') then state end
when state = 'critical' then rule_severity end else case when state = 'critical' then rule_severity end end as severity
from spread s left join policy p on p.stage = s.stage and p.domain is not distinct from s.domain
and p.product is not distinct from s.product and p.condition = case s.incident when 'stale_output' then 'freshness'
else s.incident end where s.kind = 'service' or p.enabled"""

OBSERVED_SQL = """select seq, eval, stage, domain, product, table_name, kind, component, health, severity,
case when kind = 'service_degraded' then case component when 'trino.workloads' then 'Trino workloads are degraded'
else 'the object store cannot be listed' end when said in ('latest run failed', 'an expected run did not start',
'quality checks warned') then said else case kind when 'run_failed' then 'latest run failed' when 'missed_run'
then 'an expected run did not start' when 'schedule_mismatch' then 'schedule does not match its descriptor'
when 'stale_output' then 'data is stale' when 'quality' then 'a blocking quality check failed'
else 'stage could not be read' end end as reason, run as run_id, substr(sha256(concat_ws(chr(31), '1', stage, kind,
coalesce(domain, chr(0)), coalesce(product, chr(0)), coalesce(table_name, chr(0)), coalesce(component, chr(0)))), 1, 16)
as fingerprint, case when kind = 'missed_run' and said = 'the expected run is within its grace period' then due end
as grace_due from (select *, case when state in ('warning', 'critical') and severity is null then
case when kind = 'stage_unreadable' then 'healthy' end when state = 'healthy' and (kind = 'run_failed'
and said <> 'latest run succeeded' or kind = 'missed_run' and said <> 'the expected run started'
or kind = 'stale_output' and starts_with(said, 'no scheduled run due yet')) then 'unknown' else state end as health
from judged) where health is not null"""

STRONGEST_SQL = """select l.fingerprint, l.eval, l.stage, l.domain, l.product, l.table_name, l.kind, l.component, l.health,
l.severity, l.reason, l.grace_due, coalesce(t.run_id, a.run_id) as run_id from (select *, row_number() over
(partition by fingerprint, eval order by rank desc, seq) as place from ranked) l
left join (select fingerprint, eval, arg_max(run_id, seq) as run_id from (select *, max(rank) over (partition by
fingerprint, eval order by seq rows between unbounded preceding and 1 preceding) as before from ranked)
where (before is null or rank > before) and run_id is not null group by 1, 2) t using (fingerprint, eval)
left join (select fingerprint, eval, arg_min(run_id, seq) as run_id from ranked where run_id is not null group by 1, 2) a
using (fingerprint, eval) where l.place = 1"""

RANKED_SQL = """select *, case when kind = 'stage_unreadable' and health = 'unknown' then 8 else 2 * case health
when 'disabled' then 0 when 'healthy' then 1 when 'unknown' then 2 else 3 end
+ case when severity = 'critical' then 1 else 0 end end as rank from observed"""

COUNTED_SQL = """select fingerprint, eval, stage, domain, product, table_name, kind, component,
case when unknowns >= 3 then 'critical' else health end as health, severity,
case when unknowns >= 3 then 'stage could not be read' else reason end as reason, grace_due, run_id, unknowns
from (select * exclude (island), case when kind = 'stage_unreadable' and health = 'unknown' then cast(least(3, row_number()
over (partition by fingerprint, island order by eval)) as integer) end as unknowns from (select *, case when
kind = 'stage_unreadable' and health = 'unknown' then eval - row_number() over (partition by fingerprint,
kind = 'stage_unreadable' and health = 'unknown' order by eval) end as island from strong))"""

POLICY = {"rules": RULES_SQL, "policy": POLICY_SQL}
OBSERVED = {**POLICY, "spread": SPREAD_SQL, "judged": JUDGED_SQL, "observed": OBSERVED_SQL}
STRONG = {**OBSERVED, "ranked": RANKED_SQL, "strong": STRONGEST_SQL}
COUNTED = {**STRONG, "counted": COUNTED_SQL}

# A product retired for a while, and a rule switched off for a while.
CLOSED_SQL = """select distinct eval, stage, domain, product, null::varchar as kind from signals_v where stage = 'dev'
and product = 'product_0' and eval between 300 and 330 union select distinct eval, stage, domain, product, 'quality'
from signals_v where stage = 'prod' and product = 'product_1' and eval between 500 and 530"""


def _acts_sql(closed: bool) -> dict[str, str]:
    acts = """select *, 1 as step, case when health in ('warning', 'critical') and severity is not null then 'fire'
    when health = 'healthy' then 'resolve' when health = 'disabled' and kind in ('missed_run', 'schedule_mismatch')
    then 'silence' end as act from counted"""
    if not closed:
        return {"acts": acts}
    return {
        "closures": CLOSED_SQL,
        "gone": """select distinct k.*, c.eval from closures c join (select distinct fingerprint, stage, domain, product,
        table_name, kind, component from counted) k on k.stage = c.stage and k.domain is not distinct from c.domain
        and k.product is not distinct from c.product and (c.kind is null or c.kind = k.kind)""",
        "acts": f"""select * from ({acts}) a where not exists (select 1 from gone g where g.fingerprint = a.fingerprint
        and g.eval = a.eval) union all by name select *, 0 as step, 'silence' as act from gone""",
    }


def _walk(rows: str) -> str:
    """One fingerprint's rows in order, each deciding on the state the row before left."""
    acted = """case when r.act is null and r.grace_due is not null and w.open and r.grace_due <= w.opened_at
    then 'resolve' else r.act end"""
    firing = "r.act in ('fire', 'hold_fire')"
    level = "case when r.severity = 'critical' then 1 else 0 end"
    opens = "(r.act = 'fire' and not w.open)"
    event = f"""case when {opens} then 'opened' when w.open and {firing} and {level} > w.told then 'escalated'
    when w.open and {firing} and {level} <> w.cur then 'severity_changed' when w.open and {acted} = 'resolve'
    then 'resolved' when w.open and {acted} = 'silence' then 'resolved_silently' end"""
    live = f"({opens} or (w.open and {firing}))"
    return f"""select distinct fingerprint, 0::bigint as n, false as open, null::bigint as opened_at, 0 as told, 0 as cur,
    0::bigint as number, null::varchar as event, null::varchar as incident_severity, null::varchar as incident_reason
    from {rows} union all select r.fingerprint, r.n, case when r.act = 'fire' then true when {acted} in
    ('resolve', 'silence') then false else w.open end, case when {opens} then r.eval else w.opened_at end,
    case when {opens} then {level} when {live} then greatest(w.told, {level}) else w.told end,
    case when {live} then {level} else w.cur end, case when {opens} then w.number + 1 else w.number end, {event},
    case when {live} then r.severity else w.incident_severity end,
    case when {event} in ('opened', 'escalated') then r.reason else w.incident_reason end
    from walk_{rows} w join {rows} r on r.fingerprint = w.fingerprint and r.n = w.n + 1"""


def _timeline(closed: bool) -> str:
    number = "row_number() over (partition by fingerprint order by eval, step) as n"
    text = ctes(
        "signals_v",
        **COUNTED,
        **_acts_sql(closed),
        causes=f"select *, {number} from acts where kind <> 'stale_output'",
        walk_causes=_walk("causes"),
        done_causes="select r.*, w.* exclude (fingerprint, n) from causes r join walk_causes w using (fingerprint, n)",
        moves="""select stage, domain, product, eval, sum(case when event = 'opened' then 1 else -1 end) as move
        from done_causes where kind in ('run_failed', 'missed_run') and event in ('opened', 'resolved',
        'resolved_silently') group by all""",
        stale=f"""select * replace (case when act = 'fire' and coalesce((select sum(m.move) from moves m
        where m.stage = a.stage and m.domain = a.domain and m.product = a.product and m.eval <= a.eval), 0) > 0
        then 'hold_fire' else act end as act), {number} from acts a where kind = 'stale_output'""",
        walk_stale=_walk("stale"),
        done_stale="select r.*, w.* exclude (fingerprint, n) from stale r join walk_stale w using (fingerprint, n)",
        history="""select fingerprint, number, eval, event, stage, domain, product, table_name, kind, component,
        incident_severity as severity, incident_reason as reason, run_id, opened_at from (select * from done_causes
        union all by name select * from done_stale) where event is not null""",
    )
    return text.replace("with ", "with recursive ", 1)


TIMELINE, CLOSED = _timeline(False), _timeline(True)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Signals are a table of their own; the expressions that make them here are computed once.
    return incidents.observe(cut(view(spark, sf_dir, "signals_v")), incidents.rules_table(spark, RULES))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read again for the unknowns in a row.
    return incidents.count_unreadable(cut(incidents.strongest(_observed(spark, sf_dir))))


def _evaluated(spark: SparkSession, sf_dir: str, closures: DataFrame | None = None) -> DataFrame:
    return cut(incidents.evaluate(cut(_counted(spark, sf_dir)), closures, cut))


@register("resolve_policy", "R3", "E10", "G3", sql=ctes("signals_v", **POLICY) + "select * from policy")
def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = view(spark, sf_dir, "signals_v").select("stage", "domain", "product")
    return incidents.resolve_policy(scopes, incidents.rules_table(spark, RULES))


@register(
    "incident_observations",
    "R1",
    "R2",
    "R4",
    "J18",
    sql=ctes("signals_v", **OBSERVED) + "select * from observed",
)
def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir)


@register("strongest_observations", "R5", "G4", sql=ctes("signals_v", **STRONG) + "select * from strong")
def _strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.strongest(_observed(spark, sf_dir))


@register("unreadable_counter", "R6", "G6", sql=ctes("signals_v", **COUNTED) + "select * from counted")
def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir)


@register("incident_timeline", "R7", "R9", "E14", sql=TIMELINE + "select * from history")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.timeline(_evaluated(spark, sf_dir))


@register("incident_closures", "R8", sql=CLOSED + "select * from history")
def _closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = view(spark, sf_dir, "signals_v")
    text = CLOSED_SQL.replace("from signals_v", "from {signals}").replace("null::varchar", "cast(null as string)")
    return incidents.timeline(_evaluated(spark, sf_dir, spark.sql(text, signals=signals)))


@register(
    "incident_run_ids",
    "R10",
    sql=TIMELINE + """select fingerprint, number, string_agg(run_id, ',' order by first, run_id) as run_ids from
    (select *, row_number() over (partition by fingerprint, number order by first desc, run_id desc) as place from
    (select fingerprint, number, run_id, min(eval) as first from (select * from done_causes union all by name
    select * from done_stale) where run_id is not null and number > 0 and (event in ('opened', 'escalated',
    'severity_changed', 'resolved') or (open and act in ('fire', 'hold_fire'))) group by 1, 2, 3))
    where place <= 20 group by 1, 2""",
)
def _run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = incidents.run_ids(_evaluated(spark, sf_dir))
    return listed.withColumn("run_ids", F.concat_ws(",", "run_ids"))


@register(
    "open_incidents",
    "R11",
    sql=TIMELINE + """select o.fingerprint, o.number, o.stage, o.domain, o.product, o.table_name, o.kind, o.component,
    o.severity, o.reason, o.opened_at, case when o.event = 'opened' then 'delivered' when o.event = 'escalated'
    then 'undeliverable' else t.delivery end as delivery from (select *, row_number() over (partition by fingerprint
    order by number desc, eval desc) as place from history) o left join (select fingerprint, number, case when
    arg_max(event, eval) = 'opened' then 'delivered' else 'undeliverable' end as delivery from history where event in
    ('opened', 'escalated') group by 1, 2) t using (fingerprint, number) where place = 1
    and event not in ('resolved', 'resolved_silently')""",
)
def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings were delivered, escalations were not."""
    history = incidents.timeline(_evaluated(spark, sf_dir))
    told = history.where(F.col("event").isin("opened", "escalated")).select(
        "fingerprint",
        "number",
        "eval",
        F.when(F.col("event") == "opened", "delivered").otherwise("undeliverable").alias("outcome"),
    )
    return incidents.open_incidents(history, told)


@register(
    "active_signals",
    "E13",
    sql=ctes("signals_v") + """select seq, stage, product from signals_v where (stage, product) in (select stage, product
    from signals_v where product is not null group by 1, 2 having max(eval) - min(eval) > 100 and product <> 'product_2')""",
)
def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = view(spark, sf_dir, "signals_v")
    active = (
        signals.where("product is not null")
        .groupBy("stage", "product")
        .agg((F.max("eval") - F.min("eval")).alias("span"))
        .where("span > 100 and product <> 'product_2'")
        .select("stage", "product")
    )
    return signals.join(active, ["stage", "product"], "left_semi").select("seq", "stage", "product")
