"""Incidents from health signals: what to open, escalate and close at each evaluation.

Signals come with the evaluation they belong to (`eval`, a whole number that rises by one per evaluation) and a `seq` that
orders them. After `strongest` there is one row per fingerprint and evaluation, however many signals there are. A fingerprint's
history is folded chunk by chunk (`chunks`), so no task holds all of a long one and nothing is asked in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .health import NOT_YET_DUE

# Incident kinds, the policy condition of each, the components that raise one, and the texts rules read.
PRODUCT_KINDS = {
    "run_failed": "run_failed",
    "missed_run": "missed_run",
    "stale_output": "freshness",
    "quality": "quality",
    "schedule_mismatch": "schedule_mismatch",
}
COUNTED = ("stage_unreadable", "health_unreadable")
UNREADABLE_COMPONENTS = ("dagster.read-api", "dagster.pipelines")
PIPELINES_COMPONENT = "dagster.pipelines"
POLICY_COMPONENT = "alert-policy"
HEALTH_COMPONENT = "platform-api.health"
# Service components that alert, and whether a warning of theirs counts.
SERVICE_COMPONENTS = {
    "dagster.workloads": True,
    "trino.workloads": True,
    "object-store.list": False,
    "log-archive.spool-age": False,
    "log-archive.spool-size": False,
    "log-archive.newest-object": False,
}
SERVICE_REASONS = {
    "dagster.workloads": "Dagster workloads are degraded",
    "trino.workloads": "Trino workloads are degraded",
    "object-store.list": "the object store cannot be listed",
    "log-archive.spool-age": "the log archive's spool is not draining",
    "log-archive.spool-size": "the log archive's spool is too large",
    "log-archive.newest-object": "the log archive receives no new objects",
}
DEFAULT_REASONS = {
    "run_failed": "latest run failed",
    "missed_run": "an expected run did not start",
    "schedule_mismatch": "schedule does not match its descriptor",
    "stale_output": "data is stale",
    "quality": "a blocking quality check failed",
    "stage_unreadable": "stage could not be read",
    "policy_unreadable": "alert policy could not be used",
    "service_degraded": "a platform service is degraded",
    "health_unreadable": "stage health could not be read",
}
SAFE_REASONS = (
    *(r for r in DEFAULT_REASONS.values() if r != "a platform service is degraded"),
    "quality checks warned",
    "a non-blocking quality check failed",
    "recovered",
)
RECOVERY_REASONS = {"run_failed": "latest run succeeded", "missed_run": "the expected run started"}
WITHIN_GRACE = "the expected run is within its grace period"
SILENT_ON_DISABLED = ("missed_run", "schedule_mismatch")
STALE_CAUSES = ("run_failed", "missed_run")
UNREADABLE_THRESHOLD = 3
MAX_RUN_IDS = 20
SCOPE = ("stage", "domain", "product", "table_name")
WILDCARD = "*"


@dataclass(frozen=True)
class Rule:
    """One policy rule. A rule names a product, a domain with all its products, or everything."""

    stages: tuple[str, ...]
    condition: str
    domain: str = WILDCARD
    product: str = WILDCARD
    enabled: bool = True
    severity: str | None = "critical"
    aged: bool = False


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows, one per stage: configuration, a handful of them."""
    rows = [
        (i, stage, r.condition, r.domain, r.product, r.enabled, r.severity, r.aged)
        for i, r in enumerate(rules)
        for stage in r.stages
    ]
    return spark.createDataFrame(
        rows,
        "rule int, stage string, condition string, rule_domain string, rule_product string, enabled boolean, "
        "rule_severity string, aged boolean",
    )


def resolve_policy(scopes: DataFrame, rules: DataFrame) -> DataFrame:
    """Per scope and condition the most specific rule. A rule that says false switches the condition off.

    A scope is looked up under the four keys a rule can match it by, so wildcards need an equality join only. `scopes`
    holds stage, domain and product, the latter two null for what belongs to no product.
    """
    wild = F.lit(WILDCARD)
    keys = [
        (F.col("domain"), F.col("product"), 2),
        (wild, F.col("product"), 2),
        (F.col("domain"), wild, 1),
        (wild, wild, 0),
    ]
    options = F.array(
        *[
            F.struct(d.alias("rule_domain"), p.alias("rule_product"), F.lit(level).alias("specificity"))
            for d, p, level in keys
        ]
    )
    wanted = scopes.distinct().withColumn("k", F.explode(options)).select("stage", "domain", "product", "k.*")
    matched = wanted.join(rules, ["stage", "rule_domain", "rule_product"])
    # Rules of one level on one condition are refused when a policy is loaded; the first one stands in for that here.
    return (
        matched.groupBy("stage", "domain", "product", "condition")
        .agg(
            F.max(F.struct("specificity", (-F.col("rule")).alias("first"), "enabled", "rule_severity", "aged")).alias("won"),
        )
        .select(
            "stage", "domain", "product", "condition", F.col("won.enabled").alias("enabled"),
            F.col("won.rule_severity").alias("rule_severity"), F.col("won.aged").alias("aged"),
        )
    )


def kinds_of(kind: Column, state: Column, component: Column) -> Column:
    """The incident kinds a signal speaks about; none for a component nobody named."""
    one = lambda word: F.array(F.lit(word))  # noqa: E731 - four uses, one line each
    both = F.array(F.lit("missed_run"), F.lit("schedule_mismatch"))
    service = (
        F.when(component.isin(*UNREADABLE_COMPONENTS), one("stage_unreadable"))
        .when(component == POLICY_COMPONENT, one("policy_unreadable"))
        .when(component == HEALTH_COMPONENT, one("health_unreadable"))
        .when(component.isin(*SERVICE_COMPONENTS), one("service_degraded"))
    )
    return (
        F.when(kind == "execution", one("run_failed"))
        .when(
            kind == "expected_run",
            F.when(state == "warning", one("schedule_mismatch")).when(state == "critical", one("missed_run")).otherwise(both),
        )
        .when(kind == "freshness", one("stale_output"))
        .when(kind == "quality", one("quality"))
        .when(kind == "service", service)
    )


def severity_of(kind: Column, state: Column, component: Column, rule_severity: Column, aged: Column) -> Column:
    """How bad a state is for a kind; null when the kind does not alert on it."""
    as_state = F.when(state.isin("warning", "critical"), state)
    warns = [name for name, counts in SERVICE_COMPONENTS.items() if counts]
    return (
        F.when(
            kind == "service_degraded",
            F.when(state == "critical", "critical").when((state == "warning") & component.isin(*warns), "warning"),
        )
        .when(kind == "policy_unreadable", F.when(state == "warning", "warning"))
        .when(kind.isin(*COUNTED), F.when(state == "unknown", "critical"))
        .when(kind == "quality", as_state)
        .when((kind == "stale_output") & F.coalesce(aged, F.lit(False)), as_state)
        .when(kind == "schedule_mismatch", F.when(state == "warning", rule_severity))
        .otherwise(F.when(state == "critical", rule_severity))
    )


def fingerprint(*parts: Column) -> Column:
    """The identity of an incident. A run is no part of it: repeated failures are one incident."""
    marked = [F.coalesce(p, F.lit("\x00")) for p in (F.lit("1"), *parts)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *marked), 256), 1, 16)


def observe(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Signals as observations of incident kinds, with the health each kind reads into them.

    A retry or a grace period is no recovery, so a healthy state closes a kind only on the kind's own reason.
    """
    spread = signals.withColumn("incident", F.explode(kinds_of(F.col("kind"), F.col("state"), F.col("component"))))
    policy = resolve_policy(signals.select("stage", "domain", "product"), rules)
    condition = None
    for kind, name in PRODUCT_KINDS.items():
        met = F.col("incident") == kind
        condition = F.when(met, name) if condition is None else condition.when(met, name)
    left = spread.withColumn("condition", condition).alias("s")
    on = (
        (F.col("s.stage") == F.col("p.stage"))
        & F.col("s.domain").eqNullSafe(F.col("p.domain"))
        & F.col("s.product").eqNullSafe(F.col("p.product"))
        & (F.col("s.condition") == F.col("p.condition"))
    )
    ruled = left.join(policy.where("enabled").alias("p"), on, "left").select("s.*", "p.rule_severity", "p.aged", F.col("p.enabled"))
    governed = F.col("condition").isNull() | F.coalesce("enabled", F.lit(False))
    kind, state, reason = F.col("incident"), F.col("state"), F.col("reason")
    severity = severity_of(kind, state, F.col("component"), F.col("rule_severity"), F.col("aged"))
    bad = state.isin("warning", "critical")
    own_reason = None
    for name, text in RECOVERY_REASONS.items():
        own_reason = F.when(kind == name, text) if own_reason is None else own_reason.when(kind == name, text)
    unproven = (own_reason.isNotNull() & (reason != own_reason)) | (
        (kind == "stale_output") & reason.startswith(NOT_YET_DUE)
    )
    health = (
        F.when(bad & severity.isNull(), F.when(kind == "stage_unreadable", "healthy"))
        .when((state == "healthy") & unproven, "unknown")
        .otherwise(state)
    )
    default = F.create_map(*[F.lit(x) for pair in DEFAULT_REASONS.items() for x in pair])
    service = F.create_map(*[F.lit(x) for pair in SERVICE_REASONS.items() for x in pair])
    said = F.when(kind == "service_degraded", F.try_element_at(service, F.col("component"))).otherwise(
        F.when(reason.isin(*SAFE_REASONS), reason).otherwise(F.try_element_at(default, kind))
    )
    judged = ruled.where(governed).withColumns({"health": health, "severity": severity, "said": said})
    # A failed read of the pipelines means something; a good one never proves the stage readable.
    vouches = (
        (F.col("incident") != "stage_unreadable")
        | (F.coalesce("component", F.lit("")) != PIPELINES_COMPONENT)
        | (F.col("health") == "unknown")
    )
    part = F.when(F.col("incident") == "service_degraded", F.col("component"))
    grace = F.when((F.col("incident") == "missed_run") & (F.col("reason") == WITHIN_GRACE), F.col("due"))
    return judged.where(F.col("health").isNotNull() & vouches).select(
        "seq",
        "eval",
        *SCOPE,
        F.col("incident").alias("kind"),
        part.alias("component"),
        "health",
        "severity",
        F.col("said").alias("reason"),
        F.col("run").alias("run_id"),
        fingerprint(
            F.col("stage"), F.col("incident"), F.col("domain"), F.col("product"), F.col("table_name"), part
        ).alias("fingerprint"),
        grace.alias("grace_due"),
    )


def precedence(kind: Column, health: Column, severity: Column) -> Column:
    """Firing outranks unknown, which outranks healthy, which outranks disabled. Where unknowns are counted, an unknown
    outranks everything: either read failing keeps the stage unreadable."""
    base = (
        F.when(kind.isin(*COUNTED) & (health == "unknown"), 4)
        .when(health.isin("warning", "critical"), 3)
        .when(health == "unknown", 2)
        .when(health == "healthy", 1)
        .otherwise(0)
    )
    counted = kind.isin(*COUNTED) & (health == "unknown")
    return base * 2 + F.when(~counted & (F.coalesce(severity, F.lit("")) == "critical"), 1).otherwise(0)


CARRIED = (*SCOPE, "kind", "component", "health", "severity", "reason", "grace_due")


def strongest(observed: DataFrame) -> DataFrame:
    """One observation per fingerprint and evaluation: the highest by precedence, the first of equals.

    It names the run of the last observation that took the lead with one, else the first run anybody named. Ranks are a
    handful, so after the first aggregate a fingerprint has a handful of rows per evaluation.
    """
    ranked = observed.withColumn("rank", precedence(F.col("kind"), F.col("health"), F.col("severity")))
    leaders = ranked.groupBy("fingerprint", "eval", "rank").agg(
        F.min(F.struct("seq", "run_id", *CARRIED)).alias("first"),
        F.min(F.when(F.col("run_id").isNotNull(), F.struct("seq", "run_id"))).alias("named"),
    )
    in_order = Window.partitionBy("fingerprint", "eval").orderBy("first.seq")
    before = F.max("rank").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    led = leaders.withColumn("led", F.coalesce(F.col("rank") > before, F.lit(True)))
    took = F.when(F.col("led") & F.col("first.run_id").isNotNull(), F.struct(F.col("first.seq").alias("seq"), F.col("first.run_id").alias("run_id")))
    folded = led.groupBy("fingerprint", "eval").agg(
        F.max(F.struct("rank", "first")).alias("top"), F.max(took).alias("took"), F.min("named").alias("named")
    )
    return folded.select(
        "fingerprint",
        "eval",
        *[F.col(f"top.first.{c}").alias(c) for c in CARRIED],
        F.coalesce("took.run_id", "named.run_id").alias("run_id"),
    )


def count_unreadable(observed: DataFrame, threshold: int = UNREADABLE_THRESHOLD) -> DataFrame:
    """Counted kinds turn critical at the third unknown in a row. A gap in the evaluations starts the count again.

    An unknown counts for its own evaluation and for the next ones up to the threshold, so no history is put in order.
    """
    counted = F.col("kind").isin(*COUNTED) & (F.col("health") == "unknown")
    unknown = observed.where(counted)
    spread = unknown.select("fingerprint", "eval", F.explode(F.array(*map(F.lit, range(threshold)))).alias("_back"))
    seen = spread.groupBy("fingerprint", (F.col("eval") + F.col("_back")).alias("eval")).agg(F.collect_set("_back").alias("_seen"))
    gap = F.array_min(F.array_except(F.array(*map(F.lit, range(threshold + 1))), F.col("_seen")))
    reached = unknown.join(seen, ["fingerprint", "eval"]).withColumn("unknowns", gap.cast("int")).drop("_seen")
    full = F.col("unknowns") >= threshold
    default = F.create_map(*[F.lit(x) for pair in DEFAULT_REASONS.items() for x in pair])
    settled = reached.withColumns(
        {
            "health": F.when(full, "critical").otherwise(F.col("health")),
            "reason": F.when(full, F.try_element_at(default, F.col("kind"))).otherwise(F.col("reason")),
        }
    )
    return observed.where(~counted).withColumn("unknowns", F.lit(None).cast("int")).unionByName(settled)


IDENTITY = ("fingerprint", *SCOPE, "kind", "component")


def _acts(observed: DataFrame, closures: DataFrame | None, entering: DataFrame | None) -> DataFrame:
    """What each observation does: fire, resolve, silence, or null for one that decides nothing by itself. A closure of an
    evaluation comes before its observations."""
    health = F.col("health")
    act = (
        F.when(health.isin("warning", "critical") & F.col("severity").isNotNull(), "fire")
        .when(health == "healthy", "resolve")
        .when((health == "disabled") & F.col("kind").isin(*SILENT_ON_DISABLED), "silence")
    )
    rows = observed.withColumns({"act": act, "step": F.lit(1)})
    if closures is None:
        return rows
    # A closure of a scope or rule reaches every fingerprint it covers.
    known = observed.select(*IDENTITY)
    if entering is not None:
        known = known.union(entering.select(*IDENTITY))
    known = known.distinct()
    scope = ["stage", "domain", "product"]
    on = [known[c].eqNullSafe(closures[c]) for c in scope]
    on.append(closures["kind"].isNull() | (closures["kind"] == known["kind"]))
    gone = closures.join(known, on).select(known["*"], closures["eval"]).distinct()
    filled = gone.select(
        *[
            F.col(c) if c in gone.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c)
            for c in rows.columns
            if c not in ("act", "step")
        ],
        F.lit("silence").alias("act"),
        F.lit(0).alias("step"),
    )
    # What the policy or the scope no longer covers is not observed either.
    covered = rows.join(gone.select("fingerprint", "eval"), ["fingerprint", "eval"], "left_anti")
    return covered.unionByName(filled)


def _suppress(stale: DataFrame, causes: DataFrame, entering: DataFrame | None) -> DataFrame:
    """A stale output does not open while a failed or missed run is open for its scope: that already says why.

    Causes of an evaluation are settled before its outputs, so an opening counts at once and a closing too. Openings less closings are
    added up per scope and chunk, then along the chunks of a scope, then inside each chunk.
    """
    scope = ["stage", "domain", "product"]
    moves = causes.where(F.col("kind").isin(*STALE_CAUSES) & F.col("event").isin("opened", "resolved", "resolved_silently")).select(
        *scope, "eval", F.when(F.col("event") == "opened", 1).otherwise(-1).alias("move")
    )
    if entering is not None:
        held = entering.where(F.col("kind").isin(*STALE_CAUSES) & F.col("state.open"))
        moves = moves.union(held.select(*scope, (F.col("since") - 1).alias("eval"), F.lit(1)))
    moves = moves.groupBy(*scope, "eval").agg(F.sum("move").alias("move"))
    marked = stale.unionByName(moves.withColumn("step", F.lit(-1)), allowMissingColumns=True).withColumn("_chunk", chunks.chunk_of(F.col("eval")))
    along = Window.partitionBy(*scope).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*scope, "_chunk").agg(F.sum("move").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(along), F.lit(0)))
    inside = Window.partitionBy(*scope, "_chunk").orderBy("eval", "step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = marked.withColumn("_open", F.coalesce(F.sum("move").over(inside), F.lit(0))).where("step >= 0")
    ahead = before.select(*[F.col(c).alias(f"__{c}") for c in [*scope, "_chunk"]], "_before")
    held = summed.join(ahead, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*scope, "_chunk"]])
    act = F.when((F.col("act") == "fire") & (F.col("_open") + F.col("_before") > 0), "hold_fire").otherwise(F.col("act"))
    return held.withColumn("act", act).select(*stale.columns)


def evaluate_from(
    observed: DataFrame,
    closures: DataFrame | None = None,
    entering: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """`evaluate` of a later part of a history, and the state of each fingerprint after each chunk.

    `entering` has a row per known fingerprint: its identity, its `state`, and `since`, the first evaluation of its scope that
    `observed` holds, which begins a chunk.
    """
    rows = _acts(observed, closures, entering)
    is_stale = F.col("kind") == "stale_output"
    rest = [None, None] if entering is None else [entering.where(~is_stale), entering.where(is_stale)]
    causes, after = chunks.scan(rows.where(~is_stale), list(IDENTITY), rest[0], keep)
    causes = keep(causes)
    stale, stale_after = chunks.scan(_suppress(rows.where(is_stale), causes, entering), list(IDENTITY), rest[1], keep)
    told = causes.unionByName(stale)
    state = {"number": "number", "opened_at": "opened_at", "incident_severity": "severity", "incident_reason": "reason"}
    return told.withColumns({name: F.col(f"state.{field}") for name, field in state.items()}).drop("state"), after.unionByName(stale_after)


def evaluate(
    observed: DataFrame,
    closures: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Every row of the timeline with its event, null where an evaluation moved nothing.

    `observed` comes from `count_unreadable(strongest(...))`. `closures` (eval, stage, domain, product, kind) say when a
    scope, or with a kind a rule, was gone: open incidents close silently. `keep` may write what is read again to a table.
    """
    return evaluate_from(observed, closures, None, keep)[0]


def timeline(evaluated: DataFrame) -> DataFrame:
    """The history: one row per transition, `number` counting a fingerprint's incidents."""
    return evaluated.where("event is not null").select(
        "fingerprint", "number", "eval", "event", *SCOPE, "kind", "component",
        F.col("incident_severity").alias("severity"), F.col("incident_reason").alias("reason"), "run_id", "opened_at",
    )


def run_ids(evaluated: DataFrame, n: int = MAX_RUN_IDS) -> DataFrame:
    """The last distinct runs of each incident, oldest first, at most `n`."""
    named = evaluated.where(
        F.col("run_id").isNotNull()
        & (
            (F.col("event").isNotNull() & (F.col("event") != "resolved_silently"))
            | (F.col("was_open") & F.col("act").isin("fire", "hold_fire"))
        )
    )
    first = named.groupBy("fingerprint", "number", "run_id").agg(F.min("eval").alias("first"))
    newest = Window.partitionBy("fingerprint", "number").orderBy(F.desc("first"), F.desc("run_id"))
    # At most `n` rows of an incident are left to gather.
    last = first.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", "run_id"))), lambda r: r["run_id"])
    return last.groupBy("fingerprint", "number").agg(listed.alias("run_ids"))


def open_incidents(history: DataFrame, deliveries: DataFrame | None = None) -> DataFrame:
    """Incidents still firing after the last evaluation, with the outcome of their latest delivery."""
    last = F.max(F.struct("number", "eval", "event", "severity", "reason"))
    folded = history.groupBy("fingerprint", *SCOPE, "kind", "component").agg(
        last.alias("last"), F.max(F.struct("number", "opened_at")).alias("open")
    )
    firing = folded.where(~F.col("last.event").isin("resolved", "resolved_silently")).select(
        "fingerprint",
        *SCOPE,
        "kind",
        "component",
        F.col("last.number").alias("number"),
        F.col("last.severity").alias("severity"),
        F.col("last.reason").alias("reason"),
        F.col("open.opened_at").alias("opened_at"),
    )
    if deliveries is None:
        return firing
    latest = deliveries.groupBy("fingerprint", "number").agg(F.max(F.struct("eval", "outcome"))["outcome"].alias("delivery"))
    return firing.join(latest, ["fingerprint", "number"], "left")
