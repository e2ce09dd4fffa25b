"""A fingerprint's history as a scan that composes: each chunk of it becomes a table of what it does to any state it is entered in.

A chunk is all rows of `CHUNK` evaluations. `summary` folds one without knowing the state before it: once as if no incident were open,
and for an open one by the row that closes it. Only a row that settles a grace asks when the incident had opened, so an open
incident has one entry per such row that reaches further back than the ones before, and one for the row that closes any. Applying a
summary to a state costs the same whatever the chunk holds. So the chunks of a long history are folded side by side, the states
between them follow from one short row per chunk, and a last fold of each chunk from its own state gives the transitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128
FIRING = ("fire", "hold_fire")
STATE = "struct<open:boolean,opened_at:bigint,told:int,current:int,number:bigint,severity:string,reason:string>"
BRANCH = f"struct<due:bigint,state:{STATE}>"
SUMMARY = f"struct<idle:{STATE},told:int,current:int,severity:string,reason:string,shut:boolean,closed:array<{BRANCH}>>"
MOVED = f"struct<was_open:boolean,event:string,state:{STATE}>"
# A grace that reaches back before any evaluation: the row closes whatever is open.
ANY = -(1 << 63)


def chunk_of(evaluation: Column) -> Column:
    return F.floor(evaluation / CHUNK).cast("bigint")


def idle() -> Column:
    """The state without an incident."""
    none = F.lit(None)
    return F.struct(
        F.lit(False).alias("open"), none.alias("opened_at"), F.lit(0).alias("told"), F.lit(0).alias("current"),
        F.lit(0).alias("number"), none.alias("severity"), none.alias("reason"),
    ).cast(STATE)


def _level(row: Column) -> Column:
    return F.when(row["severity"] == "critical", 1).otherwise(0)


def _act(row: Column) -> Column:
    return F.coalesce(row["act"], F.lit(""))


def _settles(row: Column) -> Column:
    """Whether the row only says since when an occurrence is within its grace."""
    return row["act"].isNull() & row["grace_due"].isNotNull()


def moved(state: Column, row: Column) -> tuple[Column, Column]:
    """The event of a row met in a state, and the state after it.

    An escalation is measured against the highest severity already told, so a flapping severity tells once. A missed run that now reads
    as inside its grace closes the incident that opened for the same occurrence.
    """
    act, level, is_open = _act(row), _level(row), state["open"]
    firing = is_open & act.isin(*FIRING)
    settled = is_open & _settles(row) & (row["grace_due"] <= state["opened_at"])
    opens = ~is_open & (act == "fire")
    escalates = firing & (level > state["told"])
    event = (
        F.when(opens, "opened")
        .when(escalates, "escalated")
        .when(firing & (level != state["current"]), "severity_changed")
        .when(is_open & (settled | (act == "resolve")), "resolved")
        .when(is_open & (act == "silence"), "resolved_silently")
    )
    live = opens | firing
    after = F.struct(
        F.when(opens, True).when(settled | act.isin("resolve", "silence"), False).otherwise(is_open).alias("open"),
        F.when(opens, row["eval"]).otherwise(state["opened_at"]).alias("opened_at"),
        F.when(opens, level).when(firing, F.greatest(state["told"], level)).otherwise(state["told"]).alias("told"),
        F.when(live, level).otherwise(state["current"]).alias("current"),
        (state["number"] + opens.cast("bigint")).alias("number"),
        F.when(live, row["severity"]).otherwise(state["severity"]).alias("severity"),
        F.when(opens | escalates, row["reason"]).otherwise(state["reason"]).alias("reason"),
    )
    return event, after.cast(STATE)


def summary(rows: Column) -> Column:
    """What a chunk does to any state. `idle`: the state after it if none was open before. For an open one that nothing closes, what it
    was told at most, last, and first at the highest level; else `closed`, the state after the chunk by what closes it, in order."""
    none = F.lit(None)
    start = F.struct(
        idle().alias("idle"), none.alias("told"), none.alias("current"), none.alias("severity"), none.alias("reason"),
        F.lit(False).alias("shut"), F.array().alias("closed"),
    ).cast(SUMMARY)

    def merge(so_far: Column, row: Column) -> Column:
        act, level = _act(row), _level(row)
        firing = act.isin(*FIRING)
        shuts = ~so_far["shut"] & act.isin("resolve", "silence")
        # Of the rows that settle a grace only one that reaches further back than those before can be the first to close anything.
        lowest = F.array_min(F.transform(so_far["closed"], lambda b: b["due"]))
        settles = ~so_far["shut"] & _settles(row) & F.coalesce(row["grace_due"] < lowest, F.lit(True))
        due = F.when(shuts, F.lit(ANY)).otherwise(row["grace_due"])
        branch = F.struct(due.alias("due"), idle().alias("state")).cast(BRANCH)
        stepped = F.transform(so_far["closed"], lambda b: F.struct(b["due"].alias("due"), moved(b["state"], row)[1].alias("state")))
        return F.struct(
            moved(so_far["idle"], row)[1].alias("idle"),
            F.when(firing, F.greatest(so_far["told"], level)).otherwise(so_far["told"]).alias("told"),
            F.when(firing, level).otherwise(so_far["current"]).alias("current"),
            F.when(firing, row["severity"]).otherwise(so_far["severity"]).alias("severity"),
            F.when(firing & (level == 1) & (F.coalesce(so_far["told"], F.lit(0)) == 0), row["reason"]).otherwise(so_far["reason"]).alias("reason"),
            (so_far["shut"] | shuts).alias("shut"),
            F.when(shuts | settles, F.concat(stepped, F.array(branch))).otherwise(stepped).alias("closed"),
        ).cast(SUMMARY)

    return F.aggregate(rows, start, merge)


def applied(chunk: Column, state: Column) -> Column:
    """The state after a chunk that is entered in a state."""
    first = F.filter(chunk["closed"], lambda b: b["due"] <= state["opened_at"])
    reached = F.when(~state["open"], chunk["idle"]).when(F.size(first) > 0, F.get(first, F.lit(0))["state"])
    kept = F.struct(
        F.lit(True).alias("open"),
        state["opened_at"].alias("opened_at"),
        F.greatest(state["told"], chunk["told"]).alias("told"),
        F.coalesce(chunk["current"], state["current"]).alias("current"),
        state["number"].alias("number"),
        F.when(chunk["current"].isNotNull(), chunk["severity"]).otherwise(state["severity"]).alias("severity"),
        F.when((state["told"] == 0) & (chunk["told"] == 1), chunk["reason"]).otherwise(state["reason"]).alias("reason"),
    ).cast(STATE)
    numbered = F.transform(
        F.array(reached), lambda s: s.withField("number", s["number"] + state["number"]).cast(STATE)
    )[0]
    return F.when(reached.isNull(), kept).otherwise(numbered)


def replayed(rows: Column, state: Column) -> Column:
    """What each row of a chunk does, entered in a state: an array of the same length."""

    def merge(so_far: Column, row: Column) -> Column:
        before = F.element_at(so_far, -1)["state"]
        event, after = moved(before, row)
        done = F.struct(before["open"].alias("was_open"), event.alias("event"), after.alias("state")).cast(MOVED)
        return F.concat(so_far, F.array(done))

    none = F.lit(None)
    first = F.struct(none.alias("was_open"), none.alias("event"), state.alias("state")).cast(MOVED)
    return F.aggregate(rows, F.array(first), merge, lambda done: F.slice(done, F.lit(2), F.size(done)))


def scan(
    rows: DataFrame,
    keys: list[str],
    entering: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Each row with `was_open`, `event` and the `state` after it; and per key and chunk the state after the chunk.

    `rows` have `eval`, `step`, `act`, `grace_due`, `severity`, `reason`; `entering` holds the `state` in which a key's first chunk
    is entered, if not an idle one. Keys may be null.
    """
    values = [c for c in rows.columns if c not in keys]
    first = ["eval", "step", *(c for c in values if c not in ("eval", "step"))]
    held = F.sort_array(F.collect_list(F.struct(*first))).alias("rows")
    dealt = keep(rows.withColumn("chunk", chunk_of(F.col("eval"))).groupBy(*keys, "chunk").agg(held))
    parts = dealt.select(*keys, "chunk", summary(F.col("rows")).alias("summary"))
    if entering is not None:
        parts = parts.unionByName(entering.select(*keys, F.lit(ANY).alias("chunk"), "state"), allowMissingColumns=True)
    else:
        parts = parts.withColumn("state", F.lit(None).cast(STATE))
    ordered = parts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("summary").isNotNull(), F.struct("chunk", "summary")))).alias("parts"),
        F.first("state", ignorenulls=True).alias("state"),
    )

    def follow(so_far: Column, part: Column) -> Column:
        after = applied(part["summary"], F.element_at(so_far, -1)["state"])
        return F.concat(so_far, F.array(F.struct(part["chunk"].alias("chunk"), after.alias("state"))))

    start = F.array(F.struct(F.lit(ANY).cast("bigint").alias("chunk"), F.coalesce("state", idle()).cast(STATE).alias("state")))
    states = ordered.select(*keys, F.aggregate("parts", start.cast(f"array<struct<chunk:bigint,state:{STATE}>>"), follow).alias("states"))
    pairs = F.transform(
        F.slice("states", F.lit(2), F.size("states")),
        lambda s, i: F.struct(s["chunk"].alias("chunk"), F.get(F.col("states"), i)["state"].alias("before"), s["state"].alias("after")),
    )
    between = states.select(*keys, F.inline(pairs))
    # Keys may be null, so they are matched null-safely under other names.
    known = between.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "chunk"]], "before")
    met = dealt.join(known, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "chunk"]])
    done = met.select(*keys, F.inline(F.arrays_zip("rows", replayed(F.col("rows"), F.col("before")).alias("done"))))
    return done.select(*keys, "rows.*", "done.*"), between.select(*keys, "chunk", F.col("after").alias("state"))
