"""Sums of doubles that do not depend on the order of the rows, whatever their sizes.

A double is cut into whole numbers of BITS bits at fixed powers of two, which is exact. Whole numbers add up exactly in any order, map-side
first, so a group is a few rows per task: one per power that its values reach. At the end a group's few totals are added from
the largest power down, with the rounding errors carried along, and rounded once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
# The 53 bits of a double lie in three slots; one more, as the logarithm may name the slot above.
SLOTS = 4
LOWEST = -1074


def _unit(slot: Column) -> Column:
    return F.pow(F.lit(2.0), F.greatest(slot * BITS, F.lit(LOWEST)).cast("double"))


def _added(state: Column, term: Column) -> Column:
    """Neumaier's step: the sum, and what rounding took from it."""
    total = state["s"] + term
    lost = F.when(F.abs(state["s"]) >= F.abs(term), (state["s"] - total) + term).otherwise((term - total) + state["s"])
    return F.struct(total.alias("s"), (state["c"] + lost).alias("c"))


def _rounded(slots: Column) -> Column:
    """The double nearest to the sum of the slots, largest first; each total may be longer than a double."""

    def merge(state: Column, slot: Column) -> Column:
        head = slot["total"].cast("double")
        rest = (slot["total"] - head.cast("decimal(38,0)")).cast("double")
        return _added(_added(state, head * _unit(slot["slot"])), rest * _unit(slot["slot"]))

    return F.aggregate(slots, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), merge, lambda state: state["s"] + state["c"])


def sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per group the sum of each column of `values` as a double, null if it has no value; infinities and NaN as in any sum.

    `weight` is a whole number of times that a row counts.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("_v"), F.col(f"`{v}`").cast("double").alias("_x")) for i, v in enumerate(values)])
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = df.select(*keys, times.alias("_n"), F.inline(listed)).where(F.col("_x").isNotNull())
    odd = F.isnan("_x") | (F.abs("_x") == float("inf"))
    left = F.when(odd, 0.0).otherwise(F.col("_x"))
    rows = rows.withColumns({"_odd": F.when(odd, F.col("_x")), "_left": left})
    rows = rows.withColumn("_top", F.when(F.col("_left") == 0, 0).otherwise(F.floor(F.log2(F.abs("_left")) / BITS)).cast("bigint"))
    for i in range(SLOTS):
        unit = _unit(F.col("_top") - i)
        scaled = F.col("_left") / unit
        rows = rows.withColumn(f"_p{i}", F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("bigint"))
        rows = rows.withColumn("_left", F.col("_left") - F.col(f"_p{i}") * unit)
    parts = F.array(*[F.struct((F.col("_top") - i).alias("slot"), F.col(f"_p{i}").alias("part")) for i in range(SLOTS)])
    # A zero needs no slot of its own, but a group of zeros has a sum.
    kept = F.filter(parts, lambda p, i: (i == 0) | (p["part"] != 0))
    spread = rows.select(*keys, "_v", "_n", "_odd", F.explode(kept).alias("p"))
    total = F.sum(F.col("p.part").cast("decimal(10,0)") * F.col("_n").cast("decimal(19,0)")).cast("decimal(38,0)")
    slots = spread.groupBy(*keys, "_v", "p.slot").agg(total.alias("total"), F.sum("_odd").alias("_odd"))
    # One row per slot: at most 83 of a group.
    per = slots.groupBy(*keys, "_v").agg(
        F.sort_array(F.collect_list(F.struct("slot", "total")), asc=False).alias("slots"), F.sum("_odd").alias("_odd")
    )
    done = per.withColumn("_sum", F.coalesce("_odd", _rounded(F.col("slots"))))
    return done.groupBy(*keys).agg(*[F.max(F.when(F.col("_v") == i, F.col("_sum"))).alias(v) for i, v in enumerate(values)])


def with_means(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """`table`, a row per group of `df`, with the mean of each column of `values` over the group's rows that have one."""
    added = sums(df, keys, values).select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"_{v}_sum") for v in values])
    counted = df.groupBy(*keys).agg(*[F.count(v).alias(f"_{v}_n") for v in values])
    counted = counted.join(added, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    means = [(F.col(f"_{v}_sum") / F.nullif(F.col(f"_{v}_n"), F.lit(0))).alias(v) for v in values]
    found = counted.select(*[F.col(k).alias(f"_{k}") for k in keys], *means)
    return table.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*table.columns, *values)
