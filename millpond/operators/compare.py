"""Table compare, retention, keyset pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import holds

MIN_RETENTION_DAYS = 7


def table_diff(
    declared: DataFrame,
    held: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    sets: Sequence[str] = (),
    *,
    managed: str | None = None,
    problem: str | None = None,
) -> DataFrame:
    """Where two tables differ: `missing`, `stale`, `changed` with its fields, `unresolved`.

    `sets` are arrays of which only a missing element counts: extra ones are the holder's. `managed` names a flag of the
    held rows: only marked rows can be stale, and a held row that lost its mark has changed. `problem` names a text of the
    declared rows that says why they could not be resolved. A key is expected once on each side; of several rows the
    largest is compared.
    """
    left = declared.select(*key, F.struct(*fields, *sets, *([problem] if problem else [])).alias("d"))
    right = held.select(*key, F.struct(*fields, *sets, *([managed] if managed else [])).alias("h"))
    # Both sides fold to their key in one aggregate: a key that repeats on both never gives all its pairs.
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*key).agg(
        F.max("d").alias("d"), F.max("h").alias("h")
    )
    marked = F.coalesce(F.col(f"h.{managed}"), F.lit(False)) if managed else F.lit(True)
    differs = [
        F.when(~F.col(f"d.{name}").eqNullSafe(F.col(f"h.{name}")), F.lit(name)) for name in fields
    ]
    for name in sets:
        gone = F.array_sort(F.array_except(_array(f"d.{name}"), _array(f"h.{name}")))
        differs.append(
            F.when(F.size(gone) > 0, F.concat(F.lit(f"{name} (missing "), F.concat_ws(", ", gone), F.lit(")")))
        )
    if managed:
        differs.append(F.when(~marked, F.lit(managed)))
    changed = F.array_compact(F.array(*differs))
    only_declared, only_held = F.col("h").isNull(), F.col("d").isNull()
    unresolved = F.col(f"d.{problem}").isNotNull() if problem else F.lit(False)
    kind = (
        F.when(unresolved, "unresolved")
        .when(only_declared, "missing")
        .when(only_held, F.when(marked, "stale"))
        .when(F.size(changed) > 0, "changed")
    )
    detail = F.when(kind == "changed", F.concat_ws(", ", changed))
    if problem:
        detail = F.when(unresolved, F.col(f"d.{problem}")).otherwise(detail)
    return (
        both.select(*key, kind.alias("kind"), F.coalesce(detail, F.lit("")).alias("detail"))
        .where("kind is not null")
    )


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def retention_candidates(
    snapshots: DataFrame, refs: DataFrame, now: str, older_than_days: int, key: str = "snapshot_id"
) -> DataFrame:
    """Snapshots past the window that no reference holds. A null reference holds nothing."""
    if older_than_days < MIN_RETENTION_DAYS:
        raise ValueError(f"the retention window is at least {MIN_RETENTION_DAYS} days")
    limit = F.lit(now).cast("timestamp") - F.expr(f"interval {int(older_than_days)} days")
    held = refs.select(key).where(F.col(key).isNotNull())
    return snapshots.where(F.col("committed_at").cast("timestamp") < limit).join(held, key, "left_anti")


def contains(column: Column, text: str) -> Column:
    """Case-folded substring; the text stands for itself, wildcards included."""
    return holds(column, text)


def keyset_page(
    names: DataFrame, column: str, limit: int, text: str | None = None, after: str | None = None
) -> DataFrame:
    """A page of names in order, with the cursor of the next page on each row, null on the last page.

    One name more than the page is read to know whether there is a next one.
    """
    rows = names.select(column)
    if text:
        rows = rows.where(contains(F.col(column), text))
    if after is not None:
        rows = rows.where(F.col(column) > after)
    # At most limit + 1 rows from here on, so the unpartitioned windows are small.
    found = rows.orderBy(column).limit(limit + 1)
    everything = Window.partitionBy(F.lit(0))
    placed = found.withColumns(
        {
            "_place": F.row_number().over(everything.orderBy(column)),
            "_n": F.count(F.lit(1)).over(everything),
        }
    ).where(F.col("_place") <= limit)
    last = F.max(column).over(everything)
    cursor = F.when(F.col("_n") > limit, F.translate(F.base64(F.encode(last, "utf-8")), "+/", "-_"))
    return placed.select(column, cursor.alias("next_cursor"))
