"""Incremental reads of a source table: past a cursor, within a row budget, nothing skipped."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.marts import latest
from ..session import cut
from .loads import cursor_value, last_cursor


class CursorNotReached(RuntimeError):
    """The budget ended before the last loaded row: moving the cursor would skip rows never read."""


def keyset_extract(table: DataFrame, cursor: str, last: Any, max_rows: int, refuse: bool = True) -> DataFrame:
    """The next rows past the cursor, in its order, at most `max_rows`. The cursor is any ordered column.

    Rows of one cursor value come together, as the next slice starts past it; a value that more than `max_rows` rows share
    is refused, or without `refuse` gives a slice of no rows. A row without a cursor has no place in the order and is in no slice. The result is a range of the cursor,
    so it stays spread over as many tasks as the scan, whatever the budget.
    """
    past = table.where(F.col(cursor).isNotNull() if last is None else F.col(cursor) > F.lit(last))
    return within(past, cursor, max_rows, refuse=refuse)


def within(rows: DataFrame, cursor: str, budget: int, newest: bool = False, refuse: bool = True) -> DataFrame:
    """The smallest, or `newest` the largest, cursor values whose rows fit the budget; all rows if they do.

    Rows are counted per value before anything is sorted. The counts are cut into ranges of values, one number per range
    reaches the driver, and only the range in which the budget ends is summed value by value. Where not even the first value
    fits, `refuse` raises, as a run after it would come to the same value; else no row is within the budget.
    """
    if budget < 1:
        raise ValueError("a row budget is at least one row")
    counts = rows.where(F.col(cursor).isNotNull()).groupBy(F.col(cursor).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = F.desc("v") if newest else F.asc("v")
    # Written, as a second run of the sampling could cut other ranges.
    ranged = cut(counts.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    before = 0
    for number, n in sorted(tuple(r) for r in ranged.groupBy("range").agg(F.sum("n")).collect()):
        if before + n > budget:
            running = F.sum("n").over(Window.orderBy(order)) + before
            inside = ranged.where(F.col("range") == number).withColumn("upto", running).where(F.col("upto") <= budget)
            reached = ranged.where(F.col("range") < number).select("v").union(inside.select("v"))
            bound = last_cursor(reached, "v", smallest=newest)
            if bound is None:
                if not refuse:
                    return rows.where(F.lit(False))
                raise CursorNotReached(f"more than {budget} rows share the next value of {cursor}")
            limit = cursor_value(rows, cursor, bound)
            return rows.where(F.col(cursor) >= limit if newest else F.col(cursor) <= limit)
        before += n
    return rows.where(F.col(cursor).isNotNull())


def newest_first_extract(
    table: DataFrame, cursor: str, key: str, last: Any, page_size: int, max_pages: int
) -> DataFrame:
    """The newest row of each key changed since the cursor, newest first, within `max_pages` of `page_size` rows.

    With a cursor, a budget that ends before reaching it raises. Without one, the budget's newest rows are the backfill;
    rows of one cursor value are in it together or not at all.
    """
    budget = page_size * max_pages
    tie = [F.col(c).asc() for c in table.columns if c not in (cursor, key)]
    if last is not None:
        rows = table.where(F.col(cursor) > F.lit(last))
        if rows.count() >= budget:
            raise CursorNotReached(f"{max_pages} pages of {page_size} did not reach {cursor} = {last}")
    else:
        rows = within(table, cursor, budget, newest=True)
    return latest(rows, [key], [F.col(cursor).desc(), *tie])
