"""Dashboard aggregates over the marts. A chart orders by its metric, then by its groups, so its cut is repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import exact
from .marts import MONEY


def _chart(
    mart: DataFrame, groups: Sequence[str | Column], measures: Sequence[Column], limit: int, means: Sequence[str] = ()
) -> DataFrame:
    """The largest groups by the first measure; `means` are averages, which come after the measures."""
    table = mart.groupBy(*groups).agg(*measures) if measures else mart.select(*groups).distinct()
    names = table.columns[: len(table.columns) - len(measures)]
    table = exact.with_means(mart, table, names, means) if means else table
    return table.orderBy(F.desc_nulls_last(table.columns[len(names)]), *names).limit(limit)


def _sum(column: str, kind: str = MONEY) -> Column:
    """Marts keep money as doubles; adding it as decimals gives one total in any row order."""
    return F.sum(F.col(column).cast(kind)).cast("double").alias(column)


def _units(column: str) -> Column:
    return F.sum(column).cast("bigint").alias(column)


def daily_net_revenue(by_day: DataFrame) -> DataFrame:
    day = F.date_trunc("day", "order_date").cast("date").alias("day")
    return _chart(by_day, [day, "region"], [_sum("net_revenue")], 1000)


def revenue_by_channel(by_channel: DataFrame) -> DataFrame:
    return _chart(by_channel, ["channel_name", "channel_type"], [_sum("net_revenue")], 100)


def margin_by_product(margin: DataFrame) -> DataFrame:
    return _chart(margin, ["category", "product_name"], [_sum("net_revenue"), _sum("gross_margin")], 100)


def discount_impact(by_channel: DataFrame) -> DataFrame:
    return _chart(by_channel, ["discount_type"], [_sum("discount_amount")], 100)


def health_by_segment(health: DataFrame) -> DataFrame:
    return _chart(health, ["segment", "region"], [], 100, ["health_score"])


def arr_at_risk(churn: DataFrame) -> DataFrame:
    return _chart(churn, ["segment", "churn_risk"], [_sum("arr_at_risk")], 100)


def sla_by_priority(sla: DataFrame) -> DataFrame:
    return _chart(sla, ["priority", "segment"], [], 100, ["sla_rate"])


def account_table(health: DataFrame) -> DataFrame:
    return _chart(health, ["account_name", "segment"], [_sum("arr")], 100, ["health_score"])


def inventory_by_status(position: DataFrame) -> DataFrame:
    return _chart(position, ["inventory_status", "region"], [_units("available_units")], 100)


def stockout_table(risk: DataFrame) -> DataFrame:
    return _chart(
        risk,
        ["warehouse_name", "product_id", "stockout_risk"],
        [_units("stockout_event_count"), _units("lost_units")],
        100,
    )


def supplier_on_time(reliability: DataFrame) -> DataFrame:
    return _chart(reliability, ["supplier_name", "risk_tier"], [], 100, ["on_time_rate"])


def supplier_lateness(reliability: DataFrame) -> DataFrame:
    return _chart(reliability, ["supplier_name", "risk_tier"], [], 100, ["avg_days_late"])
