"""Business marts over the Gold star.

Order marts have two inputs that give the same rows: the line fact, or `order_rollup`, which folds lines to their order
before the join with the headers. The rollup is the one to use on large data: an order that holds a large share of all
lines is folded map-side, the join carries one row per order, and counting orders needs no distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .star import MONEY, PRICE, line_amounts, order_headers

FULFILLED = "fulfilled"


def fulfilled(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("order_status") == FULFILLED)


def total(column: str | Column, kind: str, name: str) -> Column:
    """A sum cast once, after the exact addition."""
    return F.sum(column).cast(kind).alias(name)


def order_rollup(order_lines: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per fulfilled order that has lines: exact line totals beside the header columns.

    A header that comes twice, which a `warn` policy lets through, counts its lines twice and its order once, as in the line
    fact. Both sides of the join are by order already, so folding its copies moves no row.
    """
    headers = fulfilled(order_headers(orders))
    folded = (
        line_amounts(order_lines)
        .groupBy("order_id")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum("gross_amount").alias("gross_amount"),
            F.sum("discount_amount").alias("discount_amount"),
            F.sum("net_amount").alias("net_amount"),
        )
    )
    sums = [F.sum(c).alias(c) for c in folded.columns if c != "order_id"]
    return folded.join(headers, "order_id").groupBy(*headers.columns).agg(*sums)


def _order_count(rows: DataFrame, rolled_up: bool) -> Column:
    return F.count(F.lit(1)) if rolled_up else F.count_distinct("order_id")


def revenue_by_day(rows: DataFrame, *, rolled_up: bool = False) -> DataFrame:
    return (
        fulfilled(rows)
        .groupBy("order_date", F.col("order_region").alias("region"))
        .agg(
            _order_count(rows, rolled_up).cast("bigint").alias("order_count"),
            total("quantity", "bigint", "units_sold"),
            total("gross_amount", "double", "gross_revenue"),
            total("discount_amount", "double", "discount_amount"),
            total("net_amount", "double", "net_revenue"),
        )
    )


def revenue_by_channel(
    rows: DataFrame, channels: DataFrame, promotions: DataFrame, *, rolled_up: bool = False
) -> DataFrame:
    """A channel may hold a large share of all orders, so rows fold to their header's keys before the dimension joins.
    An order has one header, so the folded order counts add up."""
    folded = (
        fulfilled(rows)
        .groupBy("channel_id", "promotion_id", F.col("order_region").alias("region"))
        .agg(
            _order_count(rows, rolled_up).alias("orders"),
            F.sum("net_amount").alias("net"),
            F.sum("discount_amount").alias("discount"),
        )
    )
    return (
        folded.join(channels, "channel_id")
        .join(promotions, "promotion_id")
        .groupBy("channel_name", "channel_type", "discount_type", "region")
        .agg(
            F.sum("orders").cast("bigint").alias("order_count"),
            total("net", "double", "net_revenue"),
            total("discount", "double", "discount_amount"),
        )
    )


def revenue_by_segment(rows: DataFrame, accounts: DataFrame, *, rolled_up: bool = False) -> DataFrame:
    """Segments are few, but accounts are not: totals fold to the account before the account join."""
    per_account = (
        fulfilled(rows)
        .groupBy("account_id")
        .agg(_order_count(rows, rolled_up).alias("orders"), F.sum("net_amount").alias("net"))
    )
    # An order belongs to one account, so its accounts' order counts add up.
    return (
        per_account.join(accounts.select("account_id", "segment", "account_region"), "account_id")
        .groupBy("segment", F.col("account_region").alias("region"))
        .agg(F.sum("orders").cast("bigint").alias("order_count"), total("net", "double", "net_revenue"))
    )


def margin_by_product(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Margin from a fact that carries its cost. Lines fold to their product before the product join."""
    folded = (
        fulfilled(fact)
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("quantity").alias("units"),
            F.sum("net_amount").alias("net"),
            F.sum("cost_amount").alias("cost"),
            F.sum(F.col("net_amount") - F.col("cost_amount")).alias("margin"),
        )
    )
    return _margin(folded, products)


def margin_by_product_from_lines(order_lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """The same margin without the line fact: cost depends on product and quantity only, so lines fold to that pair
    before the product join, and a product that holds a large share of the lines reaches the join as a few rows."""
    paid = fulfilled(order_headers(orders)).select("order_id")
    pairs = (
        line_amounts(order_lines)
        .join(paid, "order_id", "left_semi")
        .groupBy("product_id", "quantity")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("net_amount").alias("net"))
    )
    costs = products.select("product_id", F.col("unit_cost").cast(PRICE).alias("unit_cost"))
    # Every line of a pair costs the same rounded amount.
    cost = (F.col("quantity") * F.col("unit_cost")).cast(MONEY) * F.col("lines")
    folded = (
        pairs.join(costs, "product_id")
        .withColumn("cost", cost.cast("decimal(38, 2)"))
        .groupBy("product_id")
        .agg(
            F.sum("lines").alias("lines"),
            F.sum(F.col("quantity") * F.col("lines")).alias("units"),
            F.sum("net").alias("net"),
            F.sum("cost").alias("cost"),
        )
        .withColumn("margin", F.col("net") - F.col("cost"))
    )
    return _margin(folded, products)


def _margin(folded: DataFrame, products: DataFrame) -> DataFrame:
    names = products.select("product_id", "product_name", "category")
    return folded.join(names, "product_id").select(
        "product_id",
        "product_name",
        "category",
        F.col("lines").cast("bigint").alias("line_count"),
        F.col("units").cast("bigint").alias("units_sold"),
        F.col("net").cast("double").alias("net_revenue"),
        F.col("cost").cast("double").alias("total_cost"),
        F.col("margin").cast("double").alias("gross_margin"),
    )


def share(condition: Column) -> Column:
    """The share of rows that meet a condition, as a double. A row where it is null counts as not met."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def customer_health(
    accounts: DataFrame, subscriptions: DataFrame, tickets: DataFrame, responses: DataFrame
) -> DataFrame:
    """One row per account and subscription, scored. Both event tables fold to the account before any join."""
    ticket_rollup = tickets.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.avg("resolution_hours").alias("hours"),
        share(F.col("sla_met")).alias("met"),
    )
    nps_rollup = responses.groupBy("account_id").agg(F.avg("score").alias("nps"))
    # The defaults of an account without tickets or answers, and the weights of the score.
    ticket_count = F.coalesce("tickets", F.lit(0).cast("bigint"))
    hours = F.coalesce("hours", F.lit(0.0))
    met = F.coalesce("met", F.lit(1.0))
    nps = F.coalesce("nps", F.lit(7.0))
    penalty = F.when(F.col("status") == "past_due", 20).otherwise(0)
    score = F.lit(50) + nps * 3 + met * 20 - ticket_count * 2 - penalty
    return (
        accounts.join(subscriptions.select("account_id", "status", "monthly_recurring_revenue"), "account_id")
        .join(ticket_rollup, "account_id", "left")
        .join(nps_rollup, "account_id", "left")
        .select(
            "account_id",
            "account_name",
            "segment",
            F.col("account_region").alias("region"),
            F.col("arr").cast("double").alias("arr"),
            F.col("status").alias("subscription_status"),
            F.col("monthly_recurring_revenue").cast("double").alias("monthly_recurring_revenue"),
            ticket_count.alias("ticket_count"),
            hours.alias("avg_resolution_hours"),
            met.alias("sla_rate"),
            nps.alias("avg_nps"),
            score.cast("double").alias("health_score"),
        )
    )


def churn_risk(health: DataFrame) -> DataFrame:
    band = F.when(F.col("health_score") < 55, "high").when(F.col("health_score") < 75, "medium").otherwise("low")
    # The mart keeps arr as a double; adding it as money keeps the total exact and independent of the row order.
    return (
        health.withColumn("churn_risk", band)
        .groupBy("segment", "region", "churn_risk")
        .agg(
            F.count(F.lit(1)).alias("account_count"),
            F.sum(F.col("arr").cast(MONEY)).cast("double").alias("arr_at_risk"),
            F.avg("health_score").alias("avg_health_score"),
        )
    )


def support_sla(accounts: DataFrame, tickets: DataFrame) -> DataFrame:
    folded = tickets.groupBy("account_id", "priority").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.avg("resolution_hours").alias("avg_resolution_hours"),
        F.count_if("sla_met").alias("tickets_met_sla"),
        share(F.col("sla_met")).alias("sla_rate"),
    )
    names = accounts.select("account_id", "account_name", "segment", F.col("account_region").alias("region"))
    return folded.join(names, "account_id").select(
        "account_id",
        "account_name",
        "segment",
        "region",
        "priority",
        "ticket_count",
        "avg_resolution_hours",
        "tickets_met_sla",
        "sla_rate",
    )


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Spark turns `row_number() = 1` into a group limit before the shuffle, so each task sends one row per key at most
    and a hot key never reaches one task whole.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def inventory_position(snapshots: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The newest snapshot of each warehouse and product; two on one date are told apart by their values."""
    newest = latest(
        snapshots,
        ["warehouse_id", "product_id"],
        [F.desc("snapshot_date"), F.asc("snapshot_id"), F.asc("on_hand_units"), F.asc("allocated_units")],
    )
    available = (F.col("on_hand_units") - F.col("allocated_units")).cast("int")
    names = warehouses.select("warehouse_id", "warehouse_name", F.col("warehouse_region").alias("region"))
    return newest.join(names, "warehouse_id").select(
        "product_id",
        "warehouse_id",
        "warehouse_name",
        "region",
        "snapshot_date",
        "on_hand_units",
        "allocated_units",
        available.alias("available_units"),
        "reorder_point",
        F.when(available <= F.col("reorder_point"), "reorder").otherwise("healthy").alias("inventory_status"),
    )


def stockout_risk(position: DataFrame, stockouts: DataFrame) -> DataFrame:
    folded = stockouts.groupBy("warehouse_id", "product_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("lost_units").cast("bigint").alias("lost")
    )
    events = F.coalesce("events", F.lit(0).cast("bigint"))
    reorder = F.col("inventory_status") == "reorder"
    return position.join(folded, ["warehouse_id", "product_id"], "left").select(
        "product_id",
        "warehouse_id",
        "warehouse_name",
        "region",
        "available_units",
        "reorder_point",
        "inventory_status",
        events.alias("stockout_event_count"),
        F.coalesce("lost", F.lit(0).cast("bigint")).alias("lost_units"),
        F.when(reorder & (events >= 1), "high").when(reorder, "medium").otherwise("low").alias("stockout_risk"),
    )


def supplier_reliability(receipts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Delivered orders only, folded to the supplier before the supplier join."""
    folded = (
        receipts.where(F.col("delivered_date").isNotNull())
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("purchase_order_count"),
            total("ordered_units", "bigint", "ordered_units"),
            total("received_units", "bigint", "received_units"),
            F.avg(F.datediff("delivered_date", "expected_date")).alias("avg_days_late"),
            share(F.col("delivered_date") <= F.col("expected_date")).alias("on_time_rate"),
        )
    )
    return folded.join(suppliers, "supplier_id").select(
        "supplier_id",
        "supplier_name",
        "country",
        "risk_tier",
        "purchase_order_count",
        "ordered_units",
        "received_units",
        "avg_days_late",
        "on_time_rate",
    )
