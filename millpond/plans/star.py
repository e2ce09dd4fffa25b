"""Typed facts and dimensions over the accepted Silver rows.

Every function takes the Silver tables it reads and returns the Gold table; nothing is collected and no size is assumed.
A dimension is never hinted to broadcast: Spark broadcasts it only while its measured size stays under
`spark.sql.autoBroadcastJoinThreshold`, and past that AQE splits a hot key of the fact side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18, 2)"
PRICE = "decimal(18, 4)"


def _typed(df: DataFrame, **types: str) -> list[Column]:
    return [F.col(name).cast(types[name]).alias(name) if name in types else F.col(name) for name in df.columns]


def dim_account(accounts: DataFrame) -> DataFrame:
    return accounts.select(
        "account_id",
        "account_name",
        "segment",
        F.col("region").alias("account_region"),
        F.col("signup_date").cast("date").alias("signup_date"),
        F.col("arr").cast(MONEY).alias("arr"),
    )


def dim_product(products: DataFrame) -> DataFrame:
    return products.select("product_id", "product_name", "category", F.col("unit_cost").cast(PRICE).alias("unit_cost"))


def dim_channel(channels: DataFrame) -> DataFrame:
    return channels.select("channel_id", "channel_name", "channel_type")


def dim_promotion(promotions: DataFrame) -> DataFrame:
    return promotions.select("promotion_id", "promotion_name", "discount_type")


def dim_supplier(suppliers: DataFrame) -> DataFrame:
    return suppliers.select("supplier_id", "supplier_name", "country", "risk_tier")


def dim_warehouse(warehouses: DataFrame) -> DataFrame:
    return warehouses.select(
        "warehouse_id",
        "warehouse_name",
        F.col("region").alias("warehouse_region"),
        F.col("capacity_units").cast("int").alias("capacity_units"),
    )


def line_amounts(order_lines: DataFrame) -> DataFrame:
    """Order lines with gross and net: the product is exact and each amount is rounded once, at the end."""
    lines = order_lines.select(
        *_typed(order_lines, quantity="int", unit_price=PRICE, discount_amount=MONEY),
    )
    gross = F.col("quantity") * F.col("unit_price")
    return lines.withColumns(
        {
            "gross_amount": gross.cast(MONEY),
            "net_amount": (gross - F.col("discount_amount")).cast(MONEY),
        }
    )


def order_headers(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        F.col("order_date").cast("date").alias("order_date"),
        F.col("status").alias("order_status"),
        F.col("region").alias("order_region"),
        F.col("customer_id").alias("account_id"),
        "channel_id",
        "promotion_id",
    )


def fct_order_lines(order_lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order line. A line whose header or product is missing stays, with nulls, for the data tests."""
    lines = line_amounts(order_lines)
    costs = products.select("product_id", F.col("unit_cost").cast(PRICE).alias("unit_cost"))
    return (
        lines.join(order_headers(orders), "order_id", "left")
        .join(costs, "product_id", "left")
        .select(
            "line_id",
            "order_id",
            "order_date",
            "order_status",
            "order_region",
            "account_id",
            "channel_id",
            "promotion_id",
            "product_id",
            "quantity",
            "unit_price",
            "gross_amount",
            "discount_amount",
            "net_amount",
            (F.col("quantity") * F.col("unit_cost")).cast(MONEY).alias("cost_amount"),
        )
    )


def fct_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.select(
        "subscription_id",
        "account_id",
        "plan_name",
        "status",
        F.col("start_date").cast("date").alias("start_date"),
        F.col("renewal_date").cast("date").alias("renewal_date"),
        F.col("monthly_recurring_revenue").cast(MONEY).alias("monthly_recurring_revenue"),
    )


def fct_support_tickets(tickets: DataFrame) -> DataFrame:
    columns = ["ticket_id", "account_id", "opened_date", "priority", "resolution_hours", "sla_met"]
    return tickets.select(columns).select(
        *_typed(tickets.select(columns), opened_date="date", resolution_hours="int", sla_met="boolean")
    )


def fct_nps_responses(responses: DataFrame) -> DataFrame:
    kept = responses.select("response_id", "account_id", "response_date", "score")
    return kept.select(*_typed(kept, response_date="date", score="int"))


def fct_inventory_snapshots(snapshots: DataFrame) -> DataFrame:
    """Stock counts. Units add up across warehouses and products of one date, never across dates."""
    kept = snapshots.select(
        "snapshot_id",
        "snapshot_date",
        "warehouse_id",
        "product_id",
        "on_hand_units",
        "allocated_units",
        "reorder_point",
    )
    return kept.select(
        *_typed(kept, snapshot_date="date", on_hand_units="int", allocated_units="int", reorder_point="int")
    )


def fct_stockout_events(events: DataFrame) -> DataFrame:
    kept = events.select("event_id", "event_date", "warehouse_id", "product_id", "lost_units", "root_cause")
    return kept.select(*_typed(kept, event_date="date", lost_units="int"))


def fct_purchase_order_receipts(purchase_orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """One row per purchase order. Shipments fold to the order first, so a part delivery cannot fan the order out."""
    received = shipments.groupBy("purchase_order_id").agg(
        F.count(F.lit(1)).cast("int").alias("shipment_count"),
        F.min(F.col("ship_date").cast("date")).alias("ship_date"),
        F.max(F.col("delivered_date").cast("date")).alias("delivered_date"),
        F.sum("received_units").cast("int").alias("received_units"),
    )
    return purchase_orders.join(received, "purchase_order_id", "left").select(
        "purchase_order_id",
        "supplier_id",
        "product_id",
        "warehouse_id",
        F.col("order_date").cast("date").alias("order_date"),
        F.col("expected_date").cast("date").alias("expected_date"),
        F.col("ordered_units").cast("int").alias("ordered_units"),
        F.coalesce("shipment_count", F.lit(0)).alias("shipment_count"),
        "ship_date",
        "delivered_date",
        "received_units",
    )
