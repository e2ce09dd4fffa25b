"""Data tests over Gold tables. Each returns the failing rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.marts import fulfilled
from .validate import repeated_keys


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values held by more than one row. Nulls are the not_null test's business."""
    return repeated_keys(df, [column])


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations held by more than one row, null parts included."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without a parent, with their number of rows. Rows fold to their key before the join, so a key that
    many rows hold reaches it once per task."""
    held = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk)).agg(F.count(F.lit(1)).alias("n_records"))
    known = parent.select(F.col(pk).alias(fk)).where(F.col(fk).isNotNull())
    return held.join(known, fk, "left_anti")


def total_matches_fact(mart: DataFrame, fact: DataFrame, column: str = "net_revenue", tolerance: float = 0.01) -> DataFrame:
    """The mart's total beside the fulfilled total of the fact, when they differ by more than the tolerance."""
    return drifted(mart.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("mart_total")), fact, tolerance)


def drifted(mart_total: DataFrame, fact: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """A one-row `mart_total` beside the fact's fulfilled total, when they differ."""
    fact_total = fulfilled(fact).agg(F.coalesce(F.sum("net_amount"), F.lit(0)).cast("double").alias("fact_total"))
    # Two one-row totals side by side, without a join.
    both = mart_total.unionByName(fact_total, allowMissingColumns=True).agg(
        F.max("mart_total").alias("mart_total"), F.max("fact_total").alias("fact_total")
    )
    return both.where(F.abs(F.col("mart_total") - F.col("fact_total")) > tolerance)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


@dataclass(frozen=True)
class Suite:
    """The tests declared over a set of tables."""

    not_null: Mapping[str, Sequence[str]]
    unique: Mapping[str, str]
    combinations: Mapping[str, Sequence[str]]
    relationships: Sequence[tuple[str, str, str, str]]
    reconciled: Sequence[str]
    fact: str

    def run(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """One row per test: table, test, columns, number of failing rows (keys, for the key tests)."""
        return union(list(self.by_table(tables).values()))

    def by_table(self, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The rows of `run`, apart for each table that has tests.

        All tests in one plan are one job, whose stages are all on the driver at once with the states of their tasks, and the
        whole plan is told anew with each stage that ends. Where tables are large, run one table's tests after another's.
        """
        parts: dict[str, list[DataFrame]] = {}

        def add(table: str, rows: DataFrame) -> None:
            parts.setdefault(table, []).append(rows)

        def failures(table: str, test: str, columns: str, failing: DataFrame) -> None:
            counted = failing.agg(F.count(F.lit(1)).alias("failures")).select(
                F.lit(table).alias("model"), F.lit(test).alias("test"), F.lit(columns).alias("columns"), "failures"
            )
            add(table, counted)

        for name, columns in self.not_null.items():
            add(name, _null_counts(name, tables[name], columns))
        for name, column in self.unique.items():
            failures(name, "unique", column, unique(tables[name], column))
        for name, columns in self.combinations.items():
            failures(name, "unique_combination", ",".join(columns), unique_combination(tables[name], columns))
        for child, fk, parent, pk in self.relationships:
            failures(child, "relationships", fk, orphans(tables[child], fk, tables[parent], pk))
        for name in self.reconciled:
            failures(name, "net_revenue_matches_fact", "net_revenue", total_matches_fact(tables[name], tables[self.fact]))
        return {name: union(rows) for name, rows in parts.items()}


def _null_counts(name: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every not_null test of a table from one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("columns"), F.col(c).alias("failures")) for c in columns])
    return counts.select(F.inline(pairs)).select(
        F.lit(name).alias("model"), F.lit("not_null").alias("test"), "columns", "failures"
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    merge: Callable[[DataFrame, DataFrame], DataFrame] = DataFrame.unionByName
    result = parts[0]
    for part in parts[1:]:
        result = merge(result, part)
    return result


_KEYS = {
    "dim_account": "account_id",
    "dim_product": "product_id",
    "dim_channel": "channel_id",
    "dim_promotion": "promotion_id",
    "dim_supplier": "supplier_id",
    "dim_warehouse": "warehouse_id",
    "fct_order_lines": "line_id",
    "fct_subscriptions": "subscription_id",
    "fct_support_tickets": "ticket_id",
    "fct_nps_responses": "response_id",
    "fct_inventory_snapshots": "snapshot_id",
    "fct_purchase_order_receipts": "purchase_order_id",
    "fct_stockout_events": "event_id",
    "mart_customer_health_score": "account_id",
    "mart_supplier_delivery_reliability": "supplier_id",
}
_GRAINS = {
    "mart_churn_risk_by_segment": ("segment", "region", "churn_risk"),
    "mart_support_sla_by_customer": ("account_id", "priority"),
    "mart_inventory_position": ("product_id", "warehouse_id"),
    "mart_stockout_risk": ("product_id", "warehouse_id"),
    "mart_order_revenue_by_day": ("order_date", "region"),
    "mart_order_revenue_by_channel": ("channel_name", "channel_type", "discount_type", "region"),
    "mart_order_revenue_margin_by_product": ("product_id", "product_name", "category"),
    "mart_order_revenue_by_account_segment": ("segment", "region"),
}
_LINKS = [
    ("fct_order_lines", "account_id", "dim_account"),
    ("fct_order_lines", "channel_id", "dim_channel"),
    ("fct_order_lines", "promotion_id", "dim_promotion"),
    ("fct_order_lines", "product_id", "dim_product"),
    ("fct_subscriptions", "account_id", "dim_account"),
    ("fct_support_tickets", "account_id", "dim_account"),
    ("fct_nps_responses", "account_id", "dim_account"),
    ("fct_inventory_snapshots", "warehouse_id", "dim_warehouse"),
    ("fct_inventory_snapshots", "product_id", "dim_product"),
    ("fct_stockout_events", "warehouse_id", "dim_warehouse"),
    ("fct_stockout_events", "product_id", "dim_product"),
    ("fct_purchase_order_receipts", "supplier_id", "dim_supplier"),
    ("fct_purchase_order_receipts", "product_id", "dim_product"),
    ("fct_purchase_order_receipts", "warehouse_id", "dim_warehouse"),
]
_REQUIRED: dict[str, list[str]] = {name: [key] for name, key in _KEYS.items()}
for _child, _fk, _ in _LINKS:
    _REQUIRED[_child].append(_fk)
_REQUIRED["fct_order_lines"].append("order_id")
for _name, _grain in _GRAINS.items():
    _REQUIRED[_name] = list(_grain)

# The tests declared over the Gold tables. Keys, links and grains must be present, keys must be unique.
GOLD_SUITE = Suite(
    not_null=_REQUIRED,
    unique=_KEYS,
    combinations=_GRAINS,
    relationships=[(child, fk, parent, fk) for child, fk, parent in _LINKS],
    reconciled=[name for name in _GRAINS if name.startswith("mart_order_revenue")],
    fact="fct_order_lines",
)
