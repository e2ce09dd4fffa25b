"""Declared Silver contracts: columns, types, nullability, primary key, load mode and policy."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

TYPES = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "number": T.DoubleType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
}
SEVERITIES = ("warn", "reject", "abort")


class ContractError(ValueError):
    """A contract that contradicts itself."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = False


@dataclass(frozen=True)
class Policy:
    """What a violation does. `max_rejection_rate` is a share from 0 to 1 and belongs to `reject` only."""

    severity: str = "reject"
    max_rejection_rate: float | None = None

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ContractError(f"policy severity {self.severity!r} is not one of {SEVERITIES}")
        if self.max_rejection_rate is not None:
            if self.severity != "reject":
                raise ContractError("max_rejection_rate needs severity reject")
            if not 0 <= self.max_rejection_rate <= 1:
                raise ContractError("max_rejection_rate is a share from 0 to 1")


@dataclass(frozen=True)
class Load:
    """How a resource lands: in full, or the rows past `cursor`, versioned by `primary_key`."""

    mode: str = "full"
    cursor: str | None = None
    primary_key: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in ("full", "incremental"):
            raise ContractError(f"load mode {self.mode!r} is neither full nor incremental")
        if (self.mode == "incremental") != bool(self.cursor and self.primary_key):
            raise ContractError("an incremental load, and only that, names a cursor and a primary key")


@dataclass(frozen=True)
class Contract:
    name: str
    domain: str
    source: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...]
    policy: Policy = field(default_factory=Policy)
    load: Load = field(default_factory=Load)
    write_mode: str = "overwrite"
    # Whether a quoted field of the source's files may hold line breaks. If none does, large files are split over tasks.
    multiline: bool = True

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ContractError(f"{self.name}: a column is declared twice")
        for f in self.fields:
            if f.type not in TYPES:
                raise ContractError(f"{self.name}.{f.name}: unknown type {f.type!r}")
        if missing := set(self.primary_key) - set(names):
            raise ContractError(f"{self.name}: primary key columns {sorted(missing)} are not declared")
        incremental = self.load.mode == "incremental"
        if incremental and self.write_mode not in ("append", "merge_scd1", "merge_scd2"):
            raise ContractError(f"{self.name}: an incremental resource cannot be written with {self.write_mode}")
        if not incremental and self.write_mode == "append":
            raise ContractError(f"{self.name}: append would add every row of a full resource again on each run")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], f.nullable) for f in self.fields])

    @property
    def raw_schema(self) -> T.StructType:
        """Every source column as text: typing is the contract's work, never the reader's."""
        return T.StructType([T.StructField(f.name, T.StringType(), True) for f in self.fields])

    def with_policy(self, severity: str, max_rejection_rate: float | None = None) -> Contract:
        return replace(self, policy=Policy(severity, max_rejection_rate))


def _entity(domain: str, source: str, name: str, key: str, columns: str) -> Contract:
    fields = tuple(Field(*column.split(":")) for column in columns.split())
    return Contract(name, domain, source, fields, (key,))


# The declared entities. A column without a type of its own is text; every column is required.
CONTRACTS: dict[str, Contract] = {
    contract.name: contract
    for contract in (
        _entity(
            "sales", "crm", "accounts", "account_id",
            "account_id:string account_name:string segment:string region:string signup_date:date arr:number",
        ),
        _entity("sales", "crm", "channels", "channel_id", "channel_id:string channel_name:string channel_type:string"),
        _entity(
            "sales", "crm", "nps_responses", "response_id",
            "response_id:string account_id:string response_date:date score:integer",
        ),
        _entity(
            "sales", "crm", "order_lines", "line_id",
            "line_id:string order_id:string product_id:string quantity:integer unit_price:number "
            "discount_amount:number",
        ),
        _entity(
            "sales", "crm", "orders", "order_id",
            "order_id:string customer_id:string order_date:date channel_id:string promotion_id:string region:string "
            "status:string",
        ),
        _entity(
            "sales", "crm", "products", "product_id",
            "product_id:string product_name:string category:string unit_cost:number",
        ),
        _entity(
            "sales", "crm", "promotions", "promotion_id",
            "promotion_id:string promotion_name:string discount_type:string",
        ),
        _entity(
            "sales", "crm", "subscriptions", "subscription_id",
            "subscription_id:string account_id:string plan_name:string status:string start_date:date "
            "renewal_date:date monthly_recurring_revenue:number",
        ),
        _entity(
            "sales", "crm", "support_tickets", "ticket_id",
            "ticket_id:string account_id:string opened_date:date priority:string resolution_hours:integer "
            "sla_met:boolean",
        ),
        _entity(
            "supply_chain", "erp", "inventory_snapshots", "snapshot_id",
            "snapshot_id:string snapshot_date:date warehouse_id:string product_id:string on_hand_units:integer "
            "allocated_units:integer reorder_point:integer",
        ),
        _entity(
            "supply_chain", "erp", "purchase_orders", "purchase_order_id",
            "purchase_order_id:string supplier_id:string product_id:string warehouse_id:string order_date:date "
            "expected_date:date ordered_units:integer",
        ),
        _entity(
            "supply_chain", "erp", "shipments", "shipment_id",
            "shipment_id:string purchase_order_id:string ship_date:date delivered_date:date received_units:integer",
        ),
        _entity(
            "supply_chain", "erp", "stockout_events", "event_id",
            "event_id:string event_date:date warehouse_id:string product_id:string lost_units:integer "
            "root_cause:string",
        ),
        _entity(
            "supply_chain", "erp", "suppliers", "supplier_id",
            "supplier_id:string supplier_name:string country:string risk_tier:string",
        ),
        _entity(
            "supply_chain", "erp", "warehouses", "warehouse_id",
            "warehouse_id:string warehouse_name:string region:string capacity_units:integer",
        ),
    )
}
