"""A product run from landed CSV to Gold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import product
from ..contracts import CONTRACTS, Contract, Field, Load
from ..operators.validate import RunAborted
from ..registry import register
from ..session import scratch, table
from ..shapes import ctes, view
from ..sources.files import land_csv, raw_view
from .gold import BY_DAY, FACT, FACT_VIEWS, HEALTH, HEALTH_VIEWS, POSITION, RISK, RISK_VIEWS

OBSERVED = 1706659200000000
KEYS = {name: CONTRACTS[name].primary_key[0] for name in product.SALES_ENTITIES}


def _land(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> str:
    root = scratch(spark, "product")
    for name in names:
        contract = CONTRACTS[name]
        land_csv(raw_view(view(spark, sf_dir, f"{name}_v"), contract), f"{root}/bronze/{contract.source}/{name}")
    return root


def _run(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    root = _land(spark, sf_dir, product.SALES_ENTITIES)
    run = product.Run(spark, f"{root}/bronze", root, "dev", "order_revenue", "run_1")
    return product.run_sales(run, OBSERVED)


# Of the lines with one id the first by row stays.
KEPT = """select * exclude (rn) from (select *, row_number() over (partition by line_id order by order_id::varchar,
product_id::varchar, quantity::varchar, unit_price::varchar, discount_amount::varchar) as rn from order_lines_v)
where rn = 1"""


@register(
    "product_run_revenue",
    "A1",
    "B7",
    "C5",
    "D1",
    sql=ctes(*FACT_VIEWS, kept=KEPT, fact=FACT.replace("order_lines_v", "kept")) + BY_DAY,
)
def _revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue of a whole run: text files, contracts, fact, mart."""
    return _run(spark, sf_dir)[0]["mart_order_revenue_by_day"]


@register(
    "product_run_checks",
    "B9",
    "B11",
    "L9",
    sql=ctes(*[f"{name}_v" for name in KEYS]) + " union all ".join(
        f"""select '{name}' as table_name, unnest(['cast_error', 'not_null', 'unique', 'schema_mismatch', 'file_status'])
        as check_id, case when n > 0 and check_id in ('unique', 'file_status') then 'error' else 'passed' end as outcome
        from (select count(*) - count(distinct {key}) as n from {name}_v)"""
        for name, key in KEYS.items()
    ),
)
def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _run(spark, sf_dir)[1]
    return results.where(F.col("engine") == "contract").select("table_name", "check_id", "outcome")


@register("product_run_customer_health", "C6", "C7", "C8", "D5", sql=f"""{ctes(*HEALTH_VIEWS)}
select * replace (account_id::varchar as account_id) from ({HEALTH})""")
def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer health product from text files."""
    root = _land(spark, sf_dir, product.CUSTOMER_ENTITIES)
    run = product.Run(spark, f"{root}/bronze", root, "dev", "customer_health", "run_1")
    return product.run_customer_health(run, OBSERVED)[0]["mart_customer_health_score"]


# Of the snapshots with one id the first by row stays.
SNAPSHOTS = """select * exclude (rn) from (select *, row_number() over (partition by snapshot_id order by
snapshot_date::varchar, warehouse_id::varchar, product_id::varchar, on_hand_units::varchar, allocated_units::varchar)
as rn from inventory_snapshots_v) where rn = 1"""
KEPT_POSITION = POSITION.replace("inventory_snapshots_v", "kept")


@register("product_run_inventory", "C11", "C12", "D8", "D9", sql=f"""{ctes(*RISK_VIEWS, kept=SNAPSHOTS, position=KEPT_POSITION)}
select * replace (product_id::varchar as product_id, warehouse_id::varchar as warehouse_id) from ({RISK})""")
def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory reliability product from text files."""
    root = _land(spark, sf_dir, product.INVENTORY_ENTITIES)
    run = product.Run(spark, f"{root}/bronze", root, "dev", "inventory_reliability", "run_1")
    return product.run_inventory(run, OBSERVED)[0]["mart_stockout_risk"]


@register(
    "product_run_blocked",
    "B8",
    "B11",
    sql=ctes("order_lines_v") + """, found as (select count(*) as n_rows, count(distinct order_id) as n_kept
    from order_lines_v) select unnest(['cast_error', 'not_null', 'unique', 'schema_mismatch', 'file_status']) as check_id,
    case when n_rows > n_kept and check_id in ('unique', 'file_status') then 'error' else 'passed' end as outcome,
    case when n_rows > n_kept and check_id in ('unique', 'file_status') then 'blocked' else 'continued' end
    as pipeline_outcome, n_rows - n_kept as rejected_rows, n_kept as accepted_rows from found""",
)
def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines keyed by their order repeat its key past the limit: the run stops ahead of Gold and its results are there."""
    root = _land(spark, sf_dir, ["order_lines"])
    run = product.Run(spark, f"{root}/bronze", root, "dev", "order_revenue", "run_1")
    by_order = replace(CONTRACTS["order_lines"], primary_key=("order_id",)).with_policy("reject", 0.1)
    try:
        product.run_product(run, [by_order], {}, OBSERVED)
    except RunAborted:
        pass
    return product.recorded(run).select("check_id", "outcome", "pipeline_outcome", "rejected_rows", "accepted_rows")


STATES = (Field("order_id", "integer"), Field("total", "number"), Field("status", "string"))


@register(
    "silver_write_modes",
    "A13",
    "A14",
    "A15",
    "B4",
    sql="""with landed as (select 1 as load, o_orderkey::int as order_id, o_totalprice as total, o_orderstatus as status
    from orders union all select 2, o_orderkey::int, o_totalprice * 2, o_orderstatus from orders)
    select 'append' as mode, order_id, total, status, null::boolean as is_current from landed
    union all select 'merge_scd1', order_id, total, status, null from landed where load = 2
    union all select 'merge_scd1_at_once', order_id, total, status, null from landed where load = 2
    union all select 'merge_scd2', order_id, total, status, load = 2 from landed""",
)
def _write_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders land, then land again with twice the total; `at_once` takes both loads in with one run."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status")
    )
    loads = [orders, orders.withColumn("total", F.col("total") * 2)]
    found = []
    for mode in ("append", "merge_scd1", "merge_scd1_at_once", "merge_scd2"):
        contract = Contract(
            "order_states", "sales", "crm", STATES, ("order_id",), load=Load("incremental", "order_id", ("order_id",)),
            write_mode=mode.removesuffix("_at_once"),
        )
        root = scratch(spark, "modes")
        run = product.Run(spark, f"{root}/bronze", root, "dev", "orders", "run_1")
        for number, rows in enumerate(loads, 1):
            land_csv(rows, f"{run.bronze}/crm/order_states/load_id={number:010d}")
            if number == len(loads) or not mode.endswith("_at_once"):
                product.silver(run, contract)
        held = product.silver_table(run, contract).read()
        current = F.col("is_current") if mode == "merge_scd2" else F.lit(None).cast("boolean")
        found.append(held.select(F.lit(mode).alias("mode"), "order_id", "total", "status", current.alias("is_current")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
