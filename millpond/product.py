"""One product run: landed files to accepted Silver, Gold tables, data tests and the record of every check."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import CONTRACTS, Contract
from .operators import datatests, validate
from .plans import marts, quality, star
from .session import cut
from .sources.export import csv_cells
from .sources.files import csv_scan
from .sources.keyed import Keyed
from .sources.loads import RefreshRefused, Table, exists, merge_latest

Models = Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]]

# Gold models by name, in the order they are built: each reads Silver tables and the models before it.
SALES: Models = {
    "dim_account": lambda t: star.dim_account(t["accounts"]),
    "dim_product": lambda t: star.dim_product(t["products"]),
    "dim_channel": lambda t: star.dim_channel(t["channels"]),
    "dim_promotion": lambda t: star.dim_promotion(t["promotions"]),
    "fct_order_lines": lambda t: star.fct_order_lines(t["order_lines"], t["orders"], t["products"]),
    "mart_order_revenue_by_day": lambda t: marts.revenue_by_day(t["fct_order_lines"]),
    "mart_order_revenue_by_channel": lambda t: marts.revenue_by_channel(
        t["fct_order_lines"], t["dim_channel"], t["dim_promotion"]
    ),
    "mart_order_revenue_margin_by_product": lambda t: marts.margin_by_product(t["fct_order_lines"], t["dim_product"]),
    "mart_order_revenue_by_account_segment": lambda t: marts.revenue_by_segment(
        t["fct_order_lines"], t["dim_account"]
    ),
}
SALES_ENTITIES = ("accounts", "products", "channels", "promotions", "orders", "order_lines")

CUSTOMER_HEALTH: Models = {
    "dim_account": lambda t: star.dim_account(t["accounts"]),
    "fct_subscriptions": lambda t: star.fct_subscriptions(t["subscriptions"]),
    "fct_support_tickets": lambda t: star.fct_support_tickets(t["support_tickets"]),
    "fct_nps_responses": lambda t: star.fct_nps_responses(t["nps_responses"]),
    "mart_customer_health_score": lambda t: marts.customer_health(
        t["dim_account"], t["fct_subscriptions"], t["fct_support_tickets"], t["fct_nps_responses"]
    ),
    "mart_churn_risk_by_segment": lambda t: marts.churn_risk(t["mart_customer_health_score"]),
    "mart_support_sla_by_customer": lambda t: marts.support_sla(t["dim_account"], t["fct_support_tickets"]),
}
CUSTOMER_ENTITIES = ("accounts", "subscriptions", "support_tickets", "nps_responses")

INVENTORY: Models = {
    "dim_supplier": lambda t: star.dim_supplier(t["suppliers"]),
    "dim_warehouse": lambda t: star.dim_warehouse(t["warehouses"]),
    "fct_inventory_snapshots": lambda t: star.fct_inventory_snapshots(t["inventory_snapshots"]),
    "fct_stockout_events": lambda t: star.fct_stockout_events(t["stockout_events"]),
    "fct_purchase_order_receipts": lambda t: star.fct_purchase_order_receipts(t["purchase_orders"], t["shipments"]),
    "mart_inventory_position": lambda t: marts.inventory_position(t["fct_inventory_snapshots"], t["dim_warehouse"]),
    "mart_stockout_risk": lambda t: marts.stockout_risk(t["mart_inventory_position"], t["fct_stockout_events"]),
    "mart_supplier_delivery_reliability": lambda t: marts.supplier_reliability(
        t["fct_purchase_order_receipts"], t["dim_supplier"]
    ),
}
INVENTORY_ENTITIES = (
    "suppliers", "warehouses", "inventory_snapshots", "stockout_events", "purchase_orders", "shipments",
)


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes, and who it is."""

    spark: SparkSession
    bronze: str
    root: str
    stage: str
    product: str
    run_id: str


@dataclass(frozen=True)
class Landed:
    """What the validation of one entity found. `stopped` says why its policy stops the run, `missing` counts the declared
    columns that the files lack: nothing else was checked then."""

    report: DataFrame
    missing: int = 0
    exceeded: bool = False
    stopped: str | None = None


def silver_table(run: Run, contract: Contract) -> Table | Keyed:
    root = f"{run.root}/silver/{contract.domain}/{contract.name}"
    if contract.write_mode.startswith("merge"):
        return Keyed(run.spark, root, contract.load.primary_key or contract.primary_key)
    return Table(run.spark, root)


def pending(run: Run, contract: Contract, raw: DataFrame) -> DataFrame:
    """The rows of files that no committed version of the Silver table has taken in."""
    table = silver_table(run, contract)
    if not exists(run.spark, f"{table.root}/files"):
        return raw
    taken = run.spark.read.parquet(f"{table.root}/files")
    if isinstance(table, Table):
        taken = taken.where(F.col("version") <= table.version())
    return raw.join(taken.select(validate.FILE).distinct(), validate.FILE, "left_anti").select(raw.columns)


def silver(run: Run, contract: Contract, rebuild: bool = False) -> Landed:
    """Validate an entity's landed files; write accepted and rejected rows by its write mode; say what was found.

    `overwrite` reads every landed file on every run. The other modes read the files not taken in yet: `append` adds their
    rows, `merge_scd1` keeps the last file's row of a key, `merge_scd2` adds versions. `rebuild` starts them from no table
    and every landed file. An append's list of files is written before the version it belongs to and counts once that version is
    committed; a merge's is written after it, as files merged twice change nothing. So a run that dies is run again without a
    lost or repeated file.

    The rows are checked once and written, so accepted, rejected and report read files. A policy that stops the run does so
    after both are written.
    """
    raw = csv_scan(run.spark, f"{run.bronze}/{contract.source}/{contract.name}", multiline=contract.multiline)
    table, mode = silver_table(run, contract), contract.write_mode
    if rebuild and mode == "merge_scd2":
        raise RefreshRefused(f"{contract.name} keeps a version history")
    missing, _ = validate.schema_mismatch(raw, contract)
    if missing:
        return Landed(_nothing_checked(raw, contract), len(missing), False, f"{contract.name}: columns {missing} are missing")
    if mode != "overwrite" and not rebuild:
        raw = pending(run, contract, raw)
    checked = validate.check(raw, contract, cut)
    report = cut(checked.report())
    if mode == "overwrite":
        table.replace(checked.accepted)
    elif report.first()["rows"]:
        files = checked.source.select(validate.FILE).distinct()
        if isinstance(table, Table):
            files.write.mode("overwrite").parquet(f"{table.root}/files/version={table.version() + 1}")
            (table.replace if rebuild else table.append)(checked.accepted)
        else:
            if mode == "merge_scd2":
                table.add_versions(checked.accepted_from())
            elif rebuild:
                table.replace(merge_latest(None, checked.accepted_from(), table.keys))
            else:
                table.upsert(checked.accepted_from())
            files.write.mode("append").parquet(f"{table.root}/files/version=0")
    refused = checked.rejected.withColumn("_errors", validate.error_text())
    csv_cells(refused).write.mode("overwrite").option("header", True).option("escape", '"').option("compression", "gzip").csv(
        f"{run.root}/rejected/{contract.domain}/{contract.name}"
    )
    try:
        checked.enforce()
    except validate.RunAborted as stopped:
        return Landed(report, 0, contract.policy.max_rejection_rate is not None, str(stopped))
    return Landed(report)


def _nothing_checked(raw: DataFrame, contract: Contract) -> DataFrame:
    """The report of files that do not have the declared columns: no row is accepted, no violation is known."""
    counts = ("warnings", "cast_error_violations", "not_null_violations", "unique_violations")
    rows = F.count(F.lit(1))
    return raw.agg(
        rows.alias("rows"), F.lit(0).cast("bigint").alias("accepted"), rows.alias("rejected"), rows.alias("errors"),
        *[F.lit(0).cast("bigint").alias(name) for name in counts],
    ).select(F.lit(contract.name).alias("entity"), "*")


def check_results(run: Run, contract: Contract, landed: Landed, observed_us: int) -> DataFrame:
    """An entity's report as one result per check, classified by its policy."""
    counts = {
        "cast_error": F.col("cast_error_violations"),
        "not_null": F.col("not_null_violations"),
        "unique": F.col("unique_violations"),
        "schema_mismatch": F.lit(landed.missing).cast("bigint"),
        "file_status": F.col("rejected") + F.col("warnings"),
    }
    listed = F.array(*[F.struct(F.lit(c).alias("check_id"), n.alias("violations")) for c, n in counts.items()])
    rows = landed.report.select("rows", "accepted", "rejected", F.inline(listed))
    severity = contract.policy.severity
    outcome, effect = validate.classify_check(
        F.col("violations") == 0,
        F.lit("WARN" if severity == "warn" else "ERROR"),
        F.lit(severity),
        # The states of a run.
        F.lit("aborted" if landed.stopped else "success"),
        F.lit(landed.exceeded),
        F.lit(not landed.missing),
        F.col("rejected"),
    )
    return rows.select(
        F.lit(run.stage).alias("stage"),
        F.lit(contract.domain).alias("domain"),
        F.lit(run.product).alias("product"),
        F.lit(contract.name).alias("table_name"),
        F.lit("contract").alias("engine"),
        "check_id",
        F.lit(run.run_id).alias("run_id"),
        outcome.alias("outcome"),
        effect.alias("pipeline_outcome"),
        F.lit(observed_us).cast("bigint").alias("observed_us"),
        F.col("rejected").alias("rejected_rows"),
        F.col("accepted").alias("accepted_rows"),
    )


def gold(run: Run, tables: Mapping[str, DataFrame], models: Models) -> dict[str, DataFrame]:
    """Build and write the models in order; a model reads the written form of those before it."""
    built = dict(tables)
    for name, build in models.items():
        built[name] = Table(run.spark, f"{run.root}/gold/{run.product}/{name}").replace(build(built))
    return {name: built[name] for name in models}


def run_sales(run: Run, observed_us: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Bronze to Gold for the sales product."""
    return run_product(run, [CONTRACTS[name] for name in SALES_ENTITIES], SALES, observed_us)


def run_customer_health(run: Run, observed_us: int) -> tuple[dict[str, DataFrame], DataFrame]:
    return run_product(run, [CONTRACTS[name] for name in CUSTOMER_ENTITIES], CUSTOMER_HEALTH, observed_us)


def run_inventory(run: Run, observed_us: int) -> tuple[dict[str, DataFrame], DataFrame]:
    return run_product(run, [CONTRACTS[name] for name in INVENTORY_ENTITIES], INVENTORY, observed_us)


def recorded(run: Run) -> DataFrame:
    """The contract results that a run wrote, be it stopped or not."""
    return run.spark.read.parquet(f"{run.root}/checks/{run.product}/{run.run_id}")


def run_product(
    run: Run, contracts: Sequence[Contract], models: Models, observed_us: int, refresh: str | None = None
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Bronze to Gold: the Gold tables and the results of every check of the run.

    Every entity is validated and its results are written before a policy stops the run ahead of Gold. `refresh` is `bronze`
    to rebuild Silver from every landed file, or `gold`, which leaves Silver as on any run; Gold tables are rebuilt either way.
    """
    if refresh not in (None, "bronze", "gold"):
        raise ValueError(f"refresh scope {refresh!r} is neither bronze nor gold")
    if refresh == "bronze" and (kept := [c.name for c in contracts if c.write_mode == "merge_scd2"]):
        raise RefreshRefused(f"{', '.join(kept)} keep a version history")
    landed = {c.name: silver(run, c, refresh == "bronze") for c in contracts}
    found = [check_results(run, c, landed[c.name], observed_us) for c in contracts]
    reduce(DataFrame.unionByName, found).write.mode("overwrite").parquet(f"{run.root}/checks/{run.product}/{run.run_id}")
    if stopped := [one.stopped for one in landed.values() if one.stopped]:
        raise validate.RunAborted("; ".join(stopped))
    # An entity that never had a file to take in has no table yet.
    tables = {c.name: silver_table(run, c).read() for c in contracts}
    accepted = {
        c.name: run.spark.createDataFrame([], c.schema) if tables[c.name] is None else tables[c.name] for c in contracts
    }
    built = gold(run, accepted, models)
    suite = datatests.GOLD_SUITE
    mine = datatests.Suite(
        not_null={n: c for n, c in suite.not_null.items() if n in built},
        unique={n: c for n, c in suite.unique.items() if n in built},
        combinations={n: c for n, c in suite.combinations.items() if n in built},
        relationships=[r for r in suite.relationships if r[0] in built and r[2] in built],
        reconciled=[n for n in suite.reconciled if n in built],
        fact=suite.fact,
    )
    tests = mine.run(built)
    outcome, effect = quality.data_test_outcome(
        F.when(F.col("failures") > 0, "fail").otherwise("pass"),
        F.lit("error"),
        F.lit(True),
        F.lit(False),
        F.lit(True),
    )
    tested = tests.select(
        F.lit(run.stage).alias("stage"),
        F.lit(contracts[0].domain).alias("domain"),
        F.lit(run.product).alias("product"),
        F.col("model").alias("table_name"),
        F.lit("data_test").alias("engine"),
        F.concat_ws(":", "test", "columns").alias("check_id"),
        F.lit(run.run_id).alias("run_id"),
        outcome.alias("outcome"),
        effect.alias("pipeline_outcome"),
        F.lit(observed_us).cast("bigint").alias("observed_us"),
        F.lit(None).cast("bigint").alias("rejected_rows"),
        F.lit(None).cast("bigint").alias("accepted_rows"),
    )
    return built, recorded(run).unionByName(tested)
