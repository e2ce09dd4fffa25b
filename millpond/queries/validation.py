"""Contract validation and data tests over damaged source text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import CONTRACTS, Contract, Field, Policy
from ..operators import datatests, validate
from ..registry import register
from ..session import cut, scratch, table
from ..shapes import ctes, view
from . import gold
from .gold import FACT, FACT_VIEWS, Gold

RAW_LINES = Contract(
    "raw_lines",
    "sales",
    "crm",
    (
        Field("line_id", "string"),
        Field("order_id", "string"),
        Field("product_id", "string"),
        Field("quantity", "integer"),
        Field("unit_price", "number"),
        Field("ship_date", "date"),
        Field("returned", "boolean"),
    ),
    ("line_id",),
    Policy("reject", 0.5),
)
COLUMNS = ", ".join(RAW_LINES.names)
# DuckDB's casts accept more than the contract does, so the text's form is tested first, as in the plan.
ERRORS = """select *, concat_ws(',',
case when quantity <> '' and not regexp_full_match(quantity, '[+-]?[0-9]+') then 'cast_error:quantity' end,
case when unit_price <> '' and not regexp_full_match(unit_price, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')
then 'cast_error:unit_price' end,
case when ship_date <> '' and try_cast(ship_date as date) is null then 'cast_error:ship_date' end,
case when returned <> '' and lower(returned) not in ('true', 'false') then 'cast_error:returned' end,
case when line_id is null or line_id = '' then 'not_null:line_id' end,
case when order_id is null or order_id = '' then 'not_null:order_id' end,
case when product_id is null or product_id = '' then 'not_null:product_id' end,
case when quantity is null or quantity = '' then 'not_null:quantity' end,
case when unit_price is null or unit_price = '' then 'not_null:unit_price' end,
case when ship_date is null or ship_date = '' then 'not_null:ship_date' end,
case when returned is null or returned = '' then 'not_null:returned' end,
case when line_id <> '' and row_number() over (partition by line_id order by file_name, order_id, product_id nulls first,
quantity nulls first, unit_price, ship_date, returned) > 1 then 'unique:line_id' end) as errors from raw_lines_v"""


def _checked(spark: SparkSession, sf_dir: str) -> validate.Checked:
    raw = view(spark, sf_dir, "raw_lines_v").withColumnRenamed("file_name", validate.FILE)
    return validate.check(raw, RAW_LINES, cut)


@register(
    "validate_errors",
    "B2",
    "B3",
    "B4",
    sql=ctes("raw_lines_v", checked=ERRORS) + f"""select {COLUMNS}, file_name, errors, count(*) as copies
    from checked group by all""",
)
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).folded(validate.FILE).withColumnRenamed(validate.FILE, "file_name")


@register(
    "validate_accepted",
    "B2",
    "B7",
    "J1",
    sql=ctes("raw_lines_v", checked=ERRORS) + """select line_id, order_id, product_id,
    cast(quantity as integer) as quantity, cast(unit_price as double) as unit_price,
    cast(cast(ship_date as date) as varchar) as ship_date, cast(returned as boolean) as returned
    from checked where errors = ''""",
)
def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).accepted


@register(
    "validate_rejected",
    "B7",
    sql=ctes("raw_lines_v", checked=ERRORS) + f"""select {COLUMNS}, errors, count(*) as copies from checked
    where errors <> '' group by all""",
)
def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).folded(rejected=True)


@register(
    "validate_warn_accepts_all",
    "B7",
    sql=ctes("raw_lines_v") + """select count(*) as n, count(quantity) as n_quantity from
    (select case when regexp_full_match(quantity, '[+-]?[0-9]+') then quantity end as quantity from raw_lines_v)""",
)
def _warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "raw_lines_v")
    accepted = validate.check(raw, RAW_LINES.with_policy("warn")).accepted
    return accepted.agg(F.count(F.lit(1)).alias("n"), F.count("quantity").alias("n_quantity"))


@register(
    "validate_rejection_rate",
    "B8",
    sql=ctes("raw_lines_v", checked=ERRORS) + """select count(*) as rows,
    count(*) filter (where errors <> '') as rejected, count(*) filter (where errors <> '') / count(*) as rejection_rate,
    count(*) filter (where errors <> '') / count(*) > 0.5 as exceeded from checked""",
)
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).rejection()


@register(
    "validate_entity_report",
    "B9",
    sql=ctes("raw_lines_v", checked=ERRORS) + """select 'raw_lines' as entity, count(*) as rows,
    count(*) filter (where errors = '') as accepted, count(*) filter (where errors <> '') as rejected,
    0::bigint as warnings, count(*) filter (where errors <> '') as errors,
    cast(sum(len(regexp_extract_all(errors, 'cast_error:'))) as bigint) as cast_error_violations,
    cast(sum(len(regexp_extract_all(errors, 'not_null:'))) as bigint) as not_null_violations,
    cast(sum(len(regexp_extract_all(errors, 'unique:'))) as bigint) as unique_violations,
    count(distinct case when errors <> '' then file_name end) as files_impacted from checked""",
)
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).report()


@register(
    "validate_file_status",
    "B6",
    sql=ctes("raw_lines_v", checked=ERRORS) + """select file_name, count(*) as rows,
    count(*) filter (where errors <> '') as violating_rows,
    case when count(*) filter (where errors <> '') > 0 then 'rejected' else 'accepted' end as status
    from checked group by 1""",
)
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).file_status().withColumnRenamed(validate.FILE, "file_name")


@register(
    "normalize_columns_orders",
    "B1",
    sql="""select o_orderkey as order_key, o_custkey as cust_key, o_orderstatus as order_status_code,
    o_totalprice as total_price2, o_orderpriority as http_priority from orders""",
)
def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    return validate.normalize_columns(
        orders.toDF("OrderKey", "cust-key", "Order Status_Code", "totalPrice2", "HTTPPriority")
    )


@register(
    "schema_mismatch_report",
    "B5",
    sql="""select 'accounts' as entity, 'missing' as kind, unnest(['account_id', 'account_name', 'arr', 'region',
    'segment', 'signup_date']) as column_name, n from (select count(*) as n from customer)
    union all select 'accounts', 'extra', unnest(['c_acctbal', 'c_custkey', 'c_mktsegment', 'c_name', 'c_nationkey']), n
    from (select count(*) as n from customer)""",
)
def _mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    missing, extra = validate.schema_mismatch(customer, CONTRACTS["accounts"])
    found = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("column_name"))
            for kind, names in (("missing", missing), ("extra", extra))
            for name in names
        ]
    )
    rows = customer.agg(F.count(F.lit(1)).alias("n"))
    return rows.select("n", F.lit("accounts").alias("entity"), F.inline(found))


@register(
    "infer_column_types",
    "B10",
    sql=ctes("raw_lines_v") + " union all ".join(
        f"""select '{name}' as name, case when count(nullif({name}, '')) = 0 then 'string'
        when bool_and(regexp_full_match({name}, '-?[0-9]+')) filter (where {name} <> '') then 'integer'
        when bool_and(regexp_full_match({name}, '-?[0-9]+([.][0-9]+)?')) filter (where {name} <> '') then 'number'
        when bool_and(regexp_full_match({name}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) filter (where {name} <> '')
        then 'date' else 'string' end as type, false as nullable from raw_lines_v"""
        for name in (*RAW_LINES.names, "file_name")
    ),
)
def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.infer_columns(view(spark, sf_dir, "raw_lines_v"))


CHECK_EVIDENCE = """select event_id, event_type = 'purchase' or event_type = 'signup' as passed,
case when event_id % 4 = 0 then 'WARN' else 'ERROR' end as severity,
case event_id % 3 when 0 then 'reject' when 1 then 'abort' end as policy,
case when event_id % 7 = 0 then 'Failed' when event_id % 5 = 0 then 'success' end as run_status,
event_id % 11 = 0 as rate_exceeded, event_id % 13 <> 0 as evidenced, event_id % 6 - 2 as rejected_rows from events"""


@register(
    "classify_check",
    "B11",
    sql=f"""select event_id, case when passed and evidenced then 'passed' when passed then 'unknown'
    when lower(run_status) in ('failed', 'aborted') or policy = 'abort' or rate_exceeded then 'error'
    when severity = 'WARN' then 'warn' else 'error' end as outcome,
    case when passed and evidenced then 'continued' when passed then 'unknown'
    when lower(run_status) in ('failed', 'aborted') or policy = 'abort' or rate_exceeded then 'blocked'
    when severity = 'WARN' then 'continued' when policy = 'reject' or rejected_rows > 0 then 'quarantined'
    else 'unknown' end as pipeline_outcome from ({CHECK_EVIDENCE})""",
)
def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    evidence = spark.sql(CHECK_EVIDENCE.replace("from events", "from {events}"), events=events)
    outcome, effect = validate.classify_check(
        *[F.col(c) for c in evidence.columns if c != "event_id"]
    )
    return evidence.select("event_id", outcome.alias("outcome"), effect.alias("pipeline_outcome"))


@register(
    "expand_missing_checks",
    "B12",
    sql=ctes("checks_v", reported="""select run_id, table_name,
    case when table_name <> 'table_3' then check_id end as check_id, outcome from checks_v""") + """
    select e.run_id, e.table_name, c.check_id,
    coalesce(r.outcome, case when e.siblings > 0 then 'not_run' else 'unknown' end) as outcome
    from (select run_id, table_name, count(check_id) as siblings from reported group by 1, 2) e
    cross join (select unnest(['cast_error', 'not_null', 'unique', 'schema_mismatch', 'file_status']) as check_id) c
    left join (select run_id, table_name, check_id, min(outcome) as outcome from reported group by 1, 2, 3) r
    on e.run_id = r.run_id and e.table_name = r.table_name and c.check_id = r.check_id""",
)
def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = view(spark, sf_dir, "checks_v").withColumn(
        "check_id", F.when(F.col("table_name") != "table_3", F.col("check_id"))
    )
    return validate.expand_missing_checks(checks, ["run_id", "table_name"])


@register(
    "contract_reports",
    "B13",
    "B9",
    sql=ctes(*[f"{name}_v" for name in CONTRACTS]) + " union all ".join(
        f"""select '{name}' as entity, count(*) as rows, count(distinct {contract.primary_key[0]}) as accepted,
        count(*) - count(distinct {contract.primary_key[0]}) as rejected from {name}_v"""
        for name, contract in CONTRACTS.items()
    ),
)
def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = [
        validate.check(view(spark, sf_dir, f"{name}_v"), contract, cut, keep_rows=False)
        .report()
        .select("entity", "rows", "accepted", "rejected")
        for name, contract in CONTRACTS.items()
    ]
    return reduce(DataFrame.unionByName, reports)


# Data tests.


@register("test_not_null", "K1", sql=ctes("raw_lines_v") + """select line_id, product_id, unit_price from raw_lines_v
    where quantity is null""")
def _not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "raw_lines_v")
    return datatests.not_null(rows, "quantity").select("line_id", "product_id", "unit_price")


@register(
    "test_unique",
    "K2",
    "F10",
    sql="select l_shipdate::date::varchar as ship_date, count(*) as n_records from lineitem group by 1 "
    "having count(*) > 1",
)
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("ship_date"))
    return datatests.unique(lines, "ship_date")


@register(
    "test_unique_combination",
    "K4",
    sql="select l_orderkey, l_linenumber, count(*) as n_records from lineitem group by 1, 2 having count(*) > 1",
)
def _combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datatests.unique_combination(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "test_relationships",
    "K3",
    "E6",
    sql="""select l_orderkey, count(*) as n_records from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by 1""",
)
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return datatests.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", closed, "o_orderkey")


@register(
    "test_net_revenue_matches_fact",
    "K5",
    "E5",
    "F11",
    "J5",
    sql=ctes(*FACT_VIEWS, fact=FACT) + """select mart_total, fact_total, mart_total < fact_total as short from
    (select cast(sum(net_amount) as double) as mart_total from fact where order_status = 'fulfilled'
    and order_region <> 'ASIA')
    cross join (select cast(sum(net_amount) as double) as fact_total from fact where order_status = 'fulfilled')
    where abs(mart_total - fact_total) > 0.01""",
)
def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart that lost a region must be reported."""
    models = Gold(spark, sf_dir)
    lost = models.rollup().where("order_region <> 'ASIA'")
    total = lost.agg(F.sum("net_amount").cast("double").alias("mart_total"))
    return datatests.drifted(total, models.fact()).withColumn("short", F.expr("mart_total < fact_total"))


GOLD_TABLES = {
    "dim_account": "accounts",
    "dim_product": "products",
    "dim_channel": "channels",
    "dim_promotion": "promotions",
    "dim_supplier": "suppliers",
    "dim_warehouse": "warehouses",
    "fct_order_lines": "fact",
    "fct_subscriptions": "subscriptions",
    "fct_support_tickets": "tickets",
    "fct_nps_responses": "responses",
    "fct_inventory_snapshots": "snapshots",
    "fct_purchase_order_receipts": "receipts",
    "fct_stockout_events": "stockouts",
    "mart_order_revenue_by_day": "by_day",
    "mart_order_revenue_by_channel": "by_channel",
    "mart_order_revenue_margin_by_product": "margin",
    "mart_order_revenue_by_account_segment": "by_segment",
    "mart_customer_health_score": "health",
    "mart_churn_risk_by_segment": "churn",
    "mart_support_sla_by_customer": "sla",
    "mart_inventory_position": "position",
    "mart_stockout_risk": "risk",
    "mart_supplier_delivery_reliability": "reliability",
}


def build_gold(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Write every Gold table once and read the written tables back, so no test rebuilds a model."""
    models, root = Gold(spark, sf_dir), scratch(spark, "gold")
    for name, build in GOLD_TABLES.items():
        getattr(models, build)().write.mode("overwrite").parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in GOLD_TABLES}


def _suite_sql() -> str:
    """Every declared test as a count over the models' DuckDB text."""
    views = {
        "dim_account": "accounts", "dim_product": "products", "dim_channel": "channels", "dim_promotion": "promotions",
        "dim_supplier": "suppliers", "dim_warehouse": "warehouses", "fct_subscriptions": "subscriptions",
        "fct_support_tickets": "support_tickets", "fct_nps_responses": "nps_responses",
        "fct_inventory_snapshots": "inventory_snapshots", "fct_stockout_events": "stockout_events",
    }
    models = {name: f"select * from {source}_v" for name, source in views.items()}
    models |= {
        "fact": gold.FACT, "position": gold.POSITION, "receipts": gold.RECEIPTS, "health": gold.HEALTH,
        "fct_order_lines": "select * from fact", "fct_purchase_order_receipts": "select * from receipts",
        "mart_order_revenue_by_day": gold.BY_DAY, "mart_order_revenue_by_channel": gold.BY_CHANNEL,
        "mart_order_revenue_margin_by_product": gold.MARGIN, "mart_order_revenue_by_account_segment": gold.BY_SEGMENT,
        "mart_customer_health_score": "select * from health", "mart_churn_risk_by_segment": gold.CHURN,
        "mart_support_sla_by_customer": gold.SLA, "mart_inventory_position": "select * from position",
        "mart_stockout_risk": gold.RISK, "mart_supplier_delivery_reliability": gold.RELIABILITY,
    }
    suite, parts = datatests.GOLD_SUITE, []

    def failures(model: str, test: str, columns: str, failing: str) -> None:
        parts.append(f"select '{model}' as model, '{test}' as test, '{columns}' as columns, count(*) as failures {failing}")

    for name in GOLD_TABLES:
        parts.append(
            f"select '{name}' as model, 'has_rows' as test, '*' as columns, cast(count(*) = 0 as bigint) as failures from {name}"
        )
    for name, columns in suite.not_null.items():
        for column in columns:
            failures(name, "not_null", column, f"from {name} where {column} is null")
    repeated = "from (select {0} from {1} where {2} group by {0} having count(*) > 1)"
    for name, column in suite.unique.items():
        failures(name, "unique", column, repeated.format(column, name, f"{column} is not null"))
    for name, columns in suite.combinations.items():
        failures(name, "unique_combination", ",".join(columns), repeated.format(", ".join(columns), name, "true"))
    for child, fk, parent, pk in suite.relationships:
        orphan = f"select distinct {fk} from {child} where {fk} is not null and {fk} not in (select {pk} from {parent})"
        failures(child, "relationships", fk, f"from ({orphan})")
    for name in suite.reconciled:
        failures(
            name, "net_revenue_matches_fact", "net_revenue",
            f"from (select abs((select sum(net_revenue) from {name}) - (select sum(net_amount) from fct_order_lines "
            "where order_status = 'fulfilled')::double) as d) where d > 0.01",
        )
    return ctes(*[f"{name}_v" for name in CONTRACTS], **models) + " union all ".join(parts)


@register("gold_test_suite", "K1", "K2", "K3", "K4", "K5", "K6", "A17", sql=_suite_sql())
def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = build_gold(spark, sf_dir)
    tests, path = datatests.GOLD_SUITE.by_table(tables), scratch(spark, "tests")
    for name, df in tables.items():
        has_rows = datatests.row_count(df).select(
            F.lit(name).alias("model"),
            F.lit("has_rows").alias("test"),
            F.lit("*").alias("columns"),
            (F.col("n_rows") == 0).cast("bigint").alias("failures"),
        )
        # A job per table: the driver holds the stages of one table's tests, not of all.
        datatests.union([has_rows, *([tests[name]] if name in tests else [])]).write.mode("append").parquet(path)
    return spark.read.schema(has_rows.schema).parquet(path)
