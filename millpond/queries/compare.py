"""Table compare, retention and paging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare
from ..registry import register
from ..session import table

DECLARED = """select o_orderkey, o_orderstatus, o_orderpriority, case when o_orderkey % 2 = 0 then 'a' else 'b' end as t1,
'c' as t2, case when o_custkey % 101 = 0 then 'no resolvable owner' end as problem from orders
where o_orderdate < timestamp '2001-01-01'"""
HELD = """select o_orderkey, case when o_custkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus,
case when o_custkey % 5 = 0 then null else o_orderpriority end as o_orderpriority,
case when o_custkey % 3 = 0 then 'z' when o_orderkey % 2 = 0 then 'a' else 'b' end as t1,
case when o_custkey % 11 = 0 then 'z' else 'c' end as t2, o_custkey % 13 <> 0 as managed from orders
where o_orderdate >= timestamp '1996-01-01'"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    pair = []
    for text in (DECLARED, HELD):
        rows = spark.sql(text.replace("from orders", "from {orders}").replace("timestamp '", "timestamp_ntz '"), orders=orders)
        pair.append(rows.withColumn("tags", F.array("t1", "t2")).drop("t1", "t2"))
    return pair[0], pair[1]


@register(
    "table_diff",
    "T1",
    "T2",
    "E9",
    sql=f"""with d as ({DECLARED}), h as ({HELD}), b as (select coalesce(d.o_orderkey, h.o_orderkey) as o_orderkey,
    d.problem, d.o_orderkey is null as only_held, h.o_orderkey is null as only_declared, coalesce(h.managed, false) as managed,
    concat_ws(', ', case when d.o_orderstatus is distinct from h.o_orderstatus then 'o_orderstatus' end,
    case when d.o_orderpriority is distinct from h.o_orderpriority then 'o_orderpriority' end,
    case when d.t1 not in (h.t1, h.t2) and d.t2 not in (h.t1, h.t2) then 'tags (missing ' || d.t1 || ', ' || d.t2 || ')'
    when d.t1 not in (h.t1, h.t2) then 'tags (missing ' || d.t1 || ')' when d.t2 not in (h.t1, h.t2)
    then 'tags (missing ' || d.t2 || ')' end, case when not coalesce(h.managed, false) then 'managed' end) as changes
    from d full join h on d.o_orderkey = h.o_orderkey) select * from (select o_orderkey,
    case when problem is not null then 'unresolved' when only_declared then 'missing' when only_held then
    case when managed then 'stale' end when changes <> '' then 'changed' end as kind,
    case when problem is not null then problem when only_declared or only_held then '' else changes end as detail from b)
    where kind is not null""",
)
def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, held = _both(spark, sf_dir)
    return compare.table_diff(
        declared, held, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], ["tags"],
        managed="managed", problem="problem",
    )


@register(
    "declared_minus_held",
    "I2",
    sql=f"select o_orderkey from ({DECLARED}) except select o_orderkey from ({HELD})",
)
def _minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, held = _both(spark, sf_dir)
    return declared.select("o_orderkey").exceptAll(held.select("o_orderkey"))


@register(
    "retention_candidates",
    "T3",
    "E8",
    "C14",
    "J7",
    sql="""select event_id as snapshot_id, event_type from events where ts < timestamp '2024-01-31' - interval 14 day
    and event_id not in (select event_id from events where event_type = 'purchase')""",
)
def _retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots; purchases are held by a reference, and one reference is null."""
    events = table(spark, sf_dir, "events")
    snapshots = events.select(F.col("event_id").alias("snapshot_id"), F.col("ts").alias("committed_at"), "event_type")
    refs = events.select(
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("snapshot_id")
    )
    return compare.retention_candidates(snapshots, refs, "2024-01-31", 14).drop("committed_at")


@register(
    "keyset_page",
    "H1",
    "J8",
    sql="""with found as (select c_name from customer where contains(lower(c_name), 'r#0000000')
    and c_name > 'Customer#000000009' order by 1 limit 51) select c_name, case when (select count(*) from found) > 50
    then replace(replace(to_base64(encode((select max(c_name) from (select c_name from found order by 1 limit 50)))), '+', '-'),
    '/', '_') end as next_cursor from found order by 1 limit 50""",
)
def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return compare.keyset_page(customer, "c_name", 50, text="R#0000000", after="Customer#000000009")


@register(
    "literal_contains",
    "H1",
    "J8",
    "J9",
    sql="""select doc_id from documents where contains(lower(text), '100%') or contains(lower(text), '_')
    or contains(lower(text), 'the ')""",
)
def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    wanted = compare.contains(text, "100%") | compare.contains(text, "_") | compare.contains(text, "THE ")
    return table(spark, sf_dir, "documents").where(wanted).select("doc_id")
