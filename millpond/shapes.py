"""The contract tables as views over the driver's tables, in Spark and as DuckDB common table expressions.

Both forms are one SQL text each: the only difference is the name of the text type. A view keeps every row of the table
it is made from, or every row of one event type where the entity is that event.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .session import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

# name -> (views it reads, SQL). `{text}` is the engine's name for the string type.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "accounts_v": (
        (),
        """select c_custkey as account_id, c_name as account_name, c_mktsegment as segment, r_name as region,
        cast(date '1992-01-01' + cast(c_custkey % 2000 as int) as date) as signup_date, c_acctbal as arr
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    "products_v": (
        (),
        """select p_partkey as product_id, p_name as product_name, p_type as category, p_retailprice as unit_cost
        from part""",
    ),
    "channels_v": (
        (),
        """select o_orderpriority as channel_id, substring(o_orderpriority, 3) as channel_name,
        case when substring(o_orderpriority, 1, 1) in ('1', '2') then 'direct' else 'partner' end as channel_type
        from (select distinct o_orderpriority from orders) as priorities""",
    ),
    "promotions_v": (
        (),
        """select l_returnflag as promotion_id, concat('promo ', l_returnflag) as promotion_name,
        case l_returnflag when 'A' then 'percent' when 'R' then 'fixed' else 'none' end as discount_type
        from (select distinct l_returnflag from lineitem) as flags""",
    ),
    "orders_v": (
        ("accounts_v",),
        """select o_orderkey as order_id, o_custkey as customer_id, cast(o_orderdate as date) as order_date,
        o_orderpriority as channel_id,
        case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end as promotion_id, accounts_v.region as region,
        case o_orderstatus when 'F' then 'fulfilled' when 'O' then 'pending' else 'cancelled' end as status
        from orders left join accounts_v on o_custkey = accounts_v.account_id""",
    ),
    "order_lines_v": (
        (),
        """select concat_ws('-', cast(l_orderkey as {text}), cast(l_linenumber as {text}), cast(l_partkey as {text}),
        cast(l_suppkey as {text})) as line_id, l_orderkey as order_id, l_partkey as product_id,
        cast(l_quantity as int) as quantity, unit_price,
        cast(unit_price * cast(l_discount as decimal(18, 2)) as decimal(18, 2)) as discount_amount
        from (select *, cast(l_extendedprice as decimal(18, 4)) as unit_price from lineitem) as priced""",
    ),
    "subscriptions_v": (
        (),
        """select c_custkey as subscription_id, c_custkey as account_id,
        case c_custkey % 3 when 0 then 'basic' when 1 then 'pro' else 'enterprise' end as plan_name,
        case when c_acctbal < 0 then 'past_due' else 'active' end as status,
        cast(date '1995-01-01' + cast(c_custkey % 1000 as int) as date) as start_date,
        cast(date '1996-01-01' + cast(c_custkey % 1000 as int) as date) as renewal_date,
        c_acctbal as monthly_recurring_revenue from customer""",
    ),
    "support_tickets_v": (
        (),
        """select event_id as ticket_id, user_id as account_id, cast(ts as date) as opened_date,
        case event_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as priority,
        cast(floor(value) as int) as resolution_hours, value <= 24 as sla_met from events where event_type = 'error'""",
    ),
    "nps_responses_v": (
        (),
        """select event_id as response_id, user_id as account_id, cast(ts as date) as response_date,
        cast(event_id % 11 as int) as score from events where event_type = 'purchase'""",
    ),
    "suppliers_v": (
        (),
        """select s_suppkey as supplier_id, s_name as supplier_name, n_name as country,
        case when s_acctbal < 0 then 'high' when s_acctbal < 5000 then 'medium' else 'low' end as risk_tier
        from supplier join nation on s_nationkey = n_nationkey""",
    ),
    "warehouses_v": (
        (),
        """select s_suppkey as warehouse_id, concat('Warehouse ', cast(s_suppkey as {text})) as warehouse_name,
        r_name as region, cast(s_suppkey * 10 + 100 as int) as capacity_units
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    ),
    "inventory_snapshots_v": (
        (),
        """select concat_ws('-', cast(l_orderkey as {text}), cast(l_linenumber as {text}), cast(l_partkey as {text}),
        cast(l_suppkey as {text})) as snapshot_id, cast(l_shipdate as date) as snapshot_date,
        l_suppkey as warehouse_id, l_partkey as product_id, cast(l_quantity as int) as on_hand_units,
        l_linenumber as allocated_units, 10 as reorder_point from lineitem""",
    ),
    "stockout_events_v": (
        (),
        """select concat_ws('-', cast(l_orderkey as {text}), cast(l_linenumber as {text}), cast(l_partkey as {text}),
        cast(l_suppkey as {text})) as event_id, cast(l_shipdate as date) as event_date, l_suppkey as warehouse_id,
        l_partkey as product_id, cast(l_quantity as int) as lost_units,
        case l_linestatus when 'F' then 'demand' else 'supplier' end as root_cause
        from lineitem where l_returnflag = 'R'""",
    ),
    "purchase_orders_v": (
        (),
        """select o_orderkey as purchase_order_id, cast(o_custkey % 10 as bigint) as supplier_id,
        cast(o_orderkey % 200 as bigint) as product_id, cast(o_orderkey % 10 as bigint) as warehouse_id,
        cast(o_orderdate as date) as order_date,
        cast(cast(o_orderdate as date) + cast(60 + o_orderkey % 600 as int) as date) as expected_date,
        cast(o_orderkey % 100 + 1 as int) as ordered_units from orders""",
    ),
    "shipments_v": (
        (),
        """select concat_ws('-', cast(l_orderkey as {text}), cast(l_linenumber as {text}), cast(l_partkey as {text}),
        cast(l_suppkey as {text})) as shipment_id, l_orderkey as purchase_order_id,
        cast(l_shipdate as date) as ship_date,
        cast(cast(l_shipdate as date) + l_linenumber as date) as delivered_date,
        cast(l_quantity as int) as received_units from lineitem""",
    ),
    # Source text as it lands, with damage every contract check can find. The line id of an order repeats.
    "raw_lines_v": (
        (),
        """select concat_ws('-', cast(l_orderkey as {text}), cast(l_linenumber as {text})) as line_id,
        cast(l_orderkey as {text}) as order_id,
        case when l_partkey % 41 = 0 then '' else cast(l_partkey as {text}) end as product_id,
        case when l_orderkey % 11 = 0 then concat(cast(cast(l_quantity as int) as {text}), '.5')
        when l_partkey % 29 = 0 then null else cast(cast(l_quantity as int) as {text}) end as quantity,
        case when l_suppkey % 23 = 0 then 'free' else cast(cast(l_extendedprice as decimal(18, 2)) as {text}) end
        as unit_price,
        case when l_suppkey % 19 = 0 then 'n/a' when l_suppkey % 17 = 0 then '2001-02-30'
        else cast(cast(l_shipdate as date) as {text}) end as ship_date,
        case l_returnflag when 'A' then 'true' when 'N' then 'FALSE' else 'yes' end as returned,
        concat('batch-', l_linestatus, '.csv') as file_name from lineitem""",
    ),
    # Operational records. Times are epoch seconds where an operator does arithmetic on them.
    "runs_v": (
        (),
        """select event_id as run_id, concat('job_', cast(user_id % 5 as {text})) as job_name,
        case user_id % 2 when 0 then 'dev' else 'prod' end as stage,
        case event_type when 'purchase' then 'SUCCESS' when 'signup' then 'SUCCESS' when 'error' then 'FAILURE'
        when 'click' then 'CANCELED' else 'STARTED' end as status, ts as created_at, {epoch_us} as created_us,
        case when event_type <> 'view' then value end as duration_s from events""",
    ),
    "checks_v": (
        (),
        """select event_id as seq, case user_id % 2 when 0 then 'dev' else 'prod' end as stage, 'sales' as domain,
        concat('product_', cast(user_id % 3 as {text})) as product,
        concat('table_', cast(event_id % 7 as {text})) as table_name,
        case when event_id % 3 = 0 then concat('column_', cast(event_id % 4 as {text})) end as column_name,
        case event_id % 2 when 0 then 'contract' else 'data_test' end as engine,
        case event_id % 5 when 0 then 'cast_error' when 1 then 'not_null' when 2 then 'unique'
        when 3 then 'schema_mismatch' else 'file_status' end as check_id,
        concat('run_', cast(user_id % 2 as {text}), '_', cast(user_id % 3 as {text}), '_',
        cast(cast(floor(event_id / 50) as bigint) as {text})) as run_id,
        case event_type when 'purchase' then 'passed' when 'signup' then 'passed' when 'click' then 'warn'
        when 'error' then 'error' else case when event_id % 2 = 0 then 'not_run' else 'unknown' end end as outcome,
        case event_type when 'purchase' then 'continued' when 'signup' then 'continued' when 'click' then 'continued'
        when 'error' then case when event_id % 2 = 0 then 'blocked' else 'quarantined' end
        else 'unknown' end as pipeline_outcome,
        {epoch_us} as observed_us, cast(event_id % 100 as bigint) as rejected_rows,
        cast(1000 + event_id % 900 as bigint) as accepted_rows from events""",
    ),
    "samples_v": (
        (),
        """select concat('series_', cast(user_id % 9 as {text})) as series,
        case when user_id % 9 in (4, 8) then null when user_id % 9 < 4 then 'dev' else 'prod' end as stage,
        concat('component_', cast(user_id % 3 as {text})) as component, {epoch_us} as ts_us,
        cast(event_id % 997 as bigint) as counter, value as gauge,
        {epoch_us} - case when user_id % 2 = 0 then 3600000000 else 36000000000 end as created_us,
        case when event_type = 'error' then 0 else 1 end as up from events""",
    ),
    # Archived log lines: parsed records of the newer layout, each error replayed once by another file, and older lines of
    # every third user, most of them copies of a newer record.
    "log_v2_v": (
        (),
        """select event_id as line_index, 'k8s_log.v2' as schema, concat({iso}, lpad(cast(event_id % 1000 as {text}), 3, '0'), 'Z')
        as time, case user_id % 2 when 0 then 'dev' else 'prod' end as namespace,
        concat('pod-', cast(user_id % 7 as {text})) as pod, concat('c', cast(event_id % 2 as {text})) as container,
        concat('component_', cast(user_id % 3 as {text})) as component, concat('product_', cast(user_id % 3 as {text})) as product,
        concat('run_', cast(cast(floor(event_id / 50) as bigint) as {text})) as run_id,
        case event_id % 8 when 0 then concat(word, ' plain text ', event_type)
        when 1 then concat('{"msg": "x", "level": "', lower(word), '"}')
        when 2 then concat('{"level": 30, "severity": "', word, '"}')
        when 3 then concat('2024-01-01 09:41:07,123 - root - ', word, ' - hello')
        when 4 then concat('ts=1 level=', lower(word), ' msg="a b level=debug"')
        when 5 then concat('Error in prose ', cast(event_id as {text}))
        when 6 then concat(chr(27), '[31m[ ', lower(word), '] coloured', chr(27), '[0m')
        else concat('level=', lower(word), ' msg="open') end as message,
        case when event_id % 10 <> 9 then concat('k', cast(event_id as {text})) end as dedup_key,
        concat('file-', cast(event_id % 5 as {text}), copy) as file_name, {day} as day, word, event_id, user_id
        from (select *, case event_type when 'purchase' then 'INFO' when 'view' then 'DEBUG' when 'click' then 'WARN'
        when 'signup' then 'FATAL' else 'ERROR' end as word, '' as copy from events
        union all select *, 'ERROR' as word, '-replay' as copy from events where event_type = 'error') as written""",
    ),
    "log_v1_v": (
        (),
        """select event_id as line_index, 'k8s_log.v1' as schema, concat({iso}, 'Z') as archived_at,
        case user_id % 2 when 0 then 'dev' else 'prod' end as namespace,
        concat('pod-', cast(user_id % 7 as {text})) as pod, concat('c', cast(event_id % 2 as {text})) as container,
        case when event_id % 6 = 5 then concat('no stamp WARN ', cast(event_id as {text})) else
        concat({iso}, lpad(cast(event_id % 1000 as {text}), 3, '0'), 'Z ', case when event_id % 8 = 5
        then concat('Error in prose ', cast(event_id as {text})) else concat('WARNING only in v1 ', cast(event_id as {text}))
        end) end as line, concat('old-', cast(event_id % 3 as {text})) as file_name, {day} as day, event_id
        from events where user_id % 3 = 0""",
    ),
    # Health signals, one per event, in evaluations of an hour.
    "signals_v": (
        (),
        """select event_id as seq, eval, stage, case when kind <> 'service' then 'sales' end as domain,
        case when kind <> 'service' then product end as product,
        case when kind = 'quality' then concat('table_', cast(user_id % 2 as {text})) end as table_name, kind,
        case kind when 'execution' then case event_type when 'error' then 'critical' when 'click' then 'warning'
        when 'view' then 'unknown' else 'healthy' end
        when 'expected_run' then case event_type when 'error' then 'critical' when 'click' then 'warning'
        when 'view' then 'disabled' else 'healthy' end
        when 'service' then case event_type when 'purchase' then 'healthy' when 'click' then 'warning'
        when 'error' then case when component = 'dagster.read-api' then 'unknown' else 'critical' end else 'unknown' end
        else case event_type when 'error' then 'critical' when 'click' then 'warning' when 'view' then 'unknown'
        else 'healthy' end end as state,
        case kind when 'execution' then case event_type when 'purchase' then 'latest run succeeded'
        when 'signup' then 'latest run in progress' when 'error' then 'latest run failed' else 'other' end
        when 'expected_run' then case event_type when 'purchase' then 'the expected run started'
        when 'signup' then 'the expected run is within its grace period' else 'an expected run did not start' end
        when 'freshness' then case event_type when 'signup' then 'no scheduled run due yet; next run due today'
        else 'a run succeeded since the previous due time' end
        when 'quality' then case event_type when 'click' then 'quality checks warned' else 'quality checks passed' end
        else 'probe' end as reason,
        case when event_id % 3 <> 0 then concat('run_', cast(event_id as {text})) end as run, component,
        case when kind = 'expected_run' then eval - event_id % 40 end as due
        from (select *, cast(floor(({epoch_us} - 1704067200000000) / 3600000000) as bigint) as eval,
        case user_id % 2 when 0 then 'dev' else 'prod' end as stage, concat('product_', cast(user_id % 3 as {text})) as product,
        case when event_id % 8 in (0, 1) then 'execution' when event_id % 8 in (2, 3) then 'expected_run'
        when event_id % 8 = 4 then 'freshness' when event_id % 8 = 5 then 'quality' else 'service' end as kind,
        case when event_id % 16 in (6, 14) then 'dagster.read-api' when event_id % 16 = 7 then 'trino.workloads'
        when event_id % 16 = 15 then 'object-store.list' end as component from events) as spread""",
    ),
    "schedules_v": (
        ("runs_v",),
        """select stage, job_name, cast(1704067200000000 as bigint) as anchor_us,
        cast(1704153600000000 as bigint) as started_us,
        cast(substring(job_name, 5) as bigint) * 21600000000 + 21600000000 as interval_us,
        case when job_name = 'job_3' then 'stopped' when job_name = 'job_4' and stage = 'dev' then 'absent'
        else 'running' end as schedule_state, stage = 'prod' as declared_running
        from (select distinct stage, job_name from runs_v) as jobs""",
    ),
}

# The few words the engines spell differently.
_SPARK = {
    "{text}": "string",
    "{epoch_us}": "unix_micros(cast(ts as timestamp))",
    "{iso}": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")",
    "{day}": "date_format(ts, 'yyyy-MM-dd')",
}
_DUCKDB = {
    "{text}": "varchar",
    "{epoch_us}": "epoch_us(ts)",
    "{iso}": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')",
    "{day}": "strftime(ts, '%Y-%m-%d')",
}


def _spelled(name: str, words: dict[str, str]) -> str:
    text = VIEWS[name][1]
    for token, word in words.items():
        text = text.replace(token, word)
    return text


def spark_text(name: str) -> str:
    return _spelled(name, _SPARK)


def duckdb_text(name: str) -> str:
    return _spelled(name, _DUCKDB)


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    order: list[str] = []
    for needed in VIEWS[name][0]:
        order.extend(item for item in _closure(needed) if item not in order)
    return (*order, name)


def ctes(*names: str, **extra: str) -> str:
    """A DuckDB `with` clause holding the named views, then `extra` ones in the order given."""
    order: list[str] = []
    for name in names:
        order.extend(item for item in _closure(name) if item not in order)
    parts = [f"{name} as ({duckdb_text(name)})" for name in order]
    parts += [f"{name} as ({text})" for name, text in extra.items()]
    return "with " + ",\n".join(parts) + "\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame. `{table}` placeholders bind the driver's tables, so no global name is made."""
    text = spark_text(name)
    sources: dict[str, DataFrame] = {}
    for base in (*BASE, *VIEWS[name][0]):
        if re.search(rf"\b(from|join) {base}\b", text):
            sources[base] = view(spark, sf_dir, base) if base in VIEWS else table(spark, sf_dir, base)
    # Braces of the text itself (JSON) are doubled, as `spark.sql` fills in the named tables.
    text = text.replace("{", "{{").replace("}", "}}")
    ctx = "with " + ", ".join(f"{base} as (select * from {{{base}}})" for base in sources)
    return spark.sql(f"{ctx} {text}", **sources)
