"""Facts, dimensions and marts, each beside its DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import marts, star
from ..registry import register
from ..shapes import ctes, view

FACT = """select ol.line_id, ol.order_id, o.order_date, o.status as order_status, o.region as order_region,
o.customer_id as account_id, o.channel_id, o.promotion_id, ol.product_id, ol.quantity, ol.unit_price,
cast(ol.quantity * ol.unit_price as decimal(18, 2)) as gross_amount, ol.discount_amount,
cast(ol.quantity * ol.unit_price - ol.discount_amount as decimal(18, 2)) as net_amount,
cast(ol.quantity * cast(p.unit_cost as decimal(18, 4)) as decimal(18, 2)) as cost_amount
from order_lines_v ol left join orders_v o on ol.order_id = o.order_id
left join products_v p on ol.product_id = p.product_id"""

POSITION = """select r.product_id, r.warehouse_id, w.warehouse_name, w.region,
cast(r.snapshot_date as varchar) as snapshot_date, r.on_hand_units, r.allocated_units,
cast(r.on_hand_units - r.allocated_units as integer) as available_units, r.reorder_point,
case when r.on_hand_units - r.allocated_units <= r.reorder_point then 'reorder' else 'healthy' end as inventory_status
from (select *, row_number() over (partition by warehouse_id, product_id order by snapshot_date desc, snapshot_id,
on_hand_units, allocated_units) as rn from inventory_snapshots_v) r
join warehouses_v w on r.warehouse_id = w.warehouse_id where r.rn = 1"""

RISK = """select ip.product_id, ip.warehouse_id, ip.warehouse_name, ip.region, ip.available_units, ip.reorder_point,
ip.inventory_status, cast(coalesce(s.events, 0) as bigint) as stockout_event_count,
cast(coalesce(s.lost, 0) as bigint) as lost_units,
case when ip.inventory_status = 'reorder' and coalesce(s.events, 0) >= 1 then 'high'
when ip.inventory_status = 'reorder' then 'medium' else 'low' end as stockout_risk
from position ip left join (select warehouse_id, product_id, count(*) as events, sum(lost_units) as lost
from stockout_events_v group by 1, 2) s on ip.warehouse_id = s.warehouse_id and ip.product_id = s.product_id"""

RECEIPTS = """select po.purchase_order_id, po.supplier_id, po.product_id, po.warehouse_id, po.order_date,
po.expected_date, po.ordered_units, cast(coalesce(s.n, 0) as integer) as shipment_count, s.ship_date, s.delivered_date,
s.received_units from purchase_orders_v po left join (select purchase_order_id, count(*) as n,
min(ship_date) as ship_date, max(delivered_date) as delivered_date, cast(sum(received_units) as integer)
as received_units from shipments_v group by 1) s on po.purchase_order_id = s.purchase_order_id"""

RELIABILITY = """select s.supplier_id, s.supplier_name, s.country, s.risk_tier,
cast(count(*) as bigint) as purchase_order_count, cast(sum(r.ordered_units) as bigint) as ordered_units,
cast(sum(r.received_units) as bigint) as received_units,
avg(date_diff('day', r.expected_date, r.delivered_date)) as avg_days_late,
avg(case when r.delivered_date <= r.expected_date then 1.0::double else 0.0::double end) as on_time_rate
from receipts r join suppliers_v s on r.supplier_id = s.supplier_id where r.delivered_date is not null
group by 1, 2, 3, 4"""

HEALTH = """select a.account_id, a.account_name, a.segment, a.region, cast(cast(a.arr as decimal(18, 2)) as double)
as arr, s.status as subscription_status,
cast(cast(s.monthly_recurring_revenue as decimal(18, 2)) as double) as monthly_recurring_revenue,
cast(coalesce(t.n, 0) as bigint) as ticket_count, coalesce(t.hours, 0.0::double) as avg_resolution_hours,
coalesce(t.met, 1.0::double) as sla_rate, coalesce(n.nps, 7.0::double) as avg_nps,
cast(50 + coalesce(n.nps, 7.0::double) * 3 + coalesce(t.met, 1.0::double) * 20 - coalesce(t.n, 0) * 2
- case when s.status = 'past_due' then 20 else 0 end as double) as health_score
from accounts_v a join subscriptions_v s on a.account_id = s.account_id
left join (select account_id, count(*) as n, avg(resolution_hours) as hours,
avg(case when sla_met then 1.0::double else 0.0::double end) as met from support_tickets_v group by 1) t
on a.account_id = t.account_id
left join (select account_id, avg(score) as nps from nps_responses_v group by 1) n on a.account_id = n.account_id"""

CHURN = """select segment, region, case when health_score < 55 then 'high' when health_score < 75 then 'medium'
else 'low' end as churn_risk, cast(count(*) as bigint) as account_count,
cast(sum(cast(arr as decimal(18, 2))) as double) as arr_at_risk, avg(health_score) as avg_health_score
from health group by 1, 2, 3"""

SLA = """select a.account_id, a.account_name, a.segment, a.region, t.priority, cast(count(*) as bigint) as ticket_count,
avg(t.resolution_hours) as avg_resolution_hours,
cast(sum(case when t.sla_met then 1 else 0 end) as bigint) as tickets_met_sla,
avg(case when t.sla_met then 1.0::double else 0.0::double end) as sla_rate
from accounts_v a join support_tickets_v t on a.account_id = t.account_id group by 1, 2, 3, 4, 5"""

FACT_VIEWS = ("orders_v", "order_lines_v", "products_v")
HEALTH_VIEWS = ("accounts_v", "subscriptions_v", "support_tickets_v", "nps_responses_v")
POSITION_VIEWS = ("inventory_snapshots_v", "warehouses_v")
RISK_VIEWS = (*POSITION_VIEWS, "stockout_events_v")
RECEIPT_VIEWS = ("purchase_orders_v", "shipments_v")

BY_DAY = """select cast(order_date as varchar) as order_date, order_region as region,
cast(count(distinct order_id) as bigint) as order_count, cast(sum(quantity) as bigint) as units_sold,
cast(sum(gross_amount) as double) as gross_revenue, cast(sum(discount_amount) as double) as discount_amount,
cast(sum(net_amount) as double) as net_revenue from fact where order_status = 'fulfilled'
group by order_date, order_region"""

BY_CHANNEL = """select c.channel_name, c.channel_type, p.discount_type, f.order_region as region,
cast(count(distinct f.order_id) as bigint) as order_count, cast(sum(f.net_amount) as double) as net_revenue,
cast(sum(f.discount_amount) as double) as discount_amount from fact f
join channels_v c on f.channel_id = c.channel_id join promotions_v p on f.promotion_id = p.promotion_id
where f.order_status = 'fulfilled' group by 1, 2, 3, 4"""

BY_SEGMENT = """select a.segment, a.region, cast(count(distinct f.order_id) as bigint) as order_count,
cast(sum(f.net_amount) as double) as net_revenue from fact f join accounts_v a on f.account_id = a.account_id
where f.order_status = 'fulfilled' group by 1, 2"""

MARGIN = """select p.product_id, p.product_name, p.category, cast(count(*) as bigint) as line_count,
cast(sum(f.quantity) as bigint) as units_sold, cast(sum(f.net_amount) as double) as net_revenue,
cast(sum(f.cost_amount) as double) as total_cost, cast(sum(f.net_amount - f.cost_amount) as double) as gross_margin
from fact f join products_v p on f.product_id = p.product_id where f.order_status = 'fulfilled' group by 1, 2, 3"""


class Gold:
    """The Gold tables of one data folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir = spark, sf_dir

    def silver(self, name: str) -> DataFrame:
        return view(self._spark, self._dir, f"{name}_v")

    def accounts(self) -> DataFrame:
        return star.dim_account(self.silver("accounts"))

    def products(self) -> DataFrame:
        return star.dim_product(self.silver("products"))

    def channels(self) -> DataFrame:
        return star.dim_channel(self.silver("channels"))

    def promotions(self) -> DataFrame:
        return star.dim_promotion(self.silver("promotions"))

    def suppliers(self) -> DataFrame:
        return star.dim_supplier(self.silver("suppliers"))

    def warehouses(self) -> DataFrame:
        return star.dim_warehouse(self.silver("warehouses"))

    def fact(self) -> DataFrame:
        return star.fct_order_lines(self.silver("order_lines"), self.silver("orders"), self.silver("products"))

    def rollup(self) -> DataFrame:
        return marts.order_rollup(self.silver("order_lines"), self.silver("orders"))

    def tickets(self) -> DataFrame:
        return star.fct_support_tickets(self.silver("support_tickets"))

    def responses(self) -> DataFrame:
        return star.fct_nps_responses(self.silver("nps_responses"))

    def subscriptions(self) -> DataFrame:
        return star.fct_subscriptions(self.silver("subscriptions"))

    def snapshots(self) -> DataFrame:
        return star.fct_inventory_snapshots(self.silver("inventory_snapshots"))

    def stockouts(self) -> DataFrame:
        return star.fct_stockout_events(self.silver("stockout_events"))

    def receipts(self) -> DataFrame:
        return star.fct_purchase_order_receipts(self.silver("purchase_orders"), self.silver("shipments"))

    def by_day(self) -> DataFrame:
        return marts.revenue_by_day(self.rollup(), rolled_up=True)

    def by_channel(self) -> DataFrame:
        return marts.revenue_by_channel(self.rollup(), self.channels(), self.promotions(), rolled_up=True)

    def by_segment(self) -> DataFrame:
        return marts.revenue_by_segment(self.rollup(), self.accounts(), rolled_up=True)

    def margin(self) -> DataFrame:
        return marts.margin_by_product_from_lines(self.silver("order_lines"), self.silver("orders"), self.products())

    def health(self) -> DataFrame:
        return marts.customer_health(self.accounts(), self.subscriptions(), self.tickets(), self.responses())

    def churn(self) -> DataFrame:
        return marts.churn_risk(self.health())

    def sla(self) -> DataFrame:
        return marts.support_sla(self.accounts(), self.tickets())

    def position(self) -> DataFrame:
        return marts.inventory_position(self.snapshots(), self.warehouses())

    def risk(self) -> DataFrame:
        return marts.stockout_risk(self.position(), self.stockouts())

    def reliability(self) -> DataFrame:
        return marts.supplier_reliability(self.receipts(), self.suppliers())


def _model(name: str, covers: tuple[str, ...], build: str, sql: str) -> None:
    @register(name, *covers, sql=sql)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(Gold(spark, sf_dir), build)()


_model(
    "dim_account",
    ("C1", "J1"),
    "accounts",
    ctes("accounts_v") + """select account_id, account_name, segment, region as account_region,
    cast(signup_date as varchar) as signup_date, cast(cast(arr as decimal(18, 2)) as double) as arr from accounts_v""",
)
_model(
    "dim_product",
    ("C2",),
    "products",
    ctes("products_v") + """select product_id, product_name, category,
    cast(cast(unit_cost as decimal(18, 4)) as double) as unit_cost from products_v""",
)
_model("dim_channel", ("C3",), "channels", ctes("channels_v") + "select * from channels_v")
_model("dim_promotion", ("C4", "I4"), "promotions", ctes("promotions_v") + "select * from promotions_v")
_model(
    "fct_order_lines",
    ("C5", "E2", "J4"),
    "fact",
    ctes(*FACT_VIEWS, fact=FACT) + """select line_id, order_id, cast(order_date as varchar) as order_date, order_status,
    order_region, account_id, channel_id, promotion_id, product_id, quantity, cast(unit_price as double) as unit_price,
    cast(gross_amount as double) as gross_amount, cast(discount_amount as double) as discount_amount,
    cast(net_amount as double) as net_amount, cast(cost_amount as double) as cost_amount from fact""",
)
_model(
    "fct_subscriptions",
    ("C6",),
    "subscriptions",
    ctes("subscriptions_v") + """select subscription_id, account_id, plan_name, status,
    cast(start_date as varchar) as start_date, cast(renewal_date as varchar) as renewal_date,
    cast(cast(monthly_recurring_revenue as decimal(18, 2)) as double) as monthly_recurring_revenue
    from subscriptions_v""",
)
_model(
    "fct_support_tickets",
    ("C7",),
    "tickets",
    ctes("support_tickets_v") + """select ticket_id, account_id, cast(opened_date as varchar) as opened_date, priority,
    resolution_hours, sla_met from support_tickets_v""",
)
_model(
    "fct_nps_responses",
    ("C8",),
    "responses",
    ctes("nps_responses_v") + """select response_id, account_id, cast(response_date as varchar) as response_date, score
    from nps_responses_v""",
)
_model("dim_supplier", ("C9",), "suppliers", ctes("suppliers_v") + "select * from suppliers_v")
_model(
    "dim_warehouse",
    ("C10",),
    "warehouses",
    ctes("warehouses_v")
    + "select warehouse_id, warehouse_name, region as warehouse_region, capacity_units from warehouses_v",
)
_model(
    "fct_inventory_snapshots",
    ("C11",),
    "snapshots",
    ctes("inventory_snapshots_v") + """select snapshot_id, cast(snapshot_date as varchar) as snapshot_date,
    warehouse_id, product_id, on_hand_units, allocated_units, reorder_point from inventory_snapshots_v""",
)
_model(
    "fct_stockout_events",
    ("C12",),
    "stockouts",
    ctes("stockout_events_v") + """select event_id, cast(event_date as varchar) as event_date, warehouse_id, product_id,
    lost_units, root_cause from stockout_events_v""",
)
_model(
    "fct_purchase_order_receipts",
    ("C13", "E3", "F7", "J2"),
    "receipts",
    ctes(*RECEIPT_VIEWS, receipts=RECEIPTS) + """select purchase_order_id, supplier_id, product_id, warehouse_id,
    cast(order_date as varchar) as order_date, cast(expected_date as varchar) as expected_date, ordered_units,
    shipment_count, cast(ship_date as varchar) as ship_date, cast(delivered_date as varchar) as delivered_date,
    received_units from receipts""",
)
_model(
    "mart_order_revenue_by_day", ("D1", "F2", "F3", "C14"), "by_day", ctes(*FACT_VIEWS, fact=FACT) + BY_DAY
)
_model(
    "mart_order_revenue_by_channel",
    ("D2", "E1"),
    "by_channel",
    ctes(*FACT_VIEWS, "channels_v", "promotions_v", fact=FACT) + BY_CHANNEL,
)
_model(
    "mart_order_revenue_margin_by_product", ("D3", "F8"), "margin", ctes(*FACT_VIEWS, fact=FACT) + MARGIN
)
_model(
    "mart_order_revenue_by_account_segment",
    ("D4",),
    "by_segment",
    ctes(*FACT_VIEWS, "accounts_v", fact=FACT) + BY_SEGMENT,
)
_model("mart_customer_health_score", ("D5", "F1", "F4", "F5"), "health", ctes(*HEALTH_VIEWS) + HEALTH)
_model("mart_support_sla_by_customer", ("D7", "F6"), "sla", ctes("accounts_v", "support_tickets_v") + SLA)
_model("mart_inventory_position", ("D8", "G1"), "position", ctes(*POSITION_VIEWS) + POSITION)
_model("mart_stockout_risk", ("D9", "E4"), "risk", ctes(*RISK_VIEWS, position=POSITION) + RISK)
_model(
    "mart_supplier_delivery_reliability",
    ("D10", "J6"),
    "reliability",
    ctes(*RECEIPT_VIEWS, "suppliers_v", receipts=RECEIPTS) + RELIABILITY,
)


@register(
    "mart_churn_risk_by_segment",
    "D6",
    "F9",
    "J3",
    sql=ctes(*HEALTH_VIEWS, health=HEALTH) + f"select * replace (round(avg_health_score, 10) as avg_health_score) "
    f"from ({CHURN})",
)
def _churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An average of doubles depends on the order of addition in its last digits; both sides round them away.
    return Gold(spark, sf_dir).churn().withColumn("avg_health_score", F.round("avg_health_score", 10))


# The same marts read from the line fact instead of the rollup.
@register("mart_order_revenue_by_day_from_fact", "D1", sql=ctes(*FACT_VIEWS, fact=FACT) + BY_DAY)
def _by_day_from_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.revenue_by_day(Gold(spark, sf_dir).fact())


@register(
    "mart_order_revenue_by_channel_from_fact",
    "D2",
    sql=ctes(*FACT_VIEWS, "channels_v", "promotions_v", fact=FACT) + BY_CHANNEL,
)
def _by_channel_from_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = Gold(spark, sf_dir)
    return marts.revenue_by_channel(gold.fact(), gold.channels(), gold.promotions())


@register("mart_order_revenue_margin_by_product_from_fact", "D3", sql=ctes(*FACT_VIEWS, fact=FACT) + MARGIN)
def _margin_from_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = Gold(spark, sf_dir)
    return marts.margin_by_product(gold.fact(), gold.products())
