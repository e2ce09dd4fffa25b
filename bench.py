"""Time the headline queries at `$BENCH_SF_DIR` on `local[$BENCH_CPUS]`; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import millpond.queries  # noqa: E402, F401
from millpond.registry import QUERIES, runner  # noqa: E402
from millpond.session import build  # noqa: E402

HEADLINE = (
    "fct_order_lines",
    "mart_order_revenue_by_day",
    "mart_order_revenue_by_channel",
    "mart_order_revenue_margin_by_product",
    "mart_order_revenue_by_account_segment",
    "mart_customer_health_score",
    "mart_support_sla_by_customer",
    "mart_inventory_position",
    "mart_stockout_risk",
    "mart_supplier_delivery_reliability",
    "validate_entity_report",
    "test_unique_combination",
    "test_relationships",
    "metric_by_month",
    "profile_values",
    "merge_latest",
    "quality_signal_warn",
    "run_counts",
    "counter_increase",
    "log_archive_landing",
    "log_severity_floor",
    "incident_timeline",
    "table_diff",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        started = time.perf_counter()
        runner(QUERIES[name])(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # One pass warms the JVM, the second is what a running application sees.
    times = {}
    for name in HEADLINE:
        timed(name)
        times[name] = round(timed(name), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
