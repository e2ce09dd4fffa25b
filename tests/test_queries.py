"""Every registered query on the smallest data, beside its DuckDB text, and the shape of its plan."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
import millpond.queries  # noqa: F401
from millpond.registry import QUERIES, runner

FOLDER = "/root/testdata/sf0.001"
INVENTORY = dict(zip("ABCDEFGHIJKLMNOPQRSTU", (22, 13, 14, 10, 14, 15, 8, 6, 4, 21, 6, 9, 2, 5, 12, 13, 8, 11, 13, 3, 4)))
# Results that are rightly empty on the smallest data.
MAY_BE_EMPTY = ()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_duckdb(spark, duck, name):
    query = QUERIES[name]
    df = runner(query)(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # No plan pairs every row with every other, and none leaves the JVM.
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas", "MapInArrow", "FlatMap"):
        assert operator not in plan
    if query.sql is None:
        assert df.count() > 0
        return
    n, problems = compare(df, duck, query.sql)
    assert not problems, "\n".join(problems)
    assert n > 0 or name in MAY_BE_EMPTY


def test_every_inventory_row_is_covered():
    covered = {row for query in QUERIES.values() for row in query.covers}
    wanted = {f"{letter}{n}" for letter, count in INVENTORY.items() for n in range(1, count + 1)}
    assert not wanted - covered


def test_driver_contract(spark):
    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names)
    assert contract.entry(spark).count() > 0


def test_latest_per_key_is_limited_before_the_shuffle(spark):
    plan = runner(QUERIES["mart_inventory_position"])(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = runner(QUERIES["fct_stockout_events"])(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_tax" not in plan and "l_discount" not in plan
