"""Where each named query meets its Spark plan and, if one exists, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .session import present, size_shuffles, tune

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, *covers: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under `name`; `covers` lists the inventory rows it answers."""

    def bind(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, covers, plan, sql)
        return plan

    return bind


def runner(query: Query) -> Plan:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        size_shuffles(tune(spark), sf_dir)
        return present(query.plan(spark, sf_dir))

    return run
