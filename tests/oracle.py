"""Compare a Spark result with its DuckDB text: names, types and the multiset of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _cell(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """The number of Spark rows and what differs."""
    rows = [tuple(r) for r in df.collect()]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(types):
        return len(rows), [f"columns {sorted(types)} vs {sorted(names)}"]
    problems = []
    off = {c: (types[c], kinds[c]) for c in names if TYPES.get(types[c], types[c]) != kinds[c]}
    if off:
        problems.append(f"types {off}")
    order = [list(types).index(c) for c in names]
    got = Counter(tuple(_cell(r[i]) for i in order) for r in rows)
    expected = Counter(tuple(_cell(v) for v in r) for r in want)
    if got != expected:
        extra, gone = got - expected, expected - got
        problems.append(
            f"{len(rows)} vs {len(want)} rows, {sum(extra.values())} differ in {names}\n"
            f"   spark {sorted(map(str, extra))[:3]}\n   duck  {sorted(map(str, gone))[:3]}"
        )
    return len(rows), problems
