from __future__ import annotations

import datetime
import random
from collections import Counter, defaultdict
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millpond.contracts import CONTRACTS, Contract, ContractError, Field, Load, Policy
from millpond.operators import datatests, profiling, validate
from millpond.session import cut

ITEM = Contract(
    "item", "sales", "crm",
    (Field("id", "integer"), Field("name", "string"), Field("price", "number"), Field("day", "date", True),
     Field("live", "boolean", True)),
    ("id",),
)
SCHEMA = "id string, name string, price string, day string, live string, _file string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, "a.csv") if len(v) == 5 else v for v in values], SCHEMA)


def errors(df):
    return {r["id"]: r["e"] for r in df.withColumn("e", validate.error_text()).collect()}


def test_casts_are_narrower_than_sparks(spark):
    checked = validate.check(
        rows(
            spark,
            ("1", "a", "1.5", "2024-02-29", "true"),
            ("2", "a", "x", "2024-02-30", "yes"),
            ("3.0", "a", "1e3", "2024", "FALSE"),
            ("99999999999", "a", ".5", None, None),
            ("5", "", "7", "", ""),
        ),
        ITEM,
    )
    found = errors(checked.rows)
    assert found["1"] == ""
    assert found["2"] == "cast_error:price,cast_error:day,cast_error:live"
    assert found["3.0"] == "cast_error:id,cast_error:day"
    assert found["99999999999"] == "cast_error:id"
    assert found["5"] == "not_null:name"
    assert [r["id"] for r in checked.accepted.collect()] == [1]


def test_first_copy_of_a_key_stays_by_file_then_by_row(spark):
    checked = validate.check(
        rows(
            spark,
            ("7", "b", "1", None, None, "b.csv"),
            ("07", "z", "1", None, None, "a.csv"),
            ("7", "a", "1", None, None, "b.csv"),
            ("7", "b", "1", None, None, "b.csv"),
        ),
        ITEM,
    )
    assert [r["name"] for r in checked.accepted.collect()] == ["z"]
    rejected = {(r["id"], r["name"]): r["_copies"] for r in checked.rejected.collect()}
    assert rejected == {("7", "a"): 1, ("7", "b"): 2}
    assert checked.report().first().asDict()["unique_violations"] == 3


def test_a_merge_takes_the_last_file_and_a_history_every_file(spark):
    copies = rows(
        spark,
        ("7", "b", "1", None, None, "b.csv"),
        ("07", "z", "1", None, None, "a.csv"),
        ("7", "a", "1", None, None, "b.csv"),
        ("7", "a", "1", None, None, "a.csv"),
    )
    load = Load("incremental", "id", ("id",))
    merged = validate.check(copies, replace(ITEM, load=load, write_mode="merge_scd1"))
    assert [(r["name"], r["_file"]) for r in merged.accepted_from().collect()] == [("a", "b.csv")]
    assert merged.report().first()["unique_violations"] == 3
    versions = validate.check(copies, replace(ITEM, load=load, write_mode="merge_scd2"))
    # In one file the smallest row by its own columns, as they are written.
    assert {(r["name"], r["_file"]) for r in versions.accepted_from().collect()} == {("z", "a.csv"), ("a", "b.csv")}


@pytest.mark.parametrize("mode", ["overwrite", "merge_scd1", "merge_scd2"])
@pytest.mark.parametrize("severity", ["warn", "reject"])
def test_counts_taken_while_rows_are_written(spark, mode, severity):
    """Written or not, the same rows, report and shares; with and without repeated keys, and for no rows at all."""
    rng = random.Random(8)
    data = [
        (rng.choice(["1", "01", "2", "x", None, str(i)]), rng.choice(["a", "b", ""]), rng.choice(["1", "z"]), None, "true", f"{rng.choice('abc')}.csv")
        for i in range(200)
    ]
    load = Load("full") if mode == "overwrite" else Load("incremental", "id", ("id",))
    contract = replace(ITEM, load=load, write_mode=mode, policy=Policy(severity, None if severity == "warn" else 0.5))
    for some in (data, [(str(i), *r[1:]) for i, r in enumerate(data)], []):
        plain, written = (validate.check(rows(spark, *some), contract, keep) for keep in (validate._as_is, cut))
        for table in ("rows", "accepted", "rejected"):
            one, two = (getattr(c, table) for c in (plain, written))
            assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))
        assert plain.report().first() == written.report().first()
        assert plain.rejection().first() == written.rejection().first()
        assert sorted(plain.file_status().collect()) == sorted(written.file_status().collect())


def test_rows_without_a_key_are_not_duplicates(spark):
    checked = validate.check(rows(spark, (None, "a", "1", None, None), (None, "a", "1", None, None)), ITEM)
    assert [r["_copies"] for r in checked.rejected.collect()] == [1, 1]
    assert set(errors(checked.rows).values()) == {"not_null:id"}


@pytest.mark.parametrize("seed", range(3))
def test_split_copies_on_a_hot_key_equals_brute_force(spark, seed):
    """A third of the rows share one key, and many of them are identical."""
    rng = random.Random(seed)
    data = [
        (str(0 if rng.random() < 0.34 else rng.randrange(40)), rng.choice("ab"), str(rng.randrange(3)))
        for _ in range(600)
    ]
    df = spark.createDataFrame(data, "k string, a string, b string").repartition(7)
    once, several = (df.join(validate.repeated_keys(df, ["k"]), "k", how).select(*df.columns) for how in ("left_anti", "left_semi"))
    first, later = validate.split_copies(several, ["k"], df.columns)
    first = once.unionByName(first.select(*df.columns))
    groups = defaultdict(list)
    for row in data:
        groups[row[0]].append(row)
    assert sorted(map(tuple, first.collect())) == sorted(min(g) for g in groups.values())
    expected = Counter()
    for g in groups.values():
        expected.update(sorted(g)[1:])
    assert {tuple(r)[:3]: r["_copies"] for r in later.select("k", "a", "b", "_copies").collect()} == expected


def test_policies(spark):
    data = rows(spark, ("1", "a", "1", None, None), ("x", "a", "1", None, None), ("3", "a", "1", None, None))
    warned = validate.check(data, ITEM.with_policy("warn"))
    assert warned.accepted.count() == 3 and warned.rejected.count() == 0
    warned.enforce()
    assert warned.report().first()["warnings"] == 1
    rejecting = validate.check(data, ITEM)
    assert (rejecting.accepted.count(), rejecting.rejected.count()) == (2, 1)
    rejecting.enforce()
    with pytest.raises(validate.RunAborted):
        validate.check(data, ITEM.with_policy("abort")).enforce()


@pytest.mark.parametrize("limit, stops", [(0.25, False), (0.2499, True), (1.0, False), (0.0, True)])
def test_rejection_rate_at_the_limit_passes(spark, limit, stops):
    data = rows(spark, *[(str(i), "a", "1" if i else "bad", None, None) for i in range(4)])
    checked = validate.check(data, ITEM.with_policy("reject", limit))
    assert (checked.accepted.count(), checked.rejected.count()) == (3, 1)
    assert checked.rejection().first()["exceeded"] is stops
    if stops:
        with pytest.raises(validate.RunAborted):
            checked.enforce()
    else:
        checked.enforce()


def test_empty_source_passes(spark):
    checked = validate.check(rows(spark).limit(0), ITEM.with_policy("reject", 0.0))
    assert checked.report().first()["rows"] == 0
    checked.enforce()


def test_missing_column_stops_and_extra_is_left_out(spark):
    data = spark.createDataFrame([("1", "a", "x")], "id string, name string, more string")
    assert validate.schema_mismatch(data, ITEM) == (["price", "day", "live"], ["more"])
    with pytest.raises(validate.RunAborted):
        validate.check(data, ITEM)


def test_contract_rules():
    assert len(CONTRACTS) == 15 and all(not f.nullable for c in CONTRACTS.values() for f in c.fields)
    for broken in (
        lambda: Policy("reject", 1.5),
        lambda: Policy("warn", 0.1),
        lambda: Policy("ignore"),
        lambda: Load("incremental"),
        lambda: Load("full", "ts", ("id",)),
        lambda: Contract("x", "d", "s", (Field("a", "string"),), ("b",)),
        lambda: Contract("x", "d", "s", (Field("a", "text"),), ("a",)),
        lambda: Contract("x", "d", "s", (Field("a", "string"),), ("a",), write_mode="append"),
        lambda: Contract("x", "d", "s", (Field("a", "string"),), ("a",), load=Load("incremental", "a", ("a",))),
    ):
        with pytest.raises(ContractError):
            broken()


def test_snake_case():
    cases = {"OrderID": "order_id", "HTTPCode": "http_code", "order id": "order_id", " a-b ": "a_b", "x2Y": "x2_y"}
    assert {k: validate.snake_case(k) for k in cases} == cases


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError):
        validate.normalize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))


def test_infer_columns(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "2024-01-01", "", "1"), ("-2", "3", "2024-01-02", "", "x"), ("", "", "", "", "")],
        "i string, n string, d string, e string, s string",
    )
    assert {r["name"]: r["type"] for r in validate.infer_columns(df).collect()} == {
        "i": "integer", "n": "number", "d": "date", "e": "string", "s": "string",
    }


def test_data_tests(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, None), (None, None)], "id int, b string")
    assert datatests.not_null(df, "b").count() == 3
    assert [tuple(r) for r in datatests.unique(df, "id").collect()] == [(1, 2)]
    assert [tuple(r) for r in datatests.unique_combination(df, ["id", "b"]).collect()] == [(None, None, 2)]
    parent = spark.createDataFrame([(2,), (None,)], "pk int")
    assert [tuple(r) for r in datatests.orphans(df, "id", parent, "pk").collect()] == [(1, 2)]


def test_profile_gates(spark):
    df = spark.createDataFrame([(1, "aa", None), (1, None, None), (3, "b", None)], "n int, t string, z double")
    assert profiling.profile(df, "Restricted") is None and profiling.profile(df, None) is None
    assert profiling.profile(df, "Public", role="Mart") is None
    assert "min_value" not in profiling.profile(df, "Confidential").columns
    found = {r["column_name"]: r.asDict() for r in profiling.profile(df, "Public").collect()}
    assert (found["n"]["distinct_count"], found["n"]["mean_value"]) == (2, 5 / 3)
    assert (found["t"]["min_value"], found["t"]["max_value"], found["t"]["null_count"]) == (1.0, 2.0, 1)
    assert (found["z"]["values_count"], found["z"]["null_proportion"], found["z"]["mean_value"]) == (0, 1.0, None)


def test_profile_of_every_type(spark):
    schema = "`a.b` int, big bigint, d decimal(12,2), wide decimal(38,2), day date, m map<string,int>, l array<int>, flag boolean, f double"
    big, day = 2**63 - 1, datetime.date(2024, 1, 2)
    rows = [
        (1, big, Decimal("1.10"), Decimal("9" * 36 + ".99"), day, {"x": 1}, [1], True, 0.0),
        (1, big, Decimal("1.20"), Decimal("9" * 36 + ".99"), day, {"x": 1}, [1], None, -0.0),
        (None, big - 2, None, None, None, {"x": 2}, [], False, None),
    ]
    df = spark.createDataFrame(rows, schema)
    found = {r["column_name"]: r.asDict() for r in profiling.profile(df, "Public").collect()}
    assert {n: r["distinct_count"] for n, r in found.items()} == {"a.b": 1, "big": 2, "d": 2, "wide": 1, "day": 1, "m": 2, "l": 2, "flag": 2, "f": 1}
    assert (found["big"]["mean_value"], found["d"]["mean_value"], found["wide"]["mean_value"]) == (float(3 * big - 2) / 3, 1.15, 1e36)
    assert found["day"]["mean_value"] == 19724 and found["m"]["mean_value"] is None and found["flag"]["min_value"] is None
    assert profiling.profile(df.where("flag = false and flag = true"), "Public").count() == 0
    # Values keep their types: none becomes a text, and one shuffle of grouping sets serves all distinct counts.
    plan = profiling.profile(df.select("big", "d", "day"), "Internal")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and "as string" not in plan and "Generate" not in plan.split("Expand")[1]


@pytest.mark.parametrize("mode", ["overwrite", "merge_scd1", "merge_scd2"])
def test_folded_rows_group_only_what_can_repeat(spark, mode):
    """One row per different row and its errors, keyless copies and repeated keys among them, as grouping them all gives."""
    contract = Contract("t", "d", "s", (Field("id", "integer"), Field("v", "integer")), ("id",), write_mode=mode)
    rows = [("1", "1", "a"), ("2", "x", "a"), ("2", "x", "b"), ("02", "x", "b"), ("3", "4", "a"), ("3", "4", "a"), ("3", "4", "b"),
            (None, "7", "a"), (None, "7", "a"), (None, "7", "b"), ("y", "1", "a"), ("y", "1", "a"), ("9", "", "b")]
    raw = spark.createDataFrame(rows, f"id string, v string, {validate.FILE} string")
    for keep in (cut, validate._as_is):
        checked = validate.check(raw, contract, keep)
        for columns in ([], [validate.FILE]):
            for rejected in (False, True):
                whole = checked.rejected if rejected else checked.rows
                want = whole.withColumn("errors", validate.error_text()).groupBy("id", "v", *columns, "errors")
                want = Counter(map(tuple, want.agg(F.sum(validate.COPIES).alias("copies")).collect()))
                assert Counter(map(tuple, checked.folded(*columns, rejected=rejected).collect())) == want
    assert sum(r.copies for r in validate.check(raw, contract, cut).folded().collect()) == len(rows)


def test_a_report_alone_writes_no_checked_rows(spark):
    """Without `keep_rows` the report is the same, and what is written holds no row of a key that is not repeated."""
    contract = Contract("t", "d", "s", (Field("id", "string"), Field("v", "integer")), ("id",))
    raw = spark.range(2000).selectExpr("concat('k', if(id < 5, 0, id)) as id", "if(id % 9 = 0, 'x', cast(id as string)) as v")
    written = []

    def keep(df, label="cut", by=()):
        written.append((label, (held := cut(df, label, by)).count(), held.columns))
        return held

    report = validate.check(raw, contract, keep, keep_rows=False).report().collect()
    assert [(label, n) for label, n, _ in written] == [("cut", 1), ("cut", 5)]
    assert report == validate.check(raw, contract, keep).report().collect() == validate.check(raw, contract).report().collect()
    # Checked rows are written without a second, typed copy of their key.
    assert [c for label, _, c in written if label == "checked"] == [["id", "v", "_errors", "_repeated"]]


def test_a_suite_runs_a_table_at_a_time(spark, monkeypatch):
    """All tests were one plan, whose stages were all on the driver at once."""
    from millpond.queries import validation

    tables = {
        "parent": spark.createDataFrame([(1,), (2,), (2,)], "pk int"),
        "child": spark.createDataFrame([(1, 1), (2, 9), (None, 9)], "id int, pk int"),
        "plain": spark.createDataFrame([], "x int"),
    }
    suite = datatests.Suite(
        not_null={"parent": ["pk"], "child": ["id", "pk"]},
        unique={"parent": "pk"},
        combinations={"child": ["id", "pk"]},
        relationships=[("child", "pk", "parent", "pk")],
        reconciled=[],
        fact="child",
    )
    apart = suite.by_table(tables)
    want = {("parent", "not_null", "pk", 0), ("parent", "unique", "pk", 1), ("child", "not_null", "id", 1)}
    want |= {("child", "not_null", "pk", 0), ("child", "unique_combination", "id,pk", 0), ("child", "relationships", "pk", 1)}
    assert {tuple(r) for r in suite.run(tables).collect()} == want
    assert {n: {tuple(r) for r in df.collect()} for n, df in apart.items()} == {
        n: {r for r in want if r[0] == n} for n in ("parent", "child")
    }
    monkeypatch.setattr(datatests, "GOLD_SUITE", suite)
    monkeypatch.setattr(validation, "build_gold", lambda *_: tables)
    rows = validation._suite(spark, "unused")
    assert {tuple(r) for r in rows.collect()} == want | {(n, "has_rows", "*", int(n == "plain")) for n in tables}
    # What is left to run is a scan of the written rows.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Aggregate" not in plan and "Union" not in plan
