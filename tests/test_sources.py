from __future__ import annotations

import gzip
import json
import os
import random
from collections import Counter
from dataclasses import replace
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millpond import product
from millpond.contracts import Contract, ContractError, Field, Load
from millpond.functions import loglines
from millpond.plans import logs
from millpond.sources import export, extract, files, loads
from millpond.sources.archive import Archive
from millpond.sources.keyed import Keyed
from millpond.streaming import ingest


def test_csv_records_are_not_lines(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as out:
        out.write('id,note\n1,"two\nlines"\n\n2,"say ""hi"", twice"\n3,\n')
    found = {r["id"]: r["note"] for r in files.csv_scan(spark, folder).collect()}
    assert found == {"1": "two\nlines", "2": 'say "hi", twice', "3": None}
    assert files.csv_row_count(spark, folder) == 3


def test_a_contract_says_whether_csv_files_split(spark, folder):
    """A source without line breaks inside fields is read in splits of its one file, to the same Silver rows."""
    made = Contract("item", "sales", "crm", (Field("id", "integer"), Field("note", "string")), primary_key=("id",))
    where = f"{folder}/bronze/crm/item"
    os.makedirs(where)
    with open(f"{where}/a.csv", "w") as out:
        out.write("id,note\n" + "".join(f'{n},"say ""{n}"""\n' for n in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        whole, split = (files.csv_scan(spark, where, multiline=m).drop("_file") for m in (True, False))
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 2
        assert sorted(whole.collect()) == sorted(split.collect())
        tables = []
        for contract in (made, replace(made, multiline=False)):
            run = product.Run(spark, f"{folder}/bronze", f"{folder}/{contract.multiline}", "dev", "stock", "r")
            product.silver(run, contract)
            tables.append(sorted(tuple(r) for r in product.silver_table(run, contract).read().select("id", "note").collect()))
        assert tables[0] == tables[1] and len(tables[0]) == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_csv_is_an_error(spark, folder):
    os.makedirs(folder)
    with open(f"{folder}/a.csv", "w") as out:
        out.write("id,note\n")
    with pytest.raises(files.EmptySource):
        files.csv_row_count(spark, folder)


def test_ndjson_keeps_carriage_returns(spark, folder):
    path = f"{folder}/namespace=dev/date=2024-01-01/hour=05"
    os.makedirs(path)
    record = json.dumps({"schema": logs.SCHEMA_V2, "message": "a", "time": "2024-01-01T05:00:00Z"})
    with gzip.open(f"{path}/x.ndjson.gz", "wt", newline="") as out:
        out.write(f"{record}\n\n[1]\n \r\n{record}\r\n")
    lines = files.ndjson_lines(spark, folder)
    parsed = logs.parse_records(logs.with_line_index(lines))
    assert sorted(r["line_index"] for r in parsed.collect()) == [0, 2]
    kept = lines.where(
        files.window_partitions(datetime(2024, 1, 1, 6, tzinfo=UTC), datetime(2024, 1, 1, 9, tzinfo=UTC))
    )
    assert kept.count() == 0


def test_an_archive_of_mixed_depth(spark, folder):
    """Objects under an hour, a date or neither are one archive, and a filter on what their paths say opens no other file."""
    places = ["namespace=dev/date=2024-01-01/hour=05", "namespace=dev/date=2024-01-01", "namespace=dev/date=2024-01-02", "namespace=prod/date=2024-01-01/hour=07", ""]
    for n, place in enumerate(places):
        os.makedirs(f"{folder}/{place}", exist_ok=True)
        with gzip.open(f"{folder}/{place}/x{n}.ndjson.gz", "wt") as out:
            out.write(f'{{"n": {n}}}\n')
    lines = files.ndjson_lines(spark, folder)
    found = {(r["namespace"], r["date"], r["hour"]) for r in lines.collect()}
    assert found == {("dev", "2024-01-01", 5), ("dev", "2024-01-01", None), ("dev", "2024-01-02", None), ("prod", "2024-01-01", 7), (None, None, None)}
    window = files.window_partitions(datetime(2024, 1, 1, 6, tzinfo=UTC), datetime(2024, 1, 1, 9, tzinfo=UTC))
    kept = lines.where(F.col("namespace") == "dev").where(window)
    # An object without an hour may hold the window's lines; the one of another hour does not.
    assert [(r["date"], r["hour"]) for r in kept.collect()] == [("2024-01-01", None)]
    kept._jdf.queryExecution().executedPlan().executeCollect()
    scan = kept._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1


def _records(spark, *lines):
    fields = dict.fromkeys((*logs.V2_FIELDS, *logs.V1_FIELDS, "day", "file_digest"))
    schema = ", ".join(f"{name} string" for name in fields) + ", line_index long"
    return spark.createDataFrame([tuple({**fields, "day": "d", "file_digest": "f", **line}.values()) + (n,) for n, line in enumerate(lines)], schema)


def _v2(time, message="m", key=None, namespace="dev", pod="p"):
    return {"schema": logs.SCHEMA_V2, "time": time, "namespace": namespace, "pod": pod, "container": "c", "message": message, "dedup_key": key}


def _files_read(df):
    df._jdf.queryExecution().executedPlan().executeCollect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_a_landed_archive_is_read_by_folder(spark, folder):
    archive = Archive(spark, folder)
    first = _records(
        spark,
        _v2("2024-01-01T05:00:00.000000001Z", "level=error a", "k1"),
        _v2("2024-01-02T05:00:00Z", "level=info b", "k2"),
        _v2("no time", "level=error c", "k3"),
        _v2("2024-01-01T05:00:00Z", "level=error d", "k4", namespace="prod"),
    )
    archive.land(first, "1")
    archive.land(first, "1")
    # A replay lands later; an older copy of `a` has the same stamp and text, another line has not.
    older = {"schema": logs.SCHEMA_V1, "archived_at": "2024-01-01T06:00:00Z", "namespace": "dev", "pod": "p", "container": "c"}
    archive.land(
        _records(
            spark,
            _v2("2024-01-01T05:00:00.000000001Z", "level=error a", "k1"),
            {**older, "line": "2024-01-01T05:00:00.000000001Z level=error a"},
            {**older, "line": "2024-01-01T05:00:00.000000002Z level=error a"},
            {**older, "pod": None, "line": "marker"},
        ),
        "2",
    )

    def found(**filters):
        return sorted((r["ns"], r["layout"], r["message"]) for r in archive.search(logs.Search("dev", **filters)).collect())

    day = 1704067200 * 10**9
    a, older_a = (day + 18000 * 10**9 + 1, 0, "level=error a"), (day + 18000 * 10**9 + 2, 1, "level=error a")
    b, c = (day + 104400 * 10**9, 0, "level=info b"), (-1, 0, "level=error c")
    assert found() == [c, a, older_a, b]
    # A line without a readable time is in no window.
    assert found(until="2024-01-02 05:00:00") == [a, older_a]
    assert found(since="2024-01-02 05:00:00") == [b]
    assert found(severity="error") == [c, a, older_a]
    assert found(text="LEVEL=INFO") == [b]
    day_two = archive.lines().where(logs.Search("dev", since="2024-01-02 00:00:00", pod="p").wanted())
    assert _files_read(day_two) == 1
    assert "EqualTo(pod,p)" in day_two._jdf.queryExecution().executedPlan().toString()
    assert _files_read(archive.lines().where(logs.Search("prod").wanted())) == 1


def test_late_lines_are_looked_up_in_the_days_a_run_touches(spark, folder):
    archive = Archive(spark, f"{folder}/archive")
    archive.land(_records(spark, *[_v2(f"2024-01-{d:02}T05:00:00Z", f"m{d}", f"k{d}") for d in (10, 11, 20)], _v2("2024-01-20T05:00:00Z", "free")), "0")
    lines = archive.lines()
    ingested = lines.where("dedup_key in ('k10', 'k20')")
    found = lambda days: sorted(r["dedup_key"] for r in ingest.late_lines(lines, ingested, days).collect() if r["dedup_key"])
    assert found(None) == ["k11"] and found([date(2024, 1, 11)]) == ["k11"] and found([date(2024, 1, 10)]) == []
    plan = ingest.late_lines(lines, ingested, [date(2024, 1, 10)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("2024-01-10") >= 2 or plan.count("19732") >= 2
    assert ingest.touched_days(lines, None) == [date(2024, 1, d) for d in (10, 11, 20)]
    later = datetime.now(UTC) + timedelta(hours=1)
    assert ingest.touched_days(lines, later) == []
    assert len(ingest.touched_days(lines, later, timedelta(hours=2))) == 3


def test_a_run_of_lines_repeated_after_a_failure_adds_nothing(spark, folder):
    fields = "ns long, layout int, day string, file_digest string, line_index long, dedup_key string, event_time timestamp, event_day date"
    schema = T.StructType.fromDDL(fields)
    work = ingest.Ingest(spark, f"{folder}/archive", f"{folder}/lines", f"{folder}/checkpoint", schema, "1 day")

    def land(number, *rows):
        made = [(n, 0, "d", "f", n, key, datetime.fromisoformat(f"{day}T12:00:00"), date.fromisoformat(day)) for n, (day, key) in enumerate(rows)]
        spark.createDataFrame(made, schema).coalesce(1).write.partitionBy("event_day").parquet(f"{work.archive}/landing={number}")

    def keys():
        return sorted(r["dedup_key"] or "" for r in work.read().collect())

    land(0, ("2024-01-20", "a"), ("2024-01-20", "a"), ("2024-01-20", None))
    work.run(0, None)
    assert keys() == ["", "a"]
    began = datetime.now(UTC)
    # One line far too late, with a replay of its own; a replay of an ingested one; and one in time.
    land(1, ("2024-01-02", "b"), ("2024-01-02", "b"), ("2024-01-20", "a"), ("2024-01-21", "c"))
    for _ in range(2):
        work.run(1, began)
        assert keys() == ["", "a", "b", "c"]
    work.run(2, datetime.now(UTC))
    assert keys() == ["", "a", "b", "c"]


def test_manifests_of_another_run_are_refused(spark, folder):
    os.makedirs(folder)
    good = {"version": "1", "stage": "dev", "run_id": "r", "results": [{"stage": "dev", "run_id": "r", "identity": "i"}]}
    documents = {
        "a.json": json.dumps(good),
        "b.json": json.dumps({**good, "version": "9"}),
        "c.json": json.dumps({**good, "results": [{"stage": "prod", "run_id": "r"}]}),
        "d.json": "{nope",
    }
    for name, text in documents.items():
        with open(f"{folder}/{name}", "w") as out:
            out.write(text)
    fine, refused = files.manifest_scan(spark, folder)
    assert fine.count() == 1 and files.manifest_results(fine).first()["identity"] == "i"
    assert sorted(r["reason"] for r in refused.collect()) == [
        "not valid JSON", "result of another run", "unknown version",
    ]


def test_keyset_slices(spark):
    """Seven rows past a cursor of 2, three a run: 3, 4, 5 and then the rest."""
    table = spark.range(1, 8).withColumnRenamed("id", "key")
    first = extract.keyset_extract(table, "key", 2, 3)
    assert sorted(r["key"] for r in first.collect()) == [3, 4, 5]
    rest = extract.keyset_extract(table, "key", 5, 3)
    assert sorted(r["key"] for r in rest.collect()) == [6, 7]
    assert extract.keyset_extract(table, "key", 7, 3).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "timestamp", "timestamp_ntz", "double"])
@pytest.mark.parametrize("newest", [False, True])
def test_slices_hold_whole_values_within_the_budget(spark, kind, newest):
    rng = random.Random(kind)
    values = [rng.choice([None, *range(10, 60)]) for _ in range(300)]
    text = {"date": "date_add(date'2024-01-01', v)", "timestamp": "timestamp_micros(v * 3600000001L)",
            "timestamp_ntz": "timestamp_ntz'2024-03-30 23:00:00.000001' + make_interval(0, 0, 0, 0, v)"}
    df = spark.createDataFrame([(v,) for v in values], "v int")
    df = df.select("v", F.expr(text.get(kind, f"cast(v as {kind})")).alias("c"))
    counts = sorted(Counter(v for v in values if v is not None).items(), reverse=newest)
    for budget in (20, 150, 299, 1000):
        kept, total = Counter(), 0
        for value, n in counts:
            if total + n > budget:
                break
            kept[value], total = n, total + n
        assert Counter(r["v"] for r in extract.within(df, "c", budget, newest).collect()) == kept


def test_a_value_larger_than_the_budget_is_refused(spark):
    df = spark.createDataFrame([(1,)] * 5, "c int")
    with pytest.raises(extract.CursorNotReached):
        extract.within(df, "c", 4)


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "timestamp", "timestamp_ntz"])
def test_cursors_of_every_type_are_read_back(spark, folder, kind):
    cursors = loads.Cursors(spark, f"{folder}/cursors")
    text = {"bigint": "id", "string": "concat('k', id)", "date": "date_add(date'2024-01-01', int(id))",
            "timestamp": "timestamp_micros(id * 3600000001L)", "timestamp_ntz": "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, int(id))"}
    source = spark.range(9).select("id", F.expr(text[kind]).alias("at")).union(spark.sql("select -1L, null"))
    for upto in (5, 9, 9):
        loads.run_incremental(source.where(f"id < {upto}"), f"{folder}/dev", cursors, "dev", "crm", "x", "at")
    assert sorted(os.listdir(f"{folder}/dev")) == ["load_id=0000000001", "load_id=0000000002"]
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/dev").collect()) == list(range(9))


def test_newest_first_budget(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "at bigint, key bigint")
    found = extract.newest_first_extract(df, "at", "key", 4, 2, 3)
    assert {r["key"]: r["at"] for r in found.collect()} == {0: 9, 1: 7, 2: 8}
    with pytest.raises(extract.CursorNotReached):
        extract.newest_first_extract(df, "at", "key", 4, 5, 1)
    backfill = extract.newest_first_extract(df, "at", "key", None, 2, 1)
    assert {r["key"]: r["at"] for r in backfill.collect()} == {0: 9, 2: 8}


def test_a_version_without_its_commit_is_not_seen(spark, folder):
    table = loads.Table(spark, folder)
    assert table.read() is None
    table.replace(spark.range(3), {"id": "The key."})
    spark.range(9).write.parquet(f"{folder}/versions/0000000002")
    assert table.read().count() == 3 and table.version() == 1
    assert table.read().schema["id"].metadata["comment"] == "The key."
    table.replace(spark.range(5))
    assert table.read().count() == 5 and table.version() == 2
    assert table.append(spark.range(2)).count() == 7 and table.replace(spark.range(1)).count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark, folder):
    left = loads.save_bucketed(spark.range(1000).withColumn("a", F.lit(1)), "bucketed_left", f"{folder}/l", ["id"], 4)
    right = loads.save_bucketed(spark.range(500).withColumn("b", F.lit(2)), "bucketed_right", f"{folder}/r", ["id"], 4)
    joined = left.hint("merge").join(right, "id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 500


def test_a_run_killed_before_its_cursor_reads_again(spark, folder):
    cursors = loads.Cursors(spark, f"{folder}/cursors")
    source = spark.range(5).withColumnRenamed("id", "at")
    loads.load_incremental(source, f"{folder}/dev", "at", None, 1)
    assert cursors.last("dev", "crm", "x") == (0, None)
    cursors.save("dev", "crm", "x", 1, 4)
    assert cursors.last("dev", "crm", "x") == (1, 4) and cursors.last("prod", "crm", "x") == (0, None)
    assert not loads.run_incremental(source, f"{folder}/dev", cursors, "dev", "crm", "x", "at")
    assert sorted(os.listdir(f"{folder}/dev")) == ["load_id=0000000001"]


def test_merge_and_history_on_hand_made_versions(spark):
    target = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    batch = spark.createDataFrame([(1, "b", "f2"), (1, "a", "f1"), (3, "n", "f1")], "k int, v string, _file string")
    merged = loads.merge_latest(target, batch, ["k"])
    assert {r["k"]: r["v"] for r in merged.collect()} == {1: "b", 2: "keep", 3: "n"}
    assert [tuple(r) for r in loads.superseded(batch, ["k"]).collect()] == [(1, "f2", 1)]
    versions = spark.createDataFrame(
        [(1, "a", 1), (1, "a", 2), (1, None, 3), (1, "a", 4), (2, "z", 1)], "k int, v string, load int"
    )
    spans = {tuple(r) for r in loads.history(versions, ["k"], "load").collect()}
    assert spans == {(1, "a", 1, 3, False), (1, None, 3, 4, False), (1, "a", 4, None, True), (2, "z", 1, None, True)}


def test_refresh_refuses_a_history(spark, folder):
    contract = Contract(
        "x", "d", "s", (Field("k", "string"),), ("k",), load=Load("incremental", "k", ("k",)), write_mode="merge_scd2"
    )
    with pytest.raises(loads.RefreshRefused):
        loads.full_refresh(spark, folder, loads.Table(spark, folder), contract, "bronze")
    with pytest.raises(ContractError):
        loads.append(spark.range(1), folder, Contract("y", "d", "s", (Field("k", "string"),), ()))


def test_a_batch_run_again_changes_nothing(spark, folder):
    target = Keyed(spark, folder, ["id"], 4)
    write = ingest.merge_into(target)
    batch = spark.range(3).withColumn("_file", F.lit("a"))
    write(batch, 0)
    write(batch, 0)
    assert sorted(r["id"] for r in target.read().collect()) == [0, 1, 2]
    write(batch.withColumn("id", F.col("id") + 10), 1)
    assert target.read().count() == 6


def _files(folder):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.startswith("part-")}


@pytest.mark.parametrize("mode", ["upsert", "add_versions"])
def test_a_merge_rewrites_only_the_buckets_it_touches(spark, folder, mode):
    """A batch with keys of one bucket leaves the files of the others as they were; run again it changes no row."""
    target = Keyed(spark, folder, ["k"], 8)
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit("f1").alias("load"))
    getattr(target, mode)(rows, "load")
    before = _files(f"{folder}/rows")
    assert len({os.path.dirname(f) for f in before}) == 8
    mine = [r.k for r in rows.where(target._bucket(rows) == 3).collect()]
    # Keys of another number type meet theirs.
    batch = rows.where(F.col("k").isin(mine[:2])).select(F.col("k").cast("int"), F.lit("new").alias("v"), F.lit("f2").alias("load"))
    getattr(target, mode)(batch, "load")
    first = sorted(map(tuple, target.read().collect()), key=str)
    after = _files(f"{folder}/rows")
    gone = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert gone == {"_bucket=3"}
    assert sum("new" in r for r in first) == 2 and len(first) == (400 if mode == "upsert" else 402)
    getattr(target, mode)(batch, "load")
    assert sorted(map(tuple, target.read().collect()), key=str) == first


def test_json_keys_and_csv_cells(spark):
    assert export.json_keys(["id", "id", "id_2", "x"]) == ["id", "id_2", "id_2_2", "x"]
    df = spark.createDataFrame([("=1", True, [1, 2], 1.5), ("ok", None, None, None)], "s string, b boolean, a array<int>, d double")
    assert [tuple(r) for r in export.csv_cells(df).collect()] == [("'=1", "true", "[1,2]", "1.5"), ("ok", "", "", "")]
    assert [r[0] for r in export.json_rows(df).collect()] == ['["=1",true,[1,2],1.5]', '["ok",null,null,null]']
    with pytest.raises(export.TooManyRows):
        export.bounded_export(df, 1)
    assert export.bounded_export(df, 2).count() == 2


LEVELS = {
    '{"level": "nope", "lvl": "WARN"}': "warning",
    '{"level": 30}': None,
    '{"log.level": "Fatal"}': "critical",
    "ERROR something": "error",
    "ERROR": "error",
    "ERRORS": None,
    "Error in prose": None,
    "[ info] x": "info",
    "2026-11-16 09:41:07 WARNING x": "warning",
    "ERROR:root:x": "error",
    "26/11/16 09:41:07 INFO x": "info",
    "2026-11-16 09:41:07,123 - dagster - DEBUG - x": "debug",
    "level=warn x=1": "warning",
    'x="level=error" lvl=info': "info",
    'x="a \\" b" level="error"': "error",
    'level=info x="open': None,
    "level=info = x": None,
    "level=other lvl=info": None,
    "\x1b[31mERROR\x1b[0m x": "error",
    "": None,
}


def test_levels(spark):
    lines = [*LEVELS, "a=1 " * 50_000 + "level=warn", 'k="' + "x" * 200_000 + '" level=info']
    expected = [*LEVELS.values(), "warning", "info"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, m string")
    got = [r["l"] for r in df.select("i", loglines.level_of(F.col("m")).alias("l")).orderBy("i").collect()]
    assert got == expected


def test_nanoseconds(spark):
    stamps = ["2024-01-01T00:00:00.123456789Z", "2024-01-01T01:00:00.5+01:00", "2024-01-01T00:00:00Z", "no"]
    df = spark.createDataFrame(list(enumerate(stamps)), "i int, s string")
    got = [r["n"] for r in df.select("i", loglines.event_ns(F.col("s")).alias("n")).orderBy("i").collect()]
    base = 1704067200 * 10**9
    assert got == [base + 123456789, base + 500000000, base, -1]


def test_many_manifests_share_files(spark, folder):
    """Three thousand runs of two results are lines of a few files and read back as they were."""
    columns = ["stage", "domain", "product", "run_id", "complete", "identity", "engine", "table_name", "column_name",
               "check_id", "outcome", "pipeline_outcome", "observed_us", "metrics"]
    rows = spark.range(6000).selectExpr(
        "'dev' as stage", "'d' as domain", "'p' as product", "concat('run_', id div 2) as run_id", "id % 7 <> 0 as complete",
        "concat('i\n', id) as identity", "'e' as engine", "'t' as table_name", "cast(null as string) as column_name",
        "'unique' as check_id", "'passed' as outcome", "'continued' as pipeline_outcome", "id as observed_us",
        "map('n', cast(id as double)) as metrics",
    )
    assert rows.columns == columns
    files.write_manifests(rows, folder, per_file=100_000)
    assert len([n for n in os.listdir(folder) if n.endswith(".json")]) <= 8
    fine, refused = files.manifest_scan(spark, folder, lines=True)
    assert fine.count() == 3000 and refused.count() == 0
    back = files.manifest_results(fine).agg(F.count("identity"), F.countDistinct("identity"), F.sum("observed_us")).first()
    assert tuple(back) == (6000, 6000, 5999 * 3000)


@pytest.mark.parametrize("kind", ["bigint", "date", "timestamp_ntz"])
def test_a_first_value_past_the_budget_gives_an_empty_slice(spark, kind):
    """Five rows of one value and a budget of four: refused, or no row at all, never a part of the value."""
    table = spark.sql(f"select cast({'1' if kind == 'bigint' else '"2024-01-01"'} as {kind}) as at, id from range(5)")
    with pytest.raises(extract.CursorNotReached):
        extract.keyset_extract(table, "at", None, 4)
    assert extract.keyset_extract(table, "at", None, 4, refuse=False).count() == 0
    assert extract.keyset_extract(table, "at", None, 5, refuse=False).count() == 5


def test_landed_files_are_bounded_and_gzipped(spark, folder):
    """One partition of 2,500 rows lands as files of 1,000, line breaks and quotes in its fields kept, and beside a plain file."""
    rows = spark.range(2500).selectExpr("cast(id as string) as id", "concat('a\n\"b\", ', id) as note").coalesce(1)
    files.land_csv(rows, f"{folder}/gz", per_file=1000)
    assert len([n for n in os.listdir(f"{folder}/gz") if n.endswith(".csv.gz")]) == 3
    with open(f"{folder}/gz/plain.csv", "w") as out:
        out.write("id,note\nx,y\n")
    back = Counter((r["id"], r["note"]) for r in files.csv_scan(spark, f"{folder}/gz").collect())
    assert back == Counter([("x", "y"), *((r["id"], r["note"]) for r in rows.collect())])
