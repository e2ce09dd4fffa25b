"""The pipeline's stages beside the contracts in plain Python, each judged on its own input."""

from __future__ import annotations

import time

import brute
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from millpond.llm import decontaminate, pii, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.cut(stage(spark, out[-1], FOLDER), "test"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, steps):
    source, judged, single, clean, masked, last = steps
    for step in steps[1:5]:
        assert step.schema.names == source.schema.names
    kept = {r.doc_id for r in queries.op5_quality(spark, FOLDER).where("kept").collect()}
    assert {d for d, _ in rows(judged)} == kept and len(kept) > 0.7 * source.count()

    want = {d for d, _, c in brute.near_components(rows(judged)) if d == c}
    assert sorted(d for d, _ in rows(single)) == sorted(want)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {r[0] for r in brute.contamination(rows(single), items) if not r[5]}
    assert sorted(d for d, _ in rows(clean)) == sorted(want)

    before = dict(rows(clean))
    for doc_id, text in rows(masked):
        assert not brute.base_spans(text)
        assert (text == before[doc_id]) or brute.base_spans(before[doc_id])
    assert sorted(r.doc_id for r in last.select("doc_id").collect()) == sorted(want)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    """Rows are judged by id and text together: none is lost to its id, and no copy stays for want of one."""

    def prose(name, changed=""):
        return " ".join(f"{name}{i}" for i in range(40)) + changed

    table = [
        (1, prose("a")), (2, prose("a", " end")),  # a component of its own ids
        (5, prose("b")), (5, prose("c")), (6, prose("c", " end")),  # two texts under one id
        (7, prose("d")), (7, prose("d")), (7, prose("d", " end")),  # equal rows, and a near one under the same id
        (None, prose("a")), (None, prose("a", " more")),  # copies of a named row
        (None, prose("e")), (None, prose("e")), (None, prose("e", " end")),  # a component without any id
        (None, prose("f")),  # alone without an id
        (9, ""), (9, ""), (None, None), (None, None),  # texts without words
    ]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = sorted(rows(corpus_pipeline.near_duplicates(spark, docs, FOLDER)), key=str)
    heads = [(i, t.split()[0] if t else t) for i, t in got]
    assert sorted(heads, key=str) == sorted(
        [(1, "a0"), (5, "b0"), (5, "c0"), (7, "d0"), (None, "e0"), (None, "f0"), (9, ""), (9, ""), (None, None), (None, None)], key=str
    )
    assert set(got) <= set(table)


CLASHING = ("__id", "__k1", "id", "ID", "k1", "k2", "words", "comp", "least", "unnamed", "found", "n", "item", "pos", "term", "keep")


def test_other_columns_and_long_texts_change_nothing(spark):
    """Stages give the same documents beside columns under names that they use themselves, and keep these as they are."""
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = " ".join(f"word{i * i % 7919} is here." for i in range(30_000)) + " call +1 (988) 555-1234 now, or 10.0.0.1"
    extra = [(-1, None), (-2, ""), (-3, "  "), (-4, long), (-5, long), (-5, long), (None, long[:9000]), (-6, "ab " * 50)]
    added = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in extra], plain.schema)
    plain = corpus_pipeline.cut(plain.limit(20).union(added), "plain")
    names = list(dict.fromkeys(c for c in CLASHING if c.lower() not in {x.lower() for x in plain.columns}))
    seen: set[str] = set()
    names = [c for c in names if not (c.lower() in seen or seen.add(c.lower()))]
    wide = plain.select(*[F.lit(f"own {c}").alias(c) for c in names], *plain.columns)
    for name, stage in corpus_pipeline.STAGES:
        want, got = (corpus_pipeline.cut(stage(spark, df, FOLDER), "clash") for df in (plain, wide))
        if "text" not in got.columns:
            assert got.count() == want.count() == plain.count()
            break
        assert got.columns == wide.columns, name
        assert all(r[c] == f"own {c}" for r in got.limit(5).collect() for c in names)
        assert sorted(rows(got), key=str) == sorted(rows(want), key=str), name


def test_many_candidates_in_one_text():
    """Thousands of loose spans: the same choice as by comparing each with all."""
    found = [(i % 5, i % 3, (i * 7919) % 50_000, (i * 7919) % 50_000 + 1 + i % 9, i % 4) for i in range(20_000)]
    allowed = frozenset((k, f, v) for k in range(5) for f in (1, 2) for v in (0, 2))
    spans = [(s, k, e) for k, f, s, e, _ in found[:1500] if f == 0]
    for k, f, s, e, v in found[:1500]:
        if f and (k, f, v) in allowed and all(e <= a or s >= b for a, _, b in spans):
            spans.append((s, k, e))
    assert pii.choose(found[:1500], allowed) == sorted(spans)
    began = time.perf_counter()
    pii.choose(found, allowed)
    assert time.perf_counter() - began < 2


def test_empty_input(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_registered():
    names = contract.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_matches_duckdb(spark, name):
    n, problems = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name])
    assert not problems and n > 0, "\n".join(problems)


def test_decontamination_takes_its_proximity_step(spark, monkeypatch):
    """The query looks at the proximity matches: were they not found, its exact ones would not be believed."""
    real = decontaminate.near
    monkeypatch.setattr(decontaminate, "near", lambda *context: real(*context).where("false"))
    with pytest.raises(Exception, match="an exact match is not near"):
        queries.op6_decontamination(spark, FOLDER).collect()
