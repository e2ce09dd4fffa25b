"""The line rules beside their DuckDB text, on lines that the tables lack."""

from __future__ import annotations

import random

from oracle import compare, connect

from millpond.llm import oracles, quality, queries
from millpond.llm.common import prepare

FOLDER = "/root/testdata/sf0.001"


def _lines():
    rng = random.Random(9)
    words = [f"word{i}" for i in range(60)] + ["Zeile", "größer", "日本語の文章です", "किताब", "x"]
    signs = [" | ", " > ", " » ", " • ", " "]
    for size in (1, 2, 3, 8, 30, 70, 120):
        for _ in range(25):
            line = [rng.choice(words) for _ in range(size)]
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line.insert(rng.randrange(len(line) + 1), rng.choice(quality.PHRASES).decode().title())
            yield rng.choice(signs).join(line) + rng.choice(["", ".", "!", "。", "؟", "…", " home", " |"])


def test_line_rules_match_their_text(spark):
    lines = list(_lines())
    rng = random.Random(10)
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(1, 5)))) for i in range(250)]
    rows += [(1000 + i, line) for i, line in enumerate(lines)] + [(2000, None), (2001, ""), (2002, "Home\nAbout | Contact\n好\n")]
    found = quality.measure(prepare(spark).createDataFrame(rows, "doc_id long, text string"))
    shown = found.select("doc_id", *(c.split()[0] for c in quality.MEASURES.split(", ")), "kept")
    con = connect(FOLDER)
    con.execute("create or replace temp table own (doc_id bigint, text varchar)")
    con.executemany("insert into own values (?, ?)", rows)
    con.execute("create or replace view documents as select * from own")
    n, problems = compare(shown.select(*queries.op5_quality(spark, FOLDER).columns), con, oracles.QUALITY)
    assert not problems and n == len(rows), "\n".join(problems)
    assert 50 < shown.where("not kept and not base_failed").count() < len(rows) - 50
