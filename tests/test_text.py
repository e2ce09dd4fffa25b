from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from millpond.functions import loglines, text
from millpond.plans import quality


def _texts():
    rng = random.Random(1)
    ranges = [(32, 127), (0, 32), (0xA0, 0x250), (0x370, 0x590), (0x1E00, 0x2000), (0xFB00, 0xFB20), (0x10400, 0x10430), (0x1F600, 0x1F640), (127, 160)]
    found = ["", "straße STRASSE ẞ", "ΌΣΟΣ ς", "İstanbul ı", "ﬃ ŉ ΐ", "a\"b\\c\n\r\t\f\b\x0b\x1f\x7f", "日本語 😀"]
    for _ in range(150):
        low, high = rng.choice(ranges)
        found.append("".join(chr(rng.randrange(low, high)) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "ß", "x"]))
    return found


def test_case_folding_and_ascii_json(spark):
    texts = _texts()
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    got = df.select("t", text.casefold(F.col("t")).alias("f"), text.json_ascii(F.col("t")).alias("j")).collect()
    for r in got:
        assert r.j == json.dumps(r.t) and r.f == (None if r.t is None else r.t.casefold()), repr(r.t)


def test_searches_fold_case(spark):
    df = spark.createDataFrame([("Hauptstraße 1",), ("HAUPTSTRASSE 2",), ("Hauptstr. 3",), ("100%",)], "m string")
    assert df.where(loglines.holds_text(F.col("m"), "STRASSE")).count() == 2
    assert df.where(loglines.holds_text(F.col("m"), "straße")).count() == 2
    assert df.where(loglines.holds_text(F.col("m"), "%")).count() == 1


def test_searches_find_what_folding_finds(spark):
    """Any piece of any folded text, from one letter on, is found where `str.casefold` has it, and texts are not folded whole."""
    texts = [t for t in _texts() if t] + ["THE ẗhe ﬆ ſT K ẞ", "teﬄe", "a\\E[b^-]&&"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
    rng = random.Random(2)
    wanted = ["the ", "_", "100%", "st", "t", "k", "ss", "S", "fl", "]&&", "\\e[", "^-", "", "µ", "ΣΑ"]
    for t in rng.sample(texts, 60):
        low = rng.randrange(len(t))
        wanted.append(t[low : low + rng.randrange(1, 4)].swapcase())
    got = df.select("t", *[text.holds(F.col("t"), w).alias(f"c{n}") for n, w in enumerate(wanted)]).collect()
    for r in got:
        assert list(r[1:]) == [None if r.t is None else w.casefold() in r.t.casefold() for w in wanted], repr(r.t)
    plan = df.select(text.holds(F.col("t"), "100%"))._jdf.queryExecution().executedPlan().toString()
    assert "translate" not in plan


def test_identities_of_other_alphabets(spark):
    rows = [("dev", "größe", None, "日本", "a|b", "e\x1f", "c😀", "r\"1", None), tuple("abcdefghi"), (None,) * 9]
    df = spark.createDataFrame(rows, ", ".join(f"`{p}` string" for p in quality.IDENTITY))
    got = [r[0] for r in df.coalesce(1).select(quality.identity()).collect()]
    assert got == [hashlib.sha256(json.dumps(list(r), separators=(",", ":")).encode()).hexdigest() for r in rows]
