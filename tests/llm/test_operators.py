"""Each operator beside its contract in plain Python: on edge cases, and on whole small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millpond.llm import bpe, decontaminate, jaccard, lm, pii, quality, queries, sharding, suffixes, urls, warc
from millpond.llm.common import components, prepare

FOLDER = "/root/testdata/sf0.001"
PROSE = " ".join(f"word{i % 97} of{i}" for i in range(120)) + "."
EDGES = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (5, "ONE two\x0bthree"), (6, PROSE), (7, PROSE), (7, PROSE),
    (8, PROSE.replace("of60", "off")), (None, PROSE + " and more"), (None, None), (9, "line a b c d e\n" * 30),
    (10, "naïve café 日本語 ß " * 40), (11, "x" * 5000), (12, "ab" * 300), (13, PROSE[:700] + "\n" + PROSE[300:]),
    (14, "word " * 3000), (15, "the quick brown fox jumps over the lazy dog and runs"),
]


def frame(spark, rows, clash=True):
    """Rows as documents, with other columns under names that operators use themselves."""
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"n": F.lit(1), "k1": F.lit("x"), "id": F.lit(2.0), "found": F.lit(True)}) if clash else df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def check(df, columns, want):
    assert rows_of(df, *columns) == sorted(want, key=str)


def table(spark, name, *columns):
    df = prepare(spark).read.parquet(f"{FOLDER}/{name}.parquet")
    return df, [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module", params=["edges", "table", "none"])
def docs(request, spark):
    if request.param == "table":
        return table(spark, "documents", "doc_id", "text")
    rows = EDGES if request.param == "edges" else []
    return frame(spark, rows), rows


PII = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_pii_base(docs):
    check(pii.find(docs[0]), PII, brute.pii(docs[1]))


TRICKY = [
    "a@b.c@d.e f@g.h", "x@y x@y.z. ..@a-b.c-d.e", "1.2.3.4.5 256.1.1.1 01.02.03.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (988) 555-2485 orth +49-30-1234567, +1 2 +()", "é@x.y ünï@dö.de 9" * 3, "a" * 3000 + "@" + "b" * 3000, "1" * 4000, "1." * 2000, "+1 " * 500,
    "_@a.b_c@d.e", "12345678901234567890", "4 4 4 4 4 4 4 4 4 4 4 4 4 4",
]


def test_pii_tricky_spans(spark):
    rows = list(enumerate(TRICKY))
    check(pii.find(frame(spark, rows)), PII, brute.pii(rows))


def test_pii_adds_spans_and_keeps_base(spark):
    rows = [(i, f"mail me{i}@site.org or call +1 (988) 555-{1000 + i} now") for i in range(40)]
    rows += [(100 + i, f"call 988-555-{2000 + i} by phone, order 12{i:03}.7") for i in range(40)]
    got = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    assert all(got[i].spans.count(":") == 4 and got[i].n_added == 0 for i in range(40))
    assert all(got[100 + i].spans.startswith("phone:5:17") for i in range(40))
    text = pii.redact(frame(spark, rows, clash=False).withColumn("n_chars", F.length("text"))).where("doc_id = 0").first()
    assert text.text == "mail <EMAIL> or call <PHONE> now" and text.n_chars == len(text.text)


@pytest.mark.parametrize("order", [2, 3])
def test_lm(docs, order):
    want = {(r[0], r[2], round(r[5], 3)): r for r in brute.scores(docs[1], lm.STRENGTH, order)}
    got = lm.score(docs[0], order=order, block_bytes=1 << 16).collect()
    assert len(got) == len(docs[1])
    for r in got:
        w = want[(r.doc_id, r.n_tokens, round(r.base_score, 3))]
        assert (r.held_out, r.n_known, r.train_tokens) == (w[1], w[3], w[4])
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-9)


def test_lm_query_counts_two_words_of_context(spark):
    _, rows = table(spark, "documents", "doc_id", "text")
    got = {r.doc_id: r.score for r in queries.op2_lm_score(spark, FOLDER).collect()}
    want = brute.scores(rows, lm.STRENGTH, 3)
    assert len(got) == len(want) and all(math.isclose(got[r[0]], r[6], rel_tol=1e-9) for r in want)


def test_lm_predicts_held_out_texts_better_than_single_words(spark):
    scored = lm.score(table(spark, "documents", "doc_id")[0])
    total = scored.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert total[1] > total[0]


def test_near_duplicates(docs):
    check(jaccard.join(docs[0]), ["doc_id", "n_shingles", "component_id"], brute.near_components(docs[1]))


def test_near_duplicates_of_a_large_family_and_chains(spark, monkeypatch):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(f"z{i}" if j == i % 70 else w for j, w in enumerate(base))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(2 * i, 2 * i + 60))) for i in range(40)]
    rows += [(5000 + i, " ".join([*(f"c{j}" for j in range(30)), *(f"own{i}x{j}" for j in range(30))])) for i in range(40)]
    want = brute.near_components(rows)
    for sample in (20_000, 1):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        monkeypatch.setattr(jaccard, "GROUP", 16)
        monkeypatch.setattr(jaccard, "QUERIES", 8)
        check(jaccard.join(frame(spark, rows)), ["doc_id", "n_shingles", "component_id"], want)


def test_order_of_tokens_does_not_matter_to_a_prefix():
    import numpy as np

    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 100).astype(np.uint64))
    hot = np.stack([tokens[:10], np.arange(10, dtype=np.uint64)])
    rare, often = jaccard.prefix(tokens, hot)
    assert len(rare) == 26 and not len(often) and not set(rare) & set(tokens[:10])
    rare, often = jaccard.prefix(tokens[:20], hot)
    assert len(rare) == 6 and not len(often)
    assert len(jaccard.prefix(tokens[:10], hot)[1]) == 3


def test_bitmaps_never_rule_a_link_out():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (3, 20, 130, 700):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(n) < 0.9], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)])) for _ in range(30)]
        sizes = np.array([len(s) for s in sets])
        matrix = jaccard.Matrix([jaccard.bitmap(s) for s in sets], sizes, np.arange(30))
        holders = jaccard.Holders(sets)
        for i, s in enumerate(sets):
            linked = set(holders.linked(s).tolist()) - {i}
            plain = {j for j, t in enumerate(sets) if j != i and 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t))}
            assert linked == plain and linked <= set(matrix.qualifying(jaccard.bitmap(s), len(s), i).tolist())


def test_links_share_tokens_of_their_prefixes():
    import numpy as np

    rng = np.random.default_rng(3)
    none = np.zeros((2, 0), dtype=np.uint64)
    for n in (3, 4, 7, 20, 130, 700):
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        kept = [base[rng.random(n) < share] for share in np.repeat([0.75, 0.86, 0.95, 1], 12)]
        sets = [np.unique(np.concatenate([k, rng.integers(0, 1 << 62, n // 12).astype(np.uint64)])) for k in kept if len(k)]
        sizes = np.array([len(s) for s in sets])
        prefixes = [jaccard.prefix(s, none)[0] for s in sets]
        for i, s in enumerate(sets):
            least = jaccard.least_shared(sizes[i], sizes)
            for j, t in enumerate(sets):
                if 4 * len(np.intersect1d(s, t)) >= 3 * len(np.union1d(s, t)):
                    assert 1 <= least[j] <= len(np.intersect1d(prefixes[i], prefixes[j]))
    assert jaccard.least_shared(100, np.array([74, 75, 100, 133, 134])).tolist() == [jaccard.NEVER, 1, 12, 1, jaccard.NEVER]


def test_enough_shared_never_rules_out_what_links(spark):
    import numpy as np

    sizes = [(n, m) for n in range(1, 60) for m in range(1, 80) if 4 * min(n, m) >= 3 * max(n, m)]
    rows = [(int(jaccard.least_shared(n, np.array([m]))[0]), n, low, high) for n, m in sizes for low, high in ((m, m), (m - 3, m), (m, m + 40))]
    df = spark.createDataFrame([(max(1, s), n, low, high) for s, n, low, high in rows], "s long, n long, low long, high long")
    enough = jaccard.enough_shared(*(F.col(c) for c in ("s", "n", "low", "high")))
    assert df.where(enough).count() == len(rows)
    few = spark.createDataFrame([(1, 400, 390, 410), (40, 400, 390, 410)], "s long, n long, low long, high long")
    assert [r[0] for r in few.where(enough).select("s").collect()] == [40]


def _families(n, shared):
    """Texts of 200 words, in pairs that differ in one; every text shares one short passage, of which there are few, with others."""
    rows = []
    for i in range(n):
        own = [f"a{i // 2}x{j}" for j in range(200)]
        own[100] = f"b{i}"
        rows.append((i, " ".join([*own, *(f"p{i % shared}y{j}" for j in range(5))])))
    return rows


def test_near_duplicates_send_texts_that_may_link_only(spark, monkeypatch):
    """Sets that meet in a token or two of a common passage queried each other's groups, and all texts were sent to all groups."""
    sizes = {}
    keep = jaccard.cut

    def cut(df, label):
        written = keep(df, label)
        sizes.setdefault(label, []).append(written.count())
        return written

    monkeypatch.setattr(jaccard, "cut", cut)
    rows = _families(120, 6) + [(1000 + i, " ".join([*(f"c{i}x{j}" for j in range(200 + i)), *(f"p{i % 6}y{j}" for j in range(5))])) for i in range(60)]
    check(jaccard.join(frame(spark, rows)), ["doc_id", "n_shingles", "component_id"], brute.near_components(rows))
    # Texts: first of the pairs only, then of next to none.
    assert sizes["texts"][0] <= 130 and sizes["texts"][1] <= 30 and sizes["opens"][0] <= 20


def test_shuffle_files_go_with_the_step_that_made_them(spark):
    import time

    from millpond.llm import common

    def files():
        return {b for b in blocks.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle_")}

    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before, held = spark.conf.get(common.CLEANUP), files()
    df = spark.range(1000).repartition(7, "id")
    written = common.cut(df, "test")
    until = time.time() + 20
    while files() - held and time.time() < until:
        time.sleep(0.1)
    assert not files() - held and spark.conf.get(common.CLEANUP) == before
    # What was written can still be run again.
    assert written.count() == df.count() == 1000


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_counts(docs):
    check(quality.measure(docs[0]), BASE, brute.quality(docs[1]))


def test_quality_lines(spark):
    clean = "This is a plain sentence with enough words in it.\nAnd here is another one that says more things.\nThe last of them ends here too."
    junk = "Home | About | Contact | Login\nWe use cookies on this site, accept cookies to go on with it all.\n" + "ab%% cd## ef&& gh** ij$$ kl%%\n" * 1
    rows = [(1, clean), (2, junk + "Only this short sentence remains."), (3, clean + "\nHome About Contact Menu\nok"), (4, None), (5, "")]
    got = {r.doc_id: r for r in quality.measure(frame(spark, rows)).collect()}
    assert got[1].kept and got[1].n_failed_lines == 0
    assert not got[2].kept and not got[2].base_failed and got[2].n_failed_lines == 3
    assert got[3].kept and got[3].n_failed_lines == 2
    assert not got[4].kept and not got[5].kept
    docs = frame(spark, rows, clash=False).withColumn("n_chars", F.length("text")).withColumn("kept", F.lit("mine"))
    kept = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(kept) == {1, 3} and kept[1].text == clean and kept[3].text == clean + "\n" and kept[3].kept == "mine"
    assert kept[3].n_chars == len(clean) + 1


def test_quality_lines_that_only_mention_a_phrase(spark):
    words = " ".join(f"word{i}" for i in range(80))
    prose = f"{words} where you read more of the privacy policy | or a > b | and it ends so."
    rows = [
        (1, prose), (2, "read more about it\n" + prose), (3, "Shop now | Sale | Shoes and more | " * 20 + f"\n{words}."),
        (4, "click here to read more " * 20), (5, "今日は天気がいいですね。\n散歩に行きましょう！\n" + words + "."),
        (6, "这一行没有句号但是它有很多汉字\nकहानी यहाँ।\nवह؟\nok\n" + words + "."), (7, "好\n…\n" + words + "."),
    ]
    got = {r.doc_id: (r.n_lines, r.n_failed_lines, r.kept) for r in quality.measure(frame(spark, rows)).collect()}
    assert got[1] == (1, 0, True) and got[2] == (2, 1, True)
    assert got[3][1] == 1 and got[4][1] == 1
    assert got[5] == (3, 0, True) and got[6] == (5, 1, True) and got[7] == (3, 1, True)


HITS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
ITEMS = [
    (1, " ".join(f"q{i} of the" for i in range(12))), (2, "one short item"), (2, "a second text of item two"), (3, None), (4, ""),
    (10, "ÄRGER über the of and The of and the of and the of and tail"), (None, "nameless item of six words"), (11, "repeat " * 20),
]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination_edges(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "SMALL", broadcast)
    full = ITEMS[0][1]
    rows = [*EDGES, (20, full), (21, "x " + full.upper() + " y"), (22, full[12:] + " end"), (23, "One, SHORT; item!"), (24, "short item one"),
            (25, "repeat " * 50), (25, "repeat " * 50), (26, ITEMS[5][1]), (27, "nameless item of six words " * 3), (28, "pad " * 500 + ITEMS[5][1]),
            (29, full[: len(full) // 2] + " gap " + full[len(full) // 2 :])]
    items = prepare(spark).createDataFrame(ITEMS, "item_id long, text string").withColumn("word", F.lit(1))
    check(decontaminate.judge(frame(spark, rows), items), HITS, brute.contamination(rows, ITEMS))


def test_contamination_table(spark):
    docs, rows = table(spark, "documents", "doc_id", "text")
    items, wanted = table(spark, "benchmark", "item_id", "text")
    check(decontaminate.judge(docs, items), HITS, brute.contamination(rows, wanted))
    check(decontaminate.judge(docs.limit(0), items), HITS, [])
    check(decontaminate.judge(docs, items.limit(0)), HITS, brute.contamination(rows, []))


def near_items(text, items, slop=26):
    """How many items have a window three quarters of whose different words stand in one stretch of a text."""
    words, close = brute.TERM.findall(brute.lower(text)), set()
    for item_id, item in items:
        own = brute.TERM.findall(brute.lower(item))
        need = min(13, len(own))
        windows = [set(own[i : i + need]) for i in range(len(own) - need + 1)] if own else []
        for i in range(len(words)):
            stretch = set(words[i : i + slop])
            if any(4 * len(w & stretch) >= 3 * len(w) for w in windows):
                close.add("" if item_id is None else str(item_id))
    return len(close)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_near_items(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "SMALL", broadcast)
    rng = random.Random(4)
    own = [f"u{i}" for i in range(13)]
    items = [(1, " ".join(own)), (2, "rare " * 3 + "the of and a to in"), (3, " ".join(["unseen", *(f"v{i}" for i in range(12))])),
             (4, " ".join(f"x{i % 17} y{i % 5}" for i in range(30))), (None, "two words"), (5, None)]
    rows = [(100, None), (101, ""), (102, "words and two"), (103, "two " + "pad " * 24 + "words"), (104, "two " + "pad " * 25 + "words")]
    for i in range(60):
        base = brute.TERM.findall(items[i % 4][1])[:13]
        rng.shuffle(base)
        base = base[: rng.randrange(7, 14)] + [f"pad{j}" for j in range(rng.randrange(0, 16))]
        rng.shuffle(base)
        rows.append((i, "fill " * rng.randrange(0, 60) + " ".join(base) + " tail" * rng.randrange(0, 30)))
    rows.append(rows[-1])
    # Ten of thirteen words across the border of two tiles, and an item with a word that no document has.
    rows += [(200, "fill " * 21 + " ".join(own[:10])), (201, " ".join(f"v{i}" for i in range(12))), (202, "of rare the and to a in rare")]
    table_ = prepare(spark).createDataFrame(items, "item_id long, text string")
    want = [(doc_id, near_items(text, items)) for doc_id, text in rows]
    assert sum(n > 0 for _, n in want) > 20 and {i for i, n in want if n} >= {103, 200, 201, 202}
    check(decontaminate.judge(frame(spark, rows), table_), ["doc_id", "n_near"], want)


def test_a_text_is_hashed_once_not_for_each_word(spark):
    plan = decontaminate.tokens(frame(spark, EDGES))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    generate = next(i for i, line in enumerate(plan) if "Generate" in line)
    hashed = [i for i, line in enumerate(plan) if "xxhash64" in line]
    assert hashed and min(hashed) > generate  # below it in the tree


def test_near_items_whose_words_share_bits(spark):
    """Words 64 places apart are one bit of a mask, here in one window."""
    rng = random.Random(7)
    own = [f"a{i}" for i in range(64)] + ["b64", "a0", *(f"b{i}" for i in range(66, 77))]
    items = [(1, " ".join(own)), (2, " ".join(own[60:] + own[:70])), (3, "far " + " ".join(reversed(own)))]
    rows = []
    for i in range(80):
        start = rng.choice([64, 64, 63, 58, rng.randrange(64)])
        part = rng.sample(own[start : start + 13], rng.choice([9, 10, 10, 11])) + [f"pad{j}" for j in range(rng.randrange(0, 16))]
        rng.shuffle(part)
        rows.append((i, "fill " * rng.randrange(0, 60) + " ".join(part) + " tail" * rng.randrange(0, 30)))
    table_ = prepare(spark).createDataFrame(items, "item_id long, text string")
    want = [(doc_id, near_items(text, items)) for doc_id, text in rows]
    assert sum(n > 0 for _, n in want) > 20 and sum(n == 0 for _, n in want) > 10
    check(decontaminate.judge(frame(spark, rows), table_), ["doc_id", "n_near"], want)


def test_rare_words_of_different_windows_are_no_candidate(spark, monkeypatch):
    seen = []
    real = decontaminate.cut

    def watch(df, label):
        written = real(df, label)
        if label == "spots":
            seen.append(written.count())
        return written

    monkeypatch.setattr(decontaminate, "cut", watch)
    item = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "w1 w21 w41 w59 pad")] + [(9, f"only w{i} here") for i in range(60)]
    table_ = prepare(spark).createDataFrame([(1, item)], "item_id long, text string")
    check(decontaminate.judge(frame(spark, rows), table_), ["doc_id", "n_near"], [(d, 0) for d, _ in rows])
    assert seen == [0]


SPANS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeated_bytes(docs):
    check(suffixes.remove(docs[0]), SPANS, brute.repeats(docs[1]))


def test_repeated_bytes_of_a_frequent_passage(spark, monkeypatch):
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(260))
    rows = [(i, f"{i * 7919:040d}" * 3 + passage[: 150 + i % 110] + f"{i * 104729:050d}" * 4) for i in range(120)]
    rows += [(500, passage * 3), (501, "abc" * 400), (502, "bca" * 90), (503, "é" * 260)]
    want = brute.repeats(rows)
    for split, sample, shard in ((700, 20_000, 1 << 18), (5, 20_000, 1 << 10), (5, 10, 1 << 12)):
        monkeypatch.setattr(suffixes, "OCCURRENCES", split)
        monkeypatch.setattr(suffixes, "SAMPLE", sample)
        monkeypatch.setattr(suffixes, "SHARD", shard)
        monkeypatch.setattr(suffixes, "CHUNK", 1 << 11)
        check(suffixes.remove(frame(spark, rows)), SPANS, want)


def test_suffix_order():
    import numpy as np

    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (5, 400, 300, 1, 250)]
    parts.append(parts[1][:350])
    buf, ends = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts])
    end_of = np.repeat(ends, [len(p) for p in parts])
    suffix = [bytes(buf[i : min(end_of[i], i + suffixes.DEPTH)]) for i in range(len(buf))]
    rank, sa = suffixes.suffix_ranks(buf, ends)
    assert sa.tolist() == sorted(range(len(buf)), key=lambda i: (suffix[i], i))
    slot = np.empty(len(buf), dtype=np.int64)
    slot[sa] = np.arange(len(buf))
    shared = suffixes.common_prefixes(buf, ends, sa, slot, np.ones(len(buf), dtype=bool))

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    assert shared[sa[1:]].tolist() == [common(suffix[a], suffix[b]) for a, b in zip(sa, sa[1:])]


def test_shards(docs):
    even = {s: 1.0 for s in range(16)}
    got = sharding.assign(docs[0], even, even | {16: 1.0}).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs[1]
    )
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_follow_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r.shard: r["count"] for r in sharding.assign(docs, {0: 1.0, 1: 3.0}, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()}
    assert abs(counts[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("a"), {0: 0.0})


def test_shards_are_gone_through_by_one_small_expression(spark):
    """What is compiled for a row does not grow with the shards, and the places are those of the plain formula."""
    docs = frame(spark, [(i, f"text {i}") for i in range(200)] + [(None, None)], clash=False)

    def plan(n):
        even = {s: 1.0 for s in range(n)}
        return sharding.assign(docs, even, even | {n: 1.0})._jdf.queryExecution().optimizedPlan().toString().count("md5(")

    assert plan(4) == plan(64)

    def place(key, weights):
        def score(s):
            return weights[s] / -math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52))

        return max(weights, key=lambda s: (score(s), -s))

    old, new = {0: 1.0, 1: 2.5, 5: 1.0}, {0: 1.0, 1: 2.5, 5: 1.0, 9: 3.0}
    got = sharding.assign(docs, old, new).collect()
    assert len(got) == 201
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (place(key, old), place(key, new))


def test_slots_of_a_row_that_comes_very_often(spark):
    docs = spark.range(10_000).select(F.lit(7).alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.assign(docs, {0: 1.0}, {0: 1.0, 1: 1.0})
    assert sorted(r.slot for r in got.collect()) == list(range(10_000))


@pytest.fixture(scope="module")
def tokens():
    return queries.vocabulary()


def test_bpe(docs, tokens):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = []
    for doc_id, text in docs[1]:
        ids = own.encode_ordinary(text or "")
        want.append((doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")))
    got = bpe.encode(docs[0], tokens, public_tokenizers.PATTERN)
    check(got, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)
    assert all(len(r.ids) == r.n_tokens for r in got.select("ids", "n_tokens").collect())


def test_bpe_forgets_and_learns_again(tokens, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 3)
    encoder = bpe.Encoder(bpe.Vocabulary(tokens), public_tokenizers.PATTERN)
    first = [encoder.encode([t])[2][0] for t in ("one two three four", "five six", "one two three four")]
    assert first[0] == first[2] != first[1]


PAGES = [
    (1, "http://a.com/x", "<p>" + "long page " * 20), (2, "http://b.com/", "<p>" + "long page " * 20), (3, None, "<p>" + "long page " * 20),
    (3, None, "<p>" + "long page " * 20), (None, "http://c.com/\r\nX: y", "<p>" + "long page " * 20), (4, "u", None), (5, "u", ""), (6, "u", "short"),
    (7, "u", "short"), (8, "u", "é" * 50), (9, "u", "é" * 50), (None, "v", "z" * 200), (0, "u", "\r\n\r\nWARC/1.1 " * 30),
]


@pytest.mark.parametrize("rows", [PAGES, []])
def test_archive(spark, rows):
    pages = prepare(spark).createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    archive = warc.write(pages)
    back = warc.read(archive, spark)
    got = [(r.page_id, len(r.payload), r.digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=str) == sorted(brute.archive(rows), key=str)
    assert not back.where("not verified").count()
    assert archive.payloads(spark).count() == len({(h or "") for _, _, h in rows})
    html = {(p, (h or "").encode()) for p, _, h in rows}
    for page_id, record in warc.records(archive, spark).collect():
        head, _, rest = bytes(record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        assert rest == block + b"\r\n\r\n" and b"X" not in fields
        assert fields[b"WARC-Type"] == b"revisit" or (page_id, block) in html


URLS = [
    (1, "http://www.example.com/en/1", ""), (2, "http://example.com/en/2", ""), (3, "https://m.example.com/en/3?utm_source=a#b", ""),
    (4, "http://x.net/es/1", ""), (5, "http://alias.org/p", '<link rel="canonical" href="http://x.net/es/1/?ref=q">'),
    (6, "http://other.org/q", '<META HTTP-EQUIV="refresh" content="0; url=http://alias.org/p#top">'), (7, "http://free.org/", "<link rel=canonical href=/home>"),
    (8, None, ""), (9, "no scheme", None), (10, "HTTP://EXAMPLE.COM:80/en/", ""), (11, "http://good.org/a", '<link href="http://www.example.com/en/9" rel="canonical">'),
    (12, "http://bad.org/a", '<link rel="canonical" href="http://example.com/en/2">'), (13, "http://mixed.org/", '<link rel="canonical" href="http://good.org/a"><link rel="canonical" href="http://bad.org/a">'),
    (13, "http://mixed.org/", None), (14, "http://free.org/home", ""), (15, "ftp://notnet/fr/", ""), (16, "http://a.net?x=/fr/", ""),
]


def test_urls(spark):
    pages = prepare(spark).createDataFrame(URLS, "page_id long, url string, html string").withColumn("node", F.lit(1))
    got = {}
    for r in urls.judge(pages).collect():
        assert got.setdefault(r.page_id, r).verdict == r.verdict
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [
        ("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("example.com/en/", "block"), ("net/es/", "block"),
    ]
    assert [got[i].verdict for i in (5, 6, 7, 8, 9, 14)] == ["block", "block", "allow", "allow", "allow", "allow"]
    # A class with an allowed member is allowed, though it has a blocked one.
    assert [got[i].verdict for i in (11, 12, 13)] == ["allow"] * 3 and got[12].rule is None
    assert (got[8].host, got[8].path, got[10].host, got[10].rule) == ("", "", "example.com:80", None)
    assert got[15].rule is None and got[16].path == "" and got[16].rule is None
    assert urls.judge(pages.limit(0)).count() == 0


def test_redirect_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None), (2, "http://b.org/", None)], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://a.org/", "http://c.net/fr/x"), (None, "http://b.org/")], "source string, target string")
    assert rows_of(urls.judge(pages, moved), "page_id", "verdict") == [(1, "block"), (2, "allow")]


def test_components(spark):
    prepare(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
