"""Word windows that repeat across documents, beside a brute-force version; and the hashes words are known by."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from test_operators import EDGES, check, frame, table

from millpond.llm import jaccard, lm, passages, quality
from millpond.llm.words import fold_hash, tokenize

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256", "longest"]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("rows", [EDGES, []])
def test_edges(spark, rows):
    check(passages.remove(frame(spark, rows)), COLUMNS, brute.kept_passages(rows))


def test_table(spark):
    docs, rows = table(spark, "documents", "doc_id", "text")
    want = brute.kept_passages(rows)
    assert sum(r[2] > 0 for r in want) > 10 and max(r[4] for r in want) >= 100
    check(passages.remove(docs), COLUMNS, want)


@pytest.mark.parametrize("window", [2, 7, 50])
def test_shared_passages(spark, monkeypatch, window):
    """Passages that start and end anywhere, a frequent one, words of one kind, and ids that come with several texts."""
    monkeypatch.setattr(passages, "ROWS", 500)
    rng = random.Random(window)
    pool = [f"w{i}" for i in range(400)]
    shared = [rng.choices(pool, k=rng.randrange(window, 5 * window)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(1, 4)):
            text += [f"own{i}x{j}" for j in range(rng.randrange(0, 2 * window))]
            one = shared[min(rng.randrange(0, 12), 5)]
            at = rng.randrange(0, len(one))
            text += one[at : at + rng.randrange(1, 5 * window)]
        rows.append((i % 100 if i % 7 else None, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(i, "same " * (window * (i % 5))) for i in range(200, 220)] + [(0, rows[5][1]), (300, rows[6][1]), rows[7], rows[7], (301, rows[7][1])]
    check(passages.remove(frame(spark, rows), window), COLUMNS, brute.kept_passages(rows, window))


def test_a_very_long_text(spark):
    words = [f"w{i * i % 9973}" for i in range(120_000)]
    rows = [(1, " ".join(words[40_000:40_300])), (2, " ".join(words)), (3, " ".join(["x", *words, "y"]))]
    got = {r.doc_id: r for r in passages.remove(frame(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 300 and got[3].n_words - got[3].n_removed == 2
    assert got[3].longest == 102_400 and got[3].kept_sha256 == brute.sha("x y")


def test_hash_of_ranges_depends_on_all_bytes():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 500)
    end = start + rng.integers(1, 100, 500)
    for seed in (0, 1):
        hashes = fold_hash(buf, start, end, seed)
        known = {}
        for s, e, h in zip(start, end, hashes.tolist()):
            assert known.setdefault(bytes(buf[s:e]), h) == h
        assert len(set(known.values())) == len(known)
    assert not set(fold_hash(buf, start, end, 0).tolist()) & set(fold_hash(buf, start, end, 1).tolist())


@pytest.mark.parametrize("size", [1024, 2048, 8192])
def test_words_without_random_structure(spark, size):
    """Words that collide under any polynomial modulo a power of two are told apart by every operator that hashes words."""
    a, b = thue_morse(size), thue_morse(size, True)
    one, two = tokenize([a, b], lower=False).hash
    assert one != two and len({h for n in range(8) for h in tokenize(["\0" * n + "x"], lower=False).hash.tolist()}) == 8
    prose = " ".join(f"word{i}" for i in range(8))
    rows = [(1, f"{a} {prose}\n{a}\n{b} ends here.\n{prose}."), (2, f"{a} x y z u"), (3, f"{b} x y z u"), (4, f"{a} x y z u"), (10, f"{a} {a}")]
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    check(quality.measure(frame(spark, rows)), base, brute.quality(rows))
    check(jaccard.join(frame(spark, rows)), ["doc_id", "n_shingles", "component_id"], brute.near_components(rows))
    want = {(r[0], r[3]) for r in brute.scores(rows, lm.STRENGTH, 3)}
    assert {(r.doc_id, r.n_known) for r in lm.score(frame(spark, rows)).collect()} == want
    long = [(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (3, " ".join([a] * 55))]
    check(passages.remove(frame(spark, long)), COLUMNS, brute.kept_passages(long))


def test_hashes_do_not_depend_on_what_stands_around():
    texts = ["alpha beta gamma", "x" * 3000 + " beta", "gamma"]
    apart = [tokenize([t]).hash.tolist() for t in texts]
    together = tokenize(texts)
    assert [together.hash[together.doc == i].tolist() for i in range(3)] == apart

