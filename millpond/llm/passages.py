"""Substring dedup (operator 13): words under a 50-word window that also starts in a document with a smaller id are removed.

Level-wise doubling: only windows that repeat at one length are looked at again at twice that length.

1. Equal texts are one text, known by 128 bits; the smallest id that holds it speaks for all. A copy under a larger id loses all its words if
   they fill a window.
2. Length 25. Two equal windows of 50 words hold the same 26 windows of 25, so the one of these with the smallest hash (the leftmost of
   equal ones) stands for them: its anchor. Each text sends its anchors, one per some 13 words, with the 50-word windows that have it.
   An anchor in one text alone ends there, and its windows are unique.
3. Length 50. Only windows of repeated anchors are named: a name is 128 bits, made by doubling from the words' hashes. Per name the
   smallest and the largest id are found, map-side first; windows of names with two different ids are repeated. Those in a document with
   a larger id than the smallest are removed.
4. Length 100, 200, ...: a window is a candidate if both its halves were repeated, and its name is made of theirs. This goes on until no
   candidate survives. `longest` is the largest length at which a document still repeats an earlier one; it removes nothing
   more, since a repeated window of 100 words is covered by repeated windows of 50.
5. Windows to be removed become runs per document, and runs are cut out of the texts.

Windows are judged on the input, and never cross documents. A name that a third of all documents hold is one row per task and name before
the shuffle; its occurrences are rows of a join whose other side has one row per name, which AQE splits. The number of rounds is
the logarithm of the longest repeated passage. Nothing is capped.

Null, empty and blank texts have no words. Rows with one id are one document as far as their order goes: none of them is earlier than
another, whether equal or not. A null id comes after all others, and null ids are one id. Texts may be of any length. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, content_key, cut, expand, mapped, pieces, raw, run_lengths, starts_of
from .words import Words, combine, fold_hash, tokenize

WINDOW = 50
# The id that stands for null: after all others.
LAST = (1 << 63) - 1
SEEDS = (1, 2)
# Rows of whole documents that one step of the doubling takes together.
ROWS = 1 << 17
PLACE = np.uint64((1 << 32) - 1)


def order_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(LAST))


def names(hashes: np.ndarray, size: int) -> np.ndarray:
    """The name of `size` hashes from each position on, by doubling; the last step's halves may overlap."""
    length = 1
    while 2 * length <= size:
        hashes = combine([hashes[:-length], hashes[length:]]) if len(hashes) > length else hashes[:0]
        length *= 2
    rest = size - length
    if rest:
        hashes = combine([hashes[:-rest], hashes[rest:]]) if len(hashes) > rest else hashes[:0]
    return hashes


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the smallest (leftmost of equal) of each `width` neighbours, by their upper 32 bits."""
    least = (values & ~PLACE) | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return (least & PLACE).astype(np.int64)


def anchors(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: its name, the text, the first window's word in that text, and the number of windows."""
    counts = words.counts
    begins = np.cumsum(counts) - counts
    n = len(words.hash) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    half = names(words.hash, window // 2)
    anchor = least_of(half, window - window // 2 + 1)[:n]
    inside = words.doc[:n] == words.doc[window - 1 :]
    first = np.ones(n, dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) | ~inside[:-1]
    # A window that runs into the next text has no part in a run, so each run ends where its text's windows do.
    start = np.flatnonzero(first & inside)
    ends = np.append(np.flatnonzero(first | ~inside), n)
    stop = ends[np.searchsorted(ends, start, side="right")]
    doc = words.doc[start]
    return half[anchor[start]], doc, start - begins[doc], stop - start


def long_enough(text: Column, window: int) -> Column:
    """Whether a text may have a window: words and the gaps between them."""
    return F.octet_length(text) >= 2 * window - 1


def anchor_rows(own: DataFrame, window: int) -> DataFrame:
    """`k1`, `k2`, `anchor`, `at`, `n` of all texts; copies that meet in one piece of a batch send theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                known = {k: i for i, k in enumerate(zip(piece.column("k1").to_pylist(), piece.column("k2").to_pylist()))}
                piece = piece.take(pa.array(sorted(known.values())))
                name, doc, at, n = anchors(tokenize(raw(piece.column("text")), lower=False), window)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("k1").take(doc), piece.column("k2").take(doc), pa.array(name.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["k1", "k2", "anchor", "at", "n"],
                )

    return mapped(own.select("k1", "k2", "text"), run, "k1 long, k2 long, anchor long, at int, n int")


def window_rows(holders: DataFrame, window: int) -> DataFrame:
    """`id`, `k1`, `pos`, `f1`, `f2`: the names of all windows in the runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = tokenize(raw(piece.column("text")), lower=False)
                begins = np.cumsum(words.counts) - words.counts
                runs = piece.column("runs")
                owner = np.repeat(np.arange(piece.num_rows), np.diff(runs.offsets.to_numpy()))
                flat = runs.flatten()
                at, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
                # Only a text whose key looks the same could be shorter than its runs say.
                fits = at + n + window - 1 <= words.counts[owner]
                owner, at, n = owner[fits], at[fits], n[fits]
                pos = expand(at, n)
                doc = np.repeat(owner, n)
                f1, f2 = (names(fold_hash(words.buf, words.start, words.end, seed), window)[begins[doc] + pos] for seed in SEEDS)
                doc = pa.array(doc)
                for lo in range(0, max(len(pos), 1), ROWS):
                    some = slice(lo, lo + ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("id").take(doc[some]), piece.column("k1").take(doc[some]), pa.array(pos[some].astype(np.int32)),
                         pa.array(f1[some].view(np.int64)), pa.array(f2[some].view(np.int64))],
                        ["id", "k1", "pos", "f1", "f2"],
                    )

    return mapped(holders, run, "id long, k1 long, pos int, f1 long, f2 long")


def repeated(windows: DataFrame) -> DataFrame:
    """The windows whose name occurs under two ids, and `later`: whether theirs is not the smallest."""
    per = windows.groupBy("f1", "f2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    # As a table of its own, so that the join deals its rows anew and AQE may split a frequent name.
    per = cut(per.select("f1", "f2", "low"), "names")
    return windows.join(per, ["f1", "f2"]).select("id", "k1", "pos", "f1", "f2", (F.col("id") > F.col("low")).alias("later"))


def whole_documents(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by `id` and `k1` in tables of some `rows` rows that end where a document ends."""
    held: list[pa.RecordBatch] = []
    size = 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, keys = (batch.column(c).to_numpy() for c in ("id", "k1"))
        if size >= rows:
            # The first row that is no longer the last held document's.
            other = np.flatnonzero((ids != last[0]) | (keys != last[1]))
            if len(other):
                yield pa.Table.from_batches([*held, batch.slice(0, other[0])])
                held, size, batch = [], 0, batch.slice(other[0])
        held.append(batch)
        size += batch.num_rows
        last = (ids[-1], keys[-1])
    if held:
        yield pa.Table.from_batches(held)


def doubled(found: DataFrame, length: int, keep_runs: bool) -> DataFrame:
    """Per document the candidates of twice the length (`kind` 1: `pos`, `f1`, `f2`), whether it repeats an earlier one (`kind`
    0, `pos` the length), and if wanted its runs of windows to be removed (`kind` 2: `pos`, and `stop` after the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_documents(batches, ROWS):
            ids, k1, pos, f1, f2 = (table.column(c).to_numpy() for c in ("id", "k1", "pos", "f1", "f2"))
            later = table.column("later").to_numpy()
            fresh = starts_of(ids) | starts_of(k1)
            key = (np.cumsum(fresh) << 32) + pos
            half = np.minimum(np.searchsorted(key, key + length), len(key) - 1)
            both = np.flatnonzero(key[half] == key + length)
            pairs = [combine([f[both].view(np.uint64), f[half[both]].view(np.uint64)]).view(np.int64) for f in (f1, f2)]
            document = np.unique(np.cumsum(fresh)[later]) - 1
            first = np.flatnonzero(fresh)[document]
            parts = [(1, both, pos[both], pos[both], *pairs), (0, first, np.full(len(first), length), np.zeros(len(first)), None, None)]
            if keep_runs:
                gone = np.flatnonzero(later)
                start, size = run_lengths(np.diff(key[gone], prepend=-1) != 1) if len(gone) else (gone, gone)
                parts.append((2, gone[start], pos[gone[start]], pos[gone[start]] + size, None, None))
            for kind, rows, at, stop, *pair in parts:
                pair = [np.zeros(len(rows), dtype=np.int64) if p is None else p for p in pair]
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array(np.full(len(rows), kind, dtype=np.int32)), "id": pa.array(ids[rows]), "k1": pa.array(k1[rows]),
                        "pos": pa.array(at.astype(np.int32)), "stop": pa.array(stop.astype(np.int32)), "f1": pa.array(pair[0]), "f2": pa.array(pair[1]),
                    }
                )

    dealt = found.repartition("id", "k1").sortWithinPartitions("id", "k1", "pos")
    return mapped(dealt, run, "kind int, id long, k1 long, pos int, stop int, f1 long, f2 long")


def one_per_id(long: DataFrame) -> DataFrame:
    """Rows without those wholly equal to another, which are looked for first: mostly there is none and no text moves."""
    if not long.groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return long
    return long.groupBy("id", "k1", "k2").agg(F.first("text").alias("text"))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_removed`, `kept_sha256`, `longest`."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("*", order_of(F.col("doc_id")).alias("id"), *content_key(F.col("text")))
    long = own.where(long_enough(F.col("text"), window))
    texts = cut(long.groupBy("k1", "k2").agg(F.min("id").alias("first")), "texts")

    found = cut(anchor_rows(long, window), "anchors")
    shared = found.groupBy("anchor").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low < high").select("anchor")
    shared = cut(shared, "shared")
    runs = found.join(shared, "anchor", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    asked = cut(texts.join(runs, ["k1", "k2"]).select(F.col("first").alias("id"), "k1", "k2", "runs"), "runs")
    holders = one_per_id(long.select("id", "k1", "k2", "text")).join(asked, ["id", "k1", "k2"])

    windows = cut(window_rows(holders.select("id", "k1", "text", "runs"), window), "windows")
    length, removed, reached = window, None, None
    while True:
        steps = cut(doubled(cut(repeated(windows), "repeated"), length, removed is None), "doubled")
        if removed is None:
            removed = steps.where("kind = 2").groupBy("id", "k1").agg(F.collect_list(F.struct("pos", "stop")).alias("spans"))
        reached = steps.where("kind = 0").select("id", "k1", "pos") if reached is None else reached.union(steps.where("kind = 0").select("id", "k1", "pos"))
        windows = steps.where("kind = 1").select("id", "k1", "pos", "f1", "f2")
        if not windows.limit(1).count():
            break
        length *= 2

    longest = reached.groupBy("id", "k1").agg(F.max("pos").alias("longest"))
    state = texts.join(removed.join(longest, ["id", "k1"]).withColumnRenamed("id", "first"), ["first", "k1"], "left")
    rows = own.join(cut(state, "spans"), ["k1", "k2"], "left")
    rows = rows.select("doc_id", "text", (F.col("id") > F.col("first")).alias("copy"), "spans", "longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for piece in pieces(batch, "text", CHUNK):
                words = tokenize(raw(piece.column("text")), lower=False)
                ends = np.cumsum(words.counts)
                columns = (piece.column(c).to_pylist() for c in ("copy", "spans", "longest"))
                for end, count, copy, spans, reach in zip(ends.tolist(), words.counts.tolist(), *columns):
                    begin = end - count
                    mask = np.zeros(count + 1, dtype=np.int64)
                    if copy and count >= window:
                        spans, reach = [{"pos": 0, "stop": count - window + 1}], window << ((count // window).bit_length() - 1)
                    for span in spans or ():
                        mask[span["pos"]] += 1
                        mask[min(span["stop"] + window - 1, count)] -= 1
                    kept = np.cumsum(mask[:count]) == 0
                    digest = hashlib.sha256()
                    buf = words.buf
                    # Kept words that follow one another are hashed together; the gap between words becomes one space.
                    at = begin + np.flatnonzero(kept)
                    pieces_ = (buf[s:e].tobytes() for s, e in zip(words.start[at].tolist(), words.end[at].tolist()))
                    digest.update(b" ".join(pieces_))
                    out.append((count, count - len(at), digest.hexdigest(), reach or 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([o[k] for o in out], type=t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64())))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "longest"],
            )

    return mapped(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, longest long")
