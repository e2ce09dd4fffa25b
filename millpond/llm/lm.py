"""Weighted backoff automaton (operator 2): smoothed n-grams are states with failure arcs, one traversal scores a text.

The model is a hierarchical Dirichlet n-gram model over the training documents. With c the count of an n-gram, h its history
and P' the model one order lower, P(w | h) = (c(hw) + M * P'(w)) / (c(h) + M); the unigrams are smoothed as the base score is.
As an automaton: each history seen in training is a state. A state has an arc for each word seen after it, weighted
log10 P(w | h), and a failure arc to the state of the shorter history, weighted log10 M / (c(h) + M), taken when a word has no arc.
The root has an arc for every word, known or not. Reading a text goes from its start state word by word: along an arc if
there is one, else over failure arcs, adding up the weights.

No machine holds the whole model. The rows of a scan task are cut into blocks of some `BLOCK_BYTES` of text. Each block lists the
n-grams it holds, once each with their count in the block's training documents, and sends them as packed arrays to shards by ranges of the
n-gram's hash; there is a shard per `SHARD_BYTES` of text, so a shard stays as small on a large corpus. A shard adds up
the counts of each n-gram over all blocks and answers every block in the order it asked; the answers are written. This is done in PASSES
over the texts, each for a range of shards, so that only a part of the questions is on disk at a time. A block
then builds the part of the automaton that its documents can reach and runs them through it side by side, one word of every
document per step. So what is exchanged grows with the corpus (there are never more packed rows than n-grams of blocks), texts are shuffled
once, nothing is broadcast, and a frequent n-gram is one entry per block.

An n-gram is known by a 64-bit hash. The text of a document is its words of lower-cased (A-Z) characters outside white space, then
an end mark. Training documents are those whose id, as text, has a crc32 that is not 0 modulo 10; a null id counts as the
empty text, whose crc32 is 0: it is held out. Null and empty texts are the end mark alone. Equal rows get equal scores. Without
training documents every unigram has the uniform weight. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, cut, mapped, partitions, run_lengths, starts_of, text_bytes
from .words import combine, tokenize

ALPHA = 0.1
STRENGTH = 8.0
HELD_OUT = 10
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 2 << 20
PASSES = 2
END = np.uint64(0x6A09E667F3BCC909)
START = np.uint64(0xBB67AE8584CAA73B)
ORDER = 3
# The last bits of a key: a training occurrence (while a block counts), and a single word.
TRAINING, WORD = np.uint64(1), np.uint64(2)
HASH = ~np.uint64(3)


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT == 0


class Stream:
    """The tokens of a block's documents in a row: hash, document, and the document's first token."""

    def __init__(self, texts: list[bytes | None]) -> None:
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHUNK):
                size += len(texts[hi] or b"")
                hi += 1
            words = tokenize(texts[lo:hi])
            per = words.counts
            ends = np.cumsum(per) + np.arange(len(per))
            tokens = np.full(len(words.hash) + len(per), END, dtype=np.uint64)
            inner = np.ones(len(tokens), dtype=bool)
            inner[ends] = False
            tokens[inner] = words.hash
            parts.append(tokens)
            counts.append(per + 1)
            lo = hi
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def keys(self, order: int) -> np.ndarray:
        """For each token the n-gram of that order that ends there, texts beginning with start marks."""
        parts = []
        for back in range(order - 1, -1, -1):
            moved = np.roll(self.tokens, back)
            for j in range(back):
                at = self.first[self.counts > j] + j
                moved[at] = START
            parts.append(moved)
        hashed = combine([np.full(len(self.tokens), order, dtype=np.uint64), *parts]) & HASH
        return hashed | WORD if order == 1 else hashed

    def start_key(self, order: int) -> np.uint64:
        """The history of start marks alone, as an n-gram of that order."""
        return (combine([np.array([order], dtype=np.uint64), *[np.array([START])] * order]) & HASH)[0]


def block_counts(stream: Stream, training: np.ndarray, order: int, low: int = 0, high: int = 1 << 64) -> tuple[np.ndarray, np.ndarray, bool]:
    """The block's distinct n-grams of all orders with a key in [low, high), sorted, how often each is in training documents, and
    whether it has any below.

    The history of start marks is counted once per training document, as it is each one's first state.
    """
    flag = training[stream.doc].astype(np.uint64)
    parts, below = [], False
    least, most = np.uint64(low), np.uint64(high - 1)
    for n in range(1, order + 1):
        own = [stream.keys(n) | flag]
        if n < order:
            own.append(np.repeat(stream.start_key(n), len(training)) | training.astype(np.uint64))
        for keys in own:
            below = below or bool((keys < least).any())
            parts.append(keys if low == 0 and high == 1 << 64 else keys[(keys >= least) & (keys <= most)])
    every = np.concatenate(parts)
    del parts, own
    every.sort()
    start, _ = run_lengths(starts_of(every >> TRAINING))
    seen = np.add.reduceat((every & TRAINING).astype(np.int64), start) if len(start) else start
    return every[start] & ~TRAINING, seen, below


def traverse(stream: Stream, counts: np.ndarray, n_training: int, vocabulary: int, order: int) -> tuple:
    """Base score, score and known tokens of each document, by one left-to-right run of all documents side by side.

    `counts` are the corpus counts of the block's distinct n-grams, in the order of `block_counts`.
    """
    # Of each token and order, the count of the n-gram that ends there, and of its history.
    parts = [stream.keys(n) for n in range(1, order + 1)] + [np.array([stream.start_key(n)]) for n in range(1, order)]
    every = np.concatenate(parts)
    at = np.argsort(every)
    found = np.empty(len(every), dtype=np.int64)
    found[at] = counts[np.cumsum(starts_of(every[at])) - 1]
    total = len(stream.tokens)
    seen = [found[n * total : (n + 1) * total] for n in range(order)]
    history = []
    for n in range(order - 1):
        # The history of a token's n-gram is the n-gram of one order less that ends at the token before it.
        before = np.roll(seen[n], 1)
        before[stream.first] = found[order * total + n]
        history.append(before)
    arc = [np.log10((seen[0] + ALPHA) / (n_training + ALPHA * (vocabulary + 1)))]
    for n in range(1, order):
        arc.append(np.log10((seen[n] + STRENGTH * 10.0 ** arc[-1]) / (history[n - 1] + STRENGTH)))
    failure = [np.log10(STRENGTH / (h + STRENGTH)) for h in history]

    longest = np.argsort(-stream.counts, kind="stable")
    sizes, first = stream.counts[longest], stream.first[longest]
    scores = np.zeros(len(sizes))
    # A state is the length of the history that was last matched; every text begins in the start state.
    state = np.full(len(sizes), order - 1)
    lanes = len(sizes)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        while sizes[lanes - 1] <= step:
            lanes -= 1
        at = first[:lanes] + step
        here = state[:lanes]
        add = np.zeros(lanes)
        waiting = np.ones(lanes, dtype=bool)
        reached = (seen[0][at] > 0).astype(np.int64)
        for n in range(order - 1, 0, -1):
            able = waiting & (here >= n) & (history[n - 1][at] > 0)
            taken = able & (seen[n][at] > 0)
            add += np.where(taken, arc[n][at], np.where(able, failure[n - 1][at], 0.0))
            reached[taken] = n + 1
            waiting &= ~taken
        scores[:lanes] += add + np.where(waiting, arc[0][at], 0.0)
        state[:lanes] = np.minimum(reached, order - 1)
    out = np.zeros(len(sizes))
    out[longest] = scores
    base = np.bincount(stream.doc, weights=arc[0], minlength=len(sizes))
    known = np.bincount(stream.doc, weights=seen[0] > 0, minlength=len(sizes)).astype(np.int64)
    return base, out, known


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of their eight: the upper bytes are nearly all zero and compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts byte by byte of their eight: nearly all are small."""
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a task, each with the number of its block: a new one begins once a block has `size` bytes of text.

    A scan that is run again, be it after a loss, reads a task's rows in the same order and numbers its blocks as before.
    """
    part = TaskContext.get().partitionId() << 32
    block = held = 0
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(sizes):
            hi = lo + int(np.searchsorted(np.cumsum(sizes[lo:]), size - held)) + 1
            hi = min(hi, len(sizes))
            yield part + block, batch.slice(lo, hi - lo)
            held += int(sizes[lo:hi].sum())
            if held >= size:
                block, held = block + 1, 0
            lo = hi


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(
    docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, passes: int = PASSES
) -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(passes, partitions(docs.sparkSession), -(-text_bytes(own) // shard_bytes))
    # Where the keys of a shard begin, and of the one after the last.
    edges = [-(-(s << 64) // shards) for s in range(shards + 1)]
    own = own.withColumn("held_out", held_out(F.col("doc_id")))

    def stream_of(table: pa.Table) -> tuple[Stream, np.ndarray]:
        texts = table.column("text").combine_chunks().cast(pa.binary()).to_pylist()
        return Stream(texts), ~np.array(table.column("held_out").to_pylist(), dtype=bool)

    def ask(first: int, last: int) -> DataFrame:
        """What all blocks ask the shards from `first` up to `last`."""

        def questions(block: int, table: pa.Table) -> pa.RecordBatch:
            stream, training = stream_of(table)
            keys, seen, below = block_counts(stream, training, order, edges[first], edges[last])
            cuts = [0, *np.searchsorted(keys, np.array(edges[first + 1 : last], dtype=np.uint64)), len(keys)]
            ranges = [(first + s, lo, hi) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
            # Told once: with the first shard that the block asks in any pass.
            n_training = 0 if below else int(stream.counts[training].sum())
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([s for s, _, _ in ranges], type=pa.int32()),
                    "block": pa.array([block] * len(ranges), type=pa.int64()),
                    "keys": pa.array([pack_keys(keys[lo:hi]) for _, lo, hi in ranges], type=pa.binary()),
                    "seen": pa.array([pack_counts(seen[lo:hi]) for _, lo, hi in ranges], type=pa.binary()),
                    "n_training": pa.array([n_training if k == 0 else 0 for k in range(len(ranges))], type=pa.int64()),
                }
            )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            before = None
            for block, rows in blocks(batches, block_bytes):
                if held and block != before:
                    yield questions(before, pa.Table.from_batches(held))
                    held = []
                before = block
                held.append(rows)
            if held:
                yield questions(before, pa.Table.from_batches(held))

        return mapped(own, run, "shard int, block long, keys binary, seen binary, n_training long")

    def answer(table: pa.Table) -> pa.Table:
        asked = [unpack_keys(b) for b in table.column("keys").to_pylist()]
        every = np.concatenate(asked)
        order_ = np.argsort(every)
        first = starts_of(every[order_])
        start, _ = run_lengths(first)
        seen = np.concatenate([unpack_counts(b) for b in table.column("seen").to_pylist()])
        totals = np.add.reduceat(seen[order_], start)
        known_words = int(((every[order_][start] & WORD > 0) & (totals > 0)).sum())
        back = np.empty(len(every), dtype=np.int64)
        back[order_] = totals[np.cumsum(first) - 1]
        ends = np.cumsum([len(a) for a in asked])
        rows = len(asked)
        return pa.table(
            {
                "block": table.column("block"),
                "shard": table.column("shard"),
                "totals": pa.array([pack_counts(back[e - len(a) : e]) for e, a in zip(ends, asked)], type=pa.binary()),
                "vocabulary": pa.array([known_words] + [0] * (rows - 1), type=pa.int64()),
                "n_training": table.column("n_training"),
            }
        )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks(batches, block_bytes):
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "text", "held_out")), pa.array([block] * rows.num_rows, type=pa.int64())],
                ["doc_id", "text", "held_out", "block"],
            )

    schema = "block long, shard int, totals binary, vocabulary long, n_training long"
    bounds = [shards * p // passes for p in range(passes + 1)]
    answered = reduce(
        DataFrame.union,
        [cut(ask(first, last).groupBy("shard").applyInArrow(answer, schema), "answers") for first, last in zip(bounds, bounds[1:])],
    )
    # Every distinct word is counted in the one shard that has it.
    vocabulary, n_training = answered.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("vocabulary", "n_training"))).first()

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        stream, _ = stream_of(texts)
        replies = sorted(zip(*(answers.column(c).to_pylist() for c in ("shard", "totals"))))
        counts = np.concatenate([unpack_counts(r[1]) for r in replies])
        base, total, known = traverse(stream, counts, n_training, vocabulary, order)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array(stream.counts, type=pa.int64()),
                "n_known": pa.array(known, type=pa.int64()),
                "train_tokens": pa.array([n_training] * len(known), type=pa.int64()),
                "base_score": pa.array(base, type=pa.float64()),
                "score": pa.array(total, type=pa.float64()),
            }
        )

    texts = mapped(own, dealt, "doc_id long, text string, held_out boolean, block long")
    replies = answered.select("block", "shard", "totals")
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, RESULT)
