"""Byte-level BPE encoding and decoding (operator 9): many pieces are merged at once in padded numpy matrices.

A text is split by the tokenizer's pattern; each distinct piece is encoded on its own. Pieces are sorted into length buckets,
each a matrix of token ids with one row per piece, padded at the right. In every round each row finds its adjacent pair of the
lowest merge rank (the leftmost one of several), looked up in a hash table of pairs; the pair becomes one token, the row
moves up by one place, and rows without a mergeable pair leave the matrix. Rows are compacted as they finish. A piece longer than the largest
bucket follows the same rule with a heap, as a matrix would need a round per byte.

Ranks are those of a public rank file, read once on the driver (a vocabulary of some ten thousand tokens, whatever the data)
and sent with the task; the path is a parameter. Every document is encoded where it lies: nothing is shuffled. Each worker keeps the
pieces it has met in a table that is emptied when it reaches a fixed number of entries, which changes no result.

Null and empty texts have no tokens and decode to the empty text. Special tokens are never produced: their strings are
ordinary text. Repeated rows are encoded alike. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import expand, pieces

# Longest piece of each matrix; longer pieces go by the heap.
BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128)
ROWS = 1 << 14
KNOWN_PIECES = 600_000
NONE = 1 << 30

# The public pattern, and the same for texts without a character from U+0250 on, in classes the standard library knows.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_BLANK = "\t-\r \x85\xa0"
LATIN_PATTERN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
BEYOND_LATIN = re.compile("[^\x00-\u024f]").search


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


@dataclass
class Vocabulary:
    """Tokens by rank, the id of each byte, and the hash table of pairs that make a token."""

    tokens: list[bytes]

    def __getstate__(self) -> dict:
        return {"tokens": self.tokens}

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {token: i for i, token in enumerate(self.tokens)}

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Key left * 2^32 + right of every pair of tokens whose bytes together are a token, with that token."""
        found = {}
        for i, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = i
        return found

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing with linear probing, at most a quarter full: keys, tokens, bits."""
        keys = np.fromiter(self.pairs.keys(), dtype=np.uint64, count=len(self.pairs))
        values = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        bits = max(4, int(len(keys) * 4).bit_length())
        slots = np.full(1 << bits, np.uint64((1 << 64) - 1))
        tokens = np.full(1 << bits, NONE, dtype=np.int64)
        at = _slot(keys, bits)
        left = np.arange(len(keys))
        while len(left):
            free = slots[at[left]] == np.uint64((1 << 64) - 1)
            slots[at[left[free]]] = keys[left[free]]
            won = slots[at[left]] == keys[left]
            tokens[at[left[won]]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        return slots, tokens, bits

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token each pair makes, NONE if none."""
        slots, tokens, bits = self.table
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = _slot(keys, bits)
        there = slots[at]
        out = np.where(there == keys, tokens[at], NONE)
        open_ = np.flatnonzero((there != keys) & (there != np.uint64((1 << 64) - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << bits) - 1)
            there = slots[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = tokens[at[open_[hit]]]
            open_ = open_[~hit & (there != np.uint64((1 << 64) - 1))]
        return out

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in a row, and where each begins."""
        sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        return np.frombuffer(b"".join(self.tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a run of ids, and how many each id gave."""
        data, start = self.joined
        sizes = start[ids + 1] - start[ids]
        return data[expand(start[ids], sizes)], sizes


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def merge_rows(vocabulary: Vocabulary, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of pieces of at most `width` bytes: all ids in a row, and how many each piece has."""
    sizes = np.array([len(r) for r in rows], dtype=np.int32)
    columns = np.arange(width, dtype=np.int32)
    inside = columns < sizes[:, None]
    ids = np.full((len(rows), width), -1, dtype=np.int32)
    ids[inside] = vocabulary.byte_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
    ranks = np.full((len(rows), width), NONE, dtype=np.int32)
    pair = inside[:, 1:]
    ranks[:, :-1][pair] = vocabulary.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
    row = here = np.arange(len(rows))
    ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        at = ranks.argmin(axis=1)
        lowest = ranks[here, at]
        done = lowest == NONE
        if done.any():
            ended.append((row[done], sizes[done], ids[done][columns < sizes[done][:, None]]))
            going = np.flatnonzero(~done)
            ids, ranks, row, sizes, at, lowest = ids[going], ranks[going], row[going], sizes[going], at[going], lowest[going]
            if not len(row):
                break
            here = np.arange(len(row))
        # The pair at `at` becomes one token; what stands right of it moves one place to the left.
        moved = columns[None, :-1] > at[:, None]
        np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=moved)
        np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=moved)
        ids[:, -1] = -1
        ranks[:, -1] = NONE
        ids[here, at] = lowest
        sizes -= 1
        for side in (at - 1, at):
            real = (side >= 0) & (side + 1 < sizes)
            new = np.full(len(row), NONE, dtype=np.int32)
            new[real] = vocabulary.ranks(ids[here[real], side[real]], ids[here[real], side[real] + 1])
            ranks[here[side >= 0], side[side >= 0]] = new[side >= 0]
        longest = max(2, int(sizes.max()))
        if longest < width:
            ids, ranks, width, columns = ids[:, :longest], ranks[:, :longest], longest, columns[:longest]
    row, counts, flat = (np.concatenate([e[k] for e in ended]) for k in range(3))
    first = np.cumsum(counts) - counts
    order = np.argsort(row)
    return flat[expand(first[order], counts[order])], counts[order]


def merge_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """The token ids of one piece by a heap of (rank, place) over a linked list: the same merges in the same order."""
    ids = vocabulary.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    pairs = vocabulary.pairs
    alive = [True] * len(ids)

    def rank(i: int) -> int | None:
        j = after[i]
        return pairs.get(ids[i] << 32 | ids[j]) if j < len(ids) else None

    heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or rank(i) != r:
            continue
        j = after[i]
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (new := rank(k)) is not None:
                heapq.heappush(heap, (new, k))
    return np.array([x for x, there in zip(ids, alive) if there], dtype=np.int64)


def encode_pieces(vocabulary: Vocabulary, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all pieces in a row, and how many each has."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    chosen: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
    blocks: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))]
    low = 0
    for width in BUCKETS:
        bucket = np.flatnonzero((sizes > low) & (sizes <= width))
        for lo in range(0, len(bucket), ROWS):
            chosen.append(bucket[lo : lo + ROWS])
            blocks.append(merge_rows(vocabulary, [parts[i] for i in chosen[-1]], width))
        low = width
    for i in np.flatnonzero(sizes > low):
        ids = merge_long(vocabulary, parts[i])
        chosen.append(np.array([i]))
        blocks.append((ids, np.array([len(ids)], dtype=np.int32)))
    flat, counts = (np.concatenate([b[k] for b in blocks]) for k in range(2))
    first = np.cumsum(counts) - counts
    order = np.argsort(np.concatenate(chosen))
    return flat[expand(first[order], counts[order])], counts[order]


class Encoder:
    """Encodes texts, keeping what it learned about pieces between calls."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary = vocabulary
        self.slow = regex.compile(pattern).findall
        self.fast = re.compile(LATIN_PATTERN).findall if pattern == KNOWN_PATTERN else None
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.flat = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def split(self, text: str) -> list[str]:
        if self.fast and not BEYOND_LATIN(text):
            return self.fast(text)
        return self.slow(text)

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.number]
        if len(self.number) + len(new) > KNOWN_PIECES:
            self.forget()
            new = list(parts)
        flat, counts = encode_pieces(self.vocabulary, [p.encode() for p in new])
        ends = np.cumsum(counts)
        words = list(map(str, flat.tolist()))
        for part, lo, hi in zip(new, (ends - counts).tolist(), ends.tolist()):
            self.number[part] = len(self.text)
            self.text.append(",".join(words[lo:hi]))
        self.flat = np.concatenate([self.flat, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in a row, how many each text has, and each text's ids in decimal, joined by commas."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        number = [list(map(self.number.__getitem__, parts)) for parts in split]
        text = self.text.__getitem__
        decimal = [",".join(map(text, numbers)) for numbers in number]
        flat = np.fromiter((n for numbers in number for n in numbers), dtype=np.int64)
        sizes = self.ends[flat + 1] - self.ends[flat]
        totals = np.concatenate([[0], np.cumsum(sizes)])
        pieces_of = np.concatenate([[0], np.cumsum([len(n) for n in number])]).astype(np.int64)
        return self.flat[expand(self.ends[flat], sizes)], np.diff(totals[pieces_of]), decimal


COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Every document with `n_tokens`, digests of its ids and of the bytes they decode to, and `ids` themselves if wanted."""
    vocabulary = Vocabulary(tokens)
    names = [*keep, *(c.split()[0] for c in COLUMNS.split(", ")), *["ids"] * ids]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema = f"{kept}, {COLUMNS}{', ids array<int>' * ids}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern)
        for batch in batches:
            for piece in pieces(batch, "text"):
                flat, counts, decimal = encoder.encode(["" if t is None else t for t in piece.column("text").to_pylist()])
                data, sizes = vocabulary.decode(flat)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
                columns = [
                    pa.array(counts),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decimal]),
                    pa.array([hashlib.sha256(data[lo:hi].tobytes()).hexdigest() for lo, hi in zip(ends, ends[1:])]),
                ]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32())))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *columns], names)

    return docs.selectExpr(*(f"`{c}`" for c in keep), "cast(text as string) text").mapInArrow(run, schema)
