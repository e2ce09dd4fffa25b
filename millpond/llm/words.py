"""Words and word windows of a batch of texts as numpy arrays: one pass of vector operations, no loop over words.

Texts are joined into one byte buffer with a separator between them. A word is a run of bytes outside a separator set; since
every separator is ASCII, UTF-8 letters are never split. A word is known by a 64-bit hash of its blocks of eight bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _splitmix(n: int, seed: int) -> np.ndarray:
    """`n` fixed random 64-bit values."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# The separators of the contract: space and the control characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

# What is kept of a block of eight bytes when only so many of them belong to a range.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


@dataclass
class Words:
    """Words of a batch: `doc` is each word's text, `start`/`end` its bytes in `buf`, `hash` its 64-bit hash."""

    buf: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def join(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 with a space after each, and where each begins (null: empty)."""
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8), offsets


def tokenize(texts: list[str | bytes | None], lower: bool = True) -> Words:
    """The words of every text of a batch; null, empty and blank texts have none."""
    buf, offsets = join(texts)
    if lower:
        buf = LOWER[buf]
    inside = np.zeros(len(buf) + 1, dtype=bool)
    np.logical_not(SPACE[buf], out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(buf, offsets, doc, start, end, fold_hash(buf, start, end))


def fold_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each byte range [start, end) of a buffer.

    Every block of eight bytes is scrambled with its place in the range before the blocks are added, so ranges with equal hashes meet
    by chance only, whatever their structure. Other seeds give independent hashes.
    """
    size = end - start
    blocks = (size + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 8 * place
    left = np.minimum(np.repeat(end, blocks) - at, 8)
    words = np.ndarray(len(buf) + 1, dtype="<u8", buffer=np.concatenate([buf, np.zeros(8, dtype=np.uint8)]).tobytes(), strides=(1,))
    salt = mix(np.arange(1, int(blocks.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(seed << 40))
    sums = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(mix((words[at] & _KEEP[left]) ^ salt[place]), dtype=np.uint64, out=sums[1:])
    return mix(sums[first + blocks] - sums[first] + size.astype(np.uint64))


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of `size` words inside one text, and the index of its first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return combine([words.hash[first + j] for j in range(size)]), first


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes; the order counts."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for factor, part in zip(_splitmix(len(parts), 99) | np.uint64(1), parts):
        total += part * factor
    return mix(total + np.uint64(len(parts)))
