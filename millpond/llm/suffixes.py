"""Suffix-array dedup (operator 7): bytes covered by a 200-byte string that also starts elsewhere are removed.

1. Equal texts are one text with a count; a text of at least 200 bytes that comes twice is removed whole, and one copy stands for all.
2. Every 200-byte window has an anchor: the 40-byte gram in it with the smallest hash, the leftmost of equal ones. Equal
   windows have equal anchors at equal offsets, so windows are compared only with windows of the same anchor. Anchors (one per
   some 80 windows) are sent, packed, to shards by hash; an anchor that occurs once ends there, and its windows are unique.
3. The texts of repeated anchors are cut out, as far as their windows reach, and dealt into suffix-array shards of about
   `SHARD` bytes. An anchor's occurrences stay in one shard unless they are more than `OCCURRENCES`: then they are split over
   several.
4. A shard sorts all its suffixes to a depth of 200 bytes by Larsson-Sadakane refinement in numpy: ranks by four bytes, then
   by 8, 16, ... 128 and 200, each round sorting only suffixes whose rank is not unique yet, by the pair of their rank and the
   rank a step ahead. Common prefixes of neighbours follow by Kasai's rule, many stretches of the text side by side. A window is repeated if
   it shares 200 bytes with a neighbour.
5. Split anchors: each of their shards sends its distinct windows, as 128-bit fingerprints, to buckets of the fingerprint;
   there the shards' sorted lists are merged by binary search in each other.
6. Repeated windows become byte ranges per text, and the ranges are cut out of the texts.

Matches never cross texts. Anchors that a bounded sample shows to be very frequent are dealt by text from the start. Nothing is capped: the
sample and the shard sizes decide where work is done, never what is found.

Null and empty texts have no bytes. Repeated rows, whatever their ids, are copies of each other. Texts may be of any length: long ones are
handled in stretches. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    CHUNK, NO_ID, content_key, cut, groups, mapped, partitions, pieces, raw, run_lengths, shard_cuts, starts_of,
)
from .words import mix

DEPTH = 200
GRAM = 40
WINDOW = DEPTH - GRAM + 1
POSITION_BITS = 22
SHARD = 1 << 18
OCCURRENCES = 700
LANE = 128
SAMPLE = 20_000
FREQUENT = 1 << 16
FLUSH = 1_000_000
FACTORS = mix(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position of a buffer on."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    words = np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf.tobytes(), strides=(1,))
    total = words[:n] * FACTORS[0]
    for i in range(1, GRAM // 8):
        total += words[8 * i : 8 * i + n] * FACTORS[i]
        total ^= total >> np.uint64(29)
    return mix(total)


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: hash, first window, windows, and the text each is in.

    `buf` holds texts one after the other, `ends` where each ends; windows lie inside one text.
    """
    begins = np.concatenate([[0], ends[:-1]])
    empty = np.zeros(0, dtype=np.int64)
    hashes = gram_hashes(buf)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return hashes[:0], empty, empty, empty
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    anchor = (least & low).astype(np.int64)
    # A text's last window begins DEPTH bytes before its end.
    change = np.zeros(n + 1, dtype=bool)
    change[0] = True
    change[1:n] = anchor[1:] != anchor[:-1]
    inside = np.zeros(n + 1, dtype=np.int64)
    long = ends - begins >= DEPTH
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, np.minimum(ends[long] - DEPTH + 1, n), -1)
    inside = np.cumsum(inside[:n]) > 0
    change[begins[long]] = True
    first = np.flatnonzero(change[:n] & inside)
    # A run ends where the next begins or where its text's windows end.
    owner = np.searchsorted(ends, first, side="right")
    stop = np.minimum(np.append(first[1:], n), ends[owner] - DEPTH + 1)
    return hashes[anchor[first]], first, stop - first, owner


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about CHUNK bytes: bytes, ends of the parts, and each part's text and place in it. Parts of one text
    overlap so that each of its windows is in one part."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def give() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ends = np.cumsum([len(p) for p, _, _ in held])
        buf = np.frombuffer(b"".join(p for p, _, _ in held), dtype=np.uint8)
        return buf, ends, np.array([t for _, t, _ in held]), np.array([at for _, _, at in held])

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - DEPTH + 1), CHUNK):
            part = text[at : at + CHUNK + DEPTH - 1]
            if len(part) < DEPTH:
                continue
            held.append((part, i, at))
            size += len(part)
            if size >= CHUNK:
                yield give()
                held, size = [], 0
    if held:
        yield give()


def text_anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per buffer: hash, text, first window and number of windows of every anchor."""
    for buf, ends, owner, place in stretches(texts):
        hashes, first, count, part = anchors(buf, ends)
        begins = np.concatenate([[0], ends[:-1]])
        yield hashes, owner[part], first - begins[part] + place[part], count


def frequent_anchors(texts: DataFrame, total: int) -> np.ndarray:
    """Anchors that over a hundredth of a bounded sample of texts hold, sorted. At most FREQUENT, so tasks may carry them."""
    every = max(1, total // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [np.zeros(0, dtype=np.uint64)]
                for hashes, owner, _, _ in text_anchors(list(set(raw(piece.column("text"))))):
                    at = np.lexsort((owner, hashes))
                    hashes, owner = hashes[at], owner[at]
                    found.append(hashes[starts_of(hashes) | starts_of(owner)])
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                # A hash seen once among the texts of a piece is no candidate there.
                keys, counts = keys[counts > 1], counts[counts > 1]
                yield pa.RecordBatch.from_pydict({"h": pa.array(keys.view(np.int64)), "n": pa.array(counts, type=pa.int64())})

    sample = texts.where(F.pmod(F.xxhash64("k2"), F.lit(every)) == 0).select("text")
    counted = mapped(sample, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("n") >= max(8, min(total, SAMPLE) // 100)).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.sort(np.array([r[0] for r in often.collect()], dtype=np.int64).view(np.uint64))


ENTRY = np.dtype([("hash", "<u8"), ("id", "<i8"), ("at", "<u4"), ("count", "<u2")])


def repeated_anchors(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """`k1`, `h`, `at`, `count`, `salt`: the anchors that occur at two places at least, and the part of their anchor."""
    shards = partitions(texts.sparkSession)

    def pack(entries: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
        by = mix(entries["id"].view(np.uint64)) if known else entries["hash"]
        at = np.argsort(by)
        cuts = shard_cuts(by[at], shards)
        for shard, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if hi > lo:
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], type=pa.int32()),
                        "known": pa.array([known]),
                        "entries": pa.array([entries[at[lo:hi]].tobytes()], type=pa.binary()),
                    }
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        # Copies met since the last flush are left out here, so they never reach a shard by the thousands.
        seen: set[tuple[int, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            for known, parts in enumerate(held):
                if parts:
                    yield from pack(np.concatenate(parts), bool(known))
                    parts.clear()
            seen.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                k1, k2 = (piece.column(c).to_pylist() for c in ("k1", "k2"))
                texts_, own = [], []
                for a, b, text in zip(k1, k2, raw(piece.column("text"))):
                    if (a, b) not in seen:
                        seen.add((a, b))
                        texts_.append(text)
                        own.append(a)
                ids = np.array(own, dtype=np.int64)
                for hashes, owner, first, count in text_anchors(texts_):
                    entries = np.empty(len(hashes), dtype=ENTRY)
                    entries["hash"], entries["id"], entries["at"], entries["count"] = hashes, ids[owner], first, count
                    hot = np.isin(hashes, frequent) if len(frequent) else np.zeros(len(hashes), dtype=bool)
                    for part, kept in zip((entries[~hot], entries[hot]), held):
                        if len(part):
                            kept.append(part)
                            size += len(part)
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    def match(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        found = []
        for known in (False, True):
            blobs = [e for e, k in zip(table.column("entries").to_pylist(), table.column("known").to_pylist()) if k == known]
            entries = np.frombuffer(b"".join(blobs), dtype=ENTRY)
            at = np.lexsort((entries["at"], entries["id"], entries["hash"]))
            entries = entries[at]
            # Copies of a text send the same entries.
            first = starts_of(entries["hash"]) | starts_of(entries["id"]) | starts_of(entries["at"])
            entries = entries[first]
            start, length = run_lengths(starts_of(entries["hash"]))
            rank = np.arange(len(entries)) - np.repeat(start, length)
            split = np.repeat(length > OCCURRENCES, length) | known
            # 0 for an anchor in one part; else the parts have numbers of their own.
            salt = np.where(split, 1 + shard * known + (rank // OCCURRENCES) * (shards if known else 1), 0)
            keep = known | (np.repeat(length, length) > 1)
            found.append((entries[keep], salt[keep]))
        entries, salt = (np.concatenate([f[k] for f in found]) for k in range(2))
        return pa.table(
            {
                "k1": pa.array(entries["id"].astype(np.int64)),
                "h": pa.array(entries["hash"].copy().view(np.int64)),
                "at": pa.array(entries["at"].astype(np.int64)),
                "count": pa.array(entries["count"].astype(np.int64)),
                "salt": pa.array(salt.astype(np.int64)),
            }
        )

    packed = mapped(texts.select("k1", "k2", "text"), run, "shard int, known boolean, entries binary")
    return packed.groupBy("shard").applyInArrow(match, "k1 long, h long, at long, count long, salt long")


def cut_out(texts: DataFrame) -> DataFrame:
    """The bytes that the repeated anchors' windows reach, per anchor and text: windows that follow one another are one segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(raw(batch.column("text")), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("found").to_pylist())
            for text, k1, k2, found in rows:
                todo = sorted((f["h"], f["salt"], f["at"], f["count"]) for f in found)
                last = None
                for h, salt, at, count in todo:
                    if last and last[0] == h and last[1] == salt and at <= last[3] and at + count - last[2] <= SHARD:
                        last[3] = max(last[3], at + count)
                        continue
                    if last:
                        out.append((*last, k1, k2, text))
                    last = [h, salt, at, at + count]
                if last:
                    out.append((*last, k1, k2, text))
            for lo in range(0, len(out), 4096):
                some = out[lo : lo + 4096]
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array([r[0] for r in some], type=pa.int64()),
                        "salt": pa.array([r[1] for r in some], type=pa.int64()),
                        "k1": pa.array([r[4] for r in some], type=pa.int64()),
                        "k2": pa.array([r[5] for r in some], type=pa.int64()),
                        "at": pa.array([r[2] for r in some], type=pa.int64()),
                        "count": pa.array([r[3] - r[2] for r in some], type=pa.int64()),
                        # A text whose key only looks the same may be shorter: what it lacks cannot be a window.
                        "bytes": pa.array([r[6][r[2] : r[3] + DEPTH - 1] for r in some], type=pa.binary()),
                    }
                )

    return mapped(texts, run, "h long, salt long, k1 long, k2 long, at long, count long, bytes binary")


def suffix_ranks(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement to DEPTH bytes: ranks, and the positions in that order (equal ones by position).

    `ends` holds where each segment ends; a suffix ends with its segment, and an end comes before any byte.
    """
    n = len(buf)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n, dtype=np.uint64)
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    key = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([buf.astype(np.uint64) + np.uint64(1), np.zeros(4, dtype=np.uint64)])
    left = end_of - np.arange(n)
    for i in range(4):
        key = key << np.uint64(9) | np.where(left > i, padded[i : i + n], np.uint64(0))
    order = np.sort(key << bits | place)
    rank = np.empty(n, dtype=np.uint64)
    at = (order & low).astype(np.int64)
    first = starts_of(order >> bits)
    slots = place
    rank[at] = np.maximum.accumulate(np.where(first, slots, np.uint64(0)))
    sa = at.copy()
    depth = 4
    while depth < DEPTH:
        _, length = run_lengths(first)
        several = np.repeat(length > 1, length)
        active, slots = np.sort(at[several]), slots[several]
        if not len(active):
            break
        # The suffix a step ahead: known to the same depth, and all that a depth of DEPTH needs in the last round.
        step = min(depth, DEPTH - depth)
        ahead = active + step
        inside = ahead < end_of[active]
        second = np.zeros(len(active), dtype=np.uint64)
        second[inside] = rank[ahead[inside]] + np.uint64(1)
        order = np.sort((rank[active] << bits | second) << bits | active.astype(np.uint64))
        at = (order & low).astype(np.int64)
        first = starts_of(order >> bits)
        # Sorted by old rank first, the active suffixes fill the same slots as before.
        rank[at] = np.maximum.accumulate(np.where(first, slots, np.uint64(0)))
        sa[slots.astype(np.int64)] = at
        depth += step
    return rank.astype(np.int64), sa


def common_prefixes(buf: np.ndarray, ends: np.ndarray, sa: np.ndarray, slot: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Kasai's rule: for each wanted position, the bytes (up to DEPTH) its suffix shares with the one before it in `sa`.

    Lanes of LANE positions run side by side. From one position to the next the length drops by one at most, if the
    neighbour's successor still stands before it; else it starts anew.
    """
    n = len(buf)
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    padding = np.zeros(2 * DEPTH + 8, dtype=np.uint8)
    words = np.ndarray(n + 2 * DEPTH, dtype="<u8", buffer=np.concatenate([buf, padding]).tobytes(), strides=(1,))
    shared = np.zeros(n, dtype=np.int64)
    lanes = np.unique(np.flatnonzero(wanted) // LANE) * LANE
    length = np.zeros(len(lanes), dtype=np.int64)
    neighbour = np.full(len(lanes), -1)
    for step in range(LANE):
        i = lanes + step
        if len(i) and i[-1] >= n:
            lanes, length, neighbour, i = (x[:-1] for x in (lanes, length, neighbour, i))
        here = slot[i]
        before = np.where(here > 0, sa[np.maximum(here - 1, 0)], -1)
        follows = (neighbour >= 0) & (neighbour + 1 < n)
        follows &= slot[np.minimum(neighbour + 1, n - 1)] < here
        length = np.where(follows, np.maximum(length - 1, 0), 0)
        most = np.where(before >= 0, np.minimum(DEPTH, np.minimum(end_of[i] - i, end_of[before] - before)), 0)
        length = np.minimum(length, most)
        asked = wanted[i]
        # Most lanes have one byte left to compare; those that start anew look at all words at once.
        for few in (True, False):
            going = np.flatnonzero(asked & (length < most) & ((most - length <= 8) == few))
            if len(going):
                at = np.arange(0, 8 if few else DEPTH, 8)
                known = length[going]
                differ = words[(i[going] + known)[:, None] + at] ^ words[(before[going] + known)[:, None] + at]
                unlike = differ != 0
                column = np.where(unlike.any(axis=1), unlike.argmax(axis=1), len(at) - 1)
                # The first differing byte of eight: the lowest set bit.
                word = differ[np.arange(len(going)), column]
                lowest = np.maximum(word & (~word + np.uint64(1)), np.uint64(1)).astype(float)
                equal = 8 * column + np.where(word == 0, 8, np.log2(lowest).astype(np.int64) // 8)
                length[going] = np.minimum(known + equal, most[going])
        # Where nothing was asked the length is only a lower bound.
        shared[i] = length
        neighbour = np.where(asked, before, -1)
    return shared


def fingerprints(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the DEPTH bytes from each position on."""
    words = np.ndarray(len(buf) - 7, dtype="<u8", buffer=buf.tobytes(), strides=(1,))
    out = []
    for seed in (1, 2):
        factors = mix(np.arange(1, DEPTH // 8 + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)
        total = np.zeros(len(at), dtype=np.uint64)
        for i, factor in enumerate(factors):
            total = mix(total + words[at + 8 * i] * factor)
        out.append(total)
    return out[0], out[1]


class Shard:
    """Segments of one suffix-array shard, and what is found in it."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, bytes]] = []
        self.size = 0

    def add(self, table: pa.Table) -> None:
        seen = set()
        columns = (table.column(c).to_pylist() for c in ("salt", "k1", "k2", "at", "count"))
        for *row, text in zip(*columns, table.column("bytes").to_pylist()):
            salt, k1, k2, at, count = row
            count = min(count, len(text) - DEPTH + 1)
            # A text that came twice has sent its segments twice.
            if count > 0 and (k1, k2, at) not in seen:
                seen.add((k1, k2, at))
                self.rows.append((salt, k1, k2, at, count, text))
                self.size += len(text)

    def solve(self) -> Iterator[pa.RecordBatch]:
        """`kind` 0: a range of repeated windows, [at, stop). `kind` 1: a window of a split anchor, by its fingerprint, empty if
        it is repeated here."""
        if not self.rows:
            return
        buf = np.frombuffer(b"".join(r[5] for r in self.rows), dtype=np.uint8)
        ends = np.cumsum([len(r[5]) for r in self.rows])
        counts = np.array([r[4] for r in self.rows], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        segment = np.repeat(np.arange(len(counts)), counts)
        window = begins[segment] + np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
        rank, sa = suffix_ranks(buf, ends)
        starts = np.zeros(len(buf), dtype=bool)
        starts[window] = True
        slot = np.empty(len(buf), dtype=np.int64)
        slot[sa] = np.arange(len(buf))
        # A suffix whose rank differs from its neighbour's shares less than DEPTH bytes with it; the rest are measured.
        tied = np.zeros(len(buf), dtype=bool)
        tied[sa[1:]] = rank[sa[1:]] == rank[sa[:-1]]
        wanted = starts & tied
        shared = common_prefixes(buf, ends, sa, slot, wanted)
        long = wanted & (shared >= DEPTH)
        repeated = long.copy()
        repeated[sa[:-1]] |= long[sa[1:]]
        repeated &= starts

        marks = repeated[window]
        fresh = starts_of(segment) | (np.concatenate([[False], marks[:-1]]) != marks)
        start, length = run_lengths(fresh)
        start, length = start[marks[start]], length[marks[start]]
        owner = segment[start]
        at = np.array([r[3] for r in self.rows], dtype=np.int64)[owner] + window[start] - begins[owner]
        yield self.batch(owner, 0, at, at + length)

        split = np.array([r[0] > 0 for r in self.rows])
        if split.any():
            # Of windows that are equal here the first in order stands for all.
            chosen = split[segment] & ~(repeated[window] & (shared[window] >= DEPTH))
            window, segment = window[chosen], segment[chosen]
            at = np.array([r[3] for r in self.rows], dtype=np.int64)[segment] + window - begins[segment]
            first, second = fingerprints(buf, window)
            # What is repeated in this shard needs no answer, but tells the others.
            yield self.batch(segment, 1, at, at + ~repeated[window], first, second)

    def batch(self, owner: np.ndarray, kind: int, at: np.ndarray, stop: np.ndarray, f1: np.ndarray | None = None, f2: np.ndarray | None = None) -> pa.RecordBatch:
        k1, k2, salt = (np.array([r[k] for r in self.rows], dtype=np.int64)[owner] for k in (1, 2, 0))
        none = np.zeros(len(owner), dtype=np.uint64)
        return pa.RecordBatch.from_pydict(
            {
                "kind": pa.array(np.full(len(owner), kind, dtype=np.int32)),
                "k1": pa.array(k1),
                "k2": pa.array(k2),
                "at": pa.array(at),
                "stop": pa.array(stop),
                "salt": pa.array(salt),
                "f1": pa.array((none if f1 is None else f1).view(np.int64)),
                "f2": pa.array((none if f2 is None else f2).view(np.int64)),
            }
        )


def repeated_windows(segments: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for table in groups(batches, "g"):
            shard.add(table)
            if shard.size >= SHARD:
                yield from shard.solve()
                shard = Shard()
        yield from shard.solve()

    schema = "kind int, k1 long, k2 long, at long, stop long, salt long, f1 long, f2 long"
    dealt = segments.withColumn("g", F.xxhash64("h", "salt")).repartition("g").sortWithinPartitions("g")
    return mapped(dealt, run, schema)


def merged_windows(found: DataFrame) -> DataFrame:
    """Windows of split anchors that only another part has too: each part's sorted fingerprints are looked up in all the others'.

    A frequent passage is repeated in each part already, so its windows are looked up but not answered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "bucket"):
            first, second, at, stop, k1, k2, salt = (
                table.column(c).to_numpy().astype(np.int64) for c in ("f1", "f2", "at", "stop", "k1", "k2", "salt")
            )
            order = np.lexsort((second, first))
            fresh = starts_of(first[order]) | starts_of(second[order])
            both = np.empty(len(order), dtype=np.int64)
            both[order] = np.cumsum(fresh)
            every = np.sort(both)
            twice = np.zeros(len(both), dtype=bool)
            for part in np.unique(salt):
                own = np.flatnonzero(salt == part)
                own = own[np.argsort(both[own])]
                twice[own] = np.searchsorted(every, both[own], "right") - np.searchsorted(every, both[own], "left") > 1
            twice &= stop > at
            yield pa.RecordBatch.from_pydict(
                {"k1": pa.array(k1[twice]), "k2": pa.array(k2[twice]), "at": pa.array(at[twice]), "stop": pa.array(at[twice] + 1)}
            )

    buckets = 16 * partitions(found.sparkSession)
    bucketed = found.where("kind = 1").withColumn("bucket", F.pmod("f1", F.lit(buckets)))
    return mapped(bucketed.repartition("bucket").sortWithinPartitions("bucket"), run, "k1 long, k2 long, at long, stop long")


def covered(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """The bytes under windows that begin in [start, stop), as maximal ranges."""
    out: list[list[int]] = []
    for start, stop in sorted(zip(starts, stops)):
        end = stop + DEPTH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("*", *content_key(F.col("text")))
    texts = cut(
        own.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("d")), "texts"
    )
    frequent = frequent_anchors(own, texts.count())
    long = own.where(F.octet_length("text") >= DEPTH)
    shared = cut(repeated_anchors(long, frequent), "anchors")

    # One text per content, with its anchors. The id is in the key, so that copies of a text do not meet.
    found = shared.groupBy("k1").agg(F.collect_list(F.struct("h", "salt", "at", "count")).alias("found"))
    # Rows that are wholly equal are one from the start.
    keyed = long.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "k1", "k2").agg(F.first("text").alias("text"))
    holders = keyed.join(texts.join(found, "k1").select("d", "k1", "k2", "found"), ["d", "k1", "k2"])
    result = cut(repeated_windows(cut_out(holders.select("text", "k1", "k2", "found"))), "windows")

    ranges = result.where("kind = 0").select("k1", "k2", "at", "stop").union(merged_windows(result))
    spans = ranges.groupBy("k1", "k2").agg(F.collect_list("at").alias("starts"), F.collect_list("stop").alias("stops"))
    state = texts.select("k1", "k2", (F.col("copies") > 1).alias("twice")).join(spans, ["k1", "k2"], "left")
    rows = own.join(state, ["k1", "k2"]).select("doc_id", "text", "twice", "starts", "stops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("twice", "starts", "stops"))
            for text, twice, starts, stops in zip(raw(batch.column("text")), *columns):
                cuts = [(0, len(text))] if twice and len(text) >= DEPTH else covered(starts or [], stops or [])
                digest = hashlib.sha256()
                at = removed = 0
                for lo, hi in cuts:
                    digest.update(text[at:lo])
                    removed += hi - lo
                    at = hi
                digest.update(text[at:])
                out.append((len(text), removed, len(cuts), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([o[k] for o in out], type=pa.int64()) for k in range(3)), pa.array([o[3] for o in out], type=pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return mapped(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
