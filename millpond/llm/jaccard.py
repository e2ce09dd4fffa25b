"""N-gram Jaccard join by a token-group matrix (operator 4).

A document is the set of its distinct 5-word shingles, its tokens. Two documents link at a Jaccard similarity of 0.75 or more;
the join returns, per document, the component of the links it is in.

1. Equal sets are one row from the start. Every set is in the join.
2. All tokens have one global order, the same for every document: frequent ones last. The order is fitted on a bounded sample
   of documents and affects cost only, never a result. Two sets that link share a token among the first
   n - ceil(0.75 n) + 1 of each; these prefixes are sent, packed, to shards by token, and tokens held by one set alone end there.
3. What is left is the matrix of shared tokens. Similar sets are partitioned into groups by the smallest hash of their shared
   tokens and their size, at most `GROUP` sets each. Inside a group, and inside a second partition by another hash and of all sizes,
   all links are found; they join sets into components. Two sets that link share so many tokens of their prefixes (`least_shared`) that most sets are known by their
   rows of the matrix to link with none of their group. Only texts of the others are sent.
4. The token-group matrix has a row per (token, group) with the largest component any holder is in. A set queries a group if
   they share enough such tokens and a holder's component is another and larger one, so for two sets of different components the one in
   the smaller component queries, and copies of one text by the thousands, long joined, query nothing.
5. A group that is queried holds its sets' whole tokens as bitmaps, and their union. A token of the query whose place in the union is empty
   is in no member, so the union bounds the query's overlap with every member, and a member's bitmap the overlap with it.
   Only groups and members whose bound reaches the threshold are opened: their texts are sent and compared exactly.

Only links between components matter for the result, so one link per pair of a query and a component is kept, never all pairs. Groups are
bounded, a group with very many queries is copied to several tasks, and a token's holders are never gathered: joins run on keys
that AQE can split. Texts are fetched twice, each time only of the sets that may still link. Shingles and sets are known by 64-bit hashes.

Null, empty and blank texts have no shingles and link with nothing; texts of one to four words have one, the whole
sequence. Repeated rows link. A null doc_id is never a component's name unless all its ids are null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    NO_ID, components, content_key, cut, expand, groups, mapped, partitions, pieces, raw, run_lengths, shard_cuts, starts_of,
)
from .words import combine, tokenize, windows

SIZE = 5
# The threshold as a fraction: 3 * union <= 4 * intersection.
NUMERATOR, DENOMINATOR = 3, 4
GROUP = 128
QUERIES = 1024
# Steps of size from one power of two to the next.
STEPS = 8
# The order of tokens is fitted on about so many documents, and knows at most so many frequent tokens.
SAMPLE = 20_000
FREQUENT = 1 << 17
FLUSH = 2_000_000
# More tokens than a set has.
NEVER = 1 << 62
# Bits that mark the keys of wanted texts: 4 MB on the driver and with the tasks, whatever the number of keys.
MARKS = 1 << 25
# Spark's bitmaps hold so many bits each.
BITMAP = 1 << 15


def shingle_sets(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = tokenize(texts)
    keys, first = windows(words, size)
    owner = words.doc[first]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    counts = words.counts
    begin = np.cumsum(counts) - counts
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= size:
            own = np.sort(keys[ends[i] : ends[i + 1]])
            out.append(own[starts_of(own)])
        elif n:
            out.append(combine([words.hash[begin[i] + j : begin[i] + j + 1] for j in range(n)]))
        else:
            out.append(keys[:0])
    return out


def set_id(tokens: np.ndarray) -> int:
    """64 bits of a set's digest, signed: equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def prefix(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a set's prefix: first those that are not frequent, by hash, then frequent ones by their rank.

    `frequent` holds (token, rank) sorted by token. Returned apart: rare and frequent tokens of the prefix.
    """
    n = len(tokens)
    length = n - (-(-NUMERATOR * n // DENOMINATOR)) + 1
    at = np.minimum(np.searchsorted(frequent[0], tokens), max(0, len(frequent[0]) - 1))
    hot = frequent[0][at] == tokens if len(frequent[0]) else np.zeros(n, dtype=bool)
    rare = tokens[~hot][:length]
    rest = length - len(rare)
    hot_tokens, ranks = tokens[hot], frequent[1][at[hot]] if len(frequent[0]) else at[:0]
    return rare, hot_tokens[np.argsort(ranks)[:rest]]


def frequent_tokens(docs: DataFrame, total: int, size: int) -> np.ndarray:
    """Tokens that several documents of a bounded sample share, with their rank: the more documents, the later.

    At most FREQUENT rows, so they may go to the driver and with the tasks.
    """
    every = max(1, total // SAMPLE)
    shards = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingle_sets(raw(piece.column("text")), size)
                tokens = np.sort(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
                start, length = run_lengths(starts_of(tokens))
                cuts = shard_cuts(tokens[start], shards)
                for shard, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        yield pa.RecordBatch.from_pydict(
                            {
                                "shard": pa.array([shard], type=pa.int32()),
                                "tokens": pa.array([tokens[start[lo:hi]].tobytes()], type=pa.binary()),
                                "counts": pa.array([length[lo:hi].astype(np.uint32).tobytes()], type=pa.binary()),
                            }
                        )

    def add(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in table.column("tokens").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in table.column("counts").to_pylist()])
        at = np.argsort(tokens)
        start, _ = run_lengths(starts_of(tokens[at]))
        total_ = np.add.reduceat(counts[at].astype(np.int64), start)
        often = total_ >= 3
        return pa.table({"token": pa.array(tokens[at][start][often].view(np.int64)), "n": pa.array(total_[often])})

    sample = docs.where(F.pmod(F.xxhash64("k2"), F.lit(every)) == 0).select("text")
    packed = mapped(sample, run, "shard int, tokens binary, counts binary")
    counted = packed.groupBy("shard").applyInArrow(add, "token long, n long")
    rows = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    ranks = np.arange(len(rows), 0, -1, dtype=np.uint64)
    at = np.argsort(tokens)
    return np.stack([tokens[at], ranks[at]]) if len(rows) else np.zeros((2, 0), dtype=np.uint64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Per document its number of shingles and the id of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingle_sets(raw(piece.column("text")), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(piece.column(c) for c in ("doc_id", "k1", "k2")),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([set_id(s) for s in sets], type=pa.int64()),
                    ],
                    ["doc_id", "k1", "k2", "n", "id"],
                )

    return mapped(docs.select("doc_id", "k1", "k2", "text"), run, "doc_id long, k1 long, k2 long, n long, id long")


def shared_tokens(docs: DataFrame, frequent: np.ndarray, size: int) -> DataFrame:
    """(token, set) for every prefix token that two sets have at least. Sets of one or two tokens link only with equals."""
    shards = partitions(docs.sparkSession)

    def pack(tokens: np.ndarray, ids: np.ndarray, known: bool) -> Iterator[pa.RecordBatch]:
        # A frequent token is known to be shared: its rows are dealt by set instead, so none gathers them.
        by = combine([ids.view(np.uint64)]) if known else tokens
        at = np.argsort(by)
        cuts = shard_cuts(by[at], shards)
        tokens, ids = tokens[at], ids[at]
        for shard, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if hi > lo:
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard], type=pa.int32()),
                        "known": pa.array([known]),
                        "tokens": pa.array([tokens[lo:hi].tobytes()], type=pa.binary()),
                        "ids": pa.array([ids[lo:hi].tobytes()], type=pa.binary()),
                    }
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, int]]] = [[], []]
        n = 0
        # Copies met since the last flush are left out here, so they never reach a shard by the thousands.
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            for known, rows in enumerate(held):
                if rows:
                    tokens = np.concatenate([t for t, _ in rows])
                    ids = np.repeat(np.array([i for _, i in rows], dtype=np.int64), [len(t) for t, _ in rows])
                    yield from pack(tokens, ids, bool(known))
                    rows.clear()
            seen.clear()

        for batch in batches:
            for piece in pieces(batch, "text"):
                for tokens in shingle_sets(raw(piece.column("text")), size):
                    own = set_id(tokens) if len(tokens) > 2 else None
                    if own is not None and own not in seen:
                        seen.add(own)
                        for part, rows in zip(prefix(tokens, frequent), held):
                            if len(part):
                                rows.append((part, own))
                                n += len(part)
            if n > FLUSH:
                yield from flush()
                n = 0
        yield from flush()

    def match(table: pa.Table) -> pa.Table:
        known = np.array(table.column("known").to_pylist(), dtype=bool)
        tokens = [np.frombuffer(b, dtype=np.uint64) for b in table.column("tokens").to_pylist()]
        ids = [np.frombuffer(b, dtype=np.int64) for b in table.column("ids").to_pylist()]
        flag = np.repeat(known, [len(t) for t in tokens])
        token, owner = np.concatenate(tokens), np.concatenate(ids)
        at = np.lexsort((owner, token))
        token, owner, flag = token[at], owner[at], flag[at]
        new = starts_of(token)
        new[1:] |= owner[1:] != owner[:-1]
        token, owner, flag = token[new], owner[new], flag[new]
        _, length = run_lengths(starts_of(token))
        keep = flag | (np.repeat(length, length) > 1)
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "id": pa.array(owner[keep])})

    packed = mapped(docs.select("text"), run, "shard int, known boolean, tokens binary, ids binary")
    return packed.groupBy("shard").applyInArrow(match, "token long, id long")


class Holders:
    """The sets of one group: the union of their tokens, and for each token of it who holds it."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        tokens = np.concatenate(sets)
        at = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[at]
        self.start, self.length = run_lengths(starts_of(tokens[at]))
        self.union = tokens[at][self.start]

    def overlaps(self, query: np.ndarray) -> np.ndarray | None:
        """The overlap of a query with each member; None if its overlap with the union rules all of them out."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if DENOMINATOR * len(at) < NUMERATOR * len(query):
            return None
        held = self.owner[expand(self.start[at], self.length[at])]
        return np.bincount(held, minlength=len(self.sizes))

    def linked(self, query: np.ndarray) -> np.ndarray:
        """The members that link with a query."""
        common = self.overlaps(query)
        if common is None:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(DENOMINATOR * common >= NUMERATOR * (len(query) + self.sizes - common))


def least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens the prefixes of two sets of `a` and `b` tokens have in common at least, if the sets link.

    Of the prefixes, one ends first in the order of tokens. What the sets share up to there both prefixes hold; past it lie only
    the tokens that its set has behind its prefix. Sets whose sizes are too far apart never link.
    """
    most = np.maximum(a, b)
    overlap = -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))
    behind = -(-NUMERATOR * most // DENOMINATOR) - 1
    return np.where(DENOMINATOR * np.minimum(a, b) < NUMERATOR * most, NEVER, overlap - behind)


def enough_shared(shared: Column, n: Column, low: Column, high: Column) -> Column:
    """Whether `shared` tokens are at least `least_shared` of `n` and some size from `low` to `high`. Without its rounding that
    falls from `n` on either way, so it is least at an end."""
    whole = NUMERATOR + DENOMINATOR

    def least(m: Column) -> Column:
        return NUMERATOR * DENOMINATOR * (n + m) - NUMERATOR * whole * F.greatest(n, m) + whole

    return DENOMINATOR * whole * shared >= F.least(least(low), least(high))


def near_members(matrix: DataFrame, assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """`id`, `g`: the sets that share enough tokens of the matrix with another of their group to link with it."""
    several = assigned.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("g")
    held = matrix.groupBy("id").agg(F.collect_list("token").alias("tokens")).join(sizes.select("id", "n"), "id")
    rows = assigned.join(several, "g").join(held, "id").select("g", "id", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            sizes_ = table.column("n").to_numpy()
            keep = np.zeros(len(sizes_), dtype=bool)
            if len(keep) > 1:
                tokens = table.column("tokens").combine_chunks()
                ends = np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False))[:-1]
                sets = np.split(tokens.flatten().to_numpy().view(np.uint64), ends)
                holders = Holders(sets)
                for i, own in enumerate(sets):
                    at = np.searchsorted(holders.union, own)
                    common = np.bincount(holders.owner[expand(holders.start[at], holders.length[at])], minlength=len(sets))
                    common[i] = 0
                    keep[i] = (common >= least_shared(sizes_[i], sizes_)).any()
            columns = [pa.array(table.column(c).to_numpy()[keep]) for c in ("id", "g")]
            yield pa.RecordBatch.from_arrays(columns, ["id", "g"])

    return mapped(rows.repartition("g").sortWithinPartitions("g"), run, "id long, g long")


def texts_of(ids: DataFrame, named: DataFrame, docs: DataFrame) -> DataFrame:
    """`id`, `n`, `text` of the sets asked for. Texts whose key is marked for none of them are left out before they are sent."""
    wanted = cut(named.join(ids.select("id").distinct(), "id", "left_semi"), "wanted")
    place = F.col("k1").bitwiseAND(F.lit(MARKS - 1))
    marked = wanted.groupBy(F.floor(place / BITMAP).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP))).alias("bits"))
    marks = np.zeros(MARKS // 8, dtype=np.uint8)
    for part, bits in marked.collect():
        marks[part * BITMAP // 8 : (part + 1) * BITMAP // 8] = np.frombuffer(bits, dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("k1").to_numpy() & (MARKS - 1)
            found = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(found.astype(bool)))

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "k1", "k2", "text")
    # Rows that are wholly equal are one from the start.
    keyed = mapped(rows, run, "d long, k1 long, k2 long, text string").groupBy("d", "k1", "k2").agg(F.first("text").alias("text"))
    return wanted.join(keyed, ["d", "k1", "k2"]).select("id", "n", "text")


def with_bitmaps(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                bits = pa.array([bitmap(s) for s in shingle_sets(raw(piece.column("text")), size)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*piece.columns, bits], ["id", "n", "text", "bits"])

    return mapped(texts, run, "id long, n long, text string, bits binary")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def inside_links(assigned: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links `a`-`b` between sets inside groups, as a forest: enough to join what links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "g"):
            names = table.column("id").to_pylist()
            sets = shingle_sets(raw(table.column("text").combine_chunks()), size)
            holders = Holders(sets)
            root = list(range(len(names)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            pairs = []
            for i, own in enumerate(sets):
                for j in holders.linked(own).tolist():
                    x, y = top(i), top(j)
                    if x != y:
                        root[x] = y
                        pairs.append((names[i], names[j]))
            yield _links(pairs)

    several = assigned.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("g")
    of_set = assigned.join(several, "g").groupBy("id").agg(F.collect_list("g").alias("all"))
    rows = texts.select("id", "text").join(of_set, "id").select("id", "text", F.explode("all").alias("g"))
    return mapped(rows.repartition("g").sortWithinPartitions("g"), run, "a long, b long")


def bitmap(tokens: np.ndarray) -> bytes:
    """A row of the token-group matrix: one bit per token at a place by its hash, eight places or more to a token.

    The number of places is a power of two; half as many follow by laying the upper half over the lower.
    """
    places = 64
    while places < 8 * len(tokens):
        places *= 2
    bits = np.zeros(places, dtype=bool)
    bits[(tokens & np.uint64(places - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of a matrix of 64-bit words, folded to `width` words."""
    while rows.shape[-1] > width:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] | rows[..., half:]
    return rows


class Matrix:
    """The bitmaps of a group's sets by their width, and the union of each width."""

    def __init__(self, bits: list[bytes], sizes: np.ndarray, comps: np.ndarray) -> None:
        widths = np.array([len(b) // 8 for b in bits])
        self.parts = []
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            rows = np.frombuffer(b"".join(bits[i] for i in at), dtype=np.uint64).reshape(len(at), width)
            self.parts.append((at, rows, np.bitwise_or.reduce(rows, axis=0), sizes[at], comps[at]))

    def qualifying(self, bits: bytes, size: int, comp: int) -> np.ndarray:
        """The members of other components that may link with a query: a token whose place is empty on the other side is not shared."""
        query = np.frombuffer(bits, dtype=np.uint64)
        found = []
        for at, rows, union, sizes, comps in self.parts:
            width = min(rows.shape[1], len(query))
            own = folded(query, width)
            most = size - int(np.bitwise_count(own & ~folded(union, width)).sum())
            if DENOMINATOR * most < NUMERATOR * size:
                continue
            theirs = folded(rows, width)
            most = size - np.bitwise_count(own & ~theirs).sum(axis=1).astype(np.int64)
            most = np.minimum(most, sizes - np.bitwise_count(theirs & ~own).sum(axis=1).astype(np.int64))
            found.append(at[(comps != comp) & (DENOMINATOR * most >= NUMERATOR * (size + sizes - most))])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def qualifying(opens: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """`g`, `id`, `comp`, `role`: of the groups asked for, the queries (role 1) and members (role 0) that may link."""
    dealt = _dealt(opens, members, rows).select("slot", "g", "role", "id", "comp", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "slot"):
            g, ids, comps, role, sizes = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "id", "comp", "role", "n"))
            bits = table.column("bits").to_pylist()
            n = int((role == 0).sum())
            keep = np.zeros(len(role), dtype=bool)
            if 0 < n < len(role):
                matrix = Matrix(bits[:n], sizes[:n], comps[:n])
                for i in range(n, len(role)):
                    found = matrix.qualifying(bits[i], int(sizes[i]), int(comps[i]))
                    keep[found] = True
                    keep[i] = len(found) > 0
            columns = [pa.array(x[keep]) for x in (g, ids, comps, role)]
            yield pa.RecordBatch.from_arrays(columns, ["g", "id", "comp", "role"])

    found = mapped(dealt.repartition("slot").sortWithinPartitions("slot", "role"), run, "g long, id long, comp long, role long")
    return found.distinct()


def _dealt(opens: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """Members (role 0) and queries (role 1) of each group, with their `rows`, by slot: a group with very many queries has several."""
    busy = opens.groupBy("g").agg(F.count(F.lit(1)).alias("queries")).withColumn("copies", F.ceil(F.col("queries") / QUERIES).cast("int"))
    held = members.join(busy, "g").select(
        "id", "comp", F.lit(0).alias("role"), "g", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    )
    asked = opens.join(busy, "g").select(
        F.col("q").alias("id"), F.col("q_comp").alias("comp"), F.lit(1).alias("role"), "g", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int").alias("salt")
    )
    return held.union(asked).join(rows, "id").withColumn("slot", F.xxhash64("g", "salt"))


def opened_links(opens: DataFrame, members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links `a`-`b` between components: each query (`q`, `q_comp`) against the members of the groups `g` it may open."""
    rows = _dealt(opens, members, texts.select("id", "text")).select("slot", "role", "comp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "slot"):
            role = np.array(table.column("role").to_pylist())
            comps = table.column("comp").to_pylist()
            texts_ = raw(table.column("text").combine_chunks())
            n = int((role == 0).sum())
            pairs = set()
            if 0 < n < len(role):
                holders = Holders(shingle_sets(texts_[:n], size))
                for lo in range(n, len(role), 64):
                    for i, own in enumerate(shingle_sets(texts_[lo : lo + 64], size), lo):
                        pairs.update((comps[i], comps[j]) for j in holders.linked(own).tolist() if comps[i] != comps[j])
            yield _links(sorted(pairs))

    return mapped(rows.repartition("slot").sortWithinPartitions("slot", "role"), run, "a long, b long")


def _grouped(matrix: DataFrame, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """`id`, `g`: sets that share the smallest hash of their shared tokens, in groups of about GROUP; with `sizes`, of about one size."""
    key = matrix.groupBy("id").agg(F.min(F.xxhash64(F.lit(seed), F.col("token"))).alias("key"))
    if sizes is not None:
        step = F.floor(F.log2("n") * STEPS)
        key = key.join(sizes.select("id", "n"), "id").select("id", F.xxhash64("key", step).alias("key"))
    many = key.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.ceil(F.col("n") / GROUP))
    return key.join(many, "key").select("id", F.xxhash64(F.lit(seed), F.col("key"), salt).alias("g"))


def classes(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Each row by its id and its text's `content_key`: those with shingles as `doc_id`, `k1`, `k2`, `n`, `comp` (what they are
    joined to), and those without as `doc_id`, `k1`, `k2`, `n`."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.select("*", *content_key(F.col("text")))
    signed = cut(signatures(own, size), "sets")
    frequent = frequent_tokens(own, signed.count(), size)
    matrix = cut(shared_tokens(own, frequent, size), "matrix")

    # One text per set that shares a token, found by a key that copies of a text do not share.
    chosen = signed.where("n > 2").groupBy("id").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "k1", "k2")).alias("c"), F.first("n").alias("n")
    )
    named = cut(matrix.select("id").distinct().join(chosen, "id").select("id", "n", "c.*"), "named")

    # The groups to be queried hold sets of about one size, so that few tokens are known to be too few for all of them.
    partition_a, partition_b = (cut(_grouped(matrix, seed, sizes), "groups") for seed, sizes in ((1, named), (2, None)))
    near = cut(near_members(matrix, partition_a.union(partition_b), named), "near")
    first = cut(inside_links(near, cut(texts_of(near, named, own), "texts"), size), "links")
    joined = components(first, "links").withColumnRenamed("node", "id")
    info = named.join(joined, "id", "left").select("id", "n", F.coalesce("component", "id").alias("comp"))
    weight = info.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    info = cut(info.join(weight, "comp").join(partition_a, "id").select("id", "n", "comp", "weight", "g"), "info")

    # Tokens whose holders are all in one component have nothing to ask: they go first, while rows are slim.
    placed = cut(matrix.join(info.select("id", "comp"), "id"), "placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    rows = cut(placed.join(mixed, "token").select("token", "id").join(info, "id"), "tokens")
    rank = F.struct("weight", "comp")
    held = rows.groupBy("token", "g").agg(F.max(rank).alias("top"), F.min("n").alias("low"), F.max("n").alias("high"))
    asking = rows.select("token", F.col("id").alias("q"), F.col("comp").alias("q_comp"), F.col("n").alias("q_n"), rank.alias("q_rank"))
    fits = (NUMERATOR * F.col("q_n") <= DENOMINATOR * F.col("high")) & (NUMERATOR * F.col("low") <= DENOMINATOR * F.col("q_n"))
    met = asking.join(held, "token").where((F.col("q_rank") < F.col("top")) & fits).groupBy("q", "q_comp", "q_n", "g").agg(
        F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    enough = enough_shared(F.col("shared"), F.col("q_n"), F.col("low"), F.col("high"))
    opens = cut(met.where(enough).select("q", "q_comp", "g"), "opens")
    members = info.select("g", "id", "comp").join(opens.select("g").distinct(), "g", "left_semi")
    texts = cut(with_bitmaps(texts_of(members.select("id").union(opens.select("q")), named, own), size), "texts")
    open_ = cut(qualifying(opens, members, texts.select("id", "n", "bits")), "open")
    asking = open_.where("role = 1").select(F.col("id").alias("q"), F.col("comp").alias("q_comp"), "g")
    more = cut(opened_links(asking, open_.where("role = 0").select("g", "id", "comp"), texts, size), "links")
    merged = components(more, "links").withColumnRenamed("node", "comp")

    comps = info.join(merged, "comp", "left").select("id", F.coalesce("component", "comp").alias("comp"))
    linked = signed.where("n > 0").join(comps, "id", "left").select("doc_id", "k1", "k2", "n", F.coalesce("comp", "id").alias("comp"))
    return linked, signed.where("n = 0").select("doc_id", "k1", "k2", "n")


def join(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per document: `doc_id`, `n_shingles`, `component_id`."""
    linked, alone = classes(docs, size)
    low = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(low, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.union(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
