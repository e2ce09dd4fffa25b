"""Centroid clustering (operator 11): integer k-means whose assignment searches a vantage-point tree over the centroids.

1. Vectors of the wanted length without null or non-finite components become integers, floor(`scale` * x), written once.
2. The start centroids are the `k` vectors whose ids have the smallest salted hashes: a top-k, the only rows that reach the driver.
3. Each round builds a vantage-point tree over the centroids and broadcasts it; its size is `k` times the vector length, whatever the
   data. A node splits its centroids by their distance from one of them, the vantage point, into a near and a far half and
   keeps the range of distances of each half; a node of up to LEAF centroids is a leaf.
4. Each vector searches best-first: of all nodes seen and not opened it opens the one with the smallest lower bound (from the triangle
   inequality), until that bound is beyond the best distance found. The radius is inclusive: a node whose bound equals the best
   distance is opened too, since it may hold an equally near centroid with a smaller number. Bounds are floating point, made smaller
   by more than their rounding error; distances at vantage points and leaves are exact integers. All vectors of a batch take
   their steps side by side, each with its own queue.
5. A task adds up its own vectors per centroid, so one row per task, centroid and component is shuffled, however many vectors are equal.
   New centroids are exact floors of sum / count.

Repeated rows are vectors of their own; equal distances go to the smaller number; a null id counts as the empty text when start vectors
are chosen and is returned as null; of equal hashes the smaller vector comes first. With fewer than `k` vectors there are fewer centroids,
with none the result is empty. Components beyond `LIMIT` in size have squared distances that no long holds: they raise an error. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import cut, mapped

SIZE = 64
SCALE = 64
K = 16
ROUNDS = 3
SALT = "1:"
# At least 2, so that a node that is split has something for both halves.
LEAF = 2
# The squared distance of two vectors of 2,000 such components still fits a long.
LIMIT = 1 << 25
# More than the rounding error of a bound, as a share of the distances it is made of.
SLACK = 1e-12


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree. Node 0 is the root. `vantage` is a node's centroid, -1 in a leaf; `child` its near and far half;
    `low` and `high` the range of distances from the vantage point to each half; `members` a leaf's centroids, padded by -1."""

    points: np.ndarray
    vantage: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    members: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (of equally near ones the smallest number), and the squared distance."""
        rows = len(x)
        best = np.full(rows, np.iinfo(np.int64).max)
        label = np.full(rows, len(self.points))
        # The queue of each row: the lower bound of every node that is seen and not yet opened.
        queue = np.full((rows, len(self.vantage)), np.inf)
        queue[:, 0] = 0.0
        active = np.arange(rows)

        def look(who: np.ndarray, centroid: np.ndarray) -> np.ndarray:
            apart = x[who] - self.points[centroid]
            square = np.einsum("ij,ij->i", apart, apart)
            nearer = (square < best[who]) | ((square == best[who]) & (centroid < label[who]))
            best[who[nearer]], label[who[nearer]] = square[nearer], centroid[nearer]
            return square

        while len(active):
            node = queue[active].argmin(axis=1)
            bound = queue[active, node]
            going = bound <= np.sqrt(best[active].astype(float)) * (1 + SLACK)
            active, node, bound = active[going], node[going], bound[going]
            queue[active, node] = np.inf
            leaf = self.vantage[node] < 0
            for column in self.members.T:
                held = leaf & (column[node] >= 0)
                look(active[held], column[node[held]])
            who, inner, bound = active[~leaf], node[~leaf], bound[~leaf]
            away = np.sqrt(look(who, self.vantage[inner]).astype(float))
            for half in range(2):
                low, high = self.low[inner, half], self.high[inner, half]
                outside = np.maximum(low - away, away - high) - SLACK * (away + high)
                queue[who, self.child[inner, half]] = np.maximum(bound, outside)
        return label, best


def vantage_tree(points: np.ndarray) -> Tree:
    """The tree over the rows of an integer matrix. Halves are cut by rank, so equal points make no node empty."""
    nodes: list[tuple] = []

    def distances(origin: int, others: np.ndarray) -> np.ndarray:
        apart = points[others] - points[origin]
        return np.einsum("ij,ij->i", apart, apart)

    def grow(own: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(())
        if len(own) <= LEAF:
            nodes[at] = (-1, (0, 0), (0.0, 0.0), (0.0, 0.0), own)
            return at
        # A point at the edge of the others tells them apart best.
        origin = own[np.argmax(distances(own[0], own))]
        rest = own[own != origin]
        away = distances(origin, rest)
        order = np.lexsort((rest, away))
        halves = [h for h in np.array_split(order, 2)]
        far = [np.sqrt(away[h].astype(float)) for h in halves]
        children = tuple(grow(np.sort(rest[h])) for h in halves)
        nodes[at] = (origin, children, tuple(f.min() for f in far), tuple(f.max() for f in far), own[:0])
        return at

    grow(np.arange(len(points)))
    members = np.full((len(nodes), LEAF), -1)
    for i, node in enumerate(nodes):
        members[i, : len(node[4])] = node[4]
    vantage, child, low, high = (np.array([node[k] for node in nodes]) for k in range(4))
    return Tree(points, vantage, child, low, high, members)


def integers(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """`vec_id`, `x`: the vectors that are kept, as integers."""
    own = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    # NaN is larger than infinity.
    whole = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    kept = own.where(F.col("x").isNotNull() & (F.size("x") == size)).where(whole)

    def exact(v):
        y = F.floor(v * scale)
        return F.when(F.abs(v * scale) <= LIMIT, y).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))

    return kept.select("vec_id", F.transform("x", exact).cast("array<bigint>").alias("x"))


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def start(vectors: DataFrame, k: int) -> np.ndarray:
    """The `k` vectors whose salted ids have the smallest hashes, in that order."""
    salted = F.concat(F.lit(SALT), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    chosen = vectors.select(F.sha2(salted.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in chosen], dtype=np.int64)


def means(vectors: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; a centroid without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(vantage_tree(points))
    k, size = points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x = matrix(batch, size)
            label, _ = shared.value.nearest(x)
            np.add.at(sums, label, x)
            counts += np.bincount(label, minlength=k)
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.RecordBatch.from_pydict(
                {
                    "cluster": pa.array(held, type=pa.int32()),
                    "n": pa.array(counts[held]),
                    "sums": pa.array(list(sums[held]), type=pa.list_(pa.int64())),
                }
            )

    parts = mapped(vectors.select("x"), run, "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    new = points.copy()
    for r in totals.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new[r.cluster, r.i] = int(r.s) // r.n
    shared.unpersist()
    return new


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: `vec_id`, `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid_sha256`."""
    spark = embeddings.sparkSession
    vectors = cut(integers(embeddings, size, scale), "vectors")
    points = start(vectors, k)
    if not len(points):
        points = np.zeros((0, size), dtype=np.int64)
    for _ in range(rounds if len(points) else 0):
        points = means(vectors, points)
    shared = spark.sparkContext.broadcast(vantage_tree(points) if len(points) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label, square = shared.value.nearest(matrix(batch, size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(label, type=pa.int32()), pa.array(square)], ["vec_id", "cluster", "distance"]
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    assigned = cut(mapped(vectors, run, f"vec_id {kind}, cluster int, distance long"), "assigned")
    # One row per centroid: at most `k`.
    spread = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [
        Row(cluster=c, cluster_inertia=s, inertia=sum(spread.values()), centroid_sha256=hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest())
        for c, s in spread.items()
    ]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
