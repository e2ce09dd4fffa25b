"""Embedding whitening (operator 12): leading principal components by spectrum slicing, unit variance along each.

1. Entries become integers, floor(`SCALE` * c) + `SHIFT`, written once. Spark adds them up per dimension.
2. The covariance is exact before its one rounding: each task centres its vectors by the whole part of the mean and adds up their
   integer products (as floating point only while every sum is an exact integer); tasks' sums meet in Spark, one row per task and
   pair of dimensions, and the fractions of the mean are taken off in integers. What reaches the driver is one number per pair of
   dimensions, whatever the number of vectors.
3. Spectrum slicing of that matrix: an LDLᵀ factorisation of V - s I with complete pivoting has as many positive pivots as V has
   eigenvalues above s (Sylvester). Bisection on such counts isolates the j-th largest eigenvalue; Rayleigh quotient iteration, started
   by inverse iteration from the middle of the interval, converges cubically; two more counts, one on each side of
   the result, certify its number. An iteration that leaves its interval is begun again from a smaller one. Eigenvalues that no count
   can part any more are equal in double precision and get an orthonormal basis by inverse iteration of a block.
4. The vectors, centred, are projected and scaled. A pass before that adds up the covariance of what will be returned, for
   `identity_error`.

Repeated rows count as often as they come, in the fit and in the result; null ids are returned as null. An empty table gives no rows.
A vector without entries is left out, and so is one whose length is not the most frequent (of equally frequent ones the longest): no covariance
joins it with the rest. A component without spread (its eigenvalue is zero in double precision, as all are for a single vector)
whitens to 0, which `identity_error` shows as 1. Integers or products beyond a long or 38 digits raise an error. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
# The pivot threshold of Bunch and Parlett.
ALPHA = (1 + 17**0.5) / 8


def positive_pivots(a: np.ndarray) -> int:
    """The number of positive eigenvalues of a symmetric matrix: those of D in its LDLᵀ factorisation, with pivots of one or two."""
    b = a.copy()
    positive = 0
    while len(b):
        size = np.abs(b)
        diagonal = size.diagonal().copy()
        np.fill_diagonal(size, 0.0)
        p = int(diagonal.argmax())
        r, s = sorted(divmod(int(size.argmax()), len(b)))
        if not max(diagonal[p], size[r, s]):
            break
        if diagonal[p] >= ALPHA * size[r, s]:
            order = [p, *(i for i in range(len(b)) if i != p)]
            b = b[np.ix_(order, order)]
            positive += bool(b[0, 0] > 0)
            b = b[1:, 1:] - np.outer(b[1:, 0], b[1:, 0] / b[0, 0])
        else:
            # A pivot of two has a negative determinant: one eigenvalue on each side.
            order = [r, s, *(i for i in range(len(b)) if i not in (r, s))]
            b = b[np.ix_(order, order)]
            positive += 1
            b = b[2:, 2:] - b[2:, :2] @ np.linalg.inv(b[:2, :2]) @ b[:2, 2:]
    return positive


class Slicer:
    """The largest eigenvalues of a symmetric matrix, one interval at a time."""

    def __init__(self, v: np.ndarray) -> None:
        self.v = v
        radius = np.abs(v).sum(axis=1) - np.abs(v.diagonal())
        self.size = float(np.abs(v).sum(axis=1).max())
        self.least = 8 * len(v) * EPS * self.size
        low, high = float((v.diagonal() - radius).min()), float((v.diagonal() + radius).max())
        # Every shift that was counted, with the eigenvalues above it.
        self.counts = {low - self.least - EPS: len(v), high + self.least + EPS: 0}
        self.found: list[tuple[float, np.ndarray]] = []

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.v - shift * np.eye(len(self.v)))
        return self.counts[shift]

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, EPS * self.size, 4 * EPS * self.size):
            try:
                z = np.linalg.solve(self.v - (shift + nudge) * np.eye(len(self.v)), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(z).all():
                return z
        return x

    def begin(self, columns: int) -> np.ndarray:
        """Fixed vectors, at right angles to what is found."""
        x = np.random.default_rng(len(self.found)).standard_normal((len(self.v), columns))
        for _, vector in self.found:
            x -= np.outer(vector, vector @ x)
        return x

    def iterate(self, low: float, high: float) -> tuple[float, np.ndarray, float]:
        """Rayleigh quotient iteration from the middle of an interval: value, unit vector and residual."""
        x = self.begin(1)[:, 0]
        for _ in range(2):
            x = self.solve((low + high) / 2, x / np.linalg.norm(x))
        x /= np.linalg.norm(x)
        best = (0.0, x, np.inf)
        for _ in range(12):
            value = float(x @ self.v @ x)
            residual = float(np.linalg.norm(self.v @ x - value * x))
            if residual >= best[2]:
                break
            best = (value, x, residual)
            x = self.solve(value, x)
            x /= np.linalg.norm(x)
        return best

    def next(self) -> None:
        """Add the largest eigenvalue that is not found yet, or all that equal it in double precision."""
        j = len(self.found) + 1
        while True:
            low = max(s for s, n in self.counts.items() if n >= j)
            high = min(s for s, n in self.counts.items() if n < j)
            inside = self.above(low) - self.above(high)
            if high - low <= self.least:
                break
            if inside == 1:
                value, x, residual = self.iterate(low, high)
                margin = max(2 * residual, self.least / 4)
                # The counts on both sides say that this is number j and no other.
                if low <= value <= high and residual <= self.least and self.above(value - margin) == j and self.above(value + margin) == j - 1:
                    self.found.append((value, x))
                    return
            middle = (low + high) / 2
            if not low < middle < high:
                break
            self.above(middle)
        block = self.begin(inside)
        for _ in range(4):
            block = np.linalg.qr(self.solve((low + high) / 2, block))[0]
            for _, vector in self.found:
                block -= np.outer(vector, vector @ block)
        block = np.linalg.qr(block)[0]
        # The counts already taken stay valid: they lie outside the interval or on its ends.
        self.found += [(float(x @ self.v @ x), x) for x in block.T]


def leading(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    wanted = min(wanted, len(v))
    if not np.abs(v).max(initial=0.0):
        return np.zeros(wanted), np.eye(len(v))[:wanted]
    slicer = Slicer(v)
    while len(slicer.found) < wanted:
        slicer.next()
    return np.array([e for e, _ in slicer.found[:wanted]]), np.array([x for _, x in slicer.found[:wanted]])


def integers(embeddings: DataFrame) -> DataFrame:
    """`vec_id`, `x`: the vectors of the most frequent length without null or non-finite entries, as integers."""
    own = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    whole = F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    kept = own.where(F.col("c").isNotNull() & (F.size("c") > 0)).where(whole)
    fits = F.lit(float(1 << 60))

    def exact(v):
        big = F.abs(v * SCALE) > fits
        return F.when(big, F.raise_error(F.lit("an entry is too large for a long"))).otherwise(F.floor(v * SCALE) + SHIFT)

    return kept.select("vec_id", F.transform("c", exact).cast("array<bigint>").alias("x"))


def matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def products(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact sums of products of an integer matrix's columns, and a bound of their size."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < 1 << 53:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64), most
    z = y.astype(object)
    return z.T @ z, most


def pairs(total: np.ndarray) -> pa.RecordBatch:
    """The lower half of a matrix of integers, one row per entry."""
    i, j = np.tril_indices(len(total))
    values = [Decimal(int(v)) for v in total[i, j]]
    return pa.RecordBatch.from_pydict(
        {"i": pa.array(i, type=pa.int32()), "j": pa.array(j, type=pa.int32()), "v": pa.array(values, type=pa.decimal128(38, 0))}
    )


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor `n`), each entry the double nearest to its exact value."""
    size = len(sums)
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, bound = np.zeros((size, size), dtype=object), np.zeros((size, size), dtype=np.int64), 0
        for batch in batches:
            own, most = products(matrix(batch, size) - centre)
            if own.dtype == object:
                total += own
                continue
            if bound + most >= 1 << 62:
                total, held, bound = total + held, np.zeros_like(held), 0
            held, bound = held + own, bound + most
        yield pairs(total + held)

    rows = mapped(vectors.select("x"), run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    rest = [s % n for s in sums]
    v = np.zeros((size, size))
    for i, j, value in rows:
        v[i, j] = v[j, i] = (n * int(value) - rest[i] * rest[j]) / (n * n)
    return v


def projector(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n / n for s in sums])
    spread = values > len(sums) * EPS * max(values.max(initial=0.0), 0.0)
    scale = np.where(spread, 1 / np.sqrt(np.where(spread, values, 1.0)), 0.0)
    onto = vectors.T * scale
    return lambda x: ((x - centre) - rest) @ onto


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows per vector and component: `vec_id`, `component`, `n`, `deviation` (decimal), `whitened`, `explained`, `identity_error`."""
    vectors = cut(integers(embeddings), "vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    usual = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not usual:
        return embeddings.sparkSession.createDataFrame([], schema)
    size, n = usual[0]
    vectors = vectors.where(F.size("x") == size)
    exact = F.sum(F.col("v").cast("decimal(38,0)"))
    total = vectors.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(exact.alias("s")).collect()
    sums = [int(s) for _, s in sorted(total)]
    v = covariance(vectors, n, sums)
    values, axes = leading(v, components)
    project = projector(n, sums, values, axes)
    count = len(values)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = project(matrix(batch, size))
            first += w.sum(axis=0)
            second += w.T @ w
        i, j = np.indices((count + 1, count)).reshape(2, -1)
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(i, type=pa.int32()), "j": pa.array(j, type=pa.int32()), "v": pa.array(np.vstack([second, first]).ravel())}
        )

    moments = np.zeros((count + 1, count))
    for i, j, value in mapped(vectors.select("x"), spread, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        moments[i, j] = value / n
    error = float(np.abs(moments[:count] - np.outer(moments[count], moments[count]) - np.eye(count)).max())
    explained = values / v.trace() if v.trace() > 0 else np.zeros(count)
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, size)
            rows = len(x)
            if not rows:
                continue
            y = x - centre
            # Sum of (n * y - rest) squared, by exact sums; as longs only while they fit.
            small = size * (int(np.abs(y).max()) + 1) * max(n, int(np.abs(y).max())) < 1 << 62
            z, r = (y, rest.astype(np.int64)) if small else (y.astype(object), rest)
            square, cross = (z * z).sum(axis=1).tolist(), (z @ r).tolist()
            own = int((rest * rest).sum())
            deviation = [Decimal(n * n * a - 2 * n * b + own) for a, b in zip(square, cross)]
            every = np.repeat(np.arange(rows), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, count + 1), rows), type=pa.int32()),
                    pa.array(np.full(len(every), n), type=pa.int64()),
                    pa.array(deviation, type=pa.decimal128(38, 0)).take(pa.array(every)),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(len(every), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return mapped(vectors.select("vec_id", "x"), run, schema)
