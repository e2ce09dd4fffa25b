"""Clustering and whitening beside exact and independent versions, on edge cases and whole small tables."""

from __future__ import annotations

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millpond.llm import clusters, queries, whitening
from millpond.llm.common import prepare

FOLDER = "/root/testdata/sf0.001"


def frame(spark, rows):
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return df.withColumns({"x": F.lit(1), "cluster": F.lit("c"), "i": F.lit(2.0), "n": F.lit(3), "component": F.lit(4)})


def vectors(n, size=64, seed=1, scale=0.2):
    rng = random.Random(seed)
    return [[rng.gauss(0, scale) for _ in range(size)] for _ in range(n)]


GOOD = vectors(40)
EDGES = [
    *enumerate(GOOD), (3, GOOD[3]), (3, GOOD[3]), (None, GOOD[5]), (None, GOOD[6]), (100, None), (101, []), (102, [None] * 64),
    (103, [*GOOD[1][:-1], math.nan]), (104, [*GOOD[1][:-1], math.inf]), (105, [*GOOD[1][:-1], None]), (106, [0.0] * 64), (107, [0.0] * 64),
    (108, [-0.5] * 64), *((200 + i, [0.25] * 64) for i in range(30)),
]
CLUSTERS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def clustered(df, **options):
    return sorted((tuple(r) for r in clusters.cluster(df, **options).select(*CLUSTERS).collect()), key=str)


@pytest.mark.parametrize("rows", [EDGES, EDGES[:5], [(1, None)], [], [(i, [0.1] * 64) for i in range(20)]])
def test_clusters(spark, rows):
    assert clustered(frame(spark, rows)) == sorted(brute.clusters(rows), key=str)


def test_clusters_of_the_table(spark):
    rows = [tuple(r) for r in prepare(spark).read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((tuple(r) for r in queries.op11_clusters(spark, FOLDER).collect()), key=str)
    assert got == sorted(brute.clusters(rows), key=str) and len(got) == len(rows)


def test_clusters_of_other_shapes(spark):
    rows = [(i, [math.floor(8 * c) / 8 for c in v]) for i, v in enumerate(vectors(200, size=3, scale=0.6))]
    for k in (1, 7, 90):
        assert clustered(frame(spark, rows), k=k, rounds=2, size=3, scale=8) == sorted(brute.clusters(rows, k, 2, 3, 8), key=str)


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(frame(spark, [(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("leaf", [2, 3, 5])
def test_tree_finds_the_smallest_of_equally_near(monkeypatch, leaf):
    monkeypatch.setattr(clusters, "LEAF", leaf)
    rng = np.random.default_rng(4)
    for k, size, reach in ((1, 2, 3), (2, 1, 1), (40, 2, 4), (100, 5, 2), (60, 64, 50), (16, 3, 1 << 24)):
        points = rng.integers(-reach, reach + 1, (k, size))
        x = np.concatenate([rng.integers(-reach, reach + 1, (300, size)), points])
        label, square = clusters.vantage_tree(points).nearest(x)
        every = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (label == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()


def test_search_opens_few_nodes():
    rng = np.random.default_rng(5)
    centres = rng.integers(-10_000, 10_000, (256, 4))
    tree = clusters.vantage_tree(centres)
    opened = 0

    class Counted(np.ndarray):
        def argmin(self, *args, **kwargs):
            nonlocal opened
            opened += len(self)
            return super().argmin(*args, **kwargs)

    x = centres[rng.integers(0, 256, 500)] + rng.integers(-5, 6, (500, 4))
    full = np.full
    clusters.np.full = lambda *a, **b: full(*a, **b).view(Counted)
    try:
        tree.nearest(x)
    finally:
        clusters.np.full = full
    assert opened / 500 < len(tree.vantage) / 4


def exact_covariance(kept):
    n, x = len(kept), np.array(kept, dtype=object)
    sums = x.sum(axis=0).tolist()
    return sums, np.array([[(n * p - a * b) / (n * n) for p, b in zip(row, sums)] for row, a in zip((x.T @ x).tolist(), sums)])


def whitened(df, **options):
    out = {}
    for r in whitening.whiten(df, **options).collect():
        out.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return out


def check_whitening(rows, got, size, wanted=8):
    kept = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    sums, v = exact_covariance([x for _, x in kept])
    n = len(kept)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:wanted], axes.T[::-1][:wanted]
    assert set(got) == {i for i, _ in kept}
    assert sum(len(rs) for per in got.values() for rs in per.values()) == n * min(wanted, size)
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in kept])
    want = centred @ axes.T / np.sqrt(values)
    # An eigenvector may have either sign, the same for all rows.
    for k in range(len(values)):
        at = int(np.abs(want[:, k]).argmax())
        near = min(got[kept[at][0]][k + 1], key=lambda r: abs(abs(r.whitened) - abs(want[at, k])))
        want[:, k] *= np.sign(want[at, k]) * np.sign(near.whitened)
    for (i, x), row in zip(kept, want):
        for k, w in enumerate(row):
            found = got[i][k + 1]
            assert any(math.isclose(r.whitened, w, rel_tol=1e-7, abs_tol=1e-7) for r in found)
            for r in found:
                assert r.n == n and math.isclose(r.explained, values[k] / v.trace(), rel_tol=1e-9) and r.identity_error < 1e-9
            assert any(int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x, sums)) for r in found)


def test_whitening(spark):
    rows = [(i, v) for i, v in EDGES if i is not None and i not in (3, 106, 107) and i < 200]
    check_whitening(rows, whitened(frame(spark, rows)), 64)


def test_whitening_of_few_dimensions(spark):
    rows = [*enumerate(vectors(60, size=5, scale=3.0)), (90, [1e3, -1e3, 2.0, 3.0, 400.0]), (91, [1.0]), (92, [0.5] * 7), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    check_whitening(rows, whitened(frame(spark, rows)), 5)
    check_whitening(rows, whitened(frame(spark, rows), components=2), 5, 2)


def test_whitening_of_the_table(spark):
    rows = [tuple(r) for r in prepare(spark).read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").limit(150).collect()]
    check_whitening(rows, whitened(frame(spark, rows)), 64)
    assert queries.op12_whitening(spark, FOLDER).count() == 8 * prepare(spark).read.parquet(f"{FOLDER}/embeddings.parquet").count()


def test_whitening_without_spread(spark):
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    rows = whitening.whiten(frame(spark, [(1, [0.5] * 4)])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in rows] == [(0.0, 0.0, 0, 1.0)] * 4
    line = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 2.0]), (2, [2.0, 3.0])])).collect()
    assert [round(abs(r.whitened), 9) for r in line if r.component == 2] == [0.0] * 3 and line[0].identity_error == 1.0


def test_large_sums_stay_exact(spark):
    rows = [(i, [(-1) ** i * 3e12 + i, 1e-3 * i * i]) for i in range(30)]
    kept = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums, _ = exact_covariance(kept)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: sum((30 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in enumerate(kept)}


def test_inertia_counts():
    rng = np.random.default_rng(6)
    for size in (1, 2, 3, 10, 40):
        a = rng.standard_normal((size, size))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
            assert whitening.positive_pivots(a - shift * np.eye(size)) == (values > shift).sum()
    # No pivot of one on the diagonal, and no pivot at all.
    assert whitening.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.positive_pivots(np.zeros((3, 3))) == 0


@pytest.mark.parametrize("values", [[9, 4, 1, 0.5], [5, 5, 5, 1], [1, 1 - 1e-9, 1 - 2e-9, 0], [1e12, 1, 1e-3, 0], [3, 3, 3, 3], [2, 1, 1, 1]])
def test_leading_pairs(values):
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((4, 4)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found, axes = whitening.leading(v, 3)
    size = max(values)
    assert np.allclose(found, sorted(values)[::-1][:3], rtol=0, atol=1e-13 * size)
    assert np.abs(axes @ axes.T - np.eye(3)).max() < 1e-5 and np.abs(axes @ v - found[:, None] * axes).max() < 1e-13 * size
