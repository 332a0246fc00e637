import random

import numpy as np
import pytest

from graphloom.operators import knn


def table(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "id bigint, vector array<float>, label int").repartition(partitions)


def nearest(rows, k, every):
    """Each asked id against all others, one by one."""
    kept = {}
    for i, v, _ in rows:
        if i is not None and v and not any(x is None or np.isnan(x) for x in v):
            kept[i] = min(kept.get(i, v), v)
    points = {i: np.array(v, np.float32).astype(float) for i, v in kept.items()}
    out = {}
    for i, p in points.items():
        if i % every == 0:
            found = sorted((float(((q - p) ** 2).sum()), j) for j, q in points.items() if j != i)[:k]
            out |= {(i, r + 1): (j, d**0.5) for r, (d, j) in enumerate(found)}
    return out


def vectors(seed, n=400, width=8):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(k % 5, 0.3) for _ in range(width)], 1) for k in range(n)]
    rows += [(n + k, rows[k][1], 1) for k in range(0, 60, 2)]  # ties
    return rows + [(2000 + k, rows[50][1], 1) for k in range(120)]  # a hot place


@pytest.mark.parametrize("seed,k,sample", [(1, 5, 20_000), (2, 1, 7), (3, 30, 100)])
def test_neighbours_are_exact(spark, monkeypatch, seed, k, sample):
    monkeypatch.setattr(knn, "ROWS", 16)
    monkeypatch.setattr(knn, "QUERIES", 4)
    rows = vectors(seed) + [(None, [0.0] * 8, 1), (7000, None, 1), (7050, [1.0] * 7 + [None], 1), (50, [9.0] * 8, 1), (50, rows_at(seed), 1)]
    got = knn.knn_edges(table(spark, rows), k, 50, sample).collect()
    want = nearest(rows, k, 50)
    assert len(got) == len(want)
    for r in got:
        dst, distance = want[r.src, r.rank]
        assert r.dst == dst and abs(r.distance - distance) < 1e-9


def rows_at(seed):
    return vectors(seed)[50][1]


def test_centres_do_not_change_the_result(spark, monkeypatch):
    rows = vectors(4)
    want = {tuple(r) for r in knn.knn_edges(table(spark, rows), 5).collect()}
    monkeypatch.setattr(knn, "CELLS", 1)
    assert {tuple(r) for r in knn.knn_edges(table(spark, rows), 5).collect()} == want


def test_cells_far_away_are_passed_over():
    """In well parted clusters the bound leaves out the cells of the others."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(20 * c, 0.5, (100, 4)) for c in range(5)])
    centres = knn.fit_centres(points, 20)
    far = knn._distances(points, centres)
    cell, radius = far.argmin(axis=1), np.zeros(20)
    np.maximum.at(radius, cell, far.min(axis=1))
    counts = np.bincount(cell, minlength=20)
    first = knn._first_cells(far[0], counts, 5)
    bound = np.sort(np.linalg.norm(points[first[cell]] - points[0], axis=1))[5]
    searched = first | (far[0] - radius <= bound)
    assert counts[searched].sum() <= 100


def test_few_vectors(spark):
    assert knn.knn_edges(table(spark, [])).collect() == []
    assert knn.knn_edges(table(spark, [(0, [1.0], 1)])).collect() == []
    got = knn.knn_edges(table(spark, [(0, [1.0], 1), (3, [2.0], 1), (50, [1.0], 1)]), 10).collect()
    assert {tuple(r) for r in got} == {(0, 50, 1, 0.0), (0, 3, 2, 1.0), (50, 0, 1, 0.0), (50, 3, 2, 1.0)}
