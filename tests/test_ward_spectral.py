"""Ward against brute force, cluster features, and eigenvectors against numpy."""

import numpy as np
import pytest

from tablewright.operators import clusters, spectral, ward


def points(spark, x, parts=3):
    rows = [(int(i), None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(parts)


def labels(df):
    return [r.cluster for r in sorted(df.collect(), key=lambda r: r.id)]


def brute_ward(x, k):
    """Merge the pair of least growth in squares until ``k`` groups are left."""
    groups = [[i] for i in range(len(x))]
    centre, n = x.copy(), np.ones(len(x))
    while len(groups) > k:
        gap = ((centre[:, None] - centre[None]) ** 2).sum(-1) * (n[:, None] * n[None] / (n[:, None] + n[None]))
        np.fill_diagonal(gap, np.inf)
        a, b = sorted(np.unravel_index(gap.argmin(), gap.shape))
        centre[a] = (n[a] * centre[a] + n[b] * centre[b]) / (n[a] + n[b])
        n[a] += n[b]
        groups[a] += groups.pop(b)
        centre, n = np.delete(centre, b, 0), np.delete(n, b)
    return {frozenset(g) for g in groups}


def sets(found):
    return {frozenset(i for i, c in enumerate(found) if c == g) for g in set(found)}


@pytest.mark.parametrize("k", [1, 3, 8])
def test_ward_is_exact_when_nothing_is_merged(spark, k):
    x = np.random.default_rng(5).normal(size=(500, 3))
    assert sets(labels(clusters.cluster_hierarchical(points(spark, x), k))) == brute_ward(x, k)


def test_ward_over_features_finds_clear_groups(spark):
    rng = np.random.default_rng(6)
    true = rng.integers(0, 4, 3000)
    true[:1000] = 0
    x = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])[true] + rng.normal(size=(3000, 2)) * 0.5
    x[:1000] = [0.1, 0.2]                                         # a third of the rows are one row
    pts = points(spark, x, 40)
    found = ward.cluster_features(pts, 50).collect()
    assert len(found) <= 50 and sum(r.n for r in found) == 3000
    centre = x.mean(axis=0)
    whole = sum(r.spread + r.n * ((np.array(r.centre) - centre) ** 2).sum() for r in found)
    assert whole == pytest.approx(((x - centre) ** 2).sum())
    assert sets(labels(ward.ward(pts, 4, 50))) == sets(true.tolist())


def test_ward_edges(spark):
    assert labels(ward.ward(points(spark, []), 3)) == []
    assert labels(ward.ward(points(spark, [None]), 3)) == [None]
    assert labels(ward.ward(points(spark, [[1.0], [1.0], None]), 3)) == [0, 0, None]
    assert sorted(labels(ward.ward(points(spark, [[1.0], [2.0]]), 5))) == [0, 1]


def ring(radius, n):
    turn = np.arange(n) * 2 * np.pi / n
    return np.c_[np.cos(turn), np.sin(turn)] * radius


def test_spectral_parts_two_rings(spark):
    found = labels(clusters.cluster_spectral(points(spark, np.r_[ring(1, 60), ring(5, 120)]), 2, 1.0, 6))
    assert sets(found) == {frozenset(range(60)), frozenset(range(60, 180))}


def test_leading_vectors_are_eigenvectors(spark):
    rng = np.random.default_rng(3)
    w = np.triu((rng.random((80, 80)) < 0.08) * rng.random((80, 80)), 1)
    edges = [(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))]
    w = w + w.T
    root = np.sqrt(w.sum(axis=1))
    m = w / root[:, None] / root[None]
    links = spectral.normalised(spark.createDataFrame(edges, "a long, b long, weight double"))
    found, values = spectral.leading_vectors(spark.range(80), links, 3)
    x = np.array([r.x for r in sorted(found.collect(), key=lambda r: r.id)])
    assert values == pytest.approx(np.linalg.eigvalsh(m)[::-1][:3], abs=1e-4)
    assert np.abs(m @ x - x * values).max() < 1e-2
    assert x.T @ x == pytest.approx(np.eye(3), abs=1e-6)


def test_spectral_without_affinities(spark):
    found = labels(clusters.cluster_spectral(points(spark, [[0.0], [1e6], [3e6]]), 2, 1.0, 1))
    assert len(found) == 3 and None not in found
