"""Centroid clusters against a plain implementation with Python integers."""

import hashlib
import math

import numpy as np
import pytest

from msgrisk.llm import centroids


def plain(rows, rounds=3, n=16):
    """rows: (vec_id, vector) of usable vectors only."""
    whole = [(i, [math.floor(x) * 64 if abs(x) >= 2**53 else math.floor(64 * x) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    centres = [v for _, v in named[:n]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centres)]
    out = [(i, *reversed(nearest(v))) for i, v in whole]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = {k: sum(d for _, c, d in out if c == k) for k in range(len(centres))}

    def held(x):
        return x if x < 2**63 else None

    return [(i, c, held(d), held(inertia[c]), held(sum(inertia.values())), prints[c]) for i, c, d in out]


def order(rows):
    return sorted(rows, key=str)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance long, wide string").repartition(3)


def test_equals_plain_clusters(spark):
    draw = np.random.default_rng(1)
    middles = draw.normal(size=(9, 64))
    rows = [(i, (middles[i % 9] + draw.normal(scale=0.3, size=64)).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, rows[7][1])]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [0.5] * 63 + [math.nan]), (906, [0.5] * 63 + [math.inf])]
    got = [tuple(r) for r in centroids.clusters(vectors(spark, rows + odd)).collect()]
    assert order(got) == order(plain(rows))


@pytest.mark.parametrize("rows", [
    [(i, [0.0] * 64) for i in range(40)],                                   # all equal: one cluster, ties go to the first
    [(i, [float(i % 2)] * 64) for i in range(3)],                           # fewer vectors than centroids
    [(i, [float((-1) ** i * i)] * 64) for i in range(40)],
    [(i, [-1e-9 if i % 3 else 1e-9] * 64) for i in range(30)],              # floors of small negative numbers
])
def test_ties_and_few(spark, rows):
    assert order(tuple(r) for r in centroids.clusters(vectors(spark, rows)).collect()) == order(plain(rows))


def test_numbers_of_any_size(spark):
    rows = [(i, [float(i)] * 64) for i in range(20)] + [(30 + i, [1e300 * (1 + i)] + [0.0] * 63) for i in range(3)] + [(40, [2e7] * 64), (41, [-3e9] * 64)]
    assert order(tuple(r) for r in centroids.clusters(vectors(spark, rows)).collect()) == order(plain(rows))
    rows = [(1, [1e300] * 64), (None, [1.0] * 64), (None, [-2.5] * 64)]         # no pivot can be used
    assert order(tuple(r) for r in centroids.clusters(vectors(spark, rows)).collect()) == order(plain(rows))


def test_floats_and_no_rows(spark):
    rows = [(i, [float(np.float32(0.1 * i))] * 64) for i in range(20)]
    assert order(tuple(r) for r in centroids.clusters(vectors(spark, rows, "float")).collect()) == order(plain(rows))
    for some in ([], [(1, None)], [(None, [1.0] * 64)]):
        found = centroids.clusters(vectors(spark, some))
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not found.collect()


def test_pivots_rule_out_centroids():
    """Bounds never exceed the distance, and spare most distances of separate groups."""
    draw = np.random.default_rng(2)
    middles = draw.normal(scale=3, size=(16, 64))
    rows = np.floor(64 * (middles[draw.integers(0, 16, 2000)] + draw.normal(scale=0.2, size=(2000, 64)))).astype(np.int64)
    seeds = np.floor(64 * middles).astype(int).tolist()
    pivots = centroids.farthest_first(seeds, 8)
    held = centroids.Centroids(seeds, pivots)
    far = np.sqrt(np.stack([centroids.squared(rows, np.array(p)).astype(float) for p in pivots], 1))
    exact = np.stack([centroids.squared(rows, c) for c in held.centres], 1)
    assert (held.bounds(far) <= exact).all()
    which, best, computed = held.nearest(rows, far)
    assert (which == exact.argmin(1)).all() and (best == exact.min(1)).all() and computed < 0.3 * exact.size
