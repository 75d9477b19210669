import hashlib
import math
import random

import numpy as np
import pytest

from quillon.llm import shallot

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, width, scale=256):
    """(vec_id, cluster, distance) of every vector, with Python's integers."""
    ok = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    codes = [(i, [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v], v) for i, v in ok]
    chosen = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, c) for i, c, v in codes if i is not None)[:k]
    centroids = [c for _, _, c in chosen]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda c: min(range(len(centroids)), key=lambda j: (apart(c, centroids[j]), j))
    if not centroids:
        return [], []
    for _ in range(rounds):
        of = [place(c) for _, c, _ in codes]
        for j in range(len(centroids)):
            own = [c for (_, c, _), o in zip(codes, of) if o == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    of = [place(c) for _, c, _ in codes]
    return [(i, o, apart(c, centroids[o])) for (i, c, _), o in zip(codes, of)], centroids


def compare(spark, rows, k=5, rounds=4, width=4):
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = shallot.clustered(docs, k=k, rounds=rounds, width=width).collect()
    want, centroids = brute(rows, k, rounds, width)
    cap = 2**63 - 1
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(((i, c, min(d, cap)) for i, c, d in want), key=str)
    for r in got:
        assert r.cluster_inertia == min(cap, sum(d for _, c, d in want if c == r.cluster)) and r.inertia == min(cap, sum(d for *_, d in want))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    compare(spark, [(i, [x + r.gauss(0, 0.2) for x in r.choice(middles)]) for i in range(300)], k=(5, 12, 1)[seed])


def test_ties_and_repeated_rows(spark):
    """A lattice: many vectors are equally near to several centroids, and some centroids are equal."""
    rows = [(i % 50, [float(i % 3), float(i // 3 % 3), 0.0, float(i // 9 % 2)]) for i in range(120)]
    compare(spark, rows, k=9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 0.0, 0.0]), (5, [nan] * 4), (6, [inf, 0.0, 0.0, 0.0]), (7, [0.0] * 4), (None, [0.5] * 4), (8, [-0.001] * 4), (9, [0.25, -0.25, 1.0, 2.0])]
    compare(spark, rows)
    compare(spark, rows, k=2)
    compare(spark, rows[:6])
    compare(spark, [(None, [1.0] * 4)])


def test_components_of_any_size(spark):
    """One vector far beyond 64 bits, and centroids that it pulls there."""
    rows = [(i, [float(i % 7), float(i % 5), 0.5, -1.0]) for i in range(60)] + [(100, [3e38, -3e38, 0.0, 1.0]), (101, [2.5e38, 1.0, 0.0, 1.0]), (102, [1e12, 1e9, 5.0, 0.0])]
    compare(spark, rows, k=3, rounds=3)
    compare(spark, rows, k=63, rounds=2)


def test_bounds_save_scans(spark):
    """of separate groups the first search scans most vectors, later ones few."""
    r = np.random.default_rng(5)
    middles = r.normal(size=(10, 16)) * 40
    x = np.floor((middles[np.arange(2000) % 10] + r.normal(size=(2000, 16))) * 256).astype(np.int64)
    c = shallot.Centroids([x[i].tolist() for i in range(10)])
    s = shallot.State.fresh(len(x), 10)
    assert shallot.search(x, c, s) >= 1800
    after = shallot.Centroids([(x[s.near == i].sum(axis=0) // (s.near == i).sum()).tolist() for i in range(10)])
    s.follow(after.moved(c))
    assert shallot.search(x, after, s) < 20


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0], 3, "x"), (2, [2.0, 1.0], 4, "y")], "vec_id long, embedding array<double>, cluster int, ids string")
    assert sorted((r.vec_id, r.distance) for r in shallot.clustered(docs, k=2, rounds=1, width=2).collect()) == [(1, 0), (2, 0)]
