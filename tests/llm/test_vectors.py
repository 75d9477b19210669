import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import ann_blocks, exact_topk, grid

SCHEMA = "vec_id long, embedding array<float>, rank string, score string, id int"


def rows_of(vectors):
    return [(i, v, "x", "y", 1) for i, v in vectors]


def brute_nearest(vectors, k, every):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            d = sorted((float(np.sqrt(((c - q) ** 2).sum())), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(d)]
    return sorted(out)


def brute_best(vectors, k, every):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            d = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(d)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    v = r.normal(size=(700, 17)).astype(np.float32)
    v[100:300] = v[5]  # a large group of equal vectors: ties
    v[300:320] *= 1e-6
    out = [(i, v[i].tolist()) for i in range(700)]
    out += [(None, v[0].tolist()), (700, None), (800, [None] + v[1].tolist()[1:]), (900, [float("nan")] * 17), (1000, [0.0] * 17), (1100, []), (1200, [1.0, 2.0]), (1300, [float("inf")] * 17)]
    return out


def test_nearest_equals_brute_force(spark, vectors):
    found = ann_blocks.nearest(spark.createDataFrame(rows_of(vectors), SCHEMA), k=7, every=10).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    want = brute_nearest(vectors, 7, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)


def test_best_equals_brute_force(spark, vectors):
    found = exact_topk.best(spark.createDataFrame(rows_of(vectors), SCHEMA), k=9, every=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_best(vectors, 9, 10)


def of_any_size(seed, n=90, d=6):
    """Vectors with components from denormal to the largest, whole groups of equal ones among them."""
    r = random.Random(seed)
    kinds = [
        lambda: r.gauss(0, 1), lambda: r.choice([1.7e308, -1e308, 1e200, 1.0, 5e-324, -3e-310, 0.0]), lambda: r.gauss(0, 1) * 1e-160,
        lambda: r.gauss(0, 1) * 10 ** r.uniform(-300, 300), lambda: r.gauss(0, 1) * 1e9, lambda: 1.0,
    ]
    return [(i, [k() for _ in range(d)]) for i in range(n) for k in [r.choice(kinds)]]


def distance(a, b):
    """By fractions; infinite beyond the largest double."""
    square = sum((Fraction(x) - Fraction(y)) ** 2 for x, y in zip(a, b))
    root = math.isqrt(square.numerator * 4**1100 // square.denominator)
    try:
        return float(Fraction(root, 2**1100))
    except OverflowError:
        return math.inf


def test_components_of_any_finite_size(spark):
    vectors = [(i, v) for i, v in of_any_size(1) if any(v)] + [(900, [1.0, 2.0]), (901, [1e200, 1.0]), (902, [-1e160, 0.0]), (903, [1.0, 3.0]), (904, [2.0, 2.0])]
    found = ann_blocks.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=5, every=3).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for i, v in vectors:
        if i % 3 == 0:
            want = sorted((distance(v, w), j) for j, w in vectors if j != i and len(w) == len(v))[:5]
            assert np.allclose([s for s, _ in sorted(got[i])], [s for s, _ in want], rtol=1e-12, atol=0)
    assert [j for _, j in sorted(got[900])] == [903, 904, 902, 901]


def test_scores_of_any_size(spark):
    vectors = of_any_size(2, 80)
    found = exact_topk.best(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=6, every=3).collect()
    whole = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in vectors}
    want = []
    for i in whole:
        if i % 3 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in whole if j != i)[:6]
            want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(want)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch, vectors):
    """Small blocks and a small pilot give the same."""
    for name, value in (("BLOCK_BYTES", 17 * 8 * 40), ("PILOT", 9), ("LEAST_BLOCKS", 2)):
        monkeypatch.setattr(grid, name, value)
    found = exact_topk.best(spark.createDataFrame(rows_of(vectors[:160]), SCHEMA), k=9, every=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_best(vectors[:160], 9, 10)


def test_one_very_long_vector(spark, monkeypatch, vectors):
    """Each length has its own grid: a long row, alone or with others of its length, changes nothing for the rest."""
    seen = []
    monkeypatch.setattr(grid, "small", lambda df: seen.append(df) or df)
    r = np.random.default_rng(8)
    more = [(2000 + i, r.normal(size=20000).astype(np.float32).tolist()) for i in range(3)] + [(3000, [1.0] * 50000), (3001, [2.0] * 700)]
    table = spark.createDataFrame(rows_of(vectors[:200] + more), SCHEMA)
    for run, brute in ((ann_blocks.nearest, brute_nearest), (exact_topk.best, brute_best)):
        found = run(table, k=5, every=10).collect()
        got, want = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found), brute(vectors[:200] + more, 5, 10)
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-9)
        shapes = {x.d: (x.columns, x.lines) for x in seen[-1].collect()}
        assert shapes[17] == (1, 1) and 700 not in shapes


def test_keys_of_whole_numbers():
    r = random.Random(4)
    some = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63)] + [r.choice([1, -1]) * r.getrandbits(r.randint(1, 2200)) for _ in range(300)]
    assert [exact_topk.number(exact_topk.key(s)) for s in some] == some
    assert sorted(some, key=exact_topk.key) == sorted(some)


def test_components_beyond_exact_sums(spark):
    vectors = [(0, [3e17, -2e17]), (1, [2e10, 1.0]), (2, [1.0, 5e9]), (3, [0.5, 0.25])]
    found = exact_topk.best(spark.createDataFrame([(i, v) for i, v in vectors], "vec_id long, embedding array<double>"), k=3, every=20).collect()
    scores = sorted(((64 * int(3e17)) * math.floor(64 * a) - (64 * int(2e17)) * math.floor(64 * b), -i) for i, (a, b) in vectors[1:])[::-1]
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(-i, max(-(2**63), min(2**63 - 1, s))) for s, i in scores]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann_blocks.nearest(empty).collect() == [] and exact_topk.best(empty).collect() == []
    repeated = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    for found in (ann_blocks.nearest(repeated), exact_topk.best(repeated)):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(0, 1, 1), (0, 2, 1)]
