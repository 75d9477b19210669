import numpy as np
import pytest
import xxhash

from quillon.llm import simhash_pivots as s

SCHEMA = "doc_id long, text string, fp string, component_id string, size int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text, width):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius):
    ids, fps = [i for i, _ in items], np.array([f for _, f in items], dtype=np.uint64)
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    smallest = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            r = find(i)
            smallest[r] = min(smallest.get(r, ids[i]), ids[i])
    return [smallest.get(find(i)) for i in range(len(ids))]


def check(spark, rows, width=3, radius=3):
    found = s.near_duplicates(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA), width, radius)
    got = sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in found.collect()), key=str)
    fps = [(i, brute_fp(t, width)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps, radius))), key=str)
    assert got == want


def test_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "Éa b c d e"), (7, "x " * 5000), (None, "one"), (None, None), (8, "a b c"), (8, "a b c"), (9, "ÀB cd ef gh"), (10, "àb cd ef gh")]
    check(spark, rows)
    check(spark, rows, width=5)


def test_empty_table(spark):
    assert s.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_driver_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("radius", [3, 6])
def test_links_of_crowded_fingerprints(spark, radius):
    """Chains, balls of thousands of near copies and buckets beyond a tile."""
    r = np.random.default_rng(radius)
    base = r.integers(0, 2**64, 300, dtype=np.uint64)
    one = np.uint64(1)
    ball = [base[0] ^ (one << np.uint64(a)) ^ (one << np.uint64(b)) for a in range(64) for b in range(a, 64)]
    crowd = [(base[1] & np.uint64(0xFFFF)) | (x << np.uint64(16)) for x in r.integers(0, 2**48, 3000, dtype=np.uint64)]
    chain = [base[2]]
    for _ in range(60):
        chain.append(chain[-1] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, radius, replace=False))))
    near = [x ^ np.uint64(sum(1 << int(b) for b in r.choice(64, radius + k % 2, replace=False))) for k, x in enumerate(base)]
    items = list(enumerate(int(x) for x in dict.fromkeys([*base, *ball, *crowd, *chain, *near])))
    each = spark.createDataFrame([(i, s.signed(f)) for i, f in items], "doc_id long, fp long")
    got = {x.doc_id: x.component_id for x in s.grouped(each, radius).collect()}
    assert [got[i] for i, _ in items] == brute_components(items, radius)


def test_key_masks_miss_no_pair():
    for count in (10, 10**6, 10**9, 10**12):
        masks = s.key_masks(count, 3)
        for _ in range(300):
            flips = sum(1 << int(b) for b in np.random.default_rng(_).choice(64, 3, replace=False))
            assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("forest, hub", [(1 << 17, 1024), (0, 1024), (0, 5)])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, forest, hub):
    """Random links, a long path, a hub and a link of a node with itself."""
    monkeypatch.setattr(s, "FOREST_LINKS", forest)
    monkeypatch.setattr(s, "HUB", hub)
    r = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in r.integers(-300, 300, (150, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(-5000, 2000 + i) for i in range(60)] + [(7, 7)]
    least = {x: x for pair in links for x in pair}
    for _ in range(len(links)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {x.node: x.root for x in s.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: y for x, y in least.items() if x != y}
    assert s.components(spark.createDataFrame([], "a long, b long")).collect() == []
