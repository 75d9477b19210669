import random
from collections import defaultdict

from quillon.llm import packing

SCHEMA = "doc_id long, text string, source string, bin_id string, size int, shard int"


def brute_pack(items, capacity, limit):
    """Tightest compatible bin by looking at all of them."""
    bins, out = [], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][3])):
        size, cluster, source, _ = items[i]
        fits = [b for b, (left, cs, ss) in enumerate(bins) if left >= size and cluster not in cs and ss.count(source) < limit]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], b))
        else:
            b = len(bins)
            bins.append([capacity, [], []])
        bins[b][0] -= size
        bins[b][1].append(cluster)
        bins[b][2].append(source)
        out[i] = b
    return out


def test_search_finds_the_tightest_compatible_bin():
    r = random.Random(1)
    for _ in range(60):
        items = [(r.randint(1, 50), r.randrange(8), r.choice(["a", "b", None]), i) for i in range(r.randrange(120))]
        assert packing.pack(items, 50, 2, 0.0) == brute_pack(items, 50, 2)


def check(rows, got, capacity, limit):
    texts, pieces, bins = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t, s, *_ in rows:
        texts[i].append((len((t or "").split()), t or "", s))
    for p in got:
        pieces[p.doc_id].append(p)
        if p.bin_id is not None:
            bins[p.bin_id].append(p)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        assert sum(p.size for p in own) == sum(n for n, _, _ in texts[i])
        assert all((p.bin_id is None) == (p.size == 0) and p.start == p.piece * capacity for p in own)
    for own in bins.values():
        assert sum(p.size for p in own) <= capacity
        if all(len(texts[p.doc_id]) == 1 for p in own):
            held = [texts[p.doc_id][0] for p in own]
            assert len({t for _, t, _ in held}) == len(held)
            assert max(sum(x[2] == s for x in held) for s in {x[2] for x in held}) <= limit
    return bins


def test_constraints_and_completeness(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    r = random.Random(2)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 3, 20, 70]))), f"s{r.randrange(3)}") for i in range(400)]
    rows += [(1000 + i, "the same copy here", "s0") for i in range(300)]
    rows += [(2000, None, None), (2001, "x " * 1000, None), (2002, "x " * 128, "s1"), (None, "a b", "s1"), (2003, "r r", "s2"), (2003, "r r", "s2")]
    docs = spark.createDataFrame([(i, t, s, "b", 1, 2) for i, t, s in rows], SCHEMA)
    got = packing.packed_documents(docs, capacity=64, source_limit=4, source_share=0.0).collect()
    check(rows, got, 64, 4)
    assert packing.packed_documents(docs.limit(0)).collect() == []


def fill(got):
    held = defaultdict(int)
    for p in got:
        if p.bin_id is not None:
            held[p.bin_id] += p.size
    return sum(held.values()) / (packing.CAPACITY * len(held))


def test_bins_are_well_filled(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = packing.packed_documents(docs).collect()
    check(rows, got, packing.CAPACITY, 1 << 30)
    assert fill(got) > 0.95


def test_one_source_fills_its_bins(spark):
    """Short documents of one source, or of one that has nearly all: the share grows with the source."""
    for other in (0, 30):
        rows = [(i, f"w{i} " * (5 + i % 40), "rare" if i < other else "hot") for i in range(3000)]
        got = packing.packed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert fill(got) > 0.95


def test_sources_are_held_to_their_share():
    items = [(10, i, "a" if i % 10 else "b", i) for i in range(1000)]
    limits = packing.source_limits(items, 100, 2, 1.5)
    assert limits == {"a": 14, "b": 2}
    bins = defaultdict(list)
    for x, b in zip(items, packing.pack(items, 100, 2, 1.5)):
        bins[b].append(x[2])
    assert all(own.count("b") <= 2 and own.count("a") <= 14 for own in bins.values())


def test_odd_texts(spark):
    """Null, empty and very long texts, repeated rows and clashing columns: all words of all rows are in pieces."""
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, "w " * 100_000, "a", 3), (3, "w " * 100_000, "a", 3), (None, "x y", "b", 4), (4, " \n", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int")
    got = packing.packed_documents(docs, capacity=4096).collect()
    words = lambda i: sum(r.size for r in got if r.doc_id == i)
    assert [words(i) for i in (1, 2, 3, 4, None)] == [0, 0, 200_000, 0, 2]
    assert all((r.bin_id is None) == (r.size == 0) and r.size <= 4096 for r in got)
    assert packing.packed_documents(docs.limit(0)).collect() == []
