from collections import defaultdict

from quillon.llm import mixture

SCHEMA = "doc_id long, text string, source string, size string, target int, taken string"


def brute_targets(sizes, share, epochs, weights):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, left = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > epochs * sizes[s]]
        if not over:
            return {s: epochs * sizes[s] if s in capped else level * weight[s] for s in names}
        for s in over:
            capped.add(s)
            left -= epochs * sizes[s]


def rows():
    out = [(i, "w " * (1 + i * 7 % 50), f"s{i % 4}") for i in range(400)]
    out += [(1000 + i, "v " * 300, None) for i in range(5)]
    out += [(2000, None, "s1"), (2001, "", "s2"), (2002, " \n", "empty"), (None, "a b c", "s0"), (None, "a b", "s0"), (7, "w w", "s3"), (3000, "x " * 30000, "Z")]
    return [(i, t, s, "a", 1, "b") for i, t, s in out]


def test_targets_and_takings(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    found = mixture.mix_documents(docs).collect()
    assert len(found) == len(rows())
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes, 1.5, 2.0, (5.0, 2.0, 1.0))
    assert {s: round(t, 6) for s, t in target.items()} == {s: round(t, 6) for s, t in want.items()}
    assert all(abs(taken[s] - target[s]) <= 0.5001 for s in sizes)
    assert sorted(map(str, found)) == sorted(map(str, mixture.mix_documents(docs.repartition(7)).collect()))


def test_many_caps(spark):
    sizes = {f"s{i:02d}": (i * i * 37) % 1000 + (i % 3 == 0) * 5000 for i in range(40)}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    for share in (0.2, 1.0, 1.5, 1.9, 2.0):
        got = {r.source: r.target for r in mixture.water_fill(sources, share, 2.0, (5.0, 2.0, 1.0)).collect()}
        want = brute_targets(sizes, share, 2.0, (5.0, 2.0, 1.0))
        assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixture.mix_documents(docs).collect() == []
    assert mixture.repeated_documents(docs).collect() == []


def test_repeated_documents_keep_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = mixture.repeated_documents(docs)
    assert out.columns == docs.columns
    taken = {(r.doc_id, r.source): r.taken for r in mixture.mix_documents(docs).collect()}
    assert set((r.doc_id, r.source) for r in out.collect()) <= set(taken)


def test_rows_without_an_id_are_parted(spark, monkeypatch):
    """No task orders more than AT_ONCE rows, also where all ids are null, or one; sums stay those of the target."""
    monkeypatch.setattr(mixture, "AT_ONCE", 8)
    rows = [(None, f"w{i % 90} " * (1 + i % 9), "a") for i in range(600)] + [(5, "same text", "a")] * 300 + [(i, "x y z", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    widths = []
    plain = mixture.narrowed
    monkeypatch.setattr(mixture, "narrowed", lambda *a: widths.append(a[2]) or plain(*a))
    found = mixture.mix_documents(docs).collect()
    assert len(widths) > mixture.STEPS and len(found) == len(rows)
    for source in "ab":
        own = [r for r in found if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and all(0 <= r.taken <= 2 * r.size for r in own)
    again = mixture.mix_documents(docs.repartition(3)).collect()
    key = lambda r: (r.size, r.taken, r.source)
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_repetitions_meet_their_targets(spark):
    """Rows without ids, with one id, and equal rows: each source's words come within a document of its target."""
    rows = [(None, f"w{i % 50} " * (1 + i % 17), "a", i) for i in range(200)] + [(7, "same text here", "b", 1)] * 90 + [(7, f"x{i} y", "b", 2) for i in range(30)]
    rows += [(i, "one two three four five six", None, 3) for i in range(400)] + [(None, None, "a", 4), (None, "", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `TAKEN` int")
    out = mixture.repeated_documents(docs)
    assert out.columns == docs.columns
    got = [(r.source, len(r.text.split())) for r in out.collect()]
    targets = {r.source: r.target for r in mixture.mix_documents(docs).collect()}
    for source in ("a", "b", None):
        assert abs(sum(n for s, n in got if s == source) - targets[source]) <= max(n for s, n in got if s == source)
    again = mixture.repeated_documents(docs)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
