import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.functions import analyze
from quillon.operators import incremental, search, vector
from quillon.operators.search import All, Any, Filter, Index, Near, Phrase, Prefix, Term, Without
from quillon.plans import tables

WORDS = "rust static running runs runner memory café naïve context index merged merging policy policies store stores don_t a-b 100.5".split()


def corpus():
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    return [(f"d/{i:03d}.md", some(r.randint(0, 4)), some(r.randint(1, 40)), [r.choice(WORDS)], "feedback" if i % 2 else "knowledge", i % 3, 10 * (i % 5)) for i in range(120)]


@pytest.fixture(scope="module")
def index(spark):
    items = spark.createDataFrame(corpus(), "path string, title string, body string, tags array<string>, type string, tier int, tokens long")
    items = items.selectExpr("*", "cast(null as string) workspace", "cast(null as string) visibility", "cast(null as string) scope")
    return Index.of(items, "stemmed")


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, title, content, tags, tokenize='porter unicode61')")
    db.executemany("insert into t values (?,?,?,?)", [(p, t, b, " ".join(g)) for p, t, b, g, *_ in corpus()])
    return lambda q: {p: s for p, s in db.execute("select path, -bm25(t, 0.0, 2.0, 1.0, 2.0) from t where t match ?", [q])}


@pytest.mark.parametrize(
    "query, text",
    [
        (Term("running"), "running"),
        (All(Term("rust"), Term("policies")), "rust policies"),
        (All(Term("rust"), Term("rust")), "rust rust"),
        (Any(Term("café"), Term("absent"), Term("index")), "café OR absent OR index"),
        (Without(Term("store"), Term("memory")), "store NOT memory"),
        (Phrase("static rust"), '"static rust"'),
        (Prefix("pol"), "pol*"),
        (Prefix("r"), "r*"),
        (Term("rust", "title"), "title:rust"),
        (Any(Term("rust", "title"), Term("memory")), "title:rust OR memory"),
        (Near("rust", "memory", 2), "NEAR(rust memory, 2)"),
        (Term("naive"), "naive"),
    ],
)
def test_scores_equal_fts5(index, fts, query, text):
    got = {r.path: r.score for r in search.matches(index, query).collect()}
    want = fts(text)
    assert got.keys() == want.keys()
    for p in want:
        assert got[p] == pytest.approx(want[p], rel=1e-6, abs=1e-6)


def test_stored_index_gives_the_same(spark, index, tmp_path):
    index.write(str(tmp_path / "i"))
    again = Index.read(spark, str(tmp_path / "i"))
    for q in (All(Term("rust"), Term("index")), Prefix("me")):
        assert sorted(search.matches(again, q).collect()) == sorted(search.matches(index, q).collect())


def test_refreshed_index_equals_a_new_one(spark, index):
    items = index.items
    upserts = items.filter("tier = 1").selectExpr("*", "1 as ordinal").unionByName(items.filter("tier = 1").selectExpr("*", "2 as ordinal").withColumn("body", F.lit("memory of rust")))
    deleted = items.filter("tokens = 20 and tier != 1").select("path")
    after = index.refreshed(upserts, deleted)
    anew = Index.of(incremental.applied(items, upserts, deleted), "stemmed")
    for q in (Term("memory"), Phrase("static rust")):
        round_ = lambda i: sorted((r.path, round(r.score, 9)) for r in search.matches(i, q).collect())  # noqa: B023, E731
        assert round_(after) == round_(anew)


def test_segments_equal_a_new_index(spark, index, tmp_path):
    """Two change sets as segments: the second one brings back a path that the first deleted."""
    path, items = str(tmp_path / "s"), index.items.drop("length")
    index.write(path)
    first = items.filter("tier = 1").withColumn("body", F.lit("memory of rust")).withColumn("ordinal", F.lit(1)), items.filter("tokens = 20 and tier != 1").select("path")
    second = items.filter("tokens = 20").withColumn("title", F.lit("rust again")).withColumn("ordinal", F.lit(1)), items.filter("tokens = 10").select("path")
    grown, want = Index.read(spark, path), items
    for change in (first, second):
        grown, want = grown.append(path, *change), incremental.applied(want, *change)
    anew = Index.of(want, "stemmed")
    assert grown.statistics() == pytest.approx(anew.statistics())
    for q in (Term("memory"), All(Term("rust"), Term("again"))):
        of = lambda i: sorted((r.path, r.title, round(r.score, 9)) for r in search.search(i, q).collect())  # noqa: B023, E731
        assert of(grown) == of(anew) and of(grown)


def test_batch_of_queries_equals_single_ones(spark, index):
    asked = {1: "rust memory", 2: "rust rust", 3: "absent rust", 4: "", 5: "Policies"}
    got = {}
    for r in search.search_batch(index, spark.createDataFrame(list(asked.items()), "query_id int, text string"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.path, round(r.score, 9)))
    for i, text in asked.items():
        want = [(r["rank"], r.path, round(r.score, 9)) for r in search.search(index, search.words(text), Filter(limit=5)).collect()] if text else []
        assert sorted(got.get(i, [])) == want


def test_ranks_by_ranges(spark, monkeypatch):
    """More rows than one task numbers: ranks and budgets as in one task."""
    monkeypatch.setattr(tables, "STRETCH", 7)
    r = random.Random(1)
    rows = [(f"p{i:03d}", float(r.randrange(9)), r.randrange(20)) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, score double, tokens long").repartition(5)
    order = [F.desc("score"), F.asc("path")]
    want = [p for p, *_ in sorted(rows, key=lambda x: (-x[1], x[0]))]
    for limit in (None, 50, 500):
        assert [x.path for x in sorted(tables.ranked(df, order, limit).collect(), key=lambda x: x["rank"])] == want[:limit]
    tokens, total, kept = {p: t for p, _, t in rows}, 0, []
    for p in want:
        total += tokens[p]
        if kept and total > 400:
            break
        kept.append(p)
    assert {x.path for x in tables.within_budget(tables.ranked(df, order, None), 400).collect()} == set(kept)
    assert tables.ranked(df.limit(0), order, None).collect() == []


def test_scratch_tables_go(spark):
    with tables.scratch(spark):
        df = tables.written(spark.range(5))
        path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        kept = tables.reused(spark.range(3))
        assert kept.count() == 3 and df.count() == 5
    assert not os.path.exists(path) and not kept.is_cached


def test_filters_limit_and_budget(index):
    q = Term("memory")
    every = search.search(index, q).collect()
    assert [r["rank"] for r in every] == list(range(1, len(every) + 1))
    assert [(-r.score, r.path) for r in every] == sorted((-r.score, r.path) for r in every)
    low = search.search(index, q, Filter(tier=1, type="feedback")).collect()
    kinds = {p: (k, t) for p, _, _, _, k, t, _ in corpus()}
    assert [r.path for r in low] == [r.path for r in every if kinds[r.path][0] == "feedback" and kinds[r.path][1] <= 1]
    some = search.search(index, q, Filter(limit=9, budget=35)).collect()
    total, want = 0, []
    for r in every[:9]:
        total += r.tokens
        if want and total > 35:
            break
        want.append(r.path)
    assert [r.path for r in some] == want
    assert len(search.search(index, q, Filter(limit=5, budget=0)).collect()) >= 1
    assert search.search(index, q, Filter(workspace="x")).collect() == []


def test_substring_needs_three_characters(index):
    assert search.substring(index.items, "ME").collect() == []
    want = sorted(p for p, t, b, *_ in corpus() if "memory ru" in f"{p}\n{t}\n{b}".lower())
    assert [r.path for r in search.substring(index.items, "Memory RU").collect()] == want


def test_stems_of_the_published_examples():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit digitizer digit operator oper feudalism feudal hopefulness hope formality formal triplicate triplic electrical electr revival reviv adjustable adjust adoption adopt homologou homolog effective effect rate rate cease ceas controlling control roll roll".split()
    for word, stem in zip(pairs[::2], pairs[1::2]):
        assert analyze.stem(word) == stem, word


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [0.0, 0.0]), ("e", [1.0]), ("f", None)]
    items = spark.createDataFrame([(p, p, "x", [], 0, 1, v) for p, v in rows], "path string, title string, body string, tags array<string>, tier int, tokens long, embedding array<float>")
    got = vector.nearest(items, [1.0, 0.0]).collect()
    assert [(r.path, round(r.similarity, 6)) for r in got] == [("a", 1.0), ("c", 0.707107), ("b", 0.0), ("d", 0.0)]
    index = Index.of(items, "plain")
    with pytest.raises(vector.DimensionMismatch) as e:
        vector.hybrid(index, Term("x"), [1.0, 2.0, 3.0])
    assert e.value.stored == [1, 2]
    lists = [spark.createDataFrame([("x", 1), ("y", 2)], "path string, rank int"), spark.createDataFrame([("y", 1), ("z", 2)], "path string, rank int")]
    assert vector.fused(*lists).orderBy("score", ascending=False).first().path == "y"
    blob = spark.createDataFrame([(bytearray(b"\x00\x00\x80?\x00"),)], "b binary").select(vector.decoded("b").alias("v")).first().v
    assert blob == [1.0]
    again = spark.createDataFrame([([1.5, -2.0],)], "v array<float>").select(vector.decoded(vector.encoded("v")).alias("v")).first().v
    assert again == [1.5, -2.0]
    assert vector.with_embeddings(items, spark.createDataFrame([("f", [3.0]), ("zz", [1.0])], "path string, embedding array<float>")).filter("path = 'f'").first().embedding == [3.0]


def test_embedder_runs_in_batches(spark):
    items = spark.createDataFrame([("a", "T", "body"), ("b", "", "")], "path string, title string, body string")
    got = vector.embedded_by(items, lambda texts: [[float(len(t))] if t.strip() else None for t in texts]).collect()
    assert {r.path: r.embedding for r in got} == {"a": [7.0], "b": None}


def test_stems_of_tokens_of_any_kind():
    """Thousands of made words against SQLite's stemmer; long runs of y stay within Python's stack."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'row')")
    r, ends = random.Random(1), ["", "s", "ing", "ed", "ness", "y", "ies", "ational", "eed", "ll"]
    for w in ("".join(r.choice("aeiouyybcdlstz") for _ in range(r.randint(0, 8))) + r.choice(ends) for _ in range(3000)):
        if w:
            db.execute("delete from t")
            db.execute("insert into t values (?)", [w])
            assert analyze.stem(w) == db.execute("select term from v").fetchone()[0], w
    assert analyze.stem("y" * 2000 + "ness") and analyze.stem("y" * 5001 + "ing") and analyze.terms("y" * 100_000)


def test_substrings_by_trigrams(spark, index, tmp_path, monkeypatch):
    """A stored index finds what a scan of all texts finds, over several blocks and segments."""
    monkeypatch.setattr(search, "GRAM_BLOCK", 17)
    path, r = str(tmp_path / "g"), random.Random(6)
    index.write(path)
    items = index.items.drop("length")
    changed = items.filter("tier = 1").withColumn("body", F.concat(F.lit("Straße ÉTÉ \n 100% "), "body")).withColumn("ordinal", F.lit(1))
    grown = Index.read(spark, path).append(path, changed, items.filter("tokens = 20 and tier = 0").select("path"))
    now = grown.items.persist()
    texts = [r_.body for r_ in now.collect()]
    asked = ["ry ", "RUST", "straße été", "d/00", ".md\n", "absent", "a-b", "ab", "100% r", "don_t", "\n\n"]
    for _ in range(12):
        t = r.choice(texts)
        at = r.randrange(len(t))
        asked.append(t[at : at + r.randint(3, 12)].upper())
    for text in asked:
        want = [x.path for x in search.substring(now, text).collect()]
        assert [x.path for x in search.substring(grown, text).collect()] == want, text
    monkeypatch.setattr(search, "LISTED", 3)
    assert [x.path for x in search.substring(grown, "rust").collect()] == [x.path for x in search.substring(now, "rust").collect()]
    plan = grown.grams.filter(F.col("gram").isin(["rus", "ust"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)


def test_a_build_keeps_little_on_disk(spark, index, tmp_path, monkeypatch):
    """Terms are sorted range by range, each deleted before the next; nothing but the index stays, and no text is shuffled for trigrams."""
    whole, parts = str(tmp_path / "w"), str(tmp_path / "p")
    index.write(whole)
    monkeypatch.setattr(search, "PART_WORDS", 500)
    monkeypatch.setattr(search, "PART_DOCUMENTS", 30)
    shared, left, kept = tables.shared_dir(spark), [], search._kept
    before, known = size(shared), list(tables._paths)

    def counted(df, path, *mode):
        if "/postings/" in path:
            left.append(size(shared))
        kept(df, path, *mode)

    monkeypatch.setattr(search, "_kept", counted)
    index.write(parts)
    assert len(left) == len(search._cuts(Index.read(spark, parts).items, "stemmed")) + 1 > 3 and left == sorted(left, reverse=True) and left[-1] < left[0]
    assert size(shared) == before and tables._paths == known
    for name in ("items", "postings", "blocks", "grams", "members", "counts"):
        a, b = spark.read.parquet(f"{whole}/{name}"), spark.read.parquet(f"{parts}/{name}")
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), name
    terms = [[r.term for r in spark.read.parquet(f).select("term").collect()] for f in Index.read(spark, parts).postings.inputFiles()]
    ranges = sorted((min(t), max(t)) for t in terms if t)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])) and len(ranges) > 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index.write(parts)


def test_a_search_of_texts_reads_them_once(spark, index, tmp_path, monkeypatch):
    """An index that is not stored has the hits of a stored one from one pass, without the postings of other words."""
    path = str(tmp_path / "o")
    index.write(path)
    stored = Index.read(spark, path)
    asked = ["running policies", "pol*", "^rust", '"static rust" NOT memory', "NEAR(rust memory, 2) OR café", "title:r* OR absent", "absent", "café naïve"]
    want = [{r.path: r.score for r in search.matches(stored, q).collect()} for q in asked]

    def read(*_):
        raise AssertionError("a second pass over the texts")

    monkeypatch.setattr(Index, "statistics", read)
    for q, scores in zip(asked, want):
        assert {r.path: r.score for r in search.matches(index, q).collect()} == pytest.approx(scores), q
    rows = [("a", None, "Été étés e\u0301te\u0301 running", None), ("b", "runs", "", [])]
    found = search.matches(Index.of(spark.createDataFrame(rows, "path string, title string, body string, tags array<string>")), "run OR ete")
    assert sorted(r.path for r in found.collect()) == ["a", "b"]


def test_places_are_those_of_the_terms():
    """Words that are passed over by their first letter are no others than those with another stem."""
    r, ends = random.Random(2), ["", "s", "ies", "ying", "ed", "y", "ational", "é", "\u0327", "sses", "eed"]
    for _ in range(300):
        text = " ".join("".join(r.choice("aeyslÉßİ5") for _ in range(r.randint(1, 5))) + r.choice(ends) for _ in range(30))
        every = analyze.terms(text)
        exact, prefixes = frozenset(r.sample(every, 2)), (r.choice(every)[:2],) if r.random() < 0.5 else ()
        want = {}
        for at, t in enumerate(every):
            if t in exact or t.startswith(prefixes):
                want.setdefault(t, []).append(at)
        assert analyze.places(text, exact, prefixes) == (len(every), want)


def test_best_hits_read_few_blocks(spark, tmp_path, monkeypatch):
    """The first hits equal those of scoring all documents, ties included; blocks that cannot reach them are not read."""
    monkeypatch.setattr(search, "BLOCK", 8)
    r, path = random.Random(9), str(tmp_path / "b")
    rows = []
    for i in range(900):
        text = " ".join(r.choices(["hot", "warm", "cold", "rare"], [60, 20, 6, 1], k=r.randint(1, 12) ** 2))
        rows.append((f"p{i:03d}", r.choice(["hot", "x"]), text, ["t"], 0, 1))
    rows += [("q0", "", "", [], 0, 1), ("q1", None, None, None, 0, 1)] + [(f"same{i}", "warm", "warm cold", ["t"], 0, 1) for i in range(30)]
    items = spark.createDataFrame(rows, "path string, title string, body string, tags array<string>, tier int, tokens long")
    Index.of(items, "plain").write(path)
    stored = Index.read(spark, path, "plain")
    upserts = items.filter("path like 'p%7'").withColumn("body", F.lit("warm hot")).withColumn("ordinal", F.lit(1))
    read, matches = [], search.matches

    def counting(index, query, known=None):
        read.append(index.postings.filter(F.col("term").isin("hot", "warm", "cold", "rare")).count())
        return matches(index, query, known)

    for index in (stored, stored.append(path, upserts, items.filter("path like 'p%3'").select("path"))):
        every = index.postings.filter(F.col("term").isin("hot", "warm", "cold", "rare")).count()
        for query, limit in (("hot", 5), ("warm cold", 40), ("(rare cold) OR warm", 10), ("absent hot", 3)):
            want = matches(index, query).orderBy(F.desc("score"), "path").limit(limit).collect()
            monkeypatch.setattr(search, "matches", counting)
            read.clear()
            assert search.best(index, query, limit, scored=0).collect() == want, query
            assert limit > 5 or "absent h" in query or sum(read) < every / 2, (query, read, every)
            monkeypatch.setattr(search, "matches", matches)
    # More blocks than are listed, and more hits than there are.
    monkeypatch.setattr(search, "LISTED", 40)
    want = matches(stored, "warm").orderBy(F.desc("score"), "path").limit(40).collect()
    assert search.best(stored, "warm", 40, scored=0).collect() == want
    assert search.best(stored, "hot rare", 5000, scored=0).count() == matches(stored, "hot rare").count()
    assert search.best(stored, "hot OR absent", 0).collect() == [] and search.best(Index.of(items.limit(0), "plain"), "hot", 3).collect() == []
    empty = str(tmp_path / "e")
    Index.of(items.limit(0), "plain").write(empty)
    assert search.best(Index.read(spark, empty, "plain"), "hot", 3, scored=0).collect() == []


def test_segments_merge_in_place(spark, tmp_path):
    """Many appends keep few segments; an older reader goes on; of two writers none loses its change."""
    schema = "path string, title string, body string, tags array<string>, tier int, tokens long"
    rows = lambda names, text: spark.createDataFrame([(n, n, f"{text} {n}", ["t"], 0, 1) for n in names], schema)
    path = str(tmp_path / "m")
    Index.of(rows([f"p{i}" for i in range(30)], "old"), "plain").write(path)
    first = index = Index.read(spark, path, "plain")
    change = lambda k: rows([f"p{k}", f"new{k}"], f"change{k}").withColumn("ordinal", F.lit(1))
    gone = lambda *names: spark.createDataFrame([(n,) for n in names], "path string")
    for k in range(9):
        index = index.append(path, change(k), gone(f"p{20 + k}"))
    assert len(Index.segments(spark, path)) <= 1 + 2 * 3
    found = lambda i, word: sorted(x.path for x in search.search(i, Term(word)).collect())
    assert found(index, "old") == sorted(f"p{i}" for i in [*range(9, 20), 29]) and found(index, "change3") == ["new3", "p3"] and index.statistics()[0] == 30
    assert len(found(first, "old")) == 30
    # Both start from the same state.
    a, b = Index.read(spark, path, "plain"), Index.read(spark, path, "plain")
    a.append(path, change(100), gone("p9"), merge=False)
    after = b.append(path, change(101), gone("p10"), merge=False)
    assert found(after, "change100") == ["new100", "p100"] and found(after, "change101") == ["new101", "p101"] and not {"p9", "p10"} & set(found(after, "old"))
    assert after.statistics()[0] == 32


def test_texts_that_cannot_be_embedded(spark):
    """A batch that fails is tried text by text; each failure has its warning and nothing else is lost."""
    items = spark.createDataFrame([(t, t) for t in ("a", "bad", "ccc", "none")], "title string, body string")

    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [None if "none" in t else [float(len(t))] for t in texts]

    got = {r.title: (r.embedding, r.why) for r in vector.embedded_by(items.coalesce(1), embed, "why").collect()}
    assert got == {"a": ([4.0], None), "bad": (None, "refused"), "ccc": ([8.0], None), "none": (None, "no embedding")}
    assert vector.embedded_by(items.limit(0), embed).collect() == []
