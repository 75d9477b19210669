"""Query texts against SQLite's FTS5, which defines them."""

import random
import sqlite3

import pytest

from quillon.operators import match, search
from quillon.operators.search import All, Any, Group, Index, Nothing, Without, Words

VOCABULARY = "a b c d e running stores".split()


def rows():
    r = random.Random(11)
    text = lambda most: " ".join(r.choice(VOCABULARY) for _ in range(r.randint(0, most)))
    return [(f"p{i:02d}", text(4), text(14), [r.choice(VOCABULARY) for _ in range(r.randint(0, 2))]) for i in range(60)]


@pytest.fixture(scope="module")
def fts():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, title, content, tags, tokenize='porter unicode61')")
    db.executemany("insert into t values (?,?,?,?)", [(p, t, b, " ".join(g)) for p, t, b, g in rows()])

    def run(q):
        try:
            return dict(db.execute("select path, -bm25(t, 0.0, 2.0, 1.0, 2.0) from t where t match ?", [q]).fetchall())
        except sqlite3.Error:
            return None

    return run


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    items = spark.createDataFrame(rows(), "path string, title string, body string, tags array<string>")
    path = str(tmp_path_factory.mktemp("match") / "i")
    Index.of(items, "stemmed").write(path)
    return Index.read(spark, path)


def generated(r, depth=2):
    """A well-formed query, more or less."""
    string = lambda: r.choice([r.choice(VOCABULARY), f'"{r.choice(VOCABULARY)} {r.choice(VOCABULARY)}"', r.choice(VOCABULARY).upper(), '"..."', f'"{r.choice(VOCABULARY)}"'])
    phrase = lambda: " + ".join(string() + r.choice(["", "", "", "*"]) for _ in range(r.choice([1, 1, 1, 2, 3])))
    columns = lambda: r.choice(["title", "content:"[:-1], "tags", "{title content}", "-title", "- {tags title}", "path", '"content"', "CONTENT"]) + r.choice([":", " : "])

    def part():
        kind = r.random()
        near = phrase() if kind < 0.6 else "^" + phrase() if kind < 0.7 else f"NEAR({' '.join(phrase() for _ in range(r.randint(1, 4)))}{r.choice(['', ', 0', ',1', ', 3'])})"
        return (columns() if r.random() < 0.3 else "") + near

    if depth == 0 or r.random() < 0.3:
        return " ".join(part() for _ in range(r.choice([1, 1, 2, 3])))
    if r.random() < 0.25:
        return r.choice(["", columns()]) + f"({generated(r, depth - 1)})"
    return f" {r.choice(['AND', 'OR', 'NOT'])} ".join(generated(r, depth - 1) for _ in range(2))


def soup(r):
    tokens = [*VOCABULARY, "AND", "OR", "NOT", "NEAR", "(", ")", "{", "}", ":", ",", "+", "*", "-", "^", '"a b"', '"', "'", "title", "content", "zzz", "3", "é", "."]
    return r.choice(["", " "]).join(r.choice(tokens) for _ in range(r.randint(0, 6)))


def test_what_is_a_query_and_what_is_none(fts):
    """Thousands of strings, malformed ones among them: errors where SQLite has them, and nowhere else."""
    r, wrong, fine = random.Random(5), [], 0
    for i in range(6000):
        text = soup(r) if i % 2 else generated(r)
        want = fts(text)
        try:
            match.query(text)
            ok = True
        except match.MatchError:
            ok = False
        fine += ok
        if ok != (want is not None):
            wrong.append(text)
    assert not wrong and 2000 < fine < 5900


def brute(q, doc):
    """Whether a document's fields (lists of stems) match, and the weighted hits of each active phrase, by loops."""
    weights = {"title": 2.0, "body": 1.0, "tags": 2.0}
    if isinstance(q, Nothing):
        return False, {}
    if isinstance(q, (All, Any)):
        found = [brute(p, doc) for p in q.parts]
        ok = all(x for x, _ in found) if isinstance(q, All) else any(x for x, _ in found)
        return ok, {k: v for x, f in found if x for k, v in f.items()} if ok else {}
    if isinstance(q, Without):
        (a, f), (b, _) = brute(q.wanted, doc), brute(q.unwanted, doc)
        return a and not b, f if a and not b else {}
    phrases, f = [search._phrase(p, "stemmed") for p in q.phrases], {}
    for name, words in doc.items():
        if q.fields is not None and name not in q.fields:
            continue
        same = lambda w, t: w.startswith(t[0]) if t[1] else w == t[0]
        starts = [[i for i in range(len(words) - len(p) + 1) if all(same(words[i + k], t) for k, t in enumerate(p)) and (i == 0 or not q.first)] for p in phrases]
        for k, x in enumerate(starts if len(starts) == 1 else search._swept(starts, [len(p) for p in phrases], q.gap)):
            f[id(q), k] = f.get((id(q), k), 0.0) + weights[name] * len(x)
    ok = all(f.get((id(q), k), 0) > 0 for k in range(len(phrases)))
    return ok, f if ok else {}


def test_meaning_of_many_texts(fts):
    """Which documents match, for thousands of texts."""
    from quillon.functions import analyze

    docs = {p: {"title": analyze.terms(t), "body": analyze.terms(b), "tags": analyze.terms(" ".join(g))} for p, t, b, g in rows()}
    r, wrong, met = random.Random(8), [], 0
    for i in range(4000):
        text = soup(r) if i % 4 == 0 else generated(r)
        want = fts(text)
        if want is None:
            continue
        q = match.query(text)
        got = {p for p, d in docs.items() if brute(q, d)[0]}
        met += bool(got)
        if got != set(want):
            wrong.append((text, sorted(got ^ set(want))))
    assert not wrong and met > 1000


@pytest.mark.parametrize("seed", range(6))
def test_scores_of_texts(index, fts, seed):
    """Scores by Spark, over the stored index; six texts in one go."""
    r = random.Random(100 + seed)
    texts = []
    while len(texts) < 6:
        text = generated(r)
        if fts(text) and len(text) < 120:
            texts.append(text)
    for text in texts:
        got, want = {x.path: x.score for x in search.matches(index, text).collect()}, fts(text)
        assert got.keys() == want.keys(), text
        # Beside an OR, SQLite adds the first phrases of a NEAR that does not match, where all its words occur.
        for p in want if "NEAR" not in text or " OR " not in text else ():
            assert got[p] == pytest.approx(want[p], rel=1e-6, abs=1e-6), text


def test_no_words(index):
    assert search.matches(index, '"..."').collect() == [] and search.matches(index, 'a AND "!"').collect() == []
    with pytest.raises(match.MatchError):
        search.search(index, "a AND")


def test_a_sweep_over_many_lists():
    """Every position that is in some window, against trying all combinations."""
    from itertools import product

    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(1, 6))) for _ in range(r.randint(2, 4))]
        sizes, gap = [r.randint(1, 3) for _ in lists], r.randint(0, 4)
        some = [set() for _ in lists]
        for window in product(*lists):
            if all(max(window) - n - gap <= p for p, n in zip(window, sizes)):
                for s, p in zip(some, window):
                    s.add(p)
        got = search._swept(lists, sizes, gap)
        assert all(set(g) <= s for g, s in zip(got, some)) and all(bool(g) == bool(s) for g, s in zip(got, some))
        assert Group((Words((("a", False),)),)) == Group((Words((("a", False),)),))
