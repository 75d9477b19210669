import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string, term string, VALUE int"
WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = WORD.findall(text.translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    share = lambda n, total, v: 1 + 10**9 * (n + 2) // (total + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][x] for x in kept), len(kept)) for t in kept} for s in sources}
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: share(total[t], sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def compare(spark, rows, least=2, top=3):
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA)
    out = sd.audited(docs, least_docs=least, top=top)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, least, top)


def made(n, seed, langs=("en", "de"), sources=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 20))) for _ in range(60)] + ["samestart" * 2 + x for x in "abcd"] + ["samestart", "samestartsamestart", "日本語の長い言葉", "日本語"]
    text = lambda k: r.choice(" .-_@\n").join(r.choice((str.upper, str))(r.choice(words[: 20 + 10 * (k % 5)])) for _ in range(r.randint(0, 40)))
    return [(text(i), r.choice(langs), f"s{r.randrange(sources) if r.random() < 0.6 else 0}") for i in range(n)]


def test_equals_brute_force(spark):
    compare(spark, made(300, 1))
    compare(spark, made(120, 2), least=10, top=100)


def test_many_sources_and_parts(spark, monkeypatch):
    """Sources in several blocks, words in several parts, slices of a few texts."""
    for name, value in (("BLOCK", 3), ("PART", 40), ("SLICE", 2000), ("ROWS", 7)):
        monkeypatch.setattr(sd, name, value)
    compare(spark, made(300, 3, sources=17))


def test_odd_rows(spark):
    """Nulls, empty texts, groups without words, a language without kept words, repeated rows, equal values."""
    rows = [(None, "en", "a"), ("", "en", "b"), ("one two", None, None), ("one two", "", None), ("One, TWO!", None, "c"), ("x", "fr", "a"), ("y", "fr", "b"), ("12 34", "de", "only")]
    compare(spark, rows + [("tie tie", "en", "a"), ("tie", "en", "c"), ("eit eit", "en", "a"), ("eit", "en", "c")] * 2)
    compare(spark, [])
    compare(spark, [("a b c", "en", "x")])


def test_a_very_long_text_and_word(spark):
    long = "the same words again " * 200_000
    compare(spark, [(long, "en", "a"), (long + "x" * 300_000, "en", "b"), ("x" * 300_000, "en", "b"), ("the words", "en", "c")])


@pytest.mark.parametrize("seed", range(4))
def test_pointers_sort_like_strings(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("aab  Z.é") for _ in range(r.choice((0, 1, 9, 400)))) for _ in range(60)]
    joined, offsets = b"".join(t.encode() for t in texts), np.cumsum([0] + [len(t.encode()) for t in texts])
    data = np.frombuffer(joined.translate(sd.WORDS) + bytes(8), np.uint8)
    starts, lengths, document = sd.pointers(data, offsets)
    words = [bytes(data[s : s + n]).decode() for s, n in zip(starts, lengths)]
    assert list(zip(document.tolist(), words)) == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t.translate(LOWER))]
    order, new = sd.pointer_sort(data, starts, lengths)
    ordered = [words[i] for i in order]
    assert ordered == sorted(words, key=str.encode) and new.tolist() == [i == 0 or ordered[i] != ordered[i - 1] for i in range(len(ordered))]


def test_a_slice_has_a_row_for_each_word_and_language():
    texts = pa.table({"lang": ["b", "a", "b", "a"], "source": pa.array([2, 1, 1, 1], pa.int64()), "text": [b"x y x", b"x", b"y", b"x x"]})
    rows = [r for batch in sd.slice_counts(texts) for r in batch.to_pylist()]
    assert {(r["lang"], r["term"]): (r["sources"], r["counts"], r["docs"]) for r in rows} == {("a", "x"): ([1], [3], [2]), ("b", "x"): ([2], [2], [1]), ("b", "y"): ([1, 2], [1, 1], [1, 1])}
