import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import language_id as li
from quillon.llm import queries


def brute_subwords(text):
    """Buckets of a text's subwords, one at a time."""
    points, low = [0], text.lower()
    for c in low:
        p = ord(c) if c.isalpha() else 0
        if p or points[-1]:
            points.append(p)
    points += [0] * 3
    out = Counter()
    ends = len(points) - 3
    for i in range(ends):
        for n in li.SUBWORDS:
            gram = points[i : i + n]
            if not any(gram[:2]) or 0 in gram[1:-1]:
                continue
            h = sum(p * int(m) for p, m in zip(gram, li.PLACES)) % 2**32
            h = (h + n) % 2**32
            out[((h ^ (h >> 15)) * int(li.MIX)) % 2**32 >> (32 - li.BITS)] += 1
    return out


def counted(texts):
    out = [Counter() for _ in texts]
    for n, b in li.subwords(texts):
        for i, x in zip(n.tolist(), b.tolist()):
            out[i][x] += 1
    return out


TEXTS = ["", "a", "Ab, cd!", "...", "!x!", "The end.", "Straße ÄÖÜ", "日本語 テスト", "a b  c\n\nd", "İstanbul Σ", "1 2 3", "word" * 30, "x." * 40]


def test_subwords_equal_loops():
    assert counted(TEXTS) == [brute_subwords(x) for x in TEXTS]


@pytest.mark.parametrize("piece", [1, 2, 7, 50])
def test_pieces_lose_nothing(monkeypatch, piece):
    r = random.Random(piece)
    texts = TEXTS + ["".join(r.choice("abc .,é") for _ in range(r.randint(0, 200))) for _ in range(30)]
    want = [brute_subwords(x) for x in texts]
    monkeypatch.setattr(li, "PIECE", piece)
    assert counted(texts) == want


def test_scores_equal_loops():
    model = li.Model.fresh(["de", "en", "fr"], 4)
    model.weights[:] = np.random.default_rng(1).normal(size=model.weights.shape) * 30
    model.bias[:] = [0.1, -0.2, 0.3]
    got = softmaxes = li.softmax(model.logits(TEXTS))
    for text, p in zip(TEXTS, softmaxes):
        bag = brute_subwords(text)
        mean = sum((n * model.embeddings[b].astype(float) for b, n in bag.items()), np.zeros(li.DIMS)) / max(1, sum(bag.values()))
        z = mean @ model.weights + model.bias
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(p, np.array(e) / sum(e), atol=1e-4)
    assert got.shape == (len(TEXTS), 3)
    for (rows, share), text in zip(li.bags(TEXTS), TEXTS):
        bag = brute_subwords(text)
        assert rows.tolist() == sorted(bag) and np.allclose(share, [bag[b] / sum(bag.values()) for b in sorted(bag)])


def test_calibration_brings_scores_to_accuracy():
    """Labels that disagree one time in five with the words: scores come near 0.8 and the errors asked for hold."""
    r = random.Random(2)
    texts, labels = [], []
    for _ in range(600):
        k = r.randrange(2)
        texts.append(" ".join(r.choice((["aba", "bab", "abba"], ["xyx", "yxy", "xyyx"])[k]) for _ in range(30)))
        labels.append("pq"[k if r.random() < 0.8 else 1 - k])
    model = li.train(texts, labels, epochs=4, most_errors=0.5)
    _, score = model.scores(texts)
    assert 0.7 < score.mean() < 0.9 and (score >= model.least).mean() > 0.9
    assert li.train(texts, labels, epochs=4, most_errors=0.0).least > score.mean() - 0.1


def test_held_out_accuracy(spark, sf):
    d = sf.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op12_language(spark, d).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.97
    sure = [r for r in out if r.accepted]
    assert len(sure) / len(out) > 0.9 and sum(r.lang_pred == truth[r.doc_id] for r in sure) / len(sure) > 0.99
    assert {(r.doc_id, r.lang_pred, r.score) for r in queries.op12_language(spark, d).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in got}


SCHEMA = "doc_id long, text string, lang string, source string, score string, Accepted int"


def test_awkward_tables(spark):
    rows = [(i, f"the words of a text {'abcdefghijklm'[i % 13]}", "en", None, "s", 1) for i in range(40)]
    rows += [(100 + i, f"der Text hat große Wörter {'abcdefghijklm'[i % 13]}", "de", None, "s", 1) for i in range(40)]
    rows += [(200, None, "en", None, "s", 1), (201, "", "en", None, "s", 1), (202, "123 !?", "fr", None, "s", 1), (203, "der Text", None, None, "s", 1), (None, "the text of words", "en", None, "s", 1)]
    rows += [(204, "the words of " * 300_000, None, None, "s", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    model = li.learnt(docs, ~li.held_out())
    assert model.languages == ["de", "en"]
    out = li.identified(docs, model)
    assert out.columns == ["lang_pred", "score", "accepted", "doc_id", "text", "lang", "source"] and out.count() == len(rows)
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert [got[i] for i in (0, 100, 200, 201, 202, 203, 204, None)] == ["en", "de", "und", "und", "und", "de", "en", "en"]
    empty = spark.createDataFrame([], SCHEMA)
    assert li.learnt(empty, ~li.held_out()) is None and li.identified(empty, None).collect() == []
    assert {(r.lang_pred, r.score, r.accepted) for r in li.identified(docs, None).collect()} == {("und", 0.0, False)}
    one = li.learnt(docs.filter("lang = 'en'"), ~li.held_out())
    assert {r.lang_pred for r in li.identified(docs.filter("doc_id = 100"), one).collect()} == {"en"}


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100 + "abcdefg"[i % 7], "en" if i % 10 else "de") for i in range(300)], "doc_id long, text string, lang string")
    seen = []
    li_train, li.train = li.train, lambda texts, labels, **_: seen.append((len(texts), Counter(labels)))
    try:
        li.learnt(docs, ~li.held_out(), each=30, sample=45, sample_bytes=1 << 20)
        li.learnt(docs, ~li.held_out(), sample_bytes=1010)
    finally:
        li.train = li_train
    assert seen[0][0] <= 45 and seen[0][1]["en"] <= 30 and seen[0][1]["de"] >= 15 and seen[1][0] == 10
