from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from quillon.llm import near_copies as nc
from quillon.llm.simhash_pivots import fingerprint

SCHEMA = "doc_id long, text string, source string"


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts):
    """Links of similarity 0.8 or more, with similarity and differing bits, and each text's least linked number."""
    sets, label, found = [shingles(t) for t in texts], list(range(len(texts))), []
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
            a, b = fingerprint(texts[i].encode(), 5), fingerprint(texts[j].encode(), 5)
            found.append((both / (len(sets[i] | sets[j]) or 1), ((a ^ b) & (2**64 - 1)).bit_count()))
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return found, label


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_copies_of_each_band_are_found(spark, monkeypatch, tile):
    """No exact copies: words of a text are changed at some places, for similarities about 0.8."""
    monkeypatch.setattr(nc, "TILE", tile)
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = ["", "one two", "One  TWO", "one two three", "one two three four five"]
    for size in (20, 60, 200, 500):
        for changes in range(0, 12):
            base = list(r.choice(vocabulary, size))
            copy = list(base)
            for at in r.choice(size, changes % 4 * size // 200 + 1, replace=False):
                copy[at] = "changed"
            texts += [" ".join(base), " ".join(copy)]
    base = list(r.choice(vocabulary, 120))
    for k in range(40):  # a group whose members are near copies of one text, and of some others
        copy = list(base)
        copy[3 * k], copy[(3 * k + 50) % 120] = f"x{k}", f"y{k}"
        texts.append(" ".join(copy))
    found, label = brute(texts)
    bands = Counter(min(int(20 * s), 19) for s, _ in found)
    assert all(bands[b] for b in (16, 17, 18, 19)) and sum(bits > 3 for _, bits in found) > 20
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: x.component_id for x in nc.near_copies(docs, 5, 3).collect()}
    assert got == dict(enumerate(label))
    kept = {x.doc_id for x in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}
    assert kept == set(label)


def test_long_texts_that_share_a_key_are_not_verified(spark):
    """Before, 512 bits were too few for long texts: the sets of all that shared one leading shingle were shuffled for each pair."""
    r = np.random.default_rng(8)
    base = r.integers(1, 2**62, 5000).astype(np.uint64)
    sizes = [40, 500, 513, 1025, 1300, 2600, 5000]
    sets = [np.unique(np.r_[base[:1], r.integers(1, 2**62, n).astype(np.uint64)]) for n in sizes for _ in range(3)]
    # Similar pairs on both sides of a power of two, as unlike as they may be.
    similar = [(np.unique(base[:n]), np.unique(base[: -(-4 * n // 5)])) for n in (60, 520, 600, 1030, 1100, 2500, 5000)]
    every = [*sets, *[x for pair in similar for x in pair]]
    sig = [nc.signature(x) for x in every]
    distinct = spark.createDataFrame([(s, len(x), nc.sketch(x).tolist()) for s, x in dict(zip(sig, every)).items()], "sig long, n long, sketch array<long>")
    pairs = spark.createDataFrame([(a, b) for a in sig for b in sig if a < b], "a long, b long")
    got = {frozenset((x.a, x.b)) for x in nc.plausible(pairs, distinct).collect()}
    assert {frozenset(map(nc.signature, pair)) for pair in similar} <= got
    # The sets that share one shingle of all are far apart.
    unlike = set(sig[: len(sets)])
    assert not [x for x in got if x <= unlike]


@pytest.mark.parametrize("tile", [3, 1024])
def test_keys_are_settled_within_a_task_or_left_whole(spark, monkeypatch, tile):
    """All pairs of different components of a key, once keys go over several tasks, once keys are larger than a tile."""
    monkeypatch.setattr(nc, "TILE", tile)
    r = np.random.default_rng(3)
    rows = [(key, 100, 1000 * key + i if key % 3 else i, 0, root) for key in range(-40, 40) for i, root in enumerate(r.integers(0, 1 + key % 4, abs(key) % 12 + (300 if key == 7 else 0)).tolist())]
    placed = spark.createDataFrame(rows, "key long, n long, sig long, at long, root long")
    of = {}
    for key, _, sig, _, root in rows:
        of.setdefault(key, []).append((sig, root))
    expected = {frozenset((a, b)) for group in of.values() for (a, x), (b, y) in combinations(group, 2) if x != y}
    assert expected and {frozenset((x.a, x.b)) for x in nc.pairs_apart(placed).collect()} == expected


def test_last_round_alone_finds_the_links(spark, monkeypatch):
    """With one first key only, most links are left to the round over all keys."""
    monkeypatch.setattr(nc, "FIRST_KEYS", 1)
    r = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(40):
        base = list(r.choice(vocabulary, 150))
        for _ in range(3):
            copy = list(base)
            for at in r.choice(150, 2, replace=False):
                copy[at] = f"c{r.integers(10**9)}"
            texts.append(" ".join(copy))
    _, label = brute(texts)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    assert {x.doc_id: x.component_id for x in nc.near_copies(docs, 5, 3).collect()} == dict(enumerate(label))


def test_the_sets_of_long_unlike_texts_are_not_shuffled(spark, monkeypatch):
    """40 texts of 1,500 words that share one rare phrase: their sets came to 11 KB a pair before."""
    r = np.random.default_rng(11)
    texts = [" ".join(["a phrase that they share", *[f"v{x}" for x in r.integers(0, 10**9, 1500)]]) for _ in range(40)]
    read = []
    real = nc.texts_of

    def counted(docs, id_col, text_col):
        read.append(1)
        return real(docs, id_col, text_col)

    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(nc, "texts_of", counted)
    got = nc.near_copies(docs, 5, 3).collect()
    assert all(x.doc_id == x.component_id for x in got) and len(got) == 40
    assert len(read) == 1  # by ``described``: no text is read again to verify
