import random
import re

import pytest

from quillon.llm import license_templates as lt

SCHEMA = "doc_id long, text string, score string, labels int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOW))
    places = [(i, label) for phrase, label in lt.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", " \n", "MIT License", "mit-license apache LICENSE", "cc by cc-by CC_BY", "gnu general public license " * 3, "é" * 5 + "mit license",
    "x mit license", "the gnu general public licenses", "Licensed under CC BY-NC 4.0.", "word " * 100000 + "mit license", "mit  mit license", "MİT license",
]


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lt.scanned(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert lt.scanned(docs.limit(0)).collect() == []


def test_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in lt.scanned(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(
    "text, label, accepted",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-notice", True),
        ("licensed under the terms of the gnu general public license", "gpl-notice", True),
        ("licensed beneath the gnu general public license", "gpl-notice", False),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0-notice", True),
        ("licensed under the apache license 3 0", "apache-2.0-notice", False),
        ("Licensed under CC BY-NC 4.0.", "cc-by-notice", True),
        ("Licensed under a CC BY-NC-SA 4.0", "cc-by-notice", True),
        ("Licensed under CC BY x y z 4.0", "cc-by-notice", False),
        ("Released under the MIT License.", "mit-notice", True),
        ("under a MIT license", "mit-notice", False),
    ],
)
def test_templates(text, label, accepted):
    assert (label in lt.Scanner().scan(("a b " + text + " c d").encode())[5].split(",")) is accepted


def test_automaton_takes_the_longest_stretch():
    a = lt.Automaton("<<optional>> x <<end>> a <<any 2>> b <<optional>> c <<end>>")
    assert a.longest(b"x a b c d".split(), 0) == 4
    assert a.longest(b"a 1 2 b d".split(), 0) == 4
    assert a.longest(b"a 1 2 3 b".split(), 0) is None
    assert a.longest(b"a b b b c".split(), 0) == 5


def tree(markup):
    """A template as nested lists: words, numbers (any so many words) and lists (optional)."""
    stack = [[]]
    for part in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if part == "<<optional>>":
            stack.append([])
        elif part == "<<end>>":
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(int(part[6:-2]) if part.startswith("<<any") else part)
    return stack[0]


def ends(nodes, words, at):
    """All places where a match of ``nodes`` from ``at`` can end, by trying everything."""
    if not nodes:
        return {at}
    first, rest = nodes[0], nodes[1:]
    if isinstance(first, int):
        nexts = set(range(at, min(at + first, len(words)) + 1))
    elif isinstance(first, list):
        nexts = {at} | ends(first, words, at)
    else:
        nexts = {at + 1} if at < len(words) and words[at] == first else set()
    return set().union(*[ends(rest, words, n) for n in nexts], set())


def test_automata_equal_trying_everything():
    r = random.Random(2)

    def made(depth=0):
        out = []
        for _ in range(r.randrange(1, 4)):
            kind = r.random()
            out.append(r.choice("ab") if kind < 0.6 or depth > 2 else f"<<any {r.randrange(1, 3)}>>" if kind < 0.75 else f"<<optional>> {made(depth + 1)} <<end>>")
        return " ".join(out)

    for _ in range(1500):
        markup = f"{r.choice(['', '<<any 2>> '])}{made()} c"
        scanner = lt.Scanner({}, {"x": markup})
        words = [r.choice("aabbcd") for _ in range(r.randrange(12))]
        accepted = any(ends(tree(markup), words, i) for i in range(len(words) + 1))
        found = scanner.scan(" ".join(words).encode())
        assert (found[5] == "x") is accepted, (markup, words)


def filled(markup, optional):
    """A text of a template, with or without its optional parts, and words for replaceable ones."""
    def write(nodes):
        for x in nodes:
            if isinstance(x, int):
                yield from ["acme"] * min(x, 2)
            elif isinstance(x, str):
                yield x
            elif optional:
                yield from write(x)

    return " ".join(write(tree(markup)))


@pytest.mark.parametrize("label", lt.TEMPLATES)
def test_whole_texts_and_nothing_less(label):
    """A template's text is accepted whole; one mandatory word less or another one is not."""
    labels = lambda text: set(lt.Scanner().scan(text.encode())[5].split(","))
    for optional in (True, False):
        assert label in labels(f"before {filled(lt.TEMPLATES[label], optional).upper()}. after")
    if label.endswith(("text", "header")):
        words = filled(lt.TEMPLATES[label], False).split()
        for at in (1, len(words) // 2, len(words) - 1):
            if words[at] != "acme":
                assert label not in labels(" ".join([*words[:at], "otherwise", *words[at + 1 :]]))
                assert label not in labels(" ".join(words[:at]))


def test_variants_of_a_license_are_told_apart():
    labels = lambda text: {x for x in lt.Scanner().scan(text.encode())[5].split(",") if x.startswith("bsd")}
    for n in (2, 3, 4):
        assert labels(filled(lt.TEMPLATES[f"bsd-{n}-clause-text"], True)) == {f"bsd-{n}-clause-text"}


def test_awkward_tables(spark):
    long = "word " * 300_000 + filled(lt.TEMPLATES["mit-text"], False)
    rows = [(1, "MIT License", "s", 1), (1, "MIT License", "s", 1), (None, "cc by", None, None), (2, long, "s", 1)]
    got = lt.scanned(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.labels) for r in got if r.doc_id) == [(1, "mit"), (1, "mit"), (2, "mit-text")] and len(got) == 4
    share = next(r.score for r in got if r.doc_id == 2)
    assert share == pytest.approx(len(filled(lt.TEMPLATES["mit-text"], False).split()) / (300_000 + len(filled(lt.TEMPLATES["mit-text"], False).split())))
