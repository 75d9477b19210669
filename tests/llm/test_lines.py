import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import line_templates as lt

SCHEMA = "doc_id long, text string, doc long, tokens string, n_lines int"
BIG = 2**63 - 1


def tokens_of(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def masked(tokens):
    return [lt.WILD.decode() if re.search("[0-9]", t) else t for t in tokens]


def brute(rows, rule=lt.Rule()):
    """Kept text of each row, by loops over all lines."""
    standing, places = defaultdict(set), []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            tokens = tokens_of(line)
            short = len(tokens) < rule.min_tokens
            if not tokens or (short and not rule.every):
                continue
            m = masked(tokens)
            m = tuple(tokens if short or set(m) == {"<*>"} else m)
            long = rule.every and rule.long_documents and (len(tokens) >= rule.long_tokens or (short and len(" ".join(m).encode()) >= rule.long_bytes))
            places.append((i, t or "", n, m, rule.long_documents if long else rule.min_documents, short or set(masked(tokens)) == {"<*>"}))
            standing[m, places[-1][5]].add(t or "")
    support = Counter()
    for (m, own), texts in standing.items():
        if not own:
            for k, w in enumerate(m):
                support[len(m), m[: rule.depth], k, w] += len(texts)

    def template(m, own):
        if own:
            return m
        s = [support[len(m), m[: rule.depth], k, w] for k, w in enumerate(m)]
        level = sorted(s, reverse=True)[len(m) - int((1 - rule.agree) * len(m)) - 1]
        out = tuple(w if x >= max(rule.min_documents, rule.rare * level) else "<*>" for w, x in zip(m, s))
        return out if level >= rule.min_documents and sum(w != "<*>" for w in out[rule.depth :]) >= rule.least_common else m

    groups = defaultdict(list)
    for i, t, n, m, least, own in places:
        groups[template(m, own)].append((BIG if i is None else i, n, t, least))
    keep = {}
    for k, found in groups.items():
        if len({t for _, _, t, _ in found}) >= min(x[3] for x in found):
            _, n, t, _ = min(found)
            keep[k] = (t, n)
    gone = {(i, t, n) for i, t, n, m, _, own in places if (k := template(m, own)) in keep and keep[k] != (t, n)}
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, t, n) not in gone)) for i, t in rows]


def compare(spark, rows, rule=lt.Rule()):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    out = lt.deduplicated(docs, rule)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(brute(rows, rule), key=str)


def test_boilerplate_goes_and_first_stays(spark):
    foot = "All rights reserved by us"
    rows = [(i, f"{'abcdefgh'[i]}{'bcdefghi'[i]} {'stuvwxyz'[i]} own words\n{foot}\nUser {i} logged in at 10:{i:02d}") for i in range(1, 6)]
    rows += [(20, None), (21, ""), (None, f"{foot}\nonly here it says"), (22, f"{foot}"), (22, f"{foot}"), (23, "\n\n")]
    compare(spark, rows)
    kept = {r.doc_id: r.text for r in lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA), emptied=False).collect() if r.doc_id is not None}
    assert foot in kept[1] and foot not in kept[2] and 22 not in kept and kept[21] == ""


def test_exact_copies_are_one_text(spark):
    same = "This line is in every copy here\nand so is this other one"
    rows = [(i, same) for i in range(50)]
    compare(spark, rows)
    assert {r.text for r in lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)).collect()} == {same}


def test_variable_fields_become_wildcards(spark):
    rows = [(i, f"the job of user {name} has failed with an error today\nunique {name} words follow in this line") for i, name in enumerate("ann bob cyd dan eve".split())]
    compare(spark, rows)


def test_empty_table(spark):
    assert lt.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rule", [lt.Rule(), lt.Rule(every=True), lt.Rule(every=True, long_documents=None, rare=0.3, agree=0.6, least_common=2)])
def test_driver_table_against_brute_force(spark, sf, rule):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    compare(spark, [(r.doc_id, r.text) for r in docs.collect()], rule)


def test_likeness_does_not_chain(spark):
    """Lines that each differ from the one before in one word: all that go agree with a template in 15 of 20 places."""
    word = lambda i, k: f"{'ab'[i >= k]}{'cdefghijklmnopqrstuvwxyz'[k]}"
    rows = [(i, " ".join(word(i, k) if k > 2 else word(0, k + 4) for k in range(20))) for i in range(20)]
    compare(spark, rows)
    kept = [r.text for r in lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA), emptied=False).collect()]
    near = lambda a, b: sum(x == y for x, y in zip(a.split(), b.split())) >= 15
    assert len(kept) >= 4 and all(any(near(t, k) for k in kept) for _, t in rows)
    # Further apart than a template is wide: nothing goes.
    apart = [(i, " ".join(f"{'abcdefgh'[(i + k) % 8]}{k % 3 * 'x'}{'yz'[i > k]}" if k > 2 else "lead" for k in range(20))) for i in range(8)]
    compare(spark, apart)
    assert lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in apart], SCHEMA), emptied=False).count() == 8


def test_crowded_leaves_are_counted_by_spark(spark, monkeypatch):
    """A leaf beyond what a task holds has the same templates."""
    monkeypatch.setattr(lt, "CROWDED", 50)
    rows = [(i, f"one two three {'xyzuvw'[i % 6]} middle word{'abcdefgh'[i // 6]} of all ends here now") for i in range(48)]
    compare(spark, rows)
    assert len(lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA), emptied=False).collect()) == 1
    compare(spark, rows + [(100 + i, f"a b c the other {x} line stands here {i} times and more") for i, x in enumerate("pqrst")])


def test_words_are_told_by_their_support():
    lines = [x.encode() for x in ("a b c d e f g h i j", "a b c d e f g h i x", "a b c d e f g h i y", "a b c d q f g h i z", "a b c k l m n o p j")]
    support = lt.supports(np.zeros(5, int), np.array([1, 1, 1, 2, 1]), lt.numbered(lines))
    assert support[0].tolist() == [6, 6, 6, 5, 3, 5, 5, 5, 5, 2] and support[3].tolist() == [6, 6, 6, 5, 2, 5, 5, 5, 5, 2]
    assert lt.templates_of(lines, support, lt.Rule()) == [b"a b c d e f g h i <*>"] * 3 + [b"a b c d <*> f g h i <*>", None]


@pytest.mark.parametrize("n", [64, 65, 5000])
def test_one_template_keeps_one_line_wherever_it_varies(spark, n):
    """Whatever their number, and wherever behind the leading tokens the varying word stands."""
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    words = "the same three lead many equal words and then it ends".split()
    rows = []
    for place in range(lt.Rule.depth, len(words)) if n < 5000 else (lt.Rule.depth, len(words) - 1):
        for i in range(n):
            rows.append((place * 10000 + i, " ".join([*words[: lt.Rule.depth - 1], f"of{name(place)}", *words[lt.Rule.depth : place], name(i) + "x", *words[place + 1 :]])))
    kept = [r.doc_id for r in lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA), emptied=False).collect()]
    assert sorted(kept) == sorted({i // 10000 * 10000 for i, _ in rows})


def test_crowded_buckets_of_unlike_lines(spark, monkeypatch):
    """Lines of one leaf that share a segment and little else, some of them of templates, in chunks of a few."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    rows = [(i, " ".join(["in the end", word(), word(), "of all things", word(), word(), word(), word()])) for i in range(80)]
    rows += [(1000 + i, f"in the end {word()} one template of all things that is the same") for i in range(30)]
    rows += [(2000 + i, f"in the end one {'xyz'[i % 3]} of all things here {word()} still the same") for i in range(30)]
    r.shuffle(rows)
    monkeypatch.setattr(lt, "CROWDED", 300)
    compare(spark, rows)


def test_awkward_tables(spark):
    """Clashing column names, repeated rows, a text of very many lines, and no rows."""
    foot = "this line stands at the foot of all pages"
    many = "\n".join(f"line number {'abcdefghij'[i % 10]} {i} of the long text" for i in range(200_000)) + "\n" + foot
    rows = [(1, f"a\n{foot}", "p", "q"), (2, f"b\n{foot}", "p", "q"), (2, f"b\n{foot}", "p", "q"), (3, many, "p", "q"), (None, f"c\n{foot}", None, None), (4, None, "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string, __DROPPED string")
    out = lt.deduplicated(docs)
    got = sorted(((r.doc_id, r.text if r.doc_id != 3 else r.text.count("\n")) for r in out.collect()), key=str)
    assert out.columns == docs.columns and got == sorted([(1, f"a\n{foot}"), (2, "b"), (2, "b"), (3, 199_999), (None, "c"), (4, None)], key=str)


def test_varying_endings_meet_in_leaves_of_any_size(spark, monkeypatch):
    """Lines of a crowded leaf whose last tokens vary are one template, as in a small leaf."""
    names = [f"{a}{b}" for a in "abcdefghij" for b in "abcdefgh"]
    rows = [(i, f"the same three lead {x} many equal words and then ends {x}y") for i, x in enumerate(names)]
    rows += [(100 + i, f"the same three {x} only {x}k some {x}l few {x}m of {x}n words {x}o") for i, x in enumerate(names)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    for crowded in (5, 600, 1 << 22):
        monkeypatch.setattr(lt, "CROWDED", crowded)
        compare(spark, rows)
        kept = {r.doc_id for r in lt.deduplicated(docs, emptied=False).collect()}
        assert kept == {0, *(100 + i for i in range(len(names)))}


def test_short_and_all_number_lines_need_their_own_wording(spark):
    rows = [(i, f"Thor the haan {x}.\n{x} said so\n{i} {i + 1} {i + 2}\n7 8 9\nTurn to page {i} now") for i, x in enumerate("eaesing eron for mern".split())]
    got = {r.doc_id: r.text for r in lt.deduplicated(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)).collect()}
    assert got == {i: t if i == 0 else "\n".join(t.split("\n")[:3]) for i, t in rows}


def test_every_line_counts(spark):
    """Short and unspaced lines go from the third text on or stay, long ones go from the second."""
    long, unspaced = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(52)), "漢字" * 60
    rows = [(1, f"Les.\n{long}\nown\nand one\n短い行"), (2, f"Les.\n{long}\n{unspaced}\n\nand one\n短い行"), (3, f"Les.\n{unspaced}\nhere\n\n短い行"), (4, "5\n\n6")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in lt.deduplicated(docs, lt.Rule(every=True)).collect()}
    assert got == {1: rows[0][1], 2: f"{unspaced}\n\nand one", 3: "here\n", 4: "5\n\n6"}
