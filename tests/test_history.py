"""Commit graphs and trees against loops over random ones."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import history
from quillon.operators.history import History


def graph(seed, n=60, merges=0.25, forks=0.3):
    r, parents = random.Random(seed), {}
    for i in range(n):
        if i == 0 or (i < 5 and r.random() < 0.2):
            parents[f"c{i}"] = []
        else:
            last = i - 1 if r.random() > forks else r.randrange(i)
            own = [f"c{last}"]
            if r.random() < merges:
                own.append(f"c{r.randrange(i)}")
            parents[f"c{i}"] = list(dict.fromkeys(own))
    return parents


def ancestors(parents, *tips):
    seen, todo = set(), [t for t in tips if t in parents]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [p for p in parents[x] if p in parents]
    return seen


def frame(spark, parents):
    return spark.createDataFrame(list(parents.items()), "sha string, parents array<string>")


def shas(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "sha string")


@pytest.mark.parametrize("seed", range(3))
def test_ranges_ancestors_and_bases(spark, seed):
    parents = graph(seed, merges=(0.25, 0.5, 0.05)[seed], forks=(0.3, 0.6, 0.1)[seed])
    h, r = History.of(frame(spark, parents)), random.Random(seed)
    generations = {x.sha: (x.generation, x.place) for x in history.newest_first(h, frame(spark, parents).select("sha")).collect()}
    assert all(generations[c] > generations[p] for c, own in parents.items() for p in own) and len(generations) == len(parents)
    names = list(parents)
    for since, until in [(["c10"], ["c59"]), (["c40", "c33"], ["c59", "c50"]), ([], ["c30"]), (["c59"], ["c59"]), (["c59"], ["c3"]), (["none"], ["c8"])]:
        got = sorted(x.sha for x in h.between(shas(spark, *since), shas(spark, *until)).collect())
        assert got == sorted(ancestors(parents, *until) - ancestors(parents, *since)), (since, until)
    pairs = [(k, *r.sample(names, 2)) for k in range(12)]
    rows = [(k, s, x) for k, *both in pairs for s, x in enumerate(both)]
    got = {}
    for x in h.merge_bases(spark.createDataFrame(rows, "pair int, side int, sha string")).collect():
        got.setdefault(x.pair, set()).add(x.sha)
    for k, a, b in pairs:
        common = ancestors(parents, a) & ancestors(parents, b)
        assert got.get(k, set()) == {c for c in common if not any(c in ancestors(parents, d) and c != d for d in common)}
    found = {}
    for x in h.ancestors(spark.createDataFrame([("one", "c20"), ("two", "c59"), ("two", "c7")], "name string, sha string")).collect():
        found.setdefault(x.name, set()).add(x.sha)
    assert found == {"one": ancestors(parents, "c20"), "two": ancestors(parents, "c59", "c7")}


def bases(parents, left, right):
    common = ancestors(parents, *left) & ancestors(parents, *right)
    return {c for c in common if not any(c in ancestors(parents, d) and c != d for d in common)}


def found_bases(spark, h, pairs):
    rows = [(k, side, x) for k, both in pairs.items() for side, own in enumerate(both) for x in own]
    out = {k: set() for k in pairs}
    for x in h.merge_bases(spark.createDataFrame(rows, "pair int, side int, sha string")).collect():
        assert x.sha not in out[x.pair]
        out[x.pair].add(x.sha)
    return out


def test_merge_bases_walk_no_further_than_the_bases(spark, monkeypatch):
    """Each commit merges the two before, so all are generations of their own; two late ones meet in a few steps, not in all 40."""
    parents = {f"c{i}": [f"c{x}" for x in (i - 1, i - 2) if x >= 0] for i in range(40)}
    h, made = History.of(frame(spark, parents)), []
    plain = history.written
    monkeypatch.setattr(history, "written", lambda *a, **k: made.append(1) or plain(*a, **k))
    assert found_bases(spark, h, {1: (["c39"], ["c37"])}) == {1: {"c37"}} and len(made) <= 3


@pytest.mark.parametrize("walked, broadcast", [(1, 0), (3, 20), (8, 500_000)])
def test_merge_bases_of_several_commits(spark, monkeypatch, walked, broadcast):
    """Sides of several commits, of none that is known, and equal ones, in steps of any number and by shuffles."""
    monkeypatch.setattr(history, "WALKED", walked)
    monkeypatch.setattr(history, "BROADCAST_ROWS", broadcast)
    parents = graph(11, n=50, merges=0.6, forks=0.7)
    h, r, names = History.of(frame(spark, parents)), random.Random(5), list(parents)
    pairs = {k: (r.sample(names, r.randint(1, 3)), r.sample(names, r.randint(1, 3))) for k in range(10)}
    pairs |= {10: (["c49"], ["c49"]), 11: (["c0"], ["c49"]), 12: (["none"], ["c49"]), 13: (["c7", "none"], ["c7"])}
    assert found_bases(spark, h, pairs) == {k: bases(parents, *both) for k, both in pairs.items()}
    assert found_bases(spark, h, {1: (["none"], ["other"])}) == {1: set()}


def test_long_chains_take_few_rounds(spark, monkeypatch, tmp_path):
    """A line of 3000 commits with one fork is three runs; a range at its end never opens the rest."""
    parents = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(3000)} | {"side": ["c1500"], "end": ["c2999", "side"]}
    steps = []
    h = History.of(frame(spark, parents))
    assert h.runs.count() == 4
    h.write(str(tmp_path / "h"))
    h = History.read(spark, str(tmp_path / "h"))
    plain = History._step
    monkeypatch.setattr(History, "_step", lambda *a: steps.append(1) or plain(*a))
    assert h.between(shas(spark, "c2990"), shas(spark, "c2999")).count() == 9 and not steps
    assert h.between(shas(spark, "c2999"), shas(spark, "end")).count() == 2


def files(r, n):
    return {"/".join(r.choice("abcd") for _ in range(r.randint(0, 3))) + f"/f{k}".lstrip() if r.random() < 0.8 else f"f{k}": r.choice("xyz") for k in range(n)}


def stored(trees, paths):
    """The root of a tree of {path: content}, whose trees are added to ``trees``."""
    folders, entries = {}, []
    for path, content in paths.items():
        name, _, rest = path.lstrip("/").partition("/")
        if rest:
            folders.setdefault(name, {})[rest] = content
        else:
            entries.append((name, "blob", f"b{content}"))
    entries += [(n, "tree", stored(trees, own)) for n, own in folders.items()]
    name = "t" + str(abs(hash(tuple(sorted(entries)))))
    trees[name] = entries
    return name


def test_trees(spark):
    r = random.Random(4)
    for _ in range(3):
        trees, before = {}, {p.lstrip("/"): c for p, c in files(r, 30).items()}
        after = {p: (r.choice("xyz") if r.random() < 0.1 else c) for p, c in before.items() if r.random() > 0.1} | {"a/new": "n", "e/f/g": "n"}
        before = {p: c for p, c in before.items() if not any(q.startswith(p + "/") for q in before)}
        after = {p: c for p, c in after.items() if not any(q.startswith(p + "/") for q in after)}
        a, b = stored(trees, before), stored(trees, after)
        frame = spark.createDataFrame([(t, *e) for t, own in trees.items() for e in own], "tree string, name string, kind string, hash string")
        got = {(x.root, x.path): x.hash for x in history.listed(frame, spark.createDataFrame([(a,), (b,)], "root string")).collect()}
        assert got == {(root, p): f"b{c}" for root, own in ((a, before), (b, after)) for p, c in own.items()}
        want = {(p, "added" if p not in before else "deleted" if p not in after else "modified") for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
        assert {(x.path, x.change) for x in history.tree_changes(frame, a, b).collect()} == want
        assert {(x.path, x.change) for x in history.tree_changes(frame, None, b).collect()} == {(p, "added") for p in after}
        assert history.tree_changes(frame, a, a).collect() == []


def test_equal_subtrees_stay_closed(spark):
    """Of a hundred folders one differs: the entries that are read are the root's and that folder's."""
    trees = {}
    before = {f"d{i}/f{k}": "x" for i in range(100) for k in range(20)}
    a, b = stored(trees, before), stored(trees, before | {"d7/f3": "y"})
    # Without the trees of the folders that do not differ nothing is missed.
    own = {t for t in trees if t in (a, b)} | {e[2] for root in (a, b) for e in trees[root] if e[0] == "d7"}
    frame = spark.createDataFrame([(t, *e) for t in own for e in trees[t]], "tree string, name string, kind string, hash string")
    assert [(x.path, x.change, x.level) for x in history.tree_changes(frame, a, b).collect()] == [("d7/f3", "modified", 1)]
    assert frame.filter(F.col("kind") == "blob").count() == 40


def test_three_branches_with_three_bases(spark):
    """Branches that left at different commits fold with their own bases; one that is contained changes nothing."""
    from quillon.operators import merge

    parents = {"a": [], "b": ["a"], "c": ["b"], "x": ["a"], "y": ["b"], "z": ["c"], "m": ["c", "y"]}
    files = {
        "a": {"1": "a", "2": "a", "3": "a", "4": "a"}, "b": {"1": "b", "2": "a", "3": "a", "4": "a"}, "c": {"1": "c", "2": "a", "3": "a", "4": "a", "5": "c"},
        "x": {"1": "a", "2": "x", "3": "a", "4": "a"}, "y": {"1": "b", "2": "a", "3": "y", "4": "a"}, "z": {"1": "c", "2": "a", "3": "a", "5": "z"},
    }
    h = History.of(frame(spark, parents))
    tree = lambda sha: spark.createDataFrame(list(files[sha].items()), "path string, text string")
    got = {r.path: r.text for r in merge.folded_tips(h, ["c", "x", "y", "z", "b"], tree).collect()}
    assert got == {"1": "c", "2": "x", "3": "y", "5": "z"}
    commits = frame(spark, parents).selectExpr("*", "case when sha in ('x', 'b') then 'G' else 'N' end validity", "'human:a' signer", "concat('Change ', sha) message")
    found = merge.unsigned_between(commits, h, shas(spark, "b"), shas(spark, "x", "z", "m"))
    assert sorted(r.subject for r in found.collect()) == ["Change c", "Change y", "Change z"]


def test_bundles_of_a_range(spark, tmp_path):
    from quillon.sources import sinks

    parents = graph(9)
    commits, h = frame(spark, parents), History.of(frame(spark, parents))
    refs = spark.createDataFrame([("sync/one", "c59"), ("main", "c50")], "name string, sha string")
    sinks.export_commits(commits, h, refs, str(tmp_path / "b"), shas(spark, "c40"))
    behind = ancestors(parents, "c40")
    here = commits.filter(F.col("sha").isin(sorted(behind)))
    after, to_merge = sinks.import_commits(here, str(tmp_path / "b"), "sync/one")
    assert sorted(r.sha for r in after.collect()) == sorted(behind | ancestors(parents, "c59", "c50")) and [r.name for r in to_merge.collect()] == ["main"]
    again, _ = sinks.import_commits(after, str(tmp_path / "b"), "main")
    assert again.count() == after.count()
    with pytest.raises(sinks.BadBundle, match="prerequisite"):
        sinks.import_commits(here.limit(0), str(tmp_path / "b"), "main")
