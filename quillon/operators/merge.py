"""Three-way merge of documents, field by field, and conflict classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import derive, frontmatter
from quillon.operators.history import History, best_base
from quillon.plans.tables import written

SCALARS = ("title", "type", "scope", "workspace", "visibility", "confidence", "expires")
#: Fields that are taken from ours, whatever theirs has; ``strict`` merges them like scalars.
FROM_OURS = ("actor", "session", "source", "tokens_raw", "tokens", "refs")


def resolved(base: Column, ours: Column, theirs: Column) -> tuple[Column, Column]:
    """The merged value and whether there is a conflict; nulls are values."""
    same, mine, yours = ours.eqNullSafe(theirs), ours.eqNullSafe(base), theirs.eqNullSafe(base)
    return F.when(same | yours, ours).when(mine, theirs), ~(same | mine | yours)


def merged_tags(ours: Column, theirs: Column) -> Column:
    """Ours in their order, then what theirs adds; a deletion on one side does not count."""
    ours, theirs = F.coalesce(ours, F.array()), F.coalesce(theirs, F.array())
    return F.concat(ours, F.array_except(theirs, ours))


def merged_fields(versions: DataFrame, strict: bool = False) -> DataFrame:
    """Merges base, ours and theirs (structs of frontmatter.FIELDS) of each path.

    Returns path, the merged fields, and conflicts (names of fields that could not be merged).
    """
    values, conflicts = {}, []
    side = lambda s: lambda n: F.col(s)[n]
    base, ours, theirs = side("base"), side("ours"), side("theirs")
    for n in (*SCALARS, "body", *(FROM_OURS if strict else ())):
        values[n], bad = resolved(base(n), ours(n), theirs(n))
        conflicts.append(F.when(bad, n))
    for n in () if strict else FROM_OURS:
        values[n] = ours(n)
    values["tags"] = merged_tags(ours("tags"), theirs("tags"))
    values["updated"] = F.greatest(ours("updated"), theirs("updated"))
    fields = [n for n in frontmatter.FIELDS if n != "warnings"]
    return versions.select("path", *[values[n].alias(n) for n in fields], F.array_compact(F.array(*conflicts)).alias("conflicts"))


def trimmed_end(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def merged_texts(texts: DataFrame, marker: str = "<!-- unmerged -->", strict: bool = False) -> DataFrame:
    """(path, merged, conflicts) for whole documents base, ours and theirs.

    A clean merge is the rendered frontmatter, a line end and the body. With a conflict both
    documents are kept in full behind ``marker``, each under its actor; the layout of these lines
    and the marker are this library's own.
    """
    parsed = texts.select("path", "ours", "theirs", *[frontmatter.parsed(F.col(s)).alias(f"__{s}") for s in ("base", "ours", "theirs")])
    fields = merged_fields(parsed.select("path", *[F.col(f"__{s}").alias(s) for s in ("base", "ours", "theirs")]), strict)
    sides = parsed.select("path", "ours", "theirs", *[F.coalesce(F.col(f"__{s}")["actor"], F.lit("unknown")).alias(f"{s}_actor") for s in ("ours", "theirs")])
    clean = F.concat(frontmatter.rendered(F.col), F.lit("\n"), F.col("body"))
    both = [F.concat(F.lit(f"\n<!-- {s}: "), F.col(f"{s}_actor"), F.lit(" -->\n"), trimmed_end(F.col(s)), F.lit("\n")) for s in ("ours", "theirs")]
    kept = F.concat(F.lit(marker + "\n"), *both)
    out = fields.join(sides, "path").select("path", F.when(F.size("conflicts") == 0, clean).otherwise(kept).alias("merged"), "conflicts")
    return out


# Two-letter states of unmerged paths and their classes.
CONFLICTS = {"DU": "modify/delete by ours", "UD": "modify/delete by theirs", "UU": "content", "AA": "add/add", "DD": "delete/delete"}


def conflict_class(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CONFLICTS.items() for x in kv])[code], F.lit("other"))


def modify_beats_delete(conflicts: DataFrame) -> DataFrame:
    """(path, class) → paths to keep, and an inbox item for each that asks to confirm the deletion."""
    kept = conflicts.filter(F.col("class").startswith("modify/delete"))
    ask = kept.select(F.concat(F.lit("inbox/confirm-deletion-of-"), F.regexp_replace("path", "[^A-Za-z0-9]+", "-"), F.lit(".md")).alias("path"), F.lit("ask").alias("action"))
    return kept.select("path", F.lit("keep").alias("action")).unionByName(ask)


# The title of the item that asks about a deletion, and who asks.
QUESTION, RESOLVER = "deletion of %s needs confirmation", "agent:merge-resolver"


def deletion_questions(conflicts: DataFrame, nanos: Column, question: Column, actor: str = RESOLVER) -> DataFrame:
    """(path, text): an inbox document for each conflict (path, class) of a modification and a deletion.

    ``question`` is its body, over path and class; the document is a proposed project state.
    """
    asked = conflicts.filter(F.col("class").startswith("modify/delete"))
    title = F.format_string(QUESTION, "path")
    text = frontmatter.remembered(title, F.lit("project-state"), F.lit(None).cast("string"), F.lit(actor), question)
    return asked.select(derive.inbox_path(title, nanos).alias("path"), text.alias("text"))


def merged_trees(base: DataFrame, ours: DataFrame, theirs: DataFrame, **options) -> DataFrame:
    """(path, text, class) of a three-way merge of trees (path, text).

    Where only one side changed, its state counts, also a deletion. Where both did, equal texts are
    taken, and others are merged. A modification beats a deletion; class then names the deleting
    side as in CONFLICTS, otherwise it is null.
    """
    each = base.select("path", F.col("text").alias("base"))
    for side, name in ((ours, "ours"), (theirs, "theirs")):
        each = each.join(side.select("path", F.col("text").alias(name)), "path", "full")
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    taken = F.when(o.eqNullSafe(t) | t.eqNullSafe(b), o).when(o.eqNullSafe(b), t)
    settled = o.eqNullSafe(t) | t.eqNullSafe(b) | o.eqNullSafe(b)
    none = F.lit(None).cast("string")
    simple = each.filter(settled).select("path", taken.alias("text"), none.alias("class")).filter("text is not null")
    one = each.filter(~settled & (o.isNull() | t.isNull())).select("path", F.coalesce(o, t).alias("text"), F.when(o.isNull(), CONFLICTS["DU"]).otherwise(CONFLICTS["UD"]).alias("class"))
    both = merged_texts(each.filter(~settled & o.isNotNull() & t.isNotNull()), **options).select("path", F.col("merged").alias("text"), none.alias("class"))
    return simple.unionByName(one).unionByName(both)


def folded(base: DataFrame, branches: list[DataFrame], **options) -> DataFrame:
    """Merges (path, text) of each branch into the first, one after the other; the order matters."""
    current = branches[0].select("path", "text")
    for other in branches[1:]:
        current = merged_trees(base, current, other, **options).select("path", "text")
    return current


def folded_tips(history: History, tips: list[str], tree: Callable[[str], DataFrame], **options) -> DataFrame:
    """(path, text) after merging the commits ``tips`` into the first, one after the other, each from its own base.

    ``tree`` gives the files (path, text) of a commit. A base is the best common ancestor of a tip
    and of all that is merged so far (of several the one of the largest generation); without one it
    is an empty tree. A tip that is contained already changes nothing. Each step is written, so the
    plan of a step holds one merge. Tips are branches, a few.
    """
    spark = history.nodes.sparkSession
    current, merged = tree(tips[0]).select("path", "text"), tips[:1]
    for tip in tips[1:]:
        pairs = spark.createDataFrame([(0, 0, x) for x in merged] + [(0, 1, tip)], "pair int, side int, sha string")
        base = best_base(history, history.merge_bases(pairs)).first()
        if base is not None and base.sha == tip:
            continue
        before = tree(base.sha).select("path", "text") if base is not None else current.limit(0)
        current, merged = written(merged_trees(before, current, tree(tip), **options).select("path", "text")), [*merged, tip]
    return current


def unsigned_between(commits: DataFrame, history: History, since: DataFrame, until: DataFrame) -> DataFrame:
    """``unsigned_commits`` of what is reachable from ``until`` (sha) and not from ``since``."""
    return unsigned_commits(commits.join(history.between(since, until), "sha", "left_semi"), since)


def unsigned_commits(commits: DataFrame, since: DataFrame) -> DataFrame:
    """(sha, subject) of commits that are no merges, have no valid signer and are not among ``since``."""
    signed = F.coalesce((F.col("validity") == "G") & (F.col("signer") != ""), F.lit(False))
    out = commits.join(since.select("sha"), "sha", "left_anti").filter((F.size("parents") <= 1) & ~signed)
    return out.select(F.substring("sha", 1, 12).alias("sha"), F.substring_index("message", "\n", 1).alias("subject"))


def last_signers(commits: DataFrame) -> DataFrame:
    """(path, signer) of the latest commit of each path, where its signature is valid."""
    last = commits.groupBy("path").agg(F.max_by(F.struct("validity", "signer"), "ordinal").alias("x"))
    return last.filter((F.col("x.validity") == "G") & (F.col("x.signer") != "")).select("path", F.col("x.signer").alias("signer"))
