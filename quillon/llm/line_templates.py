"""Line deduplication with a tree of log templates.

Fields that vary (tokens with a digit) become wildcards. A tree of fixed depth parses each line by
its number of tokens and its leading tokens to a leaf. Within a leaf, places and words are counted,
and a word that is rare in its place becomes a wildcard too: what is left is the line's template. A
template that recurs in ``min_documents`` different texts or more is boilerplate: it stays where it
stands first and goes everywhere else. Exact copies of a document count as one text and are treated
alike, so they stay copies for a later stage.

How rare a word is, is told by the line itself. A different line weighs as many different texts as
it stands in; the support of a word is the weight of the leaf's lines that have it in its place; and
a line's level is the support that a share ``agree`` of its places reach at least. Below ``rare`` of
the level, or below ``min_documents``, a word is a variable field. So a template is fixed in ``agree``
of its places or more, and any two of its lines agree in all of these: likeness never chains. A line
whose level is below ``min_documents``, or with fewer than ``least_common`` fixed words behind the
leading tokens (so any line of up to ``depth + least_common`` tokens), is its own template.

Lines are counted by their hashes of 128 bits. Texts of lines are looked at again only in leaves
that hold several different lines. A leaf goes to one task up to CROWDED tokens; the words of a
larger one are counted by Spark, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, fresh, small, text_bytes, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """What counts as a line, what as a template, and how often it must recur."""

    #: Different texts in which a template recurs; least tokens of a line that counts.
    min_documents: int = 3
    min_tokens: int = 3
    #: Leading tokens of the tree, and the share of a template's places that are fixed at least.
    depth: int = 3
    agree: float = 0.75
    #: Fixed words behind the leading tokens at least.
    least_common: int = 5
    #: Share of a line's level below which a word is a variable field.
    rare: float = 0.5
    #: Whether lines of fewer tokens count too, as they are.
    every: bool = False
    #: With ``every``: different texts in which a long line recurs (None: no line is long), and what
    #: is long: so many tokens, or so many bytes where there are fewer tokens than count.
    long_documents: int | None = 2
    long_tokens: int = 50
    long_bytes: int = 300

    def is_long(self, tokens: int, size: int) -> bool:
        return self.every and self.long_documents is not None and (tokens >= self.long_tokens or (tokens < self.min_tokens and size >= self.long_bytes))

    def fixed(self, tokens: int) -> int:
        """Places of a template that are fixed at least."""
        return tokens - int((1 - self.agree) * tokens)


#: Tokens of a leaf's different lines that one task counts.
CROWDED = 1 << 22
#: Lines that Python hands on or generalises at a time.
LINES_AT_ONCE = 1 << 15
WILD = b"<*>"
LINE = ["h1", "h2"]


def digests(lines: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """The two halves of the 128-bit hash of each line."""
    found = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(found[:, 0]), pa.array(found[:, 1])


def parsed(docs: DataFrame, rule: Rule, texts: bool = False) -> DataFrame:
    """A row for each line that counts: doc_id, content, line_no, h1, h2, leaf, tokens, least.

    leaf is null where a line is its own template in any case; least is in how many texts it must
    stand. ``texts``: only lines with a leaf, as leaf, h1, h2 and line (masked), those that repeat
    in a batch once.

    Lines are bytes here; splitting and hashing them is several times cheaper in Python than by
    regular expressions of Spark's. A text is cut at line ends as it is read, and its rows go on in
    batches of LINES_AT_ONCE, however many lines it has.
    """
    bounded_batches(docs.sparkSession)
    text = text_or_empty()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(text).alias("content"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has_digit, digest, line_of = re.compile(b"[0-9]").search, xxhash.xxh64_intdigest, re.compile(b"[^\n]*\n?").finditer
        shortest = rule.depth + rule.least_common

        def rows(batch, place, number, lines, leaves, counts, least) -> pa.RecordBatch:
            linked = np.array([x is not None for x in leaves], bool)
            leaf = pa.array(np.array([x or 0 for x in leaves], np.uint64).view(np.int64), mask=~linked)
            if texts:
                return pa.RecordBatch.from_arrays([leaf, *digests(lines), pa.array(lines, pa.binary())], ["leaf", *LINE, "line"])
            own = [batch.column(c).take(pa.array(place, pa.int64())) for c in ("doc_id", "content")]
            names = ["doc_id", "content", "line_no", *LINE, "leaf", "tokens", "least"]
            return pa.RecordBatch.from_arrays([*own, pa.array(number, pa.int32()), *digests(lines), leaf, pa.array(counts, pa.int32()), pa.array(least, pa.int32())], names)

        for batch in batches:
            held, seen = [[] for _ in range(6)], set()
            for k, text in enumerate(batch.column("text")):
                for n, found in enumerate(line_of(text.as_py())):
                    line = found[0]
                    tokens = line.split()
                    short = len(tokens) < rule.min_tokens
                    if not tokens or (short and not rule.every):
                        continue
                    masked = [WILD if has_digit(t) else t for t in tokens] if has_digit(line) else tokens
                    own = short or all(t == WILD for t in masked)
                    line = b" ".join(tokens if own else masked)
                    alone = own or len(tokens) <= shortest or len(tokens) - rule.depth - masked[rule.depth :].count(WILD) < rule.least_common
                    if texts and (alone or line in seen):
                        continue
                    leaf = None if alone else digest(b"%d " % len(tokens) + b" ".join(masked[: rule.depth]))
                    least = rule.long_documents if rule.is_long(len(tokens), len(line)) else rule.min_documents
                    for column, x in zip(held, (k, n, line, leaf, len(tokens), least)):
                        column.append(x)
                    if texts:
                        seen.add(line)
                    if len(held[0]) >= LINES_AT_ONCE:
                        yield rows(batch, *held)
                        held, seen = [[] for _ in range(6)], set()
            yield rows(batch, *held)

    if texts:
        return keyed.select("text").mapInArrow(run, "leaf long, h1 long, h2 long, line binary")
    return keyed.mapInArrow(run, "doc_id long, content long, line_no int, h1 long, h2 long, leaf long, tokens int, least int")


def templates_of(lines: list[bytes], support: np.ndarray, rule: Rule) -> list[bytes | None]:
    """The template of each of some lines of one length from the support of their words; None for a line that is its own."""
    n = support.shape[1]
    k = rule.fixed(n)
    level = np.partition(support, n - k, axis=1)[:, n - k]
    fixed = support >= np.maximum(rule.min_documents, rule.rare * level)[:, None]
    out: list[bytes | None] = [None] * len(lines)
    for i in np.flatnonzero((level >= rule.min_documents) & ~fixed.all(axis=1)):
        tokens = [t if f else WILD for t, f in zip(lines[i].split(b" "), fixed[i])]
        if len(tokens) - rule.depth - tokens[rule.depth :].count(WILD) >= rule.least_common:
            out[i] = b" ".join(tokens)
    return out


def supports(leaf: np.ndarray, weight: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For lines of one length (``numbered``): how much of their leaf has each word in its place."""
    rows, n = tokens.shape
    _, leaf = np.unique(leaf, return_inverse=True)
    words = int(tokens.max(initial=0)) + 1
    key = (leaf[:, None].astype(np.int64) * n + np.arange(n)) * words + tokens
    _, inverse = np.unique(key.ravel(), return_inverse=True)
    return np.bincount(inverse, np.repeat(weight, n))[inverse].reshape(rows, n)


def numbered(lines: list[bytes]) -> np.ndarray:
    """A number for each token of lines of one length, equal for equal tokens."""
    vocabulary: dict[bytes, int] = {}
    flat = [vocabulary.setdefault(t, len(vocabulary)) for line in lines for t in line.split(b" ")]
    return np.array(flat, np.int64).reshape(len(lines), -1)


def with_templates(h1: list[int], h2: list[int], found: list[bytes | None]) -> pa.RecordBatch:
    at = [i for i, t in enumerate(found) if t is not None]
    t1, t2 = digests([found[i] for i in at])
    return pa.RecordBatch.from_arrays([pa.array([h1[i] for i in at], pa.int64()), pa.array([h2[i] for i in at], pa.int64()), t1, t2], [*LINE, "t1", "t2"])


TEMPLATE = "h1 long, h2 long, t1 long, t2 long"


def of_leaves(lines: DataFrame, rule: Rule) -> DataFrame:
    """(h1, h2, t1, t2) for ``lines`` (leaf, h1, h2, line, weight) of leaves that a task can hold."""

    def made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lines = rows.column("line").to_pylist()
        leaf, weight, h1, h2 = (rows.column(c).to_numpy() for c in ("leaf", "weight", *LINE))
        lengths = np.array([x.count(b" ") for x in lines])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            own = [lines[i] for i in at]
            yield with_templates(h1[at].tolist(), h2[at].tolist(), templates_of(own, supports(leaf[at], weight[at], numbered(own)), rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come in the order of their leaf; only the last leaf can go on in the next batch.
            leaf = batch.column("leaf").to_numpy()
            cut = int(np.searchsorted(leaf, leaf[-1]))
            if cut or (held and held[-1].column("leaf")[-1].as_py() != leaf[0]):
                yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from made(pa.Table.from_batches(held))

    return lines.select("leaf", *LINE, "line", "weight").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, TEMPLATE)


def of_crowded(lines: DataFrame, rule: Rule) -> DataFrame:
    """The same for ``lines`` (re-readable) of leaves of any size: Spark counts the words of each place and tells each line."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            columns: list[list[int]] = [[] for _ in range(6)]
            for row in zip(*(batch.column(c).to_pylist() for c in ("leaf", *LINE, "weight", "line"))):
                for place, token in enumerate(row[4].split(b" ")):
                    for column, x in zip(columns, (*row[:4], place, digest(token) - (1 << 63))):
                        column.append(x)
                    if len(columns[0]) >= 8 * LINES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["leaf", *LINE, "weight", "place", "word"])
                        columns = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["leaf", *LINE, "weight", "place", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_pylist() for c in LINE)
            found = []
            for line, of in zip(batch.column("line").to_pylist(), batch.column("support").to_pylist()):
                found += templates_of([line], np.array([[x["support"] for x in sorted(of, key=lambda x: x["place"])]], float), rule)
            yield with_templates(h1, h2, found)

    place = ["leaf", "place", "word"]
    each = lines.select("leaf", *LINE, "weight", "line").mapInArrow(words, "leaf long, h1 long, h2 long, weight long, place long, word long")
    # A line's weight is at least one, so words below min_documents need not be told apart; there are fewer others.
    known = small(written(each.groupBy(*place).agg(F.sum("weight").alias("support")).filter(F.col("support") >= rule.min_documents), compact=True))
    of = each.join(known, place, "left").groupBy(*LINE).agg(F.collect_list(F.struct("place", F.coalesce("support", F.lit(0)).alias("support"))).alias("support"))
    return lines.select(*LINE, "line").join(of, LINE).mapInArrow(run, TEMPLATE)


def templates(docs: DataFrame, lines: DataFrame, rule: Rule) -> DataFrame:
    """(h1, h2, t1, t2) for lines whose template is not just themselves."""
    per = lines.filter("leaf is not null").groupBy("leaf", *LINE).agg(F.count_distinct("content").alias("weight"), F.first("tokens").alias("tokens"))
    leaves = per.groupBy("leaf").agg(F.count("*").alias("different"), F.sum("weight").alias("all"), F.sum("tokens").alias("tokens"))
    leaves = leaves.filter((F.col("different") > 1) & (F.col("all") >= rule.min_documents)).select("leaf", (F.col("tokens") > CROWDED).alias("crowded"))
    shared = written(per.select("leaf", *LINE, "weight").join(leaves, "leaf"), compact=True)
    again = parsed(docs, rule, texts=True).join(small(shared), ["leaf", *LINE])
    again = again.groupBy("leaf", *LINE).agg(F.first("line").alias("line"), F.first("weight").alias("weight"), F.first("crowded").alias("crowded"))
    # Written: both kinds of leaves read it.
    again = written(again, compact=True)
    crowded = again.filter("crowded")
    found = of_leaves(again.filter("not crowded"), rule)
    return found if crowded.isEmpty() else found.unionByName(of_crowded(crowded, rule))


def drops(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, content, dropped): the numbers of the lines that each document loses."""
    lines = written(parsed(docs, rule))
    of = small(written(templates(docs, lines, rule), compact=True))
    lines = lines.select("doc_id", "content", "line_no", *LINE, "least").join(of, LINE, "left")
    lines = lines.select("doc_id", "content", "line_no", "least", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2"))
    once = lines.groupBy("t1", "t2", "content").agg(F.min(F.struct("doc_id", "line_no", "content")).alias("first"), F.min("least").alias("least"))
    recurring = once.groupBy("t1", "t2").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.min("least").alias("least")).filter("texts >= least")
    recurring = small(written(recurring.select("t1", "t2", F.col("first.content").alias("keeper"), F.col("first.line_no").alias("keeper_line")), compact=True))
    gone = lines.join(recurring, ["t1", "t2"]).filter((F.col("content") != F.col("keeper")) | (F.col("line_no") != F.col("keeper_line")))
    return gone.groupBy("doc_id", "content").agg(F.collect_set("line_no").alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    """The text without its dropped lines."""

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, dropped in pairs:
            out = []
            for t, d in zip(texts, dropped):
                if d is not None and len(d):
                    d = set(map(int, d))
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in d)
                out.append(t)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(text, dropped)


def deduplicated(docs: DataFrame, rule: Rule = Rule(), emptied: bool = True, counts: bool = False) -> DataFrame:
    """``docs`` (re-readable) without recurring template lines; columns are those of ``docs``, whatever their names.

    A recurring line stays where it stands first: in the text with the smallest doc_id (null is
    largest), at its smallest line number, and in exact copies of that text. Lines of fewer than
    ``rule.min_tokens`` tokens stay, unless ``rule.every``: then they go where they recur as they
    are, and a long line goes from its ``rule.long_documents``-th text on, as one that repeats a
    passage; ``long_documents=None`` treats it as any other. Of sf0.1's lines that rule alone drops
    112 of the 8,361 that go. In lines of up to ``depth + least_common`` tokens only tokens with
    digits vary. Blank lines and null texts stay, empty texts too. Repeated rows (equal doc_id and
    text) are treated alike and each keep their row. Texts and lines of any length are read whole.
    ``emptied`` keeps documents that lose all their lines, as empty texts; otherwise they go.
    ``counts`` adds n_lines and n_dropped. An empty table gives no rows.
    """
    doc, content, dropped = fresh(docs, "doc"), fresh(docs, "content"), fresh(docs, "dropped")
    gone = drops(docs, rule).select(F.col("doc_id").alias(doc), F.col("content").alias(content), F.col("dropped").alias(dropped))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), content: F.xxhash64(text_or_empty())})
    # Hashing the short lists of dropped lines spares sorting the texts.
    both = keyed.join(gone.hint("shuffle_hash"), [doc, content], "left")
    lost_all = F.col(dropped).isNotNull() & (F.size(dropped) >= F.size(F.split("text", "\n")))
    if not emptied:
        both = both.filter(~lost_all)
    columns = [without(F.col("text"), F.col(dropped)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n_lines = F.size(F.split(text_or_empty(), "\n")).cast("long")
        columns += [n_lines.alias("n_lines"), F.coalesce(F.size(dropped), F.lit(0)).cast("long").alias("n_dropped")]
    return both.select(*columns)
