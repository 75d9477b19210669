"""Full-text search over items with column-weighted BM25.

An index is three tables: items (path, title, body, tags and metadata, and length, the number of an
item's tokens), postings (term, path, field, positions, length) in the order of their terms, so that
a query's scan skips row groups of other terms, and counts (documents, words), a row for each
segment. A query is text (``match``) or built from the classes below. The number of documents,
their mean length and a term's document count are those of the whole index, whatever filters follow.

A stored index grows by segments: a change set adds one with the postings of its own items and the
paths that it replaces or deletes. What a later segment replaces is taken off as a query reads the
few postings of its terms. Segments of about one size are merged in place, into one that covers them.
A stored index also has the trigrams of its texts, by which substrings are found.

Its postings lie in blocks of documents of about one length, and a table of blocks holds for each
term and block the number of documents, the most hits and the least length. The best hits of a
query of words are looked for in the blocks that can hold them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import analyze
from quillon.operators import graph, incremental
from quillon.plans.tables import BROADCAST_ROWS, freed, ranked, scratch, small, unwritten, within_budget, written

WEIGHTS = {"title": 2.0, "body": 1.0, "tags": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CONTEXT_HITS, CONTEXT_SEEDS, CONTEXT_DEPTH = 20, 3, 2


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Prefix:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Phrase:
    text: str
    field: str | None = None


@dataclass(frozen=True)
class Near:
    """Two terms in one field with at most ``gap`` tokens between them."""

    left: str
    right: str
    gap: int = 10


@dataclass(frozen=True)
class Words:
    """A phrase: strings and whether each is a beginning of words only; each becomes as many words as the analyser makes of it."""

    parts: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class Group:
    """A phrase, or phrases near each other with at most ``gap`` tokens between, in one of ``fields`` (None: any).

    ``first``: the phrase stands at the field's start.
    """

    phrases: tuple[Words, ...]
    gap: int = 10
    fields: frozenset[str] | None = None
    first: bool = False


@dataclass(frozen=True)
class Nothing:
    """Matches no document."""


@dataclass(frozen=True, init=False)
class All:
    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True, init=False)
class Any:
    parts: tuple

    def __init__(self, *parts):
        object.__setattr__(self, "parts", parts)


@dataclass(frozen=True)
class Without:
    """What matches ``wanted`` and not ``unwanted``; the latter adds nothing to the score."""

    wanted: object
    unwanted: object


def words(text: str) -> All:
    """All words of a plain text."""
    return All(*[Term(w) for w in text.split()])


@dataclass(frozen=True)
class Filter:
    """Equality on metadata (null never matches), a tier ceiling, then limit (None: all hits), then token budget."""

    type: str | None = None
    workspace: str | None = None
    visibility: str | None = None
    scope: str | None = None
    tier: int | None = None
    limit: int | None = None
    budget: int | None = None

    def equals(self) -> dict[str, str]:
        return {n: v for n in ("type", "workspace", "visibility", "scope") if (v := getattr(self, n)) is not None}

    def condition(self) -> Column:
        out = F.lit(True)
        for name, value in self.equals().items():
            out &= F.col(name) == value
        return out if self.tier is None else out & (F.col("tier") <= self.tier)

    def takes_all(self) -> bool:
        return not self.equals() and self.tier is None


def _analysed(items: DataFrame, analyser: str) -> DataFrame:
    """``items`` with the terms of each field in t_<field>, and length."""
    run = analyze.ANALYSERS[analyser]
    tags = F.array_join("tags", " ") if "tags" in items.columns else F.lit("")
    texts = {"title": F.col("title"), "body": F.col("body"), "tags": tags}
    x = items.drop("length").select("*", *[run(texts[n]).alias(f"t_{n}") for n in WEIGHTS])
    return x.withColumn("length", sum((F.size(f"t_{n}") for n in WEIGHTS), F.lit(0)).cast("long"))


def _postings(analysed: DataFrame) -> DataFrame:
    """(term, path, field, positions, length): a row for each different term of a field.

    All places of a term in a field stand in one row of the texts, so tokens are grouped batch by
    batch, without a shuffle.
    """
    names = list(WEIGHTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                lists = batch.column(f"t_{name}")
                codes = lists.flatten().dictionary_encode()
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                row = np.repeat(np.arange(len(lists)), np.diff(offsets))
                code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = row * (len(codes.dictionary) + 1) + code
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
                cuts = pa.array(np.append(starts, len(key)).astype(np.int32))
                positions = pa.ListArray.from_arrays(cuts, pa.array((order - offsets[row[order]]).astype(np.int32)))
                at, terms = pa.array(row[order][starts]), codes.dictionary.take(pa.array(code[order][starts]))
                own = [batch.column("path").take(at), pa.array([name] * len(starts), pa.string()), positions, batch.column("length").take(at)]
                yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), *own], ["term", "path", "field", "positions", "length"])

    lists = [F.coalesce(f"t_{n}", F.array().cast("array<string>")).alias(f"t_{n}") for n in names]
    return analysed.select("path", "length", *lists).mapInArrow(run, "term string, path string, field string, positions array<int>, length long")


def _asked(texts: DataFrame, exact: list[str], prefixes: list[str]) -> tuple[DataFrame, int, float]:
    """The stemmed postings of some terms, the number of documents and their mean length, by one pass over the texts that makes no others."""
    names, wanted, begun = list(WEIGHTS), frozenset(exact), tuple(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = words = 0
        for batch in batches:
            rows = []
            for path, *fields in zip(*[batch.column(n).to_pylist() for n in ("path", *names)]):
                own = [analyze.places(x or "", wanted, begun) for x in fields]
                length = sum(n for n, _ in own)
                documents, words = documents + 1, words + length
                rows += [(t, path, name, at, length) for name, (_, found) in zip(names, own) for t, at in found.items()]
            yield made(rows)
        # What a task has read stands in a row without a term.
        yield made([(None, None, None, [documents], words)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64()]
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["term", "path", "field", "positions", "length"])

    tags = F.array_join("tags", " ") if "tags" in texts.columns else F.lit("")
    rows = texts.select("path", "title", "body", tags.alias("tags"))
    both = written(rows.mapInArrow(run, "term string, path string, field string, positions array<int>, length long"), compact=True)
    n, words = both.filter("term is null").agg(F.sum(F.col("positions")[0].cast("long")), F.sum("length")).first()
    return both.filter("term is not null"), n or 0, (words or 0) / n if n else 0.0


GRAM = 3
#: Documents of a block of the trigram index at most, and of their different trigrams, about; one task holds them.
GRAM_BLOCK, GRAMS_HELD = 1024, 1 << 22


def _searched(path: Column | str = "path") -> Column:
    """What a substring is looked for in."""
    return F.lower(F.concat_ws("\n", path, "title", "body"))


def _trigrams(text: str) -> np.ndarray:
    """The different runs of three characters, as numbers of 63 bits."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])


def _grams(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, block, docs): for each block of documents the numbers of those that hold a run of three characters; and (block, number, path).

    Documents that stand together in ``items`` are a block, so no text is shuffled, and a frequent gram has a row a block.
    """
    def made(block: int, paths: list[str], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "block", "docs", "number", "path"]
        n = len(paths)
        none = [pa.nulls(n, pa.string()), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(n), pa.int32()), pa.array(paths, pa.string())], names)
        grams, docs = np.concatenate(found), np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in found])
        order = np.argsort(grams, kind="stable")
        grams, docs = grams[order], docs[order]
        starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(grams))
        for at in range(0, len(starts), 1 << 14):
            first, last = starts[at : at + (1 << 14)], ends[at : at + (1 << 14)]
            g = grams[first]
            text = np.stack([g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, last[-1:]).astype(np.int32) - np.int32(first[0])), pa.array(docs[first[0] : last[-1]]))
            k = len(first)
            own = [pa.array([text[i : i + GRAM] for i in range(0, GRAM * k, GRAM)]), pa.array([block] * k, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*own, pa.nulls(k, pa.int32()), pa.nulls(k, pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, paths, found, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text")):
                paths.append(path)
                found.append(_trigrams(text.as_py()))
                held += len(found[-1])
                if len(paths) == GRAM_BLOCK or held >= GRAMS_HELD:
                    yield from made(block, paths, found)
                    block, paths, found, held = block + 1, [], [], 0
        if paths:
            yield from made(block, paths, found)

    both = written(items.select("path", _searched().alias("text")).mapInArrow(run, "gram string, block long, docs array<int>, number int, path string"))
    return both.filter("gram is not null").select("gram", "block", "docs"), both.filter("path is not null").select("block", "number", "path")


#: Documents of a block of postings, about; steps of a block's lengths in a doubling.
BLOCK, STEPS = 128, 8


def _dealt(items: DataFrame, segment: int) -> Column:
    """The block of a posting, from its length and path: documents of about one length, dealt by a hash of the path.

    The table of lengths has STEPS rows a doubling, however many documents there are.
    """
    step = F.floor(F.log2(F.coalesce("length", F.lit(0)) + 1) * STEPS).cast("int")
    sizes = {r[0]: r[1] for r in items.groupBy(step.alias("step")).count().collect()}
    parts, at = [], segment << 40
    for k in sorted(sizes):
        slots = -(-sizes[k] // BLOCK)
        parts += [F.lit(k), F.struct(F.lit(at).alias("at"), F.lit(slots).cast("long").alias("slots"))]
        at += slots
    if not parts:
        return F.lit(at)
    own = F.create_map(*parts)[step]
    return own["at"] + F.pmod(F.xxhash64("path"), own["slots"])


def _weight(field: Column | str = "field") -> Column:
    of = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    return of[F.col(field) if isinstance(field, str) else field]


def _blocks(postings: DataFrame) -> DataFrame:
    """(term, block, n, f, length): the documents of a term in a block, the most weighted hits and the least length among them."""
    hits = postings.select("term", "block", "path", "length", (_weight() * F.size("positions")).alias("f")).repartitionByRange("term", "block")
    each = hits.groupBy("term", "block", "path").agg(F.sum("f").alias("f"), F.first("length").alias("length"))
    return each.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("f").alias("f"), F.min("length").alias("length")).sortWithinPartitions("term", "block")


def _kept(df: DataFrame, path: str, mode: str = "append") -> None:
    """Adds ``df`` to a table of an index, compressed for the disk rather than for speed."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


#: Ranges of terms in which a large segment's postings are sorted one after the other, words from which on there is one more, and documents whose terms tell the ranges.
PARTS, PART_WORDS, PART_ITEMS = 8, 1 << 20, 500
#: Documents from which on there is one more part of the trigrams.
PART_DOCUMENTS = 1 << 14
#: Bytes of a row group of these ranges before they are sorted.
ROW_GROUP = 8 << 20


def _cuts(items: DataFrame, analyser: str) -> list[str]:
    """The last term of each range but the last one, from some documents: where they lie matters for sizes alone."""
    n, words = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = min(PARTS, 1 + words // PART_WORDS)
    if parts < 2:
        return []
    some = _postings(_analysed(items.sample(min(1.0, PART_ITEMS / n), 7), analyser)).select("term", F.ntile(parts).over(Window.orderBy("term")).alias("part"))
    return sorted({r[0] for r in some.groupBy("part").agg(F.max("term")).filter(F.col("part") < parts).select("max(term)").collect()})


def _parts(postings: DataFrame, cuts: list[str]) -> Iterator[DataFrame]:
    """``postings``, computed once, by ranges of terms; each is deleted when the next is asked for, with what was shuffled of it."""
    spark = postings.sparkSession
    if not cuts:
        yield written(postings)
        return
    part = sum((F.when(F.col("term") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = unwritten(spark)
    # A task writes all ranges at once, in small row groups; otherwise Spark sorts its rows by range, and spills.
    key = "spark.sql.maxConcurrentOutputFileWriters"
    writers = spark.conf.get(key)
    spark.conf.set(key, str(max(len(cuts) + 1, int(writers))))
    try:
        postings.withColumn("part", part).write.partitionBy("part").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(key, writers)
    for r in spark.read.parquet(path).select("part").distinct().orderBy("part").collect():
        yield spark.read.schema(postings.schema).parquet(f"{path}/part={r.part}")
        freed(spark, f"{path}/part={r.part}")


def _counts(items: DataFrame) -> DataFrame:
    """documents, words, and size: how many documents a segment touches."""
    return items.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"), F.count("*").alias("size"))


#: Segments of about one size that ``append`` merges into one.
FAN = 4


@dataclass
class Index:
    items: DataFrame
    analyser: str
    postings: DataFrame
    counts: DataFrame
    #: Whether a scan of the postings is a scan of stored files, and not an analysis of all texts.
    stored: bool = False
    #: Trigrams of a stored index and the documents' paths, for ``substring``.
    grams: DataFrame | None = None
    members: DataFrame | None = None
    #: What a stored index's blocks of postings can hold, of all segments, and whether no document in them was replaced.
    blocks: DataFrame | None = None
    whole: bool = False
    #: The texts of an index that is not stored, from which a search reads its own words alone.
    texts: DataFrame | None = None

    @staticmethod
    def of(items: DataFrame, analyser: str = "stemmed") -> Index:
        """An index that analyses the texts anew for each query; ``write`` and ``read`` it for many of them."""
        x = _analysed(items, analyser)
        plain = x.select(*items.columns, "length") if "length" not in items.columns else x.select(*items.columns)
        return Index(plain, analyser, _postings(x), _counts(plain), texts=items)

    def statistics(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        n, words = self.counts.agg(F.sum("documents"), F.sum("words")).first()
        return n or 0, (words or 0) / n if n else 0.0

    def write(self, path: str) -> None:
        """Stores the index below ``path`` as its first and only segment."""
        self._add_segment(path, 0, self.items, self.analyser, self.postings if self.stored else None)

    @staticmethod
    def _add_segment(path: str, n: int, items: DataFrame, analyser: str, postings: DataFrame | None = None, replaced: DataFrame | None = None, counts: DataFrame | None = None, covers: int | None = None) -> None:
        """Stores ``items`` with their postings (None: those that the analyser finds); without counts theirs.

        At any time the disk holds the tables that are done, and what one step reads and shuffles.
        """
        spark = items.sparkSession
        with scratch(spark):
            # Ranges of paths: hits are looked up in the row groups of theirs. Lengths are found behind the shuffle, once.
            dealt = (items if postings is not None else items.drop("length")).repartitionByRange("path").sortWithinPartitions("path")
            dealt = dealt if postings is not None else _analysed(dealt, analyser).select(*dealt.columns, "length")
            _kept(dealt, f"{path}/items/segment={n}", "error")
            items = spark.read.schema(dealt.schema).parquet(f"{path}/items/segment={n}")
            del dealt
            freed(spark)
            grams, members = _grams(items)
            # Lists of documents take more room in a shuffle than on disk, so a part of the grams goes after another.
            parts = min(PARTS, 1 + items.count() // PART_DOCUMENTS)
            for k in range(parts):
                some = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k)
                _kept(some.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), f"{path}/grams/segment={n}")
                freed(spark)
            _kept(members, f"{path}/members/segment={n}")
        with scratch(spark):
            postings = _postings(_analysed(items, analyser)) if postings is None else postings.drop("block")
            for part in _parts(postings.withColumn("block", _dealt(items, n)), _cuts(items, analyser)):
                # Ranges of terms: a hot term's rows spread over neighbouring files through the block.
                _kept(part.repartitionByRange("term", "block").sortWithinPartitions("term", "block", "path"), f"{path}/postings/segment={n}")
                freed(spark)
                _kept(_blocks(part), f"{path}/blocks/segment={n}")
        if replaced is not None:
            replaced.select("path").distinct().hint("rebalance").write.parquet(f"{path}/replaced/segment={n}")
        # The counts come last: a segment without them is not read, so a failed change changes nothing.
        counts = _counts(items) if counts is None else counts
        counts.withColumn("covers", F.lit(n if covers is None else covers)).coalesce(1).write.parquet(f"{path}/counts/segment={n}")

    @staticmethod
    def segments(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
        """(segment, documents touched, first segment covered) of those that are read, oldest first: what a later one covers is not."""
        rows = spark.read.parquet(f"{path}/counts").select("segment", "covers", "size").distinct().orderBy(F.desc("segment")).collect()
        out, below = [], None
        for r in rows:
            if below is None or r.segment < below:
                out.append((r.segment, r.size, r.covers))
                below = r.covers
        return out[::-1]

    @staticmethod
    def read(spark: SparkSession, path: str, analyser: str = "stemmed", only: list[int] | None = None) -> Index:
        """The stored index as it is now: later changes make segments of their own, which this does not see."""
        live_segments = only or [n for n, *_ in Index.segments(spark, path)]

        def of(name: str, numbers: list[int]) -> DataFrame:
            return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/segment={n}" for n in numbers])

        def live(name: str) -> DataFrame:
            rows = of(name, live_segments)
            if len(live_segments) > 1:
                later = of("replaced", live_segments[1:])
                later = small(later.groupBy("path").agg(F.max("segment").alias("since"))).alias("l")
                rows = rows.alias("r").join(later, (F.col("r.path") == F.col("l.path")) & (F.col("r.segment") < F.col("l.since")), "left_anti")
            return rows.drop("segment")

        return Index(live("items"), analyser, live("postings"), of("counts", live_segments).select("documents", "words"), stored=True, grams=of("grams", live_segments), members=of("members", live_segments), blocks=of("blocks", live_segments).drop("segment"), whole=len(live_segments) == 1)

    def changed(self, upserts: DataFrame, deleted: DataFrame) -> tuple[Index, DataFrame, DataFrame]:
        """The index of the last of each upserted path, the paths that go, and what the counts change by."""
        fresh = Index.of(incremental.applied(self.items.limit(0).drop("length"), upserts, deleted), self.analyser)
        touched = upserts.select("path").unionByName(deleted.select("path")).distinct()
        gone = _counts(self.items.join(touched, "path", "left_semi")).select(F.lit(0).cast("long").alias("size"), (-F.col("documents")).alias("documents"), (-F.col("words")).alias("words"))
        return fresh, touched, fresh.counts.unionByName(gone).agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"))

    def refreshed(self, upserts: DataFrame, deleted: DataFrame) -> Index:
        """The index after a change set: only the upserted items are analysed.

        ``upserts`` has the items' columns and ordinal (the last of a path wins), ``deleted`` paths.
        """
        fresh, touched, counts = self.changed(upserts, deleted)

        def renewed(old: DataFrame, new: DataFrame) -> DataFrame:
            old = old.drop("block")
            return old.join(touched, "path", "left_anti").unionByName(new.select(*old.columns))

        return Index(renewed(self.items, fresh.items), self.analyser, renewed(self.postings, fresh.postings), self.counts.select("documents", "words").unionByName(counts.select("documents", "words")), self.stored)

    def append(self, path: str, upserts: DataFrame, deleted: DataFrame, merge: bool = True) -> Index:
        """Adds a change set to the index that was read from ``path``, as a segment; work grows with the change set.

        A segment's number is claimed by a file that only one of several writers can create, so
        none loses its change; of two that change a path the larger number counts. With ``merge``
        FAN neighbouring segments of about one size then become one, so their number grows with the
        logarithm of the changes. Who has read the index goes on reading what was there.
        """
        spark = self.items.sparkSession
        with scratch(spark):
            fresh, touched, counts = self.changed(upserts, deleted)
            touched = written(touched, compact=True)
            n = _claimed(spark, path, spark.read.parquet(f"{path}/counts").agg(F.max("segment")).first()[0] + 1)
            self._add_segment(path, n, fresh.items, self.analyser, None, touched, counts.withColumn("size", F.lit(touched.count())))
        while merge and Index._merged(spark, path, self.analyser):
            pass
        return Index.read(spark, path, self.analyser)

    @staticmethod
    def _merged(spark: SparkSession, path: str, analyser: str) -> bool:
        """Merges the newest FAN segments whose sizes are within a factor of FAN, behind the first one; whether there were such."""
        found = Index.segments(spark, path)[1:]
        tail = found[-FAN:]
        sizes = [x for _, x, _ in tail]
        if len(tail) < FAN or max(sizes) > FAN * max(1, min(sizes)):
            return False
        numbers = [n for n, *_ in tail]
        n = _claimed(spark, path, spark.read.parquet(f"{path}/counts").agg(F.max("segment")).first()[0] + 1)
        if n != numbers[-1] + 1:
            # Another writer was faster; its segment must not be covered by what does not hold it.
            return False
        both = Index.read(spark, path, analyser, numbers)
        replaced = spark.read.parquet(*[f"{path}/replaced/segment={k}" for k in numbers])
        counts = both.counts.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).withColumn("size", F.lit(sum(sizes)))
        Index._add_segment(path, n, both.items, analyser, both.postings, replaced, counts, covers=tail[0][2])
        return True


def _claimed(spark: SparkSession, path: str, n: int) -> int:
    """The first number from ``n`` on that no other writer has: its file is created only if it is not there."""
    while True:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/claims/{n}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(p):
            return n
        n += 1


def _leaves(q) -> list:
    if isinstance(q, (All, Any)):
        return [x for p in q.parts for x in _leaves(p)]
    if isinstance(q, Without):
        return _leaves(q.wanted) + _leaves(q.unwanted)
    return [q]


def _condition(q, ids: dict[int, list[int]]) -> Column:
    """Whether a document matches, over the columns f0, f1, ... of the leaves."""
    if isinstance(q, All):
        out = F.lit(True)
        for p in q.parts:
            out &= _condition(p, ids)
        return out
    if isinstance(q, Any):
        out = F.lit(False)
        for p in q.parts:
            out |= _condition(p, ids)
        return out
    if isinstance(q, Without):
        return _condition(q.wanted, ids) & ~_condition(q.unwanted, ids)
    out = F.lit(not isinstance(q, Nothing))
    for i in ids[id(q)]:
        out &= F.col(f"f{i}") > 0
    return out


def _active(q, ids: dict[int, list[int]], above: Column) -> dict[int, Column]:
    """For each scored leaf the condition under which it adds to a document's score: that all parts above it match.

    What is unwanted adds nothing.
    """
    if isinstance(q, Without):
        return _active(q.wanted, ids, above & _condition(q, ids))
    if isinstance(q, (All, Any)):
        here = above & _condition(q, ids) if isinstance(q, All) else above
        return {k: v for p in q.parts for k, v in _active(p, ids, here).items()}
    return {id(q): above & _condition(q, ids)}


def _weighted(places: Column) -> Column:
    """The sum of the hits of ``places`` (field, positions), by the weights of their fields."""
    return F.aggregate(places, F.lit(0.0), lambda s, p: s + _weight(p["field"]) * F.size(p["positions"]))


def _positions(term: str, field: str) -> Column:
    """Where a term stands in a field of a document; null if nowhere."""
    return F.get(F.filter("places", lambda p: (p["term"] == term) & (p["field"] == field)), F.lit(0))["positions"]


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _close(positions: Column, partners: Column, gap: int) -> Column:
    """Positions with a partner that has ``gap`` tokens or fewer between."""
    return F.filter(positions, lambda p: F.exists(partners, lambda r: (p != r) & (F.abs(p - r) <= gap + 1)))


def _by_field(found, field: str | None = None) -> Column:
    """Weighted number of the places that ``found`` gives for each field."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        if field in (None, name):
            out += weight * F.coalesce(F.when(found(name).isNotNull(), F.size(found(name))), F.lit(0))
    return out


def _swept(lists: list[np.ndarray], sizes: list[int], gap: int) -> list[list[int]]:
    """Which positions of each phrase stand in a window that has one of every phrase.

    A merged sweep over the sorted lists: a window ends at its last position, and each phrase must
    start no further before than ``gap`` and its own size. After a window the list whose next
    position is smallest goes on.
    """
    out: list[list[int]] = [[] for _ in lists]
    at = [0] * len(lists)
    if not all(len(x) for x in lists):
        return out
    while True:
        end = lists[0][at[0]]
        moved = True
        while moved:
            moved = False
            for i, x in enumerate(lists):
                least = end - sizes[i] - gap
                if x[at[i]] < least:
                    moved = True
                    at[i] += int(np.searchsorted(x[at[i] :], least))
                    if at[i] == len(x):
                        return out
                if x[at[i]] > end:
                    moved, end = True, x[at[i]]
        for i, x in enumerate(lists):
            if not out[i] or out[i][-1] != x[at[i]]:
                out[i].append(int(x[at[i]]))
        following = [x[k + 1] if k + 1 < len(x) else np.inf for k, x in zip(at, lists)]
        i = int(np.argmin(following))
        at[i] += 1
        if at[i] == len(lists[i]):
            return out


def _near(starts: list[Column], sizes: list[int], gap: int) -> Column:
    """The positions of each phrase that are near all others, from where each phrase starts in a field."""

    def run(fields: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in fields:
            yield x.map(lambda lists: _swept([np.asarray(p if p is not None else [], np.int64) for p in lists], sizes, gap))

    return F.pandas_udf(run, "array<array<int>>")(F.array(*[F.coalesce(s, F.array().cast("array<int>")) for s in starts]))


def _group_hits(q: Group, phrases: list[list[tuple[str, bool]]]) -> list[tuple[Column, Column]]:
    """(f, counted) for each phrase of a group."""
    names = [n for n in WEIGHTS if q.fields is None or n in q.fields]

    def places(term: tuple[str, bool], name: str) -> Column:
        found = F.filter("places", lambda p: (p["term"].startswith(term[0]) if term[1] else p["term"] == term[0]) & (p["field"] == name))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda p: p["positions"]))))

    def starts(phrase: list[tuple[str, bool]], name: str) -> Column:
        out = places(phrase[0], name)
        for i, t in enumerate(phrase[1:], 1):
            out = F.array_intersect(out, _shifted(places(t, name), i))
        return F.filter(out, lambda p: p == 0) if q.first else out

    alone = {n: [starts(p, n) for p in phrases] for n in names}
    near = {n: _near(x, [len(p) for p in phrases], q.gap) if len(phrases) > 1 else F.array(*x) for n, x in alone.items()}
    out = []
    for i in range(len(phrases)):
        f = sum((WEIGHTS[n] * F.size(F.get(near[n], F.lit(i))) for n in names), F.lit(0.0))
        counted = sum((F.size(alone[n][i]) for n in names), F.lit(0)) > 0
        out.append((f, counted))
    return out


def _hits(q, terms: list[str]) -> list[tuple[Column, Column]]:
    """(f, counted) for each scored part of a leaf, over a document's places of the query's terms.

    f is the weighted number of hits; documents that are counted give the part's document count.
    """
    field = getattr(q, "field", None)
    here = lambda p: F.lit(True) if field is None else p["field"] == field
    if isinstance(q, Prefix):
        f = _weighted(F.filter("places", lambda p: p["term"].startswith(analyze.folded(q.text)) & here(p)))
        return [(f, f > 0)]
    if isinstance(q, Near):
        def part(x: str, y: str) -> tuple[Column, Column]:
            return _by_field(lambda n: _close(_positions(x, n), _positions(y, n), q.gap)), F.exists("places", lambda p: p["term"] == x)

        return [part(*terms), part(*terms[::-1])]
    if len(terms) < 2:
        f = _weighted(F.filter("places", lambda p: (p["term"] == terms[0]) & here(p))) if terms else F.lit(0.0)
        return [(f, f > 0)]

    # A phrase: places of its first word from which all others follow.
    def starts(name: str) -> Column:
        out = _positions(terms[0], name)
        for i, t in enumerate(terms[1:], 1):
            out = F.array_intersect(out, _shifted(_positions(t, name), i))
        return out

    f = _by_field(starts, field)
    return [(f, f > 0)]


def _idf(total: int, n: Column) -> Column:
    idf = F.log((F.lit(float(total)) - n + 0.5) / (n + 0.5))
    return F.when(idf > 0, idf).otherwise(LEAST_IDF)


def _score(idf: Column, f: Column, mean: float) -> Column:
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0))))


def matches(index: Index, query, known: list[int] | None = None) -> DataFrame:
    """(path, score) of the documents that match ``query``, a text or one of the classes above.

    One scan of the postings of the query's terms gives a row for each document that has any; all
    parts of the query are expressions over that row. ``known``: the document counts of the query's
    words, for a query of nothing else; otherwise they are counted.
    """
    query = _query(query)
    leaves = [q for q in _leaves(query) if not isinstance(q, Nothing)]
    groups = {id(q): [_phrase(p, index.analyser) for p in q.phrases] for q in leaves if isinstance(q, Group)}
    analysed = {id(q): analyze.query_terms(f"{q.left} {q.right}" if isinstance(q, Near) else q.text, index.analyser) for q in leaves if id(q) not in groups}
    found = [t for phrases in groups.values() for p in phrases for t in p]
    exact = sorted({t for q in leaves if not isinstance(q, (Prefix, Group)) for t in analysed[id(q)]} | {t for t, prefix in found if not prefix})
    prefixes = sorted({analyze.folded(q.text) for q in leaves if isinstance(q, Prefix)} | {t for t, prefix in found if prefix})
    if index.texts is not None and index.analyser == "stemmed":
        postings, total, mean = _asked(index.texts, exact, prefixes)
    else:
        wanted = F.col("term").isin(exact) if exact else F.lit(False)
        for p in prefixes:
            wanted |= F.col("term").startswith(p)
        postings, (total, mean) = index.postings.filter(wanted), index.statistics()
    each = postings.groupBy("path").agg(F.collect_list(F.struct("term", "field", "positions")).alias("places"), F.first("length").alias("length"))
    ids, columns = {}, []
    for q in leaves:
        own = _group_hits(q, groups[id(q)]) if id(q) in groups else _hits(q, analysed[id(q)])
        ids[id(q)] = list(range(len(columns), len(columns) + len(own)))
        columns += own
    each = each.select("path", "length", *[f.alias(f"f{i}") for i, (f, _) in enumerate(columns)], *[c.alias(f"c{i}") for i, (_, c) in enumerate(columns)])
    if not index.stored:
        each = written(each, compact=True)
    if not columns:
        return each.select("path", F.lit(0.0).alias("score")).filter(F.lit(False))
    n = known or each.agg(*[F.count_if(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).first()
    ids |= {id(q): [] for q in _leaves(query) if isinstance(q, Nothing)}
    score = F.lit(0.0)
    for q, active in _active(query, ids, F.lit(True)).items():
        for i in ids[q]:
            score += F.when(active & (F.col(f"f{i}") > 0), _score(_idf(total, F.lit(n[i])), F.col(f"f{i}"), mean)).otherwise(0.0)
    return each.filter(_condition(query, ids)).select("path", score.alias("score"))


def _query(query):
    """A query of these classes, from text too."""
    if not isinstance(query, str):
        return query
    from quillon.operators import match

    return match.query(query)


def _phrase(words: Words, analyser: str) -> list[tuple[str, bool]]:
    """The terms of a phrase, and whether each is a beginning only: the last of a string that is one."""
    out: list[tuple[str, bool]] = []
    for text, prefix in words.parts:
        out += [(t, False) for t in analyze.query_terms(text, analyser)]
        if out:
            out[-1] = out[-1][0], prefix
    return out


def _only_words(q, analyser: str) -> list[str] | None:
    """The term of each leaf, in order, if the query is nothing but single words in any field, joined by AND and OR."""
    if isinstance(q, (All, Any)):
        parts = [_only_words(p, analyser) for p in q.parts]
        return None if None in parts else [t for p in parts for t in p]
    if isinstance(q, Term) and q.field is None:
        terms = [(t, False) for t in analyze.query_terms(q.text, analyser)]
    elif isinstance(q, Group) and len(q.phrases) == 1 and q.fields is None and not q.first:
        terms = _phrase(q.phrases[0], analyser)
    else:
        return None
    return [terms[0][0]] if len(terms) == 1 and not terms[0][1] else None


#: Postings of a query's words up to which all are scored, as further jobs would cost more.
SCORED = 1 << 16


def best(index: Index, query, limit: int, scored: int = SCORED) -> DataFrame:
    """(path, score): the first ``limit`` of ``matches``, best first, equal scores by path.

    A query of words on a stored index scores the blocks of postings with the largest bounds first;
    their last hit is what other blocks must be able to reach to be read. A bound is the sum of what
    the words would add to a document with a block's most hits and least length. Other queries, and
    words with no more than ``scored`` postings, score all documents that have the words.
    """
    query, order = _query(query), [F.desc("score"), F.asc("path")]
    terms = _only_words(query, index.analyser) if index.blocks is not None and 0 < limit <= LISTED else None
    if not terms:
        return matches(index, query).orderBy(*order).limit(limit)
    rows = index.blocks.filter(F.col("term").isin(sorted(set(terms))))
    if index.whole:
        counted = rows.groupBy("term").agg(F.sum("n").alias("n"))
    else:
        counted = index.postings.filter(F.col("term").isin(sorted(set(terms)))).select("term", "path").distinct().groupBy("term").agg(F.count("*").alias("n"))
    have = {r.term: r.n for r in counted.collect()}
    known = [have.get(t, 0) for t in terms]
    if sum(have.values()) <= scored:
        return matches(index, query, known).orderBy(*order).limit(limit)
    total, mean = index.statistics()
    reach = [F.coalesce(F.max(F.when(F.col("term") == t, _score(_idf(total, F.lit(n)), F.col("f"), mean))), F.lit(0.0)) for t, n in zip(terms, known)]
    blocks = rows.groupBy("block").agg(*[x.alias(f"f{i}") for i, x in enumerate(reach)], F.max("n").alias("n"))
    ids = {id(q): [i] for i, q in enumerate(_leaves(query))}
    bound = sum((F.col(f"f{i}") for i in range(len(terms))), F.lit(0.0)) * (1 + 1e-9)
    blocks = written(blocks.filter(_condition(query, ids)).select("block", "n", bound.alias("bound")), compact=True)
    first, found = [], 0
    for r in blocks.orderBy(F.desc("bound"), "block").limit(limit).collect():
        if found < 2 * limit:
            first, found = [*first, r.block], found + r.n

    def of(some: list[int]) -> DataFrame:
        return matches(replace(index, postings=index.postings.filter(F.col("block").isin(some))), query, known).orderBy(*order).limit(limit)

    hits = of(first).collect()
    rest = blocks.filter(~F.col("block").isin(first))
    rest = rest.filter(F.col("bound") >= hits[-1].score) if len(hits) == limit else rest
    listed = [r.block for r in rest.select("block").limit(LISTED + 1).collect()]
    spark = index.items.sparkSession
    now = spark.createDataFrame(hits, "path string, score double")
    if not listed:
        return now.orderBy(*order)
    if len(listed) <= LISTED:
        more = of(listed)
    else:
        more = matches(replace(index, postings=index.postings.join(small(rest.select("block")), "block", "left_semi")), query, known)
    return now.unionByName(more).orderBy(*order).limit(limit)


HIT = ["path", "title", "score", "tier", "tokens", "hop_distance", "rank"]


def search(index: Index, query, where: Filter = Filter()) -> DataFrame:
    """Ranked hits; equal scores stand by path."""
    order = [F.desc("score"), F.asc("path")]
    if where.limit is None or not where.takes_all():
        found = matches(index, query)
    else:
        # Only the rows that stay are looked up.
        found = best(index, query, where.limit)
        if where.limit <= LISTED and index.stored:
            # Few hits are looked up by a list of their paths, which skips row groups of others.
            hits = found.collect()
            found = index.items.sparkSession.createDataFrame(hits, "path string, score double")
            index = replace(index, items=index.items.filter(F.col("path").isin([r.path for r in hits])))
        found = F.broadcast(found) if where.limit <= BROADCAST_ROWS else found
    meta = index.items.filter(where.condition()).select("path", "title", "tier", "tokens")
    found = meta.join(found, "path").withColumn("hop_distance", F.lit(0))
    return within_budget(ranked(found, order, where.limit), where.budget).select(*HIT)


def search_batch(index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, path, score, rank): the best ``limit`` documents with all words of each query (query_id, text).

    Many queries share one scan of the postings; scores are those of ``search``. A query's
    candidates are the documents of its rarest word, so it does not meet all those of a frequent
    one. A word that a query repeats counts as often. Queries without words have no hits.
    """
    run = analyze.ANALYSERS[index.analyser]
    asked = queries.select("query_id", F.explode(run(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = written(asked.withColumn("needed", F.count("*").over(Window.partitionBy("query_id"))), compact=True)
    terms = small(written(asked.select("term").distinct(), compact=True))
    found = index.postings.join(terms, "term").groupBy("term", "path").agg(F.sum(_weight() * F.size("positions")).alias("f"), F.first("length").alias("length"))
    found = written(found, compact=True)
    total, mean = index.statistics()
    n = small(written(found.groupBy("term").agg(F.count("*").alias("n")), compact=True))
    scored = found.join(n, "term").select("term", "path", _score(_idf(total, F.col("n")), F.col("f"), mean).alias("s"))
    # A word that no document has leaves its query without candidates.
    known = asked.join(n, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    met = found.select("term", "path").join(small(written(known, compact=True)), "term").select("query_id", "path")
    wanted = met.join(small(asked), "query_id")
    each = wanted.join(scored, ["term", "path"]).groupBy("query_id", "path").agg(F.sum(F.col("s") * F.col("times")).alias("score"), F.count("*").alias("met"), F.first("needed").alias("needed"))
    # Sums differ in their last digits by the order of their parts; equal ones stand by path.
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc("path"))
    return each.filter("met = needed").select("query_id", "path", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= limit)


def candidates(index: Index, text: str) -> DataFrame:
    """(path) of the stored documents that hold all trigrams of ``text``: few more than hold the text.

    Only rows of these grams are read; in each block their lists are intersected, the shortest
    first. Paths that a later segment replaced may be among them.
    """
    low = text.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    rows = index.grams.filter(F.col("gram").isin(grams)).withColumn("n", F.size("docs"))
    lists = rows.groupBy("segment", "block").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "docs"))).alias("x"), F.count_distinct("gram").alias("grams"))
    lists = lists.filter(F.col("grams") == len(grams))
    every = F.aggregate(F.slice("x", 2, 1 << 30), F.col("x")[0]["docs"], lambda left, g: F.array_intersect(left, g["docs"]))
    found = written(lists.select("segment", "block", F.explode(every).alias("number")), compact=True)
    return index.members.join(small(found), ["segment", "block", "number"]).select("path").distinct()


#: Paths that are looked up by a list of them, which skips row groups; more are joined.
LISTED = 1000


def substring(source: Index | DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Items whose path, title or body holds ``text`` of three characters or more, in any case; by path.

    A stored index finds candidates by their trigrams and reads the texts of these alone; from a
    table of items all texts are read.
    """
    items = source if isinstance(source, DataFrame) else source.items
    if len(text) < GRAM:
        items = items.limit(0)
    elif isinstance(source, Index) and source.grams is not None:
        some = written(candidates(source, text), compact=True)
        first = [r.path for r in some.limit(LISTED + 1).collect()]
        items = items.filter(F.col("path").isin(first)) if len(first) <= LISTED else items.join(small(some), "path", "left_semi")
    found = items.filter(_searched().contains(text.lower()))
    zero = found.select("path", "title", F.lit(0.0).alias("score"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("hop_distance"))
    return ranked(zero, [F.asc("path")], limit).select(*HIT)


def context(index: Index, edges: DataFrame, query, where: Filter = Filter()) -> DataFrame:
    """Hits, then the neighbours of the first of them, within a token budget.

    The best CONTEXT_HITS hits come first; neighbours of the first CONTEXT_SEEDS follow by seed,
    distance, tier and path, each item where it first appears. Neighbours are filtered by tier
    only. There is no further limit: ``where.limit`` does not count here.
    """
    hits = written(search(index, query, Filter(**where.equals(), tier=where.tier, limit=CONTEXT_HITS)))
    seeds = hits.filter(F.col("rank") <= CONTEXT_SEEDS).select("path", F.col("rank").alias("seed"))
    reached = graph.neighbours(edges, seeds, CONTEXT_DEPTH)
    meta = index.items.filter(F.lit(True) if where.tier is None else F.col("tier") <= where.tier).select("path", "title", "tier", "tokens")
    near = reached.join(meta, "path").join(hits.select("path"), "path", "left_anti")
    near = near.select("path", "title", (1 / (1 + F.col("depth"))).alias("score"), "tier", "tokens", F.col("depth").alias("hop_distance"), "seed")
    first = near.groupBy("path").agg(F.min_by(F.struct("title", "score", "tier", "tokens", "hop_distance", "seed"), F.struct("seed", "hop_distance", "tier")).alias("x")).select("path", "x.*")
    both = hits.select(*HIT[:-1], F.lit(0).alias("seed"), F.col("rank").alias("at")).unionByName(first.withColumn("at", F.lit(0)))
    order = [F.asc("seed"), F.asc("at"), F.asc("hop_distance"), F.asc("tier"), F.asc("path")]
    return within_budget(ranked(both, order, None), where.budget).select(*HIT)
