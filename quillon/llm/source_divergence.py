"""How far the sources of each language differ in their words, and by which words.

Words are counted by sorting pointers. A slice of texts is one Arrow buffer; each word is a pointer
to its start there. Pointers are sorted by a multikey quicksort whose characters are eight bytes
wide: a slice is sorted by the key at its depth, and only runs with equal keys go on to the next.
Equal runs are words: their pointers, in the order of language, source and document, give how often
each source has the word and in how many documents. A slice hands on a row for each word and
language, so the shuffle by word carries as many rows of a frequent word as there were slices.

Two sources are compared over all kept words of their language without a row for each word that one
lacks. Words that both lack add one and the same value; what a word adds beyond it where one source
has it, and where both have, are sums over what exists. Sources are dealt into blocks and words into
parts, and a task holds two blocks and a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches, small, text_bytes, written

#: Bytes of texts that are sorted together, about; a longer text is a slice of its own.
SLICE = 16 << 20
#: Rows that Python hands on at a time.
ROWS = 1 << 16
#: Sources of a block, and rows (word and source) of a part of the words, about.
BLOCK, PART = 256, 1 << 18
#: All bytes that are no part of a word become 0, and A to Z lower case.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
#: The first n bytes of a key of eight.
FIRST = np.array([(0xFFFFFFFFFFFFFFFF << (8 * (8 - n))) & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each word of ``data`` (0 between words), whose documents start at ``offsets``."""
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = data != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # A word ends where its document does.
    cuts = np.unique(offsets)
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def keys_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes of each word at ``depth``, as big-endian numbers with zeros behind the word's end."""
    windows = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    return windows[starts + 8 * depth].astype(np.uint64) & FIRST[np.clip(lengths - 8 * depth, 0, 8)]


def pointer_sort(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words, and whether each differs from the one before; ``data`` ends with eight zeros."""
    keys = keys_at(data, starts, lengths, 0)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    # Words that go beyond their key; a run has all of its words among them or none.
    at, depth = np.flatnonzero(keys & np.uint64(255)), 1
    while True:
        first = new[at]
        at = at[~(first & np.append(first[1:], True))] if len(at) else at
        if not len(at):
            return order, new
        words, run = order[at], np.cumsum(new[at])
        keys = keys_at(data, starts[words], lengths[words], depth)
        within = np.lexsort((keys, run))
        order[at], keys = words[within], keys[within]
        new[at[1:][(run[1:] == run[:-1]) & (keys[1:] != keys[:-1])]] = True
        at, depth = at[(keys & np.uint64(255)) != 0], depth + 1


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The words at these places as strings."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    places = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places]))])


def slice_counts(texts: pa.Table) -> Iterator[pa.RecordBatch]:
    """A row for each word and language of a slice (lang, source, text): in which sources, how often, in how many documents."""
    text = texts.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    low = (bytes(memoryview(raw)[offsets[0] : offsets[-1]]) if raw is not None else b"").translate(WORDS)
    data = np.frombuffer(low + bytes(8), np.uint8)
    offsets = offsets - offsets[0]
    starts, lengths, document = pointers(data, offsets)
    if not len(starts):
        return
    # Documents are numbered in the order of their language and source, so equal runs show groups side by side.
    langs = texts.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    lang, source = langs.indices.to_numpy(zero_copy_only=False), texts.column("source").to_numpy()
    by_group = np.lexsort((source, lang))
    number = np.empty(len(by_group), np.int64)
    number[by_group] = np.arange(len(by_group))
    lang, source = lang[by_group], source[by_group]
    group = np.zeros(len(lang), np.int64)
    group[1:] = np.cumsum((lang[1:] != lang[:-1]) | (source[1:] != source[:-1]))

    order, new = pointer_sort(data, starts, lengths)
    both = ((np.cumsum(new) - 1) << 32) | number[document[order]]
    both.sort()
    word, doc = both >> 32, both & 0xFFFFFFFF
    differs = lambda x: np.append(True, x[1:] != x[:-1])
    new_word, new_doc = differs(word), differs(both)
    new_group = new_word | differs(group[doc])
    at = np.flatnonzero(new_group)
    counts, docs = np.diff(np.append(at, len(both))), np.add.reduceat(new_doc.astype(np.int32), at)
    rows = np.flatnonzero(new_word[at] | differs(lang[doc[at]]))
    heads, ends = at[rows], np.append(rows, len(at))
    which = order[np.flatnonzero(new)]
    for a in range(0, len(rows), ROWS):
        b = min(a + ROWS, len(rows))
        cut, inner = (ends[a : b + 1] - ends[a]).astype(np.int32), slice(ends[a], ends[b])
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (source[doc[at[inner]]], counts[inner].astype(np.int32), docs[inner].astype(np.int32))]
        w = which[word[heads[a:b]]]
        terms = gathered(data, starts[w], lengths[w]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[doc[heads[a:b]]])), terms, *lists], ["lang", "term", "sources", "counts", "docs"])


def counted(texts: DataFrame) -> DataFrame:
    """(lang, term, sources, counts, docs) for each slice of ``texts`` (lang, source, text as bytes)."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE:
                yield from slice_counts(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from slice_counts(pa.Table.from_batches(held))

    return texts.select("lang", "source", "text").mapInArrow(run, "lang string, term string, sources array<long>, counts array<int>, docs array<int>")


def per_billion(count: str, total: str) -> str:
    """1 + floor(10**9 (count + 2) / total), by long division in three steps; exact for totals below 9 * 10**15."""
    m = f"greatest({total}, 1L)"
    a = f"(({count} + 2L) * 1000L)"
    b = f"(({a} % {m}) * 1000L)"
    c = f"(({b} % {m}) * 1000L)"
    return f"(1L + ({a} div {m}) * 1000000L + ({b} div {m}) * 1000L + ({c} div {m}))"


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) in whole numbers; shares are at most 10**9 + 1 and at least 1."""
    d = p - q
    return d * d // (p + q)


def tile_sums(tile: pa.Table) -> pa.Table:
    """(lang, a, b, value): what a part of the words adds to pairs of sources of two blocks.

    Rows without a term are the sources (p is a source's share of a word that it lacks), others the
    words that sources have.
    """
    names = ["lang", "a", "b", "value"]
    is_source = tile.column("term").is_null().to_numpy()
    source, p, block = (tile.column(c).to_numpy() for c in ("source", "p", "block"))
    known, first = np.unique(source[is_source], return_index=True)
    lacking, blocks = p[is_source][first], block[is_source][first]
    both = apart(lacking[:, None], lacking[None, :])
    sums = both * int(tile.column("words").to_numpy()[is_source][0]) if len(known) else both
    own, p = np.searchsorted(known, source[~is_source]), p[~is_source]
    terms = tile.column("term").filter(pa.array(~is_source)).combine_chunks().dictionary_encode()
    term = (terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms).indices.to_numpy(zero_copy_only=False)
    # Words that a source has, against a source that lacks them.
    one = np.zeros_like(both)
    by_source = np.argsort(own, kind="stable")
    for at in range(0, len(own), 4096):
        rows = by_source[at : at + 4096]
        more = apart(p[rows][:, None], lacking[None, :]) - both[own[rows]]
        heads = np.flatnonzero(np.append(True, own[rows][1:] != own[rows][:-1]))
        one[own[rows][heads]] += np.add.reduceat(more, heads, axis=0)
    sums = sums + one + one.T
    # Words that both have, pairs at growing distances within a word's rows.
    by_term = np.argsort(term, kind="stable")
    own, p, term = own[by_term], p[by_term], term[by_term]
    left, shift, flat = np.arange(len(own)), 1, np.zeros(both.size, np.int64)
    while True:
        left = left[left + shift < len(own)]
        left = left[term[left] == term[left + shift]]
        if not len(left):
            break
        i, j = left, left + shift
        a, b = own[i], own[j]
        more = apart(p[i], p[j]) - apart(p[i], lacking[b]) - apart(lacking[a], p[j]) + both[a, b]
        # Sums below 2**53 are exact in doubles.
        flat += np.bincount(a * len(known) + b, more, both.size).astype(np.int64)
        shift += 1
    flat = flat.reshape(both.shape)
    sums = sums + flat + flat.T
    a, b = np.triu_indices(len(known), 1)
    wanted = (blocks[a] != blocks[b]) | (tile.column("i").to_numpy()[:1] == tile.column("j").to_numpy()[:1]).any()
    a, b = a[wanted], b[wanted]
    lang = pa.array([tile.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.Table.from_arrays([lang, pa.array(known[a]), pa.array(known[b]), pa.array(sums[a, b])], names)


def audited(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language of ``docs`` (text, lang, source; re-readable).

    Null texts, languages and sources count as empty strings, which are a language and a source as
    any other. Words are runs of letters A to Z, lower-cased, and of all characters beyond ASCII. A
    language keeps the words that ``least_docs`` of its rows have at least; repeated rows are rows
    each. Part ``pair`` has each other source of the language and the sum of their divergence over
    all kept words (0 if none is kept); part ``term`` has the ``top`` words that a source has more
    often than its language, by their divergence. Ranks go by value, largest first, ties by item.
    All arithmetic is in whole numbers, exact below 9 * 10**15 words of a group. Texts are read
    whole. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    lang, name = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))
    groups = written(docs.select(lang, name).distinct(), compact=True)
    # Sources go by a hash; a seed is taken under which no two sources of a language share theirs.
    seed = 0
    hashed = lambda: F.xxhash64("source", F.lit(seed))
    while not groups.groupBy("lang", hashed()).count().filter("count > 1").isEmpty():
        seed += 1
    texts = docs.select(lang, name, text_bytes().alias("text")).withColumn("source", hashed())

    found = counted(texts).repartition("lang", "term")
    each = found.select("lang", "term", F.inline(F.arrays_zip("sources", "counts", "docs")).alias("source", "count", "docs"))
    each = each.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    word = Window.partitionBy("lang", "term")
    each = each.select("lang", "term", "source", "count", F.sum("docs").over(word).alias("docs"), F.sum("count").over(word).alias("total"), (F.min("source").over(word) == F.col("source")).alias("leads"))
    kept = written(each.filter(F.col("docs") >= least_docs).drop("docs"))

    by_lang = kept.groupBy("lang").agg(F.sum(F.col("leads").cast("long")).alias("words"), F.sum("count").alias("of_lang"), F.count("*").alias("rows"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("of_source"))
    about = groups.select("lang", F.col("source").alias("name"), hashed().alias("source")).join(own, ["lang", "source"], "left").join(sizes, "lang").join(by_lang, "lang", "left")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    about = about.na.fill(0, ["of_source", "words", "of_lang", "rows"]).withColumn("blocks", blocks)
    about = about.withColumn("parts", F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / F.col("blocks") / PART)).cast("int"))
    about = written(about.withColumn("block", F.pmod("source", F.col("blocks")).cast("int")), compact=True)
    # Rows of it are a few numbers for each language and source.
    share = F.expr(per_billion("count", "of_source + 2 * words"))
    known = kept.join(small(about), ["lang", "source"]).withColumn("p", share)

    terms = known.withColumn("q", F.expr(per_billion("total", "of_lang + 2 * words"))).filter("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = terms.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    terms = terms.select("lang", F.col("name").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    columns = ["lang", "term", "source", "p", "block", "words", "part"]
    have = known.select("lang", "term", "source", "p", "block", F.lit(0).cast("long").alias("words"), F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), other)
    lack = about.withColumn("p", F.expr(per_billion("0L", "of_source + 2 * words"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # The words of the language count once, in the first part.
    lack = lack.select("lang", F.lit(None).cast("string").alias("term"), "source", "p", "block", F.when(F.col("part") == 0, F.col("words")).otherwise(0).alias("words"), "part", other)
    tiles = have.unionByName(lack).select(*columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sums = tiles.groupBy("lang", "i", "j", "part").applyInArrow(tile_sums, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    names = about.select("lang", "source", "name")
    pairs = sums.join(small(names), ["lang", "source"]).select("lang", F.col("name").alias("__source"), F.col("item").alias("source"), "value")
    pairs = pairs.join(small(names), ["lang", "source"]).select("lang", F.col("__source").alias("source"), F.lit("pair").alias("part"), F.col("name").alias("item"), "value")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(ranks).cast("int")).unionByName(terms)
