"""Near copies by the Jaccard similarity of their shingle sets, exactly.

Two sets of similarity SHARE or more have a shingle in common among the first
n - ceil(SHARE n) + 1 of each, in any one order of all shingles. Those leading shingles are the
keys that candidates share, so no pair is missed, whatever the fingerprints' distance. The order
puts shingles last that recur in a sample of the texts: the sample changes how many candidates
there are, and not what is found. Sizes, places of the shared shingle and a parity sketch (its
differing bits are at most the differing shingles, and it has a bit a shingle, so it tells long
texts apart as well) discard candidates without losing a pair; the rest are verified on their sets.

A text is verified first against one other: of the smallest ones of each of its FIRST_KEYS first
keys, that which it shares most of them with; and against what SimHash fingerprints within the
radius link to it. Then against all such, and the next one in size. Last, all texts that share any
key and that are still apart are compared pair by pair, so nothing hangs on the first keys. So a group of near copies
costs a few verifications a member, and a set travels once for each. The keys of all texts are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import alone, bounded_batches, dropped, small, tasks, text_bytes, written
from quillon.llm.simhash_pivots import components, fingerprint_of, links, shingle_hashes

#: Least similarity, as a fraction.
SHARE = (4, 5)
#: Texts whose shingles are counted for the order, about.
SAMPLE = 10_000
#: Keys of a text by which links are looked for first.
FIRST_KEYS = 8
#: Least bits of a parity sketch, a power of two.
SKETCH = 512
#: Texts of a key that one task compares directly; larger keys are dealt into tiles.
TILE = 1024


def distinct_hashes(hashes: np.ndarray) -> np.ndarray:
    """The different shingles' hashes in ascending order."""
    return np.unique(hashes.view(">u8").astype(np.uint64))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """A text of fewer words is one shingle, one without words has none."""
    return distinct_hashes(np.concatenate([*shingle_hashes(text, width), np.zeros(0, ">u8")]))


def signature(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def leading(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles that a similar set cannot all lack, those that recur in the sample last."""
    n = len(shingles)
    if not n:
        return shingles
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        often = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, often))][: n + 1 - -(-SHARE[0] * n // SHARE[1])]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by their hash modulo the next power of two; half as many are the halves' XOR."""
    bits = max(SKETCH, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else SKETCH
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def recurring(docs: DataFrame, width: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one sampled text, ascending, and in how many they stand."""
    every = max(1, docs.count() // SAMPLE)
    read = docs.select(text_bytes(text_col).alias("text")).distinct() if every == 1 else docs.select(text_bytes(text_col).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), width).view(np.int64))], ["s"])

    rows = read.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    s, n = rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def described(docs: DataFrame, width: int, id_col: str | Column, text_col: str) -> DataFrame:
    """(doc_id, sig, fp, n, keys, sketch) for each row."""
    common, counts = recurring(docs, width, text_col)
    read = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, fps = [], []
            for x in batch.column("text"):
                hashes = shingle_hashes(x.as_py(), width)
                fps.append(fingerprint_of(hashes))
                sets.append(distinct_hashes(np.concatenate([*hashes, np.zeros(0, ">u8")])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([signature(x) for x in sets], pa.int64()), pa.array(fps, pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([leading(x, common, counts).view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([sketch(x) for x in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "sig", "fp", "n", "keys", "sketch"],
            )

    kinds = [("sig", T.LongType()), ("fp", T.LongType()), ("n", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("sketch", T.ArrayType(T.LongType()))]
    return read.mapInArrow(run, T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), *[T.StructField(k, t) for k, t in kinds]]))


def texts_of(docs: DataFrame, id_col: str | Column, text_col: str) -> DataFrame:
    return docs.select((F.col(id_col) if isinstance(id_col, str) else id_col).alias("doc_id"), text_bytes(text_col).alias("text"))


def possible(n: np.ndarray, m: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that first meet at these places can be similar enough."""
    p, q = SHARE
    return (q * np.minimum(n, m) >= p * np.maximum(n, m)) & ((p + q) * np.minimum(n - at, m - other) >= p * (n + m))


def in_groups(rows: DataFrame, key: str, columns: list[str], make) -> DataFrame:
    """(a, b) that ``make`` gives for the rows (arrays of ``columns``, longs) of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def made(x: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, x[0, 1:] != x[0, :-1]])
            out = [make(*x[1:, a:b]) for a, b in zip(starts, [*starts[1:], x.shape[1]]) if b - a > 1]
            pairs = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in [key, *columns]])
            held = x if held is None else np.concatenate([held, x], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if cut:
                yield made(held[:, :cut])
                held = held[:, cut:]
        if held is not None and held.shape[1]:
            yield made(held)

    dealt = rows.select(key, *columns).repartition(tasks(rows.sparkSession), key).sortWithinPartitions(key, "n", "sig")
    return dealt.mapInArrow(run, "a long, b long")


def hubs(rows: DataFrame) -> DataFrame:
    """(a, b, c): each text b with the smallest text a of its band of sizes, and of the band below, in c of its keys.

    Sizes of a band differ by less than a pair may differ, so texts of a key meet one or two others.
    Hubs come from a grouped minimum; no task holds the texts of a key.
    """
    p, q = SHARE
    band = F.floor(F.log("n") / float(np.log(q / p)))
    banded = rows.withColumn("band", band)
    first = banded.groupBy("key", "band").agg(F.min(F.struct(F.col("n").alias("m"), F.col("sig").alias("a"), F.col("at").alias("other"))).alias("x")).select("key", "band", "x.*")
    each = banded.select("key", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("sig").alias("b"), "n", "at").join(first, ["key", "band"])
    alike = (q * F.least("n", "m") >= p * F.greatest("n", "m")) & ((p + q) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other")) >= p * (F.col("n") + F.col("m")))
    return each.filter(alike & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("c"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b): each text with the one before it in size among those of a key, where they are of different components.

    Rows are dealt by ranges of keys and sizes, so a key may lie in several tasks; where one ends,
    a pair is left to ``apart``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((5, 0), np.int64)
        for batch in batches:
            x = np.concatenate([last, np.stack([batch.column(c).to_numpy() for c in ("key", "n", "sig", "at", "root")])], axis=1)
            (key, n, sig, at, root), last = x, x[:, -1:]
            keep = (key[1:] == key[:-1]) & (root[1:] != root[:-1]) & possible(n[1:], n[:-1], at[1:], at[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(sig[:-1][keep]), pa.array(sig[1:][keep])], ["a", "b"])

    dealt = rows.select("key", "n", "sig", "at", "root").repartitionByRange(tasks(rows.sparkSession), "key", "n", "sig").sortWithinPartitions("key", "n", "sig")
    return dealt.mapInArrow(run, "a long, b long")


def apart(n: np.ndarray, sig: np.ndarray, at: np.ndarray, root: np.ndarray) -> np.ndarray:
    """All pairs of different components."""
    ends = np.searchsorted(n, SHARE[1] * n // SHARE[0], side="right")
    out = [np.zeros((2, 0), np.int64)]
    for i, end in enumerate(ends):
        j = np.arange(i + 1, end)
        j = j[(root[j] != root[i]) & possible(n[i], n[j], at[i], at[j])]
        if len(j):
            out.append(np.stack([np.full(len(j), sig[i]), sig[j]]))
    return np.concatenate(out, axis=1)


def settled(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components of a key. Where b is null, (a, key, n, at, root) is a row whose key is left to ``tiles``.

    Those are keys that may lie in several tasks, and keys of several components and more than TILE
    texts. Rows are dealt by ranges of keys and sizes, so no task gets more than its share.
    """
    most = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(x: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, x[0, 1:] != x[0, :-1]])
            ends = np.r_[starts[1:], x.shape[1]]
            mixed = np.minimum.reduceat(x[4], starts) < np.maximum.reduceat(x[4], starts)
            left = mixed & (ends - starts > most)
            left[0] |= first
            left[-1] |= last
            here = mixed & ~left
            pairs = np.concatenate([np.zeros((2, 0), np.int64), *[apart(*x[1:, i:j]) for i, j in zip(starts[here], ends[here])]], axis=1)
            names = ["a", "b", "key", "n", "at", "root"]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *[pa.nulls(pairs.shape[1], pa.int64())] * 4], names)
            key, n, sig, at, root = x[:, np.repeat(left, ends - starts)]
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.nulls(len(sig), pa.int64()), *map(pa.array, (key, n, at, root))], names)

        held, first = np.zeros((5, 0), np.int64), True
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("key", "n", "sig", "at", "root")])], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            if cut:
                yield from made(held[:, :cut], first, False)
                held, first = held[:, cut:], False
        if held.shape[1]:
            yield from made(held, first, True)

    dealt = rows.select("key", "n", "sig", "at", "root").repartitionByRange(tasks(rows.sparkSession), "key", "n", "sig").sortWithinPartitions("key", "n", "sig")
    return dealt.mapInArrow(run, "a long, b long, key long, n long, at long, root long")


def tiles(rows: DataFrame) -> DataFrame:
    """(tile, n, sig, at, root) of the keys that texts of several components share: two texts of a key share a tile at least."""
    mixed = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    mixed = small(written(mixed.select("key", F.ceil(F.col("c") / TILE).alias("chunks")), compact=True))
    chunk = F.pmod(F.xxhash64("sig"), F.col("chunks"))
    both = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: F.xxhash64("key", F.least(x, chunk), F.greatest(x, chunk)))
    return rows.join(mixed, "key").withColumn("tile", F.explode(F.when(F.col("chunks") == 1, F.array("key")).otherwise(both)))


def pairs_apart(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components of each key of ``rows`` (key, n, sig, at, root)."""
    found = alone(rows.sparkSession, lambda: written(settled(rows)))
    left = found.filter("b is null").select("key", "n", F.col("a").alias("sig"), "at", "root")
    return found.filter("b is not null").select("a", "b").unionByName(in_groups(tiles(left), "tile", ["n", "sig", "at", "root"], apart))


def plausible(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: signatures) whose sizes and sketches may be of similar sets."""
    p, q = SHARE
    pairs = pairs.filter("a <> b").distinct()
    for c, s, n in (("a", "x", "n"), ("b", "y", "m")):
        pairs = pairs.join(distinct.select(F.col("sig").alias(c), F.col("sketch").alias(s), F.col("n").alias(n)), c)

    def xor(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))

    def no_longer(x: str, y: str) -> Column:
        # Sizes that may be similar differ by less than two, so one halving makes the sketches equally long.
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(y), xor(F.slice(x, 1, half), F.slice(x, half + 1, half))).otherwise(F.col(x))

    bits = F.aggregate(xor(no_longer("x", "y"), no_longer("y", "x")), F.lit(0).cast("long"), lambda z, u: z + F.bit_count(u).cast("long"))
    alike = q * F.least("n", "m") >= p * F.greatest("n", "m")
    return pairs.filter(alike).filter(bits * (p + q) <= (q - p) * (F.col("n") + F.col("m"))).select("a", "b")


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, width: int, id_col: str | Column, text_col: str) -> DataFrame:
    """Those of ``pairs`` (a, b: signatures) whose sets are similar.

    The sets of all b of an a, in chunks of TILE, come to one task behind the set of a.
    """
    p, q = SHARE
    left = written(plausible(pairs, distinct), compact=True)
    if left.isEmpty():
        return left
    ids = left.select(F.col("a").alias("sig")).unionByName(left.select(F.col("b").alias("sig"))).distinct()
    ids = small(written(distinct.join(small(written(ids, compact=True)), "sig", "left_semi").select("doc_id"), compact=True))
    read = texts_of(docs, id_col, text_col).join(ids, "doc_id", "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Repeated rows give their set once a task; what is left of them gives links twice, which does no harm.
        seen: set[int] = set()
        for batch in batches:
            found = {signature(x): x for x in (shingle_set(t.as_py(), width) for t in batch.column("text"))}
            new = [k for k in found if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[k].tobytes() for k in new], pa.binary())], ["sig", "s"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, x = None, None
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, s in enumerate(batch.column("s")):
                y = np.frombuffer(s.as_buffer(), np.uint64)
                if b[i] is None:
                    hub, x = a[i], y.copy()
                elif hub == a[i] and (p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y)):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    found = written(read.mapInArrow(sets, "sig long, s binary"))
    counts = left.groupBy("a").agg(F.ceil(F.count("*") / TILE).alias("chunks"))
    # Pairs go to the sets where they are few, so that sets are shuffled once.
    dealt = written(left.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), "b"), compact=True)
    members = small(dealt).join(found, F.col("b") == F.col("sig")).select("a", "chunk", "b", "s")
    first = small(written(dealt.select("a", "chunk").distinct(), compact=True))
    hubs = first.join(found, F.col("a") == F.col("sig")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "s")
    both = hubs.unionByName(members).repartition(tasks(docs.sparkSession), "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return written(both.select("a", "b", "s").mapInArrow(similar, "a long, b long"), compact=True)


def near_copies(docs: DataFrame, width: int, radius: int, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (re-readable): the smallest id reached over links of similarity SHARE or more.

    Ids belong to one text each. Words and shingles are those of ``simhash_pivots``, each shingle
    counted once; texts of fewer words than ``width`` are one shingle, and those without words are
    alike. Null texts count as empty. ``radius`` bits of the fingerprints give candidates to verify
    first. Repeated rows each get their row, texts of any length are read whole, other columns are
    ignored. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    every = written(described(docs, width, id_col, text_col))
    each = written(every.select("doc_id", "sig"))
    distinct = alone(docs.sparkSession, lambda: written(every.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "n", "keys", "sketch")])))
    dropped(every)  # keys and sketches are the bulk of what this stage stores
    found: list[DataFrame] = []

    def roots() -> DataFrame:
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        return alone(docs.sparkSession, lambda: written(components(every), compact=True))

    def verify(pairs: Callable[[], DataFrame]) -> None:
        # Texts and sets that one step shuffles are gone before the next.
        found.append(alone(docs.sparkSession, lambda: verified(pairs(), distinct, docs, width, id_col, text_col)))

    def placed(rows: DataFrame, of: DataFrame, name: str, root: str) -> DataFrame:
        return rows.join(small(of.select(F.col("node").alias(name), F.col("root").alias(root))), name, "left").withColumn(root, F.coalesce(root, name))

    of_fp = written(distinct.groupBy("fp").agg(F.min("sig").alias("least")), compact=True)
    close = links(of_fp.select("fp"), of_fp.count(), radius)
    close = close.join(of_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = distinct.select("fp", "sig").join(of_fp, "fp").filter("sig <> least").select(F.col("least").alias("a"), F.col("sig").alias("b"))

    # The first keys, which similar texts mostly share, lead to links for nearly all groups; all keys settle the rest.
    rows = distinct.select("sig", "n", F.posexplode(F.slice("keys", 1, FIRST_KEYS)).alias("at", "key")).withColumn("at", F.col("at").cast("long"))
    wheel = written(hubs(rows), compact=True)
    best = wheel.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b")
    verify(lambda: best.unionByName(close).unionByName(equal))
    of = roots()
    more = placed(placed(wheel.select("a", "b"), of, "a", "x"), of, "b", "y").filter("x <> y").select("a", "b")
    nearest = neighbours(placed(rows, of, "sig", "root"))
    verify(lambda: more.unionByName(nearest))
    of = roots()
    verify(lambda: pairs_apart(placed(distinct.select("sig", "n", "keys"), of, "sig", "root").select("sig", "n", "root", F.posexplode("keys").alias("at", "key")).withColumn("at", F.col("at").cast("long"))))

    of = roots()
    members = of.select(F.col("node").alias("sig"), "root").unionByName(of.select(F.col("root").alias("sig"), "root").distinct())
    grouped = distinct.select("sig", "doc_id").join(members, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = written(grouped.join(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("sig", "component_id"))
    return each.select("doc_id", "sig").join(least, "sig").select("doc_id", "component_id")
