"""SimHash near-duplicates with pivot distance tables.

A document's fingerprint has a bit where over half of its shingles' 64-bit hashes have it. Equal
fingerprints are gathered first, so what follows sees each fingerprint once.

Two fingerprints within r bits agree, out of m bands, in at least m - r; so they share the key of
some (m - r)-subset of bands, and no pair is missed whatever m is. m grows with the number of
fingerprints, to keep buckets small. Within a bucket the distances to many reference fingerprints
(the pivots) are computed once for each member: by the triangle inequality a pair is discarded if
any of its coordinates differs by more than r, and only survivors are compared bit by bit. Members
stand in the order of their first coordinate, so pairs further apart in it are never formed, and
pairs that are already connected are skipped; a bucket gives a spanning forest of its links, not
all of them. Buckets beyond TILE members are dealt into tiles of two chunks each, so that no task
holds one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import BROADCAST_ROWS, bounded_batches, reused, tasks, text_bytes, written

#: Members of a bucket that one task compares directly; larger buckets are dealt into tiles.
TILE = 1024
#: Reference fingerprints: seeded random ones, so about half of the bits of any other differ.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)
#: A band key should have so many values for each fingerprint at least (buckets of about 128).
SPREAD = 1 / 128
#: Links (16 bytes each) up to which one task solves them all; more take rounds of joins.
FOREST_LINKS = 1 << 17
#: Links of a node beyond which it counts as a hub.
HUB = 1024
#: Shingles that are hashed and summed at a time.
SUM_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, width: int) -> list[np.ndarray]:
    """Hashes (big-endian) of a text's shingles in their order, SUM_AT_ONCE in an array; without words none."""
    words = text.lower().split()  # bytes: A-Z only, and white space as in common.WORD_PATTERN
    if not words:
        return []
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    cuts = [slice(at, at + SUM_AT_ONCE) for at in range(0, n, SUM_AT_ONCE)]
    return [np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts[c], ends[c])]), ">u8") for c in cuts]


def fingerprint_of(hashes: list[np.ndarray]) -> int:
    """The fingerprint as a signed 64-bit integer; of no shingles it is zero."""
    ones, n = np.zeros(64, np.int64), sum(map(len, hashes))
    for part in hashes:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: bytes, width: int) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; ids that are named by a column become long, others keep their type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    ids = F.col(id_col).cast("long") if isinstance(id_col, str) else id_col
    read = docs.select(ids.alias("doc_id"), text_bytes(text_col).alias("text"))
    return read.mapInArrow(run, T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]))


def band_masks(bands: int) -> list[int]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def key_masks(count: int, radius: int) -> list[int]:
    """Masks of the band subsets: the fewest bands whose keys have values enough for ``count``."""
    for bands in range(radius + 1, 2 * radius + 4):
        agree = bands - radius
        if 64 * agree // bands >= 62 or 2 ** (64 * agree // bands) >= SPREAD * count:
            break
    masks = band_masks(bands)
    return [sum(x) for x in combinations(masks, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Forest:
    """Union-find over array places, with vectorised look-up."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int, pivots: np.ndarray = PIVOTS) -> list[tuple[int, int]]:
    """Links that connect, within each key, what fingerprints within ``radius`` bits connect."""
    repeated = np.zeros(len(key), bool)
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    same = key[1:] == key[:-1]
    repeated[1:] |= same
    repeated[:-1] |= same
    key, fp = key[repeated], fp[repeated]
    if not len(key):
        return []
    to_pivot = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.lexsort((to_pivot[:, 0], key))
    key, fp, to_pivot = key[order], fp[order], to_pivot[order]
    first, forest, links = to_pivot[:, 0].astype(np.int64), Forest(len(key)), []
    active, shift = np.arange(len(key) - 1), 0
    while len(active):
        shift += 1
        active = active[active + shift < len(key)]
        other = active + shift
        # Keys and first coordinates ascend: a pair that fails here fails at all larger shifts.
        near = (key[active] == key[other]) & (first[other] - first[active] <= radius)
        active = active[near]
        other = active + shift
        roots = forest.roots()
        i, j = active, other
        apart = roots[i] != roots[j]
        i, j = i[apart], j[apart]
        for at in range(0, to_pivot.shape[1], 4):
            if not len(i):
                break
            keep = (np.abs(to_pivot[i, at : at + 4] - to_pivot[j, at : at + 4]) <= radius).all(axis=1)
            i, j = i[keep], j[keep]
        if len(i):
            keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            links += [(int(a), int(b)) for a, b in zip(i[keep], j[keep]) if forest.join(int(a), int(b))]
    values = fp.view(np.int64)
    return [(int(values[a]), int(values[b])) for a, b in links]


def links(fps: DataFrame, count: int, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints: their components are those of all pairs within radius."""
    spark = fps.sparkSession
    masks = key_masks(count, radius)
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(signed(m)))) for t, m in enumerate(masks)])).alias("key")
    )
    large = keyed.groupBy("key").count().filter(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda x: F.xxhash64("key", F.least(x, chunk), F.greatest(x, chunk)),
    )
    tiles = keyed.join(large, "key", "left").select(
        "fp", F.explode(F.when(F.col("chunks").isNull(), F.array("key")).otherwise(pairs)).alias("tile")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def linked(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            out = bucket_links(keys, values.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            # Rows come in the order of their tile; only the last tile can go on in the next batch.
            keys, values = (np.concatenate([x.column(c).to_numpy() for x in [*held, batch]]) for c in ("tile", "fp"))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield linked(keys[:cut], values[:cut].copy())
            held = [pa.RecordBatch.from_arrays([pa.array(keys[cut:]), pa.array(values[cut:])], ["tile", "fp"])]
        if held:
            yield linked(held[0].column("tile").to_numpy(), held[0].column("fp").to_numpy().copy())

    return tiles.repartition(tasks(spark), "tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long").distinct()


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of links (u, v): each node takes the least label around it until none changes."""
    u, v = (np.concatenate(x) for x in zip(*[[b.column(c).to_numpy() for c in ("u", "v")] for b in batches], (np.zeros(0, np.int64),) * 2))
    nodes = np.unique(np.concatenate([u, v]))
    u, v, label = np.searchsorted(nodes, u), np.searchsorted(nodes, v), np.arange(len(nodes))
    while True:
        less = label.copy()
        np.minimum.at(less, u, label[v])
        np.minimum.at(less, v, label[u])
        less = less[less]
        if np.array_equal(less, label):
            break
        label = less
    below = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[label[below]])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the links but the roots; root is the smallest node that it reaches.

    Up to FOREST_LINKS links are solved by one task, as one round of joins would cost more. A larger
    table takes alternating large-star and small-star steps; each is a grouped minimum and a join,
    so that no task or driver ever holds a component, and the result is the same. The number of
    rounds grows with the logarithm of a component's size. Nodes with more than HUB links meet theirs by a broadcast, so that no task gets
    all links of a hub; HUB grows with the number of links, so that hubs are BROADCAST_ROWS at most.
    """
    links = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), compact=True)
    if links.count() <= FOREST_LINKS:
        return links.coalesce(1).mapInArrow(forest, "node long, root long")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n").persist(StorageLevel.DISK_ONLY)
        many = max(HUB, 2 * before[0] // BROADCAST_ROWS)
        hubs = least.filter(F.col("n") > many)
        up = both.filter("v > u")
        if hubs.isEmpty():
            large = up.join(least, "u").select("u", "v", "m")
        else:
            large = up.join(F.broadcast(hubs), "u").select("u", "v", "m")
            large = large.unionByName(up.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(F.col("n") <= many), "u").select("u", "v", "m"))
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        least.unpersist()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        links = written(small.select("x.u", "x.v").filter("u != v").distinct())
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str | Column = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    Words are runs of anything but space and U+0009-U+000D, A-Z lower-cased; shingles are
    ``width`` words, repeats included; shorter texts are one shingle. Null and empty texts, and
    those without words, have fingerprint zero and link like any other. component_id is the
    smallest id that is reached over links of ``radius`` differing bits or fewer; null ids are
    larger than all others, and a component of none but null ids has null. Repeated rows each get
    their row. Texts of any length are read whole, their shingles SUM_AT_ONCE at a time. Other
    columns are ignored. An empty table gives no rows.
    """
    each = reused(fingerprints(docs, width, id_col, text_col))
    return grouped(each, radius)


def grouped(each: DataFrame, radius: int) -> DataFrame:
    """``each`` (doc_id, fp; re-readable) with its component_id."""
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    roots = components(links(distinct.select("fp"), distinct.count(), radius))
    # Only fingerprints with a partner, or with several rows, need their component looked up.
    pairs = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    members = distinct.join(pairs, "fp", "left").filter((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))
    smallest = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = written(members.join(smallest, "root").select("fp", "component_id"), compact=True)
    # A fingerprint may have a third of all rows; adaptive execution splits that key of this join.
    out = each.join(of, "fp", "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hexadecimal(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
