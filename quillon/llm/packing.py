"""Best-fit packing with conflicts.

Documents are packed into bins of a fixed capacity, the largest first. A shard's open bins stand in
the order of their residual capacity. A document's search starts at the smallest residual that
holds it and goes on to larger ones until a bin is compatible: the bin's bitmap of duplicate
clusters must not hold the document's cluster, and its bitmap of full sources not its source. If
none is, a bin is opened.

A source is full in a bin once it has its share there: ``source_share`` times what it would have if
its documents were spread evenly over the fewest bins that hold all, and ``source_limit`` documents
at least. So sources are mixed within bins, and a source that has most of the documents still fills
its bins.

Documents are dealt by a hash into shards of about SHARD documents, which are packed on their own;
neither memory nor search grows with the table, and copies spread over all shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_or_empty, word_count

CAPACITY, SHARD, SOURCE_LIMIT, SOURCE_SHARE = 2048, 4096, 8, 2.0
SCHEMA = "doc_id long, piece int, start long, size long, bin_id long"


def source_limits(items: list[tuple[int, int, int, object]], capacity: int, least: int, share: float) -> dict:
    """How many documents of each source a bin takes."""
    bins = max(1, -(-sum(x[0] for x in items) // capacity))
    return {s: max(least, math.ceil(share * n / bins)) for s, n in Counter(x[2] for x in items).items()}


def pack(items: list[tuple[int, int, int, object]], capacity: int, source_limit: int = SOURCE_LIMIT, source_share: float = SOURCE_SHARE) -> list[int]:
    """The bin of each item (size, cluster, source, order); sizes from 1 to capacity."""
    clusters = {c: i for i, c in enumerate(dict.fromkeys(x[1] for x in items))}
    limits = source_limits(items, capacity, source_limit, source_share)
    sources = {s: i for i, s in enumerate(limits)}
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][3]))
    open_bins: list[tuple[int, int]] = []
    cluster_bits: list[int] = []
    full_sources: list[int] = []
    held: list[Counter] = []
    out = [0] * len(items)
    for i in order:
        size, cluster, source, _ = items[i]
        c, s = 1 << clusters[cluster], 1 << sources[source]
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (cluster_bits[open_bins[at][1]] & c or full_sources[open_bins[at][1]] & s):
            at += 1
        if at == len(open_bins):
            residual, b = capacity, len(cluster_bits)
            cluster_bits.append(0)
            full_sources.append(0)
            held.append(Counter())
        else:
            residual, b = open_bins.pop(at)
        out[i] = b
        cluster_bits[b] |= c
        held[b][source] += 1
        if held[b][source] == limits[source]:
            full_sources[b] |= s
        if residual > size:
            insort(open_bins, (residual - size, b))
    return out


def packed(sized: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, source_share: float = SOURCE_SHARE) -> DataFrame:
    """Packs ``sized`` (doc_id, source, size, cluster): doc_id, piece, start, size, bin_id.

    A document above the capacity is cut into pieces: full ones, each a bin of its own, and a rest
    that is packed. All pieces together are the whole document. No bin holds two pieces of a
    cluster, or more of a source (a null source is a source) than the larger of ``source_limit``
    and its share of the shard. Documents of size zero or null have one row without a bin. Repeated
    rows each get theirs; an empty table gives no rows. Rows are dealt by their place in the input
    too, which parts equal rows: bins are the same on the same files, and others on other splits.
    """
    n = sized.count()
    shards = max(1, -(-n // SHARD))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards))
    rows = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"), F.col("cluster").cast("long").alias("cluster"))

    def run(part: pa.Table) -> pa.Table:
        ids, sources, sizes, clusters, (number, *_) = (part.column(c).to_pylist() for c in ("doc_id", "source", "size", "cluster", "shard"))
        out, rest, items = [], [], []
        for i, size in enumerate(sizes):
            size = size or 0
            full, left = divmod(size, capacity)
            out += [[ids[i], k, k * capacity, capacity, -1] for k in range(full)]
            if left:
                rest.append(len(out))
                items.append((left, clusters[i], sources[i], (ids[i] is None, ids[i] or 0, i)))
                out.append([ids[i], full, full * capacity, left, None])
            elif not full:
                out.append([ids[i], 0, 0, 0, None])
        bins = pack(items, capacity, source_limit, source_share) if items else []
        base, fresh = number << 32, max(bins, default=-1) + 1
        for at, b in zip(rest, bins):
            out[at][4] = base + b
        for row in out:
            if row[4] == -1:
                row[4] = base + fresh
                fresh += 1
        cols = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "piece", "start", "size", "bin_id"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))})

    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(run, SCHEMA)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """``packed`` over a documents table; sizes are words of whole texts, and equal texts are a duplicate cluster.

    Null and empty texts have size zero: one row without a bin. A text of any length is counted
    whole; one of more than ``capacity`` words becomes full pieces and a rest. Ties of size go to
    the smaller id, null last. Other columns are ignored. An empty table gives no rows.

    Near copies are none: give ``packed`` a cluster column of your own to keep them apart as well.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64(text_or_empty()).alias("cluster"))
    return packed(sized, capacity, **options)
