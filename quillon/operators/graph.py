"""The link graph between items: edges and bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import links
from quillon.functions.derive import ascii_lower
from quillon.plans.tables import written

#: Hops up to which the plan stays lazy; each further one is written, to bound its lineage.
LAZY_HOPS = 3


def edges_of(items: DataFrame, keep_escapes: bool = False, paths: DataFrame | None = None) -> DataFrame:
    """(source, target, type): refs, also to missing items, and wikilinks that resolve to an item.

    A name, which may hold folders, resolves to the first path in byte order that is ``name.md``, or
    that ends with ``/name.md`` in any ASCII case. ``paths`` are those to resolve names by, where
    ``items`` are not all items.
    """
    paths = (items if paths is None else paths).select("path")
    refs = items.select("path", F.explode("refs").alias("ref"))
    refs = refs.select(F.col("path").alias("source"), links.normalized_ref(F.col("path"), F.col("ref"), keep_escapes).alias("target"), F.lit("refs").alias("type"))
    names = items.select(F.col("path").alias("source"), F.explode(F.array_distinct(links.wikilink_names(F.col("body")))).alias("name"))
    names = names.select("source", F.concat("name", F.lit(".md")).alias("whole"), ascii_lower(F.concat("name", F.lit(".md"))).alias("file"))
    # All ends of a path that follow a slash, one for each of its folders.
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ends = paths.filter(F.size(parts) > 1).select(F.explode(ends).alias("file"), "path").select(ascii_lower(F.col("file")).alias("file"), "path")
    ends = ends.groupBy("file").agg(F.min("path").alias("by_end"))
    found = names.join(ends, "file", "left").join(paths.select(F.col("path").alias("whole"), F.col("path").alias("exact")).distinct(), "whole", "left")
    mentions = found.select("source", F.least("by_end", "exact").alias("target"), F.lit("mentions").alias("type"))
    return refs.unionByName(mentions).filter("target is not null").distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, path, depth) of what each seed reaches over outgoing edges in ``depth`` hops or fewer.

    ``seeds`` has path and seed. A node has its smallest depth; a seed does not reach itself. Each
    hop joins the frontier with the edges and takes off what was visited.
    """
    out = edges.select("source", "target").distinct()
    visited = seeds.select("seed", "path", F.lit(0).alias("depth"))
    frontier = visited
    for hop in range(1, depth + 1):
        step = frontier.join(out, F.col("path") == F.col("source")).select("seed", F.col("target").alias("path")).distinct()
        frontier = step.join(visited.select("seed", "path"), ["seed", "path"], "left_anti").withColumn("depth", F.lit(hop))
        if hop > LAZY_HOPS:
            frontier = written(frontier)
            if frontier.isEmpty():
                break
        visited = visited.unionByName(frontier)
    return visited.filter("depth > 0")


def traverse(items: DataFrame, edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """Items that ``start`` reaches, with score 1 / (1 + depth), by depth, tier and path."""
    seeds = items.sparkSession.createDataFrame([(start, 1)], "path string, seed int")
    found = neighbours(edges, seeds, depth).join(items.select("path", "title", "tier", "tokens"), "path")
    found = found.select("path", "title", (1 / (1 + F.col("depth"))).alias("score"), "tier", "tokens", F.col("depth").alias("hop_distance"))
    return found.orderBy("hop_distance", "tier", "path")


def refreshed_edges(edges: DataFrame, upserted: DataFrame, deleted: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges after a change set: outgoing ones of upserted items anew, those of deleted items gone.

    Links are taken from the upserted items only, and resolved by ``paths``, all paths after the
    change. Incoming edges of deleted items stay, and unresolved names of other items are not tried
    again.
    """
    touched = upserted.select("path").unionByName(deleted.select("path")).distinct()
    kept = edges.join(touched, F.col("source") == F.col("path"), "left_anti")
    return kept.unionByName(edges_of(upserted, paths=paths))
