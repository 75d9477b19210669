"""Incremental maintenance of an item table from change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(tracked: DataFrame, changes: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change) of what an index of ``known`` paths has to do.

    ``changes`` has kind (added, modified, deleted, renamed), path and old_path. Current files are
    the tracked, added and renamed ones without the deleted and the renamed ones' old paths;
    Markdown files only. Added: not known. Modified: known, and modified or the target of a rename;
    a known path that is reported as added is neither. Deleted: known and gone.
    """
    def paths(kind: str, column: str = "path") -> DataFrame:
        return changes.filter(F.col("kind") == kind).select(F.col(column).alias("path"))

    appeared = paths("added").unionByName(paths("renamed"))
    gone = paths("deleted").unionByName(paths("renamed", "old_path")).distinct()
    current = tracked.select("path").unionByName(appeared).distinct().join(gone, "path", "left_anti")
    current = current.filter(F.col("path").endswith(".md"))
    dirty = paths("modified").unionByName(paths("renamed")).distinct()
    known = known.select("path").distinct()
    added = current.join(known, "path", "left_anti").withColumn("change", F.lit("added"))
    modified = current.join(known, "path", "left_semi").join(dirty, "path", "left_semi").withColumn("change", F.lit("modified"))
    deleted = known.join(current, "path", "left_anti").withColumn("change", F.lit("deleted"))
    return added.unionByName(modified).unionByName(deleted)


def applied(known: DataFrame, upserts: DataFrame, deleted: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``known`` after deletes and upserts; of several upserts of a path the last ordinal wins."""
    last = upserts.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc(ordinal)))).filter("__n = 1")
    touched = upserts.select("path").unionByName(deleted.select("path")).distinct()
    return known.join(touched, "path", "left_anti").unionByName(last.select(*known.columns))


def summary(changes: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")]
    up_to_date = (F.count("*") == 0).alias("up_to_date")
    return changes.agg(*counts, up_to_date)


class DuplicatePath(ValueError):
    pass


def checked_unique(items: DataFrame) -> DataFrame:
    """``items``, if no path occurs twice; an index build with a duplicate must not replace the old one."""
    twice = items.groupBy("path").count().filter("count > 1").limit(1).collect()
    if twice:
        raise DuplicatePath(twice[0].path)
    return items


class NotForgotten(ValueError):
    pass


def forgotten(items: DataFrame, path: str, principal: str) -> DataFrame:
    """``items`` without one path; only a human may ask, for a path inside the store that there is."""
    if not principal.startswith("human:"):
        raise NotForgotten("only a human may forget an item")
    if path.startswith("/") or ".." in path.split("/") or items.filter(F.col("path") == path).isEmpty():
        raise NotForgotten(path)
    return items.filter(F.col("path") != path)


def forgotten_device(recipients: DataFrame, device: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipients without a device, and the private items that have to be encrypted anew; one recipient must be left."""
    left = recipients.filter(F.col("label") != f"device:{device}")
    if left.isEmpty():
        raise NotForgotten("no recipient would be left")
    return left, items.filter(F.col("visibility") == "private").select("path")


def purged(history: DataFrame, path: str) -> DataFrame:
    """A history of (revision, path, ...) without any version of a path."""
    return history.filter(F.col("path") != path)
