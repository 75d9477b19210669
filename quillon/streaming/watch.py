"""Streams of changes: of published versions, and of a folder of files that is edited in place.

A published version stays as it is once its pointer row is written, so Spark's file source over the
pointers gives each version once, in whatever process the stream goes on. What a version changes is
its difference to the one before.

Files that are edited or deleted are no such source: Spark's never hands out a path twice. Here each
tick of a stream lists the folder by a Spark job, and the difference to the listing before goes into
a log of changes that grows by a part a tick. Changes are then held back until they are quiet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

CHANGE = "path string, change string"
LISTED = "path string, size long, modified timestamp"
LOGGED = f"{CHANGE}, at timestamp"


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, text, modified) of Markdown files as they appear; a path comes once, see ``watching`` for edits."""
    read = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").format("text").load(root)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def refreshing(stream: DataFrame, refresh: Callable[[DataFrame, int], None], state: str, every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Hands each batch to ``refresh``; changes within ``every`` make one batch. ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def differences(before: DataFrame, after: DataFrame, same: list[str]) -> DataFrame:
    """(path, change): what is added, deleted, or modified, that is differs in one of the columns ``same``."""
    def marked(df: DataFrame, name: str) -> DataFrame:
        return df.select("path", F.struct(*[F.col(c) for c in same], F.lit(True)).alias(name))

    both = marked(before, "b").join(marked(after, "a"), "path", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def _retried(work: Callable[[], None], attempts: int, wait: float) -> None:
    """Does ``work`` again after a failure; the last one is raised, and the batch runs again when the stream does."""
    for k in range(attempts):
        try:
            return work()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    return None


def following(
    spark: SparkSession, root: str, refresh: Callable[[DataFrame, int], None], state: str, same: list[str], every: str = "500 milliseconds", once: bool = False, attempts: int = 3, wait: float = 0.5
) -> StreamingQuery:
    """Hands ``refresh`` the changes (path, change) of each version that ``sinks.publish`` makes below ``root``, and its number.

    A version comes once, in the order of the numbers, also if the stream is stopped and goes on; the
    first brings all its paths as added. A batch that fails is tried ``attempts`` times, waiting
    longer each time; then the stream fails and begins with the same version when it is started
    again. ``same`` are the columns in which versions of an item are compared. Only the rows of
    pointers, a version each, pass the driver.
    """
    pointers = spark.readStream.schema("number long, version string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{root}/pointer")

    def batch(rows: DataFrame, _: int) -> None:
        session = rows.sparkSession
        for row in sorted(rows.collect(), key=lambda r: r.number):
            after = session.read.parquet(row.version)
            earlier = session.read.schema("number long, version string").option("recursiveFileLookup", "true").parquet(f"{root}/pointer").filter(F.col("number") < row.number)
            last = earlier.orderBy(F.desc("number")).first()
            before = session.read.parquet(last.version) if last else after.limit(0)
            _retried(lambda: refresh(differences(before, after, same), row.number), attempts, wait)  # noqa: B023

    return refreshing(pointers, batch, state, every, once)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the Markdown files below ``root``, relative to it; Spark lists them and reads none."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    inner = root.split("://")[-1].removeprefix("file:").strip("/")
    name = F.regexp_replace("path", rf"^.*?\Q{inner}\E/+", "")
    return read.select(name.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    p, system = _folder(spark, f"{path}/_SUCCESS")
    return system.exists(p)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete parts below ``path``."""
    p, system = _folder(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
    return sorted(n for n in (int(x.removeprefix("tick=")) for x in names if x.startswith("tick=")) if _complete(spark, f"{path}/tick={n}"))


def ticked(spark: SparkSession, root: str, log: str, number: int) -> None:
    """One tick of ``watching``: the changes since the last tick go to ``log``/changes, if there are any.

    A tick that runs again after a failure finds what it has done: its own listing, which it takes
    instead of a new one, and its changes, which it does not write twice. Two listings are kept.
    """
    if _complete(spark, f"{log}/changes/tick={number}"):
        return
    known = _numbers(spark, f"{log}/listings")
    if number not in known:
        try:
            now = listing(spark, root)
            now.write.mode("overwrite").parquet(f"{log}/listings/tick={number}")
        except Exception as failed:  # a file that went while it was listed: the next tick sees how things are then
            if "FileNotFound" in str(failed) or "does not exist" in str(failed):
                return
            raise
    earlier = [n for n in known if n < number]
    after = spark.read.schema(LISTED).parquet(f"{log}/listings/tick={number}")
    before = spark.read.schema(LISTED).parquet(f"{log}/listings/tick={earlier[-1]}") if earlier else after.limit(0)
    changes = differences(before, after, ["size", "modified"]).withColumn("at", F.current_timestamp())
    if not changes.isEmpty():
        changes.hint("rebalance").write.mode("overwrite").parquet(f"{log}/changes/tick={number}")
    for n in earlier[:-1]:
        p, system = _folder(spark, f"{log}/listings/tick={n}")
        system.delete(p, True)


def watching(spark: SparkSession, root: str, log: str, every: str = "1 second") -> StreamingQuery:
    """Starts the stream that looks for changes below ``root`` at each tick and adds them to ``log``.

    Additions, edits (another size or time) and deletions are found. It can be stopped and started
    again: what changed in between comes with the first tick.
    """
    _, system = _folder(spark, log)
    system.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/changes"))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(rows: DataFrame, number: int) -> None:
        ticked(rows.sparkSession, root, log, number)

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", f"{log}/ticks").trigger(processingTime=every).start()


def logged(spark: SparkSession, log: str) -> DataFrame:
    """The stream of changes (path, change, at) that ``watching`` finds."""
    return spark.readStream.schema(LOGGED).option("recursiveFileLookup", "true").parquet(f"{log}/changes")


#: What two changes of a path in a row come to; None: to nothing.
NET = {("added", "modified"): "added", ("added", "deleted"): None, ("modified", "deleted"): "deleted", ("deleted", "added"): "modified", ("deleted", "modified"): "modified"}


def net(first: str | None, then: str) -> str | None:
    return then if first is None else NET.get((first, then), then)


class UntilQuiet(StatefulProcessor):
    """Holds the changes of a unit until none has come for ``quiet`` milliseconds, then gives what each path's come to.

    State is a row for each path with a pending change and one timer for the unit.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "change string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for path, change, at in frame.sort_values("at", kind="stable")[["path", "change", "at"]].itertuples(index=False):
                before = self.pending.getValue((path,)) if self.pending.containsKey((path,)) else None
                change = net(before[0] if before else None, change)
                if change is None:
                    self.pending.removeKey((path,))
                else:
                    self.pending.updateValue((path,), (change, at))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(p[0], v[0], v[1]) for p, v in self.pending.iterator()]
        self.pending.clear()
        if found:
            yield pd.DataFrame(found, columns=["path", "change", "at"])


def debounced(changes: DataFrame, quiet: int = 2000, unit: Column | None = None) -> DataFrame:
    """The stream ``changes`` (path, change, at) once they are quiet: one change for each path of a burst.

    ``unit`` is what must be quiet: by default each path for itself, which keeps units small; a
    store's name to wait for all of its paths. Needs the state store of RocksDB.
    """
    keyed = changes.withColumn("unit", F.col("path") if unit is None else unit)
    return keyed.groupBy("unit").transformWithStateInPandas(UntilQuiet(quiet), outputStructType=LOGGED, outputMode="append", timeMode="processingTime")
