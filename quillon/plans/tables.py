"""Tables in the shared folder, and small plan helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset (local tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_paths: list[str] = []
_kept: list[DataFrame] = []


Mark = tuple[int, int]


def mark() -> Mark:
    """A place in the list of tables that ``written`` and ``reused`` make, for ``made``."""
    return len(_paths), len(_kept)


def made(since: Mark) -> tuple[list[str], list[DataFrame]]:
    """The tables made since, for ``delete`` at a later time."""
    return _paths[since[0] :], _kept[since[1] :]


def delete(spark: SparkSession, tables: tuple[list[str], list[DataFrame]], but: DataFrame | None = None) -> None:
    """Deletes ``made`` tables and frees their shuffle files; those that ``but`` reads stay. Whatever else reads them must have run."""
    paths, kept = tables
    for df in kept:
        df.unpersist()
    read = but.inputFiles() if but is not None and paths else []
    gone = [p for p in paths if not any(p.rsplit("/", 1)[-1] in f for f in read)]
    _paths[:] = [p for p in _paths if p not in gone]
    _kept[:] = [df for df in _kept if not any(df is x for x in kept)]
    freed(spark, *gone)


def freed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, and lets what no one refers to any more let go of its shuffle files."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``written`` and ``reused`` make inside, once the block is left.

    What a query returns reads its tables when it runs, so the block must hold the action as well.
    """
    since = mark()
    try:
        yield
    finally:
        delete(spark, made(since))


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` writes last and returns, without the others that it wrote on the way."""
    since = mark()
    out = make()
    delete(spark, made(since), out)
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in have:
        name += "_"
    return name


def unwritten(spark: SparkSession) -> str:
    """A new folder in the shared one, which ``scratch`` deletes."""
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def written(df: DataFrame, compact: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: one run of its plan, and no lineage behind it.

    ``compact`` first rebalances the rows, so that a small table becomes a few files rather than
    one for each task; a large one stays spread over files of the advisory partition size.
    """
    df = df.hint("rebalance") if compact else df
    path = unwritten(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``written`` returned before its block ends; nothing may read it any more."""
    spark, path = df.sparkSession, df._quillon_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_stored: dict[tuple[str, str], str] = {}


def stored_once(spark: SparkSession, name: str, write: Callable[[str], None], anew: bool = False) -> str:
    """The folder where ``write`` put what ``name`` stands for: the first call of an application writes it, others find it."""
    key = (spark.sparkContext.applicationId, name)
    if anew or key not in _stored:
        path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
        write(path)
        _stored[key] = path
    return _stored[key]


def reused(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for several readers of one query.

    What a lost executor held is computed again from its lineage, which this does not cut; for
    loops use ``written``. ``scratch`` or ``spark.catalog.clearCache()`` frees it.
    """
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return _kept[-1]


#: Rows that one task numbers or adds up in order.
STRETCH = 1 << 20
#: Rows of a table that is broadcast at most; rows here are a few numbers or a path.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (stored) with a broadcast hint if it has few rows; otherwise Spark joins by a shuffle and splits hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    """The first ``limit`` rows (None: all) with a column rank from 1; ``order`` is a total order.

    Up to STRETCH rows are numbered in one task. More are sorted by ranges, numbered within their
    range and moved on by the sizes of the ranges before.
    """
    if limit is not None and limit <= STRETCH:
        return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    place = F.monotonically_increasing_id()
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place))
    part = F.shiftright("__at", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # As many rows as there were partitions.
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = dealt.withColumn("__part", part).join(starts, "__part").withColumn("rank", rank).drop("__at", "__part", "__before")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def within_budget(hits: DataFrame, budget: int | None) -> DataFrame:
    """The longest prefix by rank whose tokens fit; the first hit always stays.

    Tokens are added up in two levels, over stretches of ranks and within each.
    """
    if budget is None:
        return hits
    x = hits.withColumn("__stretch", F.floor((F.col("rank") - 1) / STRETCH))
    sums = x.groupBy("__stretch").agg(F.sum("tokens").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(sums.select("__stretch", before.alias("__before"))), "__stretch")
    total = F.col("__before") + F.sum("tokens").over(Window.partitionBy("__stretch").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = x.withColumn("__total", total).filter((F.col("rank") == 1) | (F.col("__total") <= budget))
    return kept.drop("__stretch", "__before", "__total")
