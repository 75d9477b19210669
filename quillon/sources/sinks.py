"""Sinks: published index versions, tier files, bundles and result formats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.history import History
from quillon.operators.incremental import checked_unique
from quillon.plans.tables import written


def publish(items: DataFrame, root: str) -> str:
    """Writes ``items`` as a new version below ``root`` and then points to it.

    A failed build (also: a path that occurs twice) leaves the current version as it is. The
    pointer is a numbered table of one row, written last, so it works on any store that Spark
    writes; of two publishers with the same number the second fails, and its version is not used.
    """
    checked_unique(items)
    version = f"{root}/versions/{uuid.uuid4().hex}"
    items.write.parquet(version)
    spark = items.sparkSession
    number = _current(spark, root)[0] + 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("error").parquet(f"{root}/pointer/{number:09d}")
    return version


def _current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("number long, version string").parquet(f"{root}/pointer/*").orderBy(F.desc("number")).first()
    except AnalysisException:
        row = None
    return (row.number, row.version) if row else (0, None)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that was published last."""
    return spark.read.parquet(_current(spark, root)[1])


def write_tier(blocks: DataFrame, path: str) -> None:
    """A tier's blocks as text files whose names give their order; one file if they fit one partition."""
    # Every block ends with a line end, which the writer adds again.
    blocks.orderBy("part", "path").select(F.regexp_replace("block", r"\n\z", "")).write.text(path)


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Parquet tables with a manifest of their row counts."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    counts = [(n, spark.read.parquet(f"{path}/{n}").count()) for n in tables]
    spark.createDataFrame(counts, "name string, n long").coalesce(1).write.parquet(f"{path}/manifest")


class BadBundle(ValueError):
    pass


def import_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The bundle's tables, once their counts agree with the manifest."""
    out = {}
    for row in spark.read.parquet(f"{path}/manifest").collect():
        out[row.name] = spark.read.parquet(f"{path}/{row.name}")
        if out[row.name].count() != row.n:
            raise BadBundle(row.name)
    return out


def export_commits(commits: DataFrame, history: History, refs: DataFrame, path: str, since: DataFrame | None = None) -> None:
    """A bundle of what is reachable from ``refs`` (name, sha), without what is from ``since`` (sha), and of the refs.

    prerequisites are the parents that the bundle does not hold.
    """
    since = since if since is not None else refs.select("sha").limit(0)
    rows = written(commits.join(history.between(since, refs.select("sha")), "sha", "left_semi"))
    outside = rows.select(F.explode("parents").alias("sha")).distinct().join(rows, "sha", "left_anti")
    export_bundle({"commits": rows, "refs": refs.select("name", "sha"), "prerequisites": outside}, path)


def import_commits(commits: DataFrame, path: str, own: str) -> tuple[DataFrame, DataFrame]:
    """``commits`` with those of a bundle that are new, and the refs (name, sha) to merge: all but ``own``.

    A bundle is refused whose counts are wrong or that builds on commits which are not here.
    """
    tables = import_bundle(commits.sparkSession, path)
    missing = tables["prerequisites"].join(commits, "sha", "left_anti").orderBy("sha").first()
    if missing is not None:
        raise BadBundle(f"prerequisite {missing.sha} is missing")
    new = tables["commits"].select(*commits.columns).join(commits.select("sha"), "sha", "left_anti").select(*commits.columns)
    return commits.unionByName(new), tables["refs"].filter(F.col("name") != own)


def json_hits(hits: DataFrame) -> DataFrame:
    """Ranked hits as one JSON object each (six fields), by rank."""
    return hits.select("rank", F.to_json(F.struct("path", "title", "score", "tier", "tokens", "hop_distance")).alias("json"))


# The layouts of a result line and of a usage line.
HIT_LINE = "[T%d%s] %s  (score=%.3f, ~%dt)\n     %s"
COUNTER_LINE = "%-20s %6d calls  %4d errors  avg %7.2fms  min %7.2fms  max %7.2fms"
GAUGE_LINE = "%-20s %6d samples  last=%.2f  min=%.2f  max=%.2f"


#: What stands for an empty list of hits (fixed value).
NO_HITS = "(no results)"


def text_hits(hits: DataFrame) -> DataFrame:
    """(rank, line): two lines of text for each hit, by rank; one row of rank 0 that says so if there are none."""
    hop = F.when(F.col("hop_distance") > 0, F.concat(F.lit(" +"), F.col("hop_distance"))).otherwise("")
    line = F.format_string(HIT_LINE, "tier", hop, "title", "score", "tokens", "path")
    none = hits.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(0).cast("long").alias("rank"), F.lit(NO_HITS).alias("line"))
    return hits.select(F.col("rank").cast("long").alias("rank"), line.alias("line")).unionByName(none)


def text_usage(report: DataFrame) -> DataFrame:
    """A line for each metric: calls and errors of counters, the last value of gauges."""
    counter: Column = F.format_string(COUNTER_LINE, "name", "calls", "errors", "avg", "min", "max")
    gauge = F.format_string(GAUGE_LINE, "name", "calls", "last", "min", "max")
    return report.select("name", F.when(F.col("kind") == "counter", counter).otherwise(gauge).alias("line"))
