"""How the driver's tables stand in for the engine's inputs, in Spark and in SQL.

An analogy, not reference data: documents are items, embeddings their vectors, labels the human
signatures, events the metric samples, and foreign keys or numbers of rows the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import derive

TODAY = "2024-05-01"
KINDS = ("instruction", "project-state", "feedback", "knowledge", "reference")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    folder = F.when(i % 11 == 0, "inbox").when(i % 7 == 0, "user").when(i % 3 == 0, F.concat(F.lit("projects/"), F.col("source"))).otherwise(F.col("source"))
    x = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(folder, F.lit("/"), i, F.lit(".md")).alias("path"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"),
        F.coalesce("text", F.lit("")).alias("body"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % 5 + 1).cast("int")).alias("type"),
        F.col("source").alias("workspace"), F.col("lang").alias("scope"), F.when(i % 17 == 0, "private").otherwise("team").alias("visibility"),
        F.when(i % 13 == 0, F.concat(F.lit("2024-0"), i % 9 + 1, F.lit("-15"))).alias("expires"),
        F.when(i % 19 == 0, (i % 23).cast("long")).alias("stated"), F.array(F.concat(F.lit("tag"), i % 6)).alias("tags"),
    )
    signed = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("human_signed")).distinct()
    x = x.join(signed, "doc_id", "left").withColumn("human_signed", F.coalesce("human_signed", F.lit(False)))
    x = x.withColumn("tier", derive.tier(F.col("path"), F.col("type"), F.col("human_signed"), F.col("expires"), TODAY))
    return x.withColumn("tokens", derive.estimated_tokens(F.col("stated"), F.col("body")))


#: The same items as a common table expression.
ITEMS_SQL = f"""items0 AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'inbox' WHEN d.doc_id % 7 = 0 THEN 'user' WHEN d.doc_id % 3 = 0 THEN 'projects/' || source ELSE source END
           || '/' || d.doc_id || '.md' AS path,
         split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body,
         CASE d.doc_id % 5 WHEN 0 THEN 'instruction' WHEN 1 THEN 'project-state' WHEN 2 THEN 'feedback' WHEN 3 THEN 'knowledge' ELSE 'reference' END AS type,
         source AS workspace, lang AS scope, CASE WHEN d.doc_id % 17 = 0 THEN 'private' ELSE 'team' END AS visibility,
         CASE WHEN d.doc_id % 13 = 0 THEN '2024-0' || (d.doc_id % 9 + 1) || '-15' END AS expires,
         CASE WHEN d.doc_id % 19 = 0 THEN d.doc_id % 23 END AS stated, ['tag' || (d.doc_id % 6)] AS tags,
         d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS human_signed
  FROM documents d),
items AS (
  SELECT *, CASE WHEN path LIKE 'inbox/%' OR path LIKE '%/inbox/%' THEN 2 WHEN NOT human_signed THEN 2
                 WHEN coalesce(length(expires) >= 10 AND left(expires, 10) < '{TODAY}', false) THEN 2
                 WHEN type = 'instruction' THEN CASE WHEN path LIKE 'user/%' OR path LIKE '%projects/%' THEN 0 ELSE 2 END
                 WHEN type = 'project-state' THEN 0 WHEN type IN ('feedback', 'knowledge') THEN 1 ELSE 2 END AS tier,
         CAST(coalesce(stated, greatest(1, length(body) // 4)) AS BIGINT) AS tokens FROM items0)"""


def edges(items: DataFrame, of: int = 3) -> DataFrame:
    """(source, target): each item refers to those at 2 and 3 times its number, modulo their count, and to itself plus one."""
    n = items.agg(F.max("doc_id")).first()[0] + 1
    to = items.select("doc_id", F.col("path").alias("target"))
    refs = items.select(F.col("path").alias("source"), F.explode(F.array(*[F.pmod(F.col("doc_id") * k + k, F.lit(n)) for k in range(1, of + 1)])).alias("doc_id"))
    return refs.join(to, "doc_id").select("source", "target", F.lit("refs").alias("type")).distinct()


EDGES_SQL = """edges AS (
  SELECT DISTINCT s.path AS source, t.path AS target
  FROM items s, (SELECT max(doc_id) + 1 AS n FROM items) m, (VALUES (1), (2), (3)) k(k) JOIN items t ON t.doc_id = (s.doc_id * k + k) % n)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: event types are metrics, users tenants; event numbers give the order of arrival."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("tenant_id"), F.col("event_type").alias("name"), F.lit("counter").alias("kind"), "value",
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("arrival"),
    )


SAMPLES_SQL = "samples AS (SELECT user_id AS tenant_id, event_type AS name, value, CAST(floor(epoch(ts)) AS BIGINT) AS secs, event_id AS arrival FROM events)"
