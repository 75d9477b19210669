"""Queries of the training-data operators over the driver's tables, with the contracts' parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import ann_blocks, exact_topk, language_id, license_templates, line_templates, mixture, packing, pii_crf, quality_cnn, shallot, simhash_pivots, source_divergence, token_scan
from quillon.llm.common import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_blocks.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality_cnn.learnt(docs, table(spark, sf_dir, "labels"), ~quality_cnn.held_out())
    scored = quality_cnn.scored(docs, net).select("doc_id", quality_cnn.held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.spans(docs, pii_crf.learnt(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scanned(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), line_templates.Rule(every=True), counts=True)
    # The digests are small: they go to a few files instead of one for each task that had texts.
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256")).hint("rebalance")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", simhash_pivots.hexadecimal().alias("fingerprint"), "component_id")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix_documents(table(spark, sf_dir, "documents"), share=1.5, epochs=2.0, weights=(5.0, 2.0, 1.0))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.best(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audited(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learnt(docs, ~language_id.held_out())
    found = language_id.identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shallot.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, seed="2")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_quality": op2_quality,
        "op3_pii": op3_pii,
        "op4_token_counts": op4_token_counts,
        "op5_licenses": op5_licenses,
        "op6_simhash": op6_simhash,
        "op7_mixture": op7_mixture,
        "op8_lines": op8_lines,
        "op9_packing": op9_packing,
        "op10_topk": op10_topk,
        "op11_divergence": op11_divergence,
        "op12_language": op12_language,
        "op13_clusters": op13_clusters,
    }


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """One common table expression for the assignment and one for the means of each round."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (
  SELECT vec_id, e, cluster, distance FROM (
    SELECT v.vec_id, v.e, c.cluster, d.distance, row_number() OVER (PARTITION BY v.vec_id ORDER BY d.distance, c.cluster) AS r
    FROM v, c{n} c, LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.e, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance) d) WHERE r = 1)""")
        if n < rounds:
            steps.append(f"""s{n} AS (
  SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS i FROM a{n}) GROUP BY cluster, i),
c{n + 1} AS (
  SELECT c.cluster, coalesce(m.m, c.m) AS m FROM c{n} c
  LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM s{n} GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, e AS m
  FROM (SELECT e, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {k})),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE_SQL = {
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS BIGINT) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (
  SELECT c.lang, c.term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (sum(c.n) + 2)) // (any_value(t.n) + 2 * any_value(v.v)) AS BIGINT) AS q
  FROM c JOIN v ON v.lang = c.lang JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY lang) t ON t.lang = c.lang GROUP BY c.lang, c.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q)) // (p.p + l.q)
  FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10""",
    "op13_clusters": clusters_sql(),
    "op1_nearest": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_mixture": r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM g),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least((SELECT max(lev) FROM l WHERE lev <= cap / weight) * weight, cap) AS target FROM l),
n AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
m AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - whole * source_size) AS need FROM n),
c AS (SELECT s.doc_id, s.size, m.source_size, m.target, m.whole, m.need,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY place, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN m ON s.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, need - before)) AS BIGINT) AS taken FROM c""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
