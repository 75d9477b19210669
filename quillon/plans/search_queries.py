"""Search, vector, graph and context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import graph, materialize, search, vector
from quillon.operators.search import All, Any, Filter, Index, Near, Phrase, Prefix, Term, Without
from quillon.plans.driver_tables import EDGES_SQL, ITEMS_SQL, edges, items, table
from quillon.plans.tables import shared_dir, stored_once
from quillon.sources import sinks

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def plain_index(spark, sf_dir) -> Index:
    return Index.of(items(spark, sf_dir), analyser="plain")


def stored_index(spark, sf_dir, anew: bool = False) -> Index:
    """The index of a folder's documents: the first query of an application builds it, all others read it."""
    return Index.read(spark, stored_once(spark, f"index of {sf_dir}", plain_index(spark, sf_dir).write, anew), "plain")


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("path", F.round("score", 6).alias("score"), "tier", "tokens", F.col("rank").cast("long").alias("rank"))


TOKENS_SQL = f"""{ITEMS_SQL},
raw AS (SELECT path, 'title' AS field, regexp_extract_all(title, '[0-9A-Za-z]+') AS l FROM items
        UNION ALL SELECT path, 'body', regexp_extract_all(body, '[0-9A-Za-z]+') FROM items
        UNION ALL SELECT path, 'tags', regexp_extract_all(array_to_string(tags, ' '), '[0-9A-Za-z]+') FROM items),
tok AS (SELECT path, field, lower(unnest(l)) AS term, generate_subscripts(l, 1) AS pos FROM raw),
len AS (SELECT path, sum(len(l)) AS d FROM raw GROUP BY path),
stat AS (SELECT count(*) AS total, avg(d) AS mean FROM len)"""


def ranked_sql(leaves: list[str], match: str, where: str = "true", limit: int = 10, silent: tuple = (), budget: int | None = None) -> str:
    """``leaves``: SQL for (path, field, hits) each; ``match``: a condition over m0, m1, ..."""
    parts = ",\n".join(
        f"h{i} AS (SELECT path, sum(CASE field WHEN 'body' THEN 1.0 ELSE 2.0 END * hits) AS f FROM ({x}) GROUP BY path HAVING sum(hits) > 0),\n"
        f"n{i} AS (SELECT count(*) AS n FROM h{i})" for i, x in enumerate(leaves)
    )
    idf = "CASE WHEN ln((total - n{0}.n + 0.5) / (n{0}.n + 0.5)) > 0 THEN ln((total - n{0}.n + 0.5) / (n{0}.n + 0.5)) ELSE 1e-6 END"
    score = " + ".join(
        f"coalesce({idf.format(i)} * h{i}.f * 2.2 / (h{i}.f + 1.2 * (0.25 + 0.75 * len.d / mean)), 0)" for i in range(len(leaves)) if i not in silent
    )
    joins = " ".join(f"LEFT JOIN h{i} ON h{i}.path = items.path CROSS JOIN n{i}" for i in range(len(leaves)))
    flags = ", ".join(f"h{i}.path IS NOT NULL AS m{i}" for i in range(len(leaves)))
    cut = "" if budget is None else f"WHERE rank = 1 OR total_tokens <= {budget}"
    return f"""WITH {TOKENS_SQL},
{parts},
s AS (SELECT items.*, {score} AS score, {flags} FROM items JOIN len ON len.path = items.path CROSS JOIN stat {joins}),
r AS (SELECT path, score, tier, tokens, row_number() OVER (ORDER BY score DESC, path) AS rank FROM s WHERE ({match}) AND {where}),
b AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS total_tokens FROM r WHERE rank <= {limit})
SELECT path, round(score, 6) AS score, tier, tokens, rank FROM b {cut}"""


def term_sql(t: str, field: str | None = None) -> str:
    return f"SELECT path, field, count(*) AS hits FROM tok WHERE term = '{t}'" + (f" AND field = '{field}'" if field else "") + " GROUP BY path, field"


@query(ranked_sql([term_sql("apache"), term_sql("license")], "m0 AND m1", "tier <= 2", 10, budget=3000))
def search_budget(spark, sf_dir):
    return shown(search.search(stored_index(spark, sf_dir), search.words("Apache license"), Filter(tier=2, limit=10, budget=3000)))


@query(ranked_sql([term_sql("mit"), term_sql("gnu")], "m0 OR m1", limit=50))
def search_any(spark, sf_dir):
    return shown(search.search(stored_index(spark, sf_dir), Any(Term("mit"), Term("gnu")), Filter(limit=50)))


@query("SELECT path, score FROM (" + ranked_sql([term_sql("license"), term_sql("version"), term_sql("the")], "m0 OR m1 OR m2", limit=30) + ")")
def search_blocks(spark, sf_dir):
    """The best hits of frequent words, from the blocks of postings that can hold them."""
    query = "license OR version OR the"
    return search.best(stored_index(spark, sf_dir), query, 30, scored=0).withColumn("score", F.round("score", 6))


@query(ranked_sql([term_sql("mit"), term_sql("gnu")], "m0 OR m1", limit=50))
def search_stored(spark, sf_dir):
    """The same over an index that is written once and read again, by ranges of terms."""
    import uuid

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    plain_index(spark, sf_dir).write(path)
    return shown(search.search(Index.read(spark, path, "plain"), Any(Term("mit"), Term("gnu")), Filter(limit=50)))


@query(ranked_sql([term_sql("license"), term_sql("version")], "m0 AND m1", limit=50).replace("SELECT path, 'body', regexp_extract_all(body", "SELECT path, 'body', regexp_extract_all(CASE WHEN doc_id % 9 = 1 THEN 'license version' ELSE body END")
       .replace("FROM documents d)", "FROM documents d WHERE d.doc_id % 9 <> 2)"))
def search_refreshed(spark, sf_dir):
    """A search after a change set: ninths of the items are rewritten and deleted."""
    index = plain_index(spark, sf_dir)
    rewritten = index.items.filter("doc_id % 9 = 1").withColumn("body", F.lit("license version")).withColumn("ordinal", F.lit(1))
    after = index.refreshed(rewritten, index.items.filter("doc_id % 9 = 2").select("path"))
    return shown(search.search(after, search.words("license version"), Filter(limit=50)))


@query(SQL["search_refreshed"])
def search_appended(spark, sf_dir):
    """The same change set as a segment of a stored index."""
    import uuid

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    plain_index(spark, sf_dir).write(path)
    index = Index.read(spark, path, "plain")
    rewritten = items(spark, sf_dir).filter("doc_id % 9 = 1").withColumn("body", F.lit("license version")).withColumn("ordinal", F.lit(1))
    after = index.append(path, rewritten, items(spark, sf_dir).filter("doc_id % 9 = 2").select("path"))
    return shown(search.search(after, search.words("license version"), Filter(limit=50)))


@query(ranked_sql([term_sql("license"), term_sql("apache")], "m0 AND NOT m1", limit=50, silent=(1,)))
def search_without(spark, sf_dir):
    return shown(search.search(stored_index(spark, sf_dir), Without(Term("license"), Term("apache")), Filter(limit=50)))


_MIT = "SELECT a.path, a.field, count(*) AS hits FROM tok a JOIN tok b ON a.path = b.path AND a.field = b.field AND b.pos = a.pos + 1 AND b.term = 'license' WHERE a.term = 'mit' GROUP BY a.path, a.field"


@query(ranked_sql([
    _MIT, "SELECT path, field, count(*) AS hits FROM tok WHERE term LIKE 'licen%' AND field = 'body' GROUP BY path, field",
    "SELECT path, field, count(*) AS hits FROM tok WHERE term = 'the' AND pos = 1 GROUP BY path, field", term_sql("apache", "title"),
], "(m0 OR m1 OR m2) AND NOT m3", limit=60, silent=(3,)))
def search_match(spark, sf_dir):
    """A query as text: a phrase, a beginning in one column, a word at a field's start, and what is unwanted."""
    return shown(search.search(stored_index(spark, sf_dir), '("MIT license" OR content:licen* OR ^the) NOT title:apache', Filter(limit=60)))


@query(ranked_sql(["SELECT a.path, a.field, count(*) AS hits FROM tok a JOIN tok b ON a.path = b.path AND a.field = b.field AND b.pos = a.pos + 1 AND b.term = 'public' "
                   "JOIN tok c ON a.path = c.path AND a.field = c.field AND c.pos = a.pos + 2 AND c.term = 'license' WHERE a.term = 'general' GROUP BY a.path, a.field"], "m0", limit=40))  # fmt: skip
def search_phrase(spark, sf_dir):
    return shown(search.search(stored_index(spark, sf_dir), Phrase("general public license"), Filter(limit=40)))


@query(ranked_sql(["SELECT path, field, count(*) AS hits FROM tok WHERE term LIKE 'licen%' GROUP BY path, field"], "m0", limit=60))
def search_prefix(spark, sf_dir):
    return shown(search.search(stored_index(spark, sf_dir), Prefix("licen"), Filter(limit=60)))


@query(ranked_sql([term_sql("license", "body"), term_sql("the")], "m0 OR m1", "scope = 'en' AND type = 'feedback' AND visibility = 'team'", 20))
def search_filtered(spark, sf_dir):
    where = Filter(type="feedback", scope="en", visibility="team", limit=20)
    return shown(search.search(stored_index(spark, sf_dir), Any(Term("license", "body"), Term("the")), where))


@query(ranked_sql([term_sql("license")], "m0", "workspace IN (SELECT min(workspace) FROM items)", 1 << 40))
def search_unlimited(spark, sf_dir):
    """All hits of one source, ranked by ranges."""
    first = items(spark, sf_dir).agg(F.min("workspace")).first()[0]
    return shown(search.search(stored_index(spark, sf_dir), Term("license"), Filter(workspace=first)))


_BATCH = "SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z]+') AS l FROM benchmark"


@query(f"""WITH {TOKENS_SQL}, q AS (SELECT item_id AS query_id, unnest(l) AS term FROM ({_BATCH})),
asked AS (SELECT query_id, term, count(*) AS times, count(*) OVER (PARTITION BY query_id) AS needed FROM q GROUP BY query_id, term),
tf AS (SELECT term, path, sum(CASE field WHEN 'body' THEN 1.0 ELSE 2.0 END) AS f FROM tok WHERE term IN (SELECT term FROM q) GROUP BY term, path),
n AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
s AS (SELECT tf.term, tf.path, (CASE WHEN ln((total - n + 0.5) / (n + 0.5)) > 0 THEN ln((total - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.d / mean)) AS s
      FROM tf JOIN n ON n.term = tf.term JOIN len ON len.path = tf.path CROSS JOIN stat),
r AS (SELECT query_id, path, sum(s * times) AS score FROM s JOIN asked ON asked.term = s.term GROUP BY query_id, path HAVING count(*) = any_value(needed))
SELECT query_id, path, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM r) WHERE rank <= 10""")
def search_batch(spark, sf_dir):
    """Each benchmark text as a query, in one job: the documents that hold all of its words."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search_batch(stored_index(spark, sf_dir), asked).select("query_id", "path", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {TOKENS_SQL} SELECT (SELECT count(*) FROM items) AS documents, (SELECT sum(d)::BIGINT FROM len) AS words, (SELECT count(*) FROM (SELECT DISTINCT term, path, field FROM tok)) AS postings")
def index_build(spark, sf_dir):
    """Builds the stored index anew, as the other searches read it."""
    index = stored_index(spark, sf_dir, anew=True)
    return index.counts.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).join(index.postings.agg(F.count("*").alias("postings")))


_NEAR = (
    "SELECT a.path, a.field, count(DISTINCT a.pos) AS hits FROM tok a JOIN tok b ON a.path = b.path AND a.field = b.field "
    "AND abs(a.pos - b.pos) BETWEEN 1 AND 4 AND b.term = '{1}' WHERE a.term = '{0}' GROUP BY a.path, a.field"
)


@query(
    ranked_sql([_NEAR.format("released", "license"), _NEAR.format("license", "released")], "m0 AND m1", limit=40)
    .replace("n0 AS (SELECT count(*) AS n FROM h0)", "n0 AS (SELECT count(DISTINCT path) AS n FROM tok WHERE term = 'released')")
    .replace("n1 AS (SELECT count(*) AS n FROM h1)", "n1 AS (SELECT count(DISTINCT path) AS n FROM tok WHERE term = 'license')")
)
def search_near(spark, sf_dir):
    return shown(search.search(stored_index(spark, sf_dir), Near("released", "license", 3), Filter(limit=40)))


@query()
def search_stemmed(spark, sf_dir):
    """The stemming analyser has no SQL equivalent; tests compare it with SQLite."""
    return shown(search.search(Index.of(items(spark, sf_dir), "stemmed"), search.words("licensed versions"), Filter(limit=50)))


@query(f"WITH {TOKENS_SQL} SELECT term, count(DISTINCT path) AS documents, count(*) AS places FROM tok GROUP BY term")
def postings_statistics(spark, sf_dir):
    p = plain_index(spark, sf_dir).postings
    return p.groupBy("term").agg(F.count_distinct("path").alias("documents"), F.sum(F.size("positions")).alias("places"))


@query(f"WITH {ITEMS_SQL} SELECT path, title FROM items WHERE contains(lower(path || chr(10) || title || chr(10) || body), 'mit lic') ")
def search_substring(spark, sf_dir):
    return search.substring(stored_index(spark, sf_dir), "MIT Lic").select("path", "title")


@query(f"WITH {ITEMS_SQL} SELECT path, tier, tokens, coalesce(left(expires, 10) < '2024-05-01', false) AS expired FROM items")
def derived_columns(spark, sf_dir):
    from quillon.functions.derive import is_expired
    from quillon.plans.driver_tables import TODAY

    return items(spark, sf_dir).select("path", "tier", "tokens", is_expired(F.col("expires"), TODAY).alias("expired"))


@query(f"""WITH {ITEMS_SQL}
SELECT 0 AS part, '' AS path, '<context tier="1">' || chr(10) || chr(10) AS block
UNION ALL SELECT 1, path, '## ' || title || chr(10) || chr(10) || '<!-- source: ' || path || ' -->' || chr(10) || chr(10) || body || chr(10) || chr(10) FROM items WHERE tier = 1
UNION ALL SELECT 2, '', '</context>' || chr(10)""")
def materialize_tier(spark, sf_dir):
    return materialize.blocks(items(spark, sf_dir), 1)


def embedded(spark, sf_dir) -> DataFrame:
    return vector.with_embeddings(items(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>")), table(spark, sf_dir, "embeddings").join(items(spark, sf_dir).select("doc_id", "path"), F.col("vec_id") == F.col("doc_id")).select("path", "embedding"))


def query_vector(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 7").first().embedding


_KNN_SQL = f"""{ITEMS_SQL},
q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 7),
knn0 AS (SELECT path, tier, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.e) AS sim FROM items JOIN embeddings ON vec_id = doc_id CROSS JOIN q),
knn AS (SELECT path, sim, row_number() OVER (ORDER BY sim DESC, path) AS rank FROM knn0 WHERE tier <= 2)"""


@query(f"WITH {_KNN_SQL} SELECT path, round(sim, 6) AS similarity, rank FROM knn WHERE rank <= 40")
def nearest_items(spark, sf_dir):
    found = vector.nearest(embedded(spark, sf_dir), query_vector(spark, sf_dir), Filter(tier=2))
    return found.select("path", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


_TEXT_SQL = ranked_sql([term_sql("license"), term_sql("mit")], "m0 OR m1", limit=40).replace("WITH ", "", 1).rsplit("SELECT path, round(score", 1)[0]


@query(f"""WITH {_TEXT_SQL}, {_KNN_SQL.split(ITEMS_SQL + ",", 1)[1]},
f AS (SELECT path, sum(1.0 / (60 + rank)) AS score FROM (SELECT path, rank FROM b UNION ALL SELECT path, rank FROM knn WHERE rank <= 40) GROUP BY path)
SELECT path, round(score, 6) AS score, tier, tokens, rank FROM (
  SELECT f.path, f.score, tier, tokens, row_number() OVER (ORDER BY f.score DESC, f.path) AS rank FROM f JOIN items ON items.path = f.path) WHERE rank <= 25""")
def search_hybrid(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    index = Index(embedded(spark, sf_dir), "plain", index.postings, index.counts, stored=True)
    return shown(vector.hybrid(index, Any(Term("license"), Term("mit")), query_vector(spark, sf_dir), Filter(limit=25)))


@query("SELECT len(embedding) AS dimensions, count(*) AS vectors FROM embeddings GROUP BY 1")
def stored_dimensions(spark, sf_dir):
    return vector.stored_dimensions(table(spark, sf_dir, "embeddings"))


@query("SELECT vec_id, len(embedding) AS dimensions, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def decoded_vectors(spark, sf_dir):
    """Vectors as stored bytes and back."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", vector.decoded(vector.encoded(F.col("embedding"))).alias("v"))
    return x.select("vec_id", F.size("v").cast("long").alias("dimensions"), F.round(vector.dot(F.col("v"), F.transform("v", lambda _: F.lit(1.0))), 4).alias("total"))


@query(f"""WITH RECURSIVE {ITEMS_SQL}, {EDGES_SQL},
walk(path, depth) AS (SELECT path, 0 FROM items WHERE doc_id = 5 UNION SELECT target, depth + 1 FROM walk JOIN edges ON source = path WHERE depth < 4)
SELECT i.path, round(1.0 / (1 + min(depth)), 6) AS score, i.tier, min(depth) AS hops FROM walk JOIN items i ON i.path = walk.path
WHERE i.doc_id <> 5 GROUP BY i.path, i.tier""")
def traverse_links(spark, sf_dir):
    x = items(spark, sf_dir)
    start = x.filter("doc_id = 5").first().path
    found = graph.traverse(x, edges(x), start, 4)
    return found.select("path", F.round("score", 6).alias("score"), "tier", F.col("hop_distance").alias("hops"))


@query("""WITH e AS (SELECT 'o' || o_orderkey AS s, 'c' || o_custkey AS t FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
SELECT r.t AS region, count(*) AS orders FROM e o JOIN e c ON o.t = c.s JOIN e r ON c.t = r.s WHERE o.s LIKE 'o%' GROUP BY 1""")
def reached_regions(spark, sf_dir):
    """Key relationships as links: how many orders reach each region in three hops."""
    link = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), x).alias("source"), F.concat(F.lit(b), y).alias("target"))
    all_links = link("orders", "o", "o_orderkey", "c", "o_custkey").unionByName(link("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(link("nation", "n", "n_nationkey", "r", "n_regionkey"))
    seeds = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("seed"))
    reached = graph.neighbours(all_links, seeds, 3).filter("depth = 3")
    return reached.groupBy(F.col("path").alias("region")).agg(F.count("*").alias("orders"))


@query("""WITH i AS (SELECT 'notes/' || p_partkey || '.md' AS path, p_partkey AS k, (SELECT max(p_partkey) FROM part) AS n FROM part)
SELECT a.path AS source, b.path AS target, 'mentions' AS type FROM i a JOIN i b ON b.k = a.k % a.n + 1
UNION SELECT path, 'notes/x' || k || '.md', 'refs' FROM i UNION SELECT path, 'top/' || k || '.md', 'refs' FROM i""")
def link_edges(spark, sf_dir):
    """Links in texts made from the parts table: a name with an alias, a sibling, one above and one that leaves the root."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.max("p_partkey")).first()[0]
    k = F.col("p_partkey")
    body = F.concat(F.lit("See [[ "), k % n + 1, F.lit("|that part]] and [[nobody]], [["), k % n + 1, F.lit("#top]] and [["))
    refs = F.array(F.concat(F.lit("./x"), k, F.lit(".md")), F.concat(F.lit("../top/./"), k, F.lit(".md")), F.lit("../../out.md"))
    return graph.edges_of(part.select(F.concat(F.lit("notes/"), k, F.lit(".md")).alias("path"), body.alias("body"), refs.alias("refs")))


_CONTEXT_HITS = ranked_sql([term_sql("mit"), term_sql("license")], "m0 AND m1", limit=20).replace("WITH ", "WITH RECURSIVE ", 1).rsplit("SELECT path, round(score", 1)[0]


@query(f"""{_CONTEXT_HITS}, {EDGES_SQL},
walk(seed, path, depth) AS (SELECT rank, path, 0 FROM b WHERE rank <= 3 UNION SELECT seed, target, depth + 1 FROM walk JOIN edges ON source = path WHERE depth < 2),
near AS (SELECT seed, w.path, min(depth) AS depth, any_value(tier) AS tier FROM walk w JOIN items ON items.path = w.path GROUP BY seed, w.path HAVING min(depth) > 0),
first AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seed, depth, tier) AS n FROM near WHERE path NOT IN (SELECT path FROM b) AND tier <= 2),
u AS (SELECT path, score, 0 AS seed, rank AS place, 0 AS depth FROM b UNION ALL SELECT path, 1.0 / (1 + depth), seed, 0, depth FROM first WHERE n = 1),
o AS (SELECT u.*, i.tier, i.tokens, row_number() OVER (ORDER BY seed, place, depth, i.tier, u.path) AS rank FROM u JOIN items i ON i.path = u.path),
c AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS total_tokens FROM o)
SELECT path, round(score, 6) AS score, tier, tokens, rank FROM c WHERE rank = 1 OR total_tokens <= 20000""")
def assemble_context(spark, sf_dir):
    index = stored_index(spark, sf_dir)
    return shown(search.context(index, edges(index.items), search.words("MIT license"), Filter(tier=2, budget=20000)))


@query()
def hits_as_json(spark, sf_dir):
    return sinks.json_hits(search.search(stored_index(spark, sf_dir), search.words("MIT license"), Filter(limit=10)))
