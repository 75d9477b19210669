"""Queries over stores: parsing, change sets, merges, imports, promotion and the control plane.

Inputs that the driver's tables do not hold (Markdown with frontmatter, status records, three
versions of a document, grants) are made from their rows by Spark expressions, so work grows with
the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import derive, frontmatter, secrets
from quillon.operators import control_plane, graph, history, incremental, materialize, merge
from quillon.plans.driver_tables import ITEMS_SQL, items, table
from quillon.plans.tables import shared_dir
from quillon.sources import files, sinks
from quillon.streaming import watch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def s(x: str):
    return F.lit(x)


def part_markdown(spark, sf_dir) -> DataFrame:
    """A Markdown document for each part, with frontmatter in several spellings."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.concat(
        s("---\ntitle: \""), F.col("p_name"), s("\"\ntype: "), F.when(k % 3 == 0, "instruction").otherwise("knowledge"), s("\n# a comment\nworkspace: "), F.col("p_brand"),
        s("\nunknown: 1\nprovenance:\n  actor: agent:"), k, s("\n  source: import\ntokens: \"~"), F.col("p_size"), s(" tokens\"\n"),
        F.when(k % 2 == 0, F.concat(s("tags: [a, '"), k % 7, s("', ]\n"))).otherwise(F.concat(s("tags:\n  - a\n  - "), k % 7, s("\n"))),
        s("expires: "), F.when(k % 5 == 0, "~").otherwise("2024-01-02"), s("\n---\n"), s("Body of "), F.col("p_type"), s("\n"),
    )
    whole = F.when(k % 10 == 9, F.concat(s("no frontmatter "), k)).when(k % 10 == 8, F.concat(s("---\ntitle: open "), k)).otherwise(text)
    return p.select(F.concat(s("parts/"), k, s(".md")).alias("path"), whole.alias("text"))


@query("""SELECT 'parts/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 10 < 8 THEN p_name END AS title,
  CASE WHEN p_partkey % 10 < 8 THEN CASE WHEN p_partkey % 3 = 0 THEN 'instruction' ELSE 'knowledge' END END AS type,
  CASE WHEN p_partkey % 10 < 8 THEN p_brand END AS workspace, CASE WHEN p_partkey % 10 < 8 THEN 'agent:' || p_partkey END AS actor,
  CASE WHEN p_partkey % 10 < 8 THEN CAST(p_size AS BIGINT) END AS tokens, CASE WHEN p_partkey % 10 < 8 THEN 'a,' || (p_partkey % 7) ELSE '' END AS tags,
  CASE WHEN p_partkey % 10 < 8 AND p_partkey % 5 <> 0 THEN '2024-01-02' END AS expires,
  CASE WHEN p_partkey % 10 = 9 THEN 'no frontmatter ' || p_partkey WHEN p_partkey % 10 = 8 THEN '---' || chr(10) || 'title: open ' || p_partkey
       ELSE 'Body of ' || p_type || chr(10) END AS body, CAST(p_partkey % 10 = 8 AS INTEGER) AS warnings FROM part""")
def parse_frontmatter(spark, sf_dir):
    x = part_markdown(spark, sf_dir).select("path", frontmatter.parsed(F.col("text")).alias("f")).select("path", "f.*")
    return x.select("path", "title", "type", "workspace", "actor", "tokens", F.array_join("tags", ",").alias("tags"), "expires", "body", F.size("warnings").alias("warnings"))


@query("""SELECT 'parts/' || p_partkey || '.md' AS path, true AS equal FROM part WHERE p_partkey % 10 < 8""")
def frontmatter_round_trip(spark, sf_dir):
    """Rendering what was parsed and parsing it again gives the same fields."""
    names = [n for n in frontmatter.FIELDS if n not in ("body", "warnings")]
    x = part_markdown(spark, sf_dir).filter(F.col("text").startswith("---\ntitle: \"")).select("path", frontmatter.parsed(F.col("text")).alias("f"))
    x = x.withColumn("again", frontmatter.parsed(F.concat(frontmatter.rendered(lambda n: F.col("f")[n]), F.lit("\n"), F.col("f.body"))))
    same = F.lit(True)
    for n in names:
        same &= F.col("f")[n].eqNullSafe(F.col("again")[n])
    return x.select("path", (same & (F.col("again.body") == F.concat(F.lit("\n"), F.col("f.body")))).alias("equal"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", derive.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


_IMPORTED = """WITH f AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'project' WHEN turn % 4 = 1 THEN 'feedback' WHEN turn % 4 = 2 THEN 'user' ELSE 'other' END AS kind, role, coalesce(text, '') AS text FROM conversations),
m AS (SELECT 'c' || conv_id || 't' || turn AS stem, role || ' ' || turn AS title, CASE kind WHEN 'project' THEN 'project-state' WHEN 'feedback' THEN 'feedback' ELSE 'knowledge' END AS type,
  CASE kind WHEN 'project' THEN 'project' WHEN 'feedback' THEN 'project' WHEN 'user' THEN 'user' END AS scope, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, conv_id FROM f),
d AS (SELECT 'inbox/import/memory-' || stem || '.md' AS destination, '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'type: ' || type || chr(10) || coalesce('scope: ' || scope || chr(10), '')
  || 'provenance:' || chr(10) || '  source: import' || chr(10) || 'confidence: proposed' || chr(10) || 'updated: "2024-01-01"' || chr(10) || '---' || chr(10) || chr(10) || body || chr(10) AS text,
  conv_id % 5 = 0 AS there FROM m
  UNION ALL SELECT 'inbox/import/agents-md.md', '---' || chr(10) || 'title: "AGENTS.md"' || chr(10) || 'type: instruction' || chr(10) || 'provenance:' || chr(10) || '  source: import' || chr(10)
  || 'confidence: proposed' || chr(10) || '---' || chr(10) || chr(10) || 'Do this.' || chr(10), false)"""


def memory_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Foreign memory files, root files that are and are not instructions, and the destinations that exist."""
    c = table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*[s(k) for k in ("project", "feedback", "user", "other")]), (F.col("turn") % 4 + 1).cast("int"))
    stem = F.concat(s("c"), "conv_id", s("t"), "turn")
    text = F.concat(s("---\nname: n\ndescription: \""), "role", s(" "), "turn", s("\"\nmetadata:\n  type: "), kind, s("\n  modified: 2024-01-01\n---\n\n"), F.coalesce("text", s("")))
    found = c.select(F.concat(s("projects/p"), F.col("conv_id") % 3, s("/memory/"), stem, s(".md")).alias("path"), text.alias("text"))
    others = spark.createDataFrame([("AGENTS.md", "\n Do this.\n\n"), ("README.md", "not this"), ("sub/AGENTS.md", "nor this"), ("projects/p/memory/deep/x.md", "nor this")], "path string, text string")
    return found.unionByName(others), c.filter("conv_id % 5 = 0").select(F.concat(s("inbox/import/memory-"), stem, s(".md")).alias("path"))


@query(_IMPORTED + " SELECT destination, md5(text) AS text_md5 FROM d WHERE NOT there")
def import_memories(spark, sf_dir):
    return files.imports(*memory_files(spark, sf_dir)).select("destination", F.md5("text").alias("text_md5"))


@query(_IMPORTED + " SELECT count(*) FILTER (WHERE NOT there) AS imported, count(*) FILTER (WHERE there) AS skipped FROM d")
def import_counts(spark, sf_dir):
    return files.import_summary(*memory_files(spark, sf_dir))


@query(f"""SELECT doc_id, {", ".join(f"regexp_matches(coalesce(text, ''), '{p.replace(chr(39), chr(39) * 2)}') AS {n.replace('-', '_')}" for n, p in secrets.RULES.items())},
  left(nullif(regexp_extract(coalesce(text, ''), '{secrets.RULES["private-key"]}'), ''), 4) || '***' AS excerpt FROM documents""")
def secret_findings(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.findings(F.col("text")).alias("f"), secrets.excerpt(F.col("text"), "private-key").alias("excerpt"))
    return found.select("doc_id", *[F.array_contains("f", n).alias(n.replace("-", "_")) for n in secrets.RULES], "excerpt")


_ENTROPY_SQL = """log2(length(t)) - list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: (length(t) - length(replace(t, c, ''))) * log2(length(t) - length(replace(t, c, ''))))) / length(t)"""


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN coalesce(text, '') || ' ' || to_base64(CAST(sha256('k' || doc_id) AS BLOB)) ELSE coalesce(text, '') END AS text FROM documents),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{secrets.TOKEN}')) AS t FROM d),
b AS (SELECT *, {_ENTROPY_SQL} AS bits FROM t),
f AS (SELECT *, CASE WHEN regexp_matches(t, '{secrets.HEX}') THEN length(t) >= {secrets.HEX_LENGTH} AND length(t) NOT IN {secrets.DIGESTS} AND bits >= {secrets.HEX_BITS}
  ELSE length(t) >= {secrets.MIXED_LENGTH} AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]') AND bits >= {secrets.MIXED_BITS} END AS found FROM b)
SELECT d.doc_id, count(t) AS tokens, count(*) FILTER (WHERE found) AS found, round(coalesce(max(bits), 0), 6) AS most_bits FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def entropy_findings(spark, sf_dir):
    """Keys without a known form: every fourth document gets one, made from its number."""
    text, k = F.coalesce("text", s("")), F.col("doc_id")
    key = F.base64(F.sha2(F.concat(s("k"), k), 256).cast("binary"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 4 == 0, F.concat(text, s(" "), F.replace(key, s("\r\n"), s("")))).otherwise(text).alias("text"))
    tokens = F.regexp_extract_all("text", F.lit(secrets.TOKEN), F.lit(0))
    most = F.round(F.coalesce(F.array_max(F.transform(tokens, secrets.entropy)), s(0.0)), 6)
    return d.select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.size(secrets.random_tokens(F.col("text"))).cast("long").alias("found"), most.alias("most_bits"))


def status_lines(spark, sf_dir) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(s("dir with space/"), k, F.when(k % 9 == 0, ".txt").otherwise(".md"))
    line = (
        F.when(k % 6 == 0, F.concat(s("1 .M N... 100644 100644 100644 aa bb "), path)).when(k % 6 == 1, F.concat(s("1 A. N... 000000 100644 100644 00 bb "), path))
        .when(k % 6 == 2, F.concat(s("1 .D N... 100644 100644 000000 aa aa "), path)).when(k % 6 == 3, F.concat(s("2 R. N... 100644 100644 100644 aa bb R100 "), path, s("\told/"), k, s(".md")))
        .when(k % 6 == 4, F.concat(s("? "), path)).otherwise(F.concat(s("u "), F.when(k % 4 == 1, "UU").otherwise("DU"), s(" N... 100644 100644 100644 100644 aa bb cc "), path))
    )
    return d.select(line.alias("line"))


@query("""WITH p AS (SELECT doc_id AS k, 'dir with space/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents)
SELECT CASE k % 6 WHEN 0 THEN 'modified' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' WHEN 4 THEN 'added' ELSE 'modified' END AS kind,
       path, CASE WHEN k % 6 = 3 THEN 'old/' || k || '.md' END AS old_path FROM p""")
def status_changes(spark, sf_dir):
    return files.changes(status_lines(spark, sf_dir))


@query("""SELECT 'dir with space/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path,
CASE WHEN doc_id % 4 = 1 THEN 'content' ELSE 'modify/delete by ours' END AS class FROM documents WHERE doc_id % 6 = 5""")
def conflict_classes(spark, sf_dir):
    return files.unmerged(status_lines(spark, sf_dir)).select("path", merge.conflict_class(F.col("code")).alias("class"))


def snapshots(spark, sf_dir):
    """Paths tracked now, the records since, and the paths an index knows."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(s("dir with space/"), k, F.when(k % 9 == 0, ".txt").otherwise(".md")).alias("path")
    tracked = d.filter("doc_id % 6 in (0, 1, 2, 5)").select(path)
    known = d.filter("doc_id % 6 in (0, 2) or doc_id % 12 in (1, 3, 5)").select(path).unionByName(d.filter("doc_id % 6 = 3").select(F.concat(s("old/"), k, s(".md")).alias("path")))
    return tracked, files.changes(status_lines(spark, sf_dir)), known


#: The classes by sets of paths: what is tracked, what the records say, and what is known.
_CLASSES = """WITH p AS (SELECT doc_id AS k, 'dir with space/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents),
modified AS (SELECT path FROM p WHERE k % 6 IN (0, 5)), added AS (SELECT path FROM p WHERE k % 6 IN (1, 4)), deleted AS (SELECT path FROM p WHERE k % 6 = 2),
renamed AS (SELECT path AS new, 'old/' || k || '.md' AS old FROM p WHERE k % 6 = 3),
cur AS (SELECT path FROM ((SELECT path FROM p WHERE k % 6 IN (0, 1, 2, 5) UNION SELECT path FROM added UNION SELECT new FROM renamed) EXCEPT (SELECT path FROM deleted UNION SELECT old FROM renamed)) WHERE path LIKE '%.md'),
known AS (SELECT path FROM p WHERE k % 6 IN (0, 2) OR k % 12 IN (1, 3, 5) UNION SELECT old FROM renamed),
dirty AS (SELECT path FROM modified UNION SELECT new FROM renamed),
classes AS (SELECT path, 'added' AS change FROM (SELECT path FROM cur EXCEPT SELECT path FROM known)
  UNION ALL SELECT path, 'modified' FROM (SELECT path FROM cur INTERSECT SELECT path FROM known INTERSECT SELECT path FROM dirty)
  UNION ALL SELECT path, 'deleted' FROM (SELECT path FROM known EXCEPT SELECT path FROM cur))"""


@query(_CLASSES + " SELECT path, change FROM classes")
def classified_changes(spark, sf_dir):
    return incremental.classified(*snapshots(spark, sf_dir))


@query(_CLASSES + """ SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'modified') AS modified, count(*) FILTER (WHERE change = 'deleted') AS deleted, count(*) = 0 AS up_to_date FROM classes""")
def change_summary(spark, sf_dir):
    return incremental.summary(incremental.classified(*snapshots(spark, sf_dir)))


@query(f"""WITH {ITEMS_SQL}
SELECT path, md5(CASE WHEN doc_id % 8 = 1 THEN 'second ' || title WHEN doc_id % 8 = 2 THEN 'first ' || title ELSE title END) AS title_md5 FROM items WHERE doc_id % 8 <> 3""")
def applied_changes(spark, sf_dir):
    """Items after a batch with deletes and with two upserts of some paths."""
    known = items(spark, sf_dir).select("doc_id", "path", "title")
    first = known.filter("doc_id % 8 in (1, 2)").withColumn("title", F.concat(s("first "), "title")).withColumn("ordinal", F.lit(1))
    second = known.filter("doc_id % 8 = 1").withColumn("title", F.concat(s("second "), "title")).withColumn("ordinal", F.lit(2))
    after = incremental.applied(known, first.unionByName(second), known.filter("doc_id % 8 = 3").select("path"))
    return after.select("path", F.md5("title").alias("title_md5"))


def versions(spark, sf_dir) -> DataFrame:
    """base, ours and theirs of each order, which differ by its number."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")

    def side(name: str):
        mine = {"base": 0, "ours": 1, "theirs": 2}[name]
        changed = lambda n: F.lit(False) if mine == 0 else (k % (n + mine) == 0)
        values = {
            "title": F.when(changed(3), F.concat(s(name), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority")),
            "type": F.when(changed(5), s(name)).otherwise(F.when(k % 4 == 0, None).otherwise(s("knowledge"))),
            "updated": F.concat(s("2024-0"), (k + mine) % 9 + 1, s("-01")),
            "body": F.when((k % 7 == 0) & F.lit(mine > 0), s("both")).when(changed(8), s(name)).otherwise(s("text")),
            "tags": F.array(s("a"), F.concat(s("t"), (k + mine) % 3)),
            "actor": s(f"actor:{name}"),
            "refs": F.array(s(f"{name}.md")),
        }
        columns = []
        for f in frontmatter.SCHEMA.split(", "):
            n, kind = f.split(" ", 1)
            columns.append((values[n] if n in values else F.lit(None)).cast({"long": "bigint"}.get(kind, kind)).alias(n))
        return F.struct(*columns).alias(name)

    return o.select(F.concat(s("orders/"), k, s(".md")).alias("path"), side("base"), side("ours"), side("theirs"))


@query("""WITH v AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderkey % 4 = 0 AS nt FROM orders),
x AS (SELECT k, p AS bt, CASE WHEN k % 4 = 0 THEN 'ours' || p ELSE p END AS ot, CASE WHEN k % 5 = 0 THEN 'theirs' || p ELSE p END AS tt,
  CASE WHEN nt THEN NULL ELSE 'knowledge' END AS bk, CASE WHEN k % 6 = 0 THEN 'ours' WHEN nt THEN NULL ELSE 'knowledge' END AS ok,
  CASE WHEN k % 7 = 0 THEN 'theirs' WHEN nt THEN NULL ELSE 'knowledge' END AS tk, 'text' AS bb,
  CASE WHEN k % 7 = 0 THEN 'both' WHEN k % 9 = 0 THEN 'ours' ELSE 'text' END AS ob, CASE WHEN k % 7 = 0 THEN 'both' WHEN k % 10 = 0 THEN 'theirs' ELSE 'text' END AS tb FROM v),
y AS (SELECT *, ot <> tt AND ot <> bt AND tt <> bt AS ct, ok IS DISTINCT FROM tk AND ok IS DISTINCT FROM bk AND tk IS DISTINCT FROM bk AS ck, ob <> tb AND ob <> bb AND tb <> bb AS cb FROM x)
SELECT 'orders/' || k || '.md' AS path, CASE WHEN ct THEN NULL WHEN ot = tt OR tt = bt THEN ot ELSE tt END AS title,
  CASE WHEN ck THEN NULL WHEN ok IS NOT DISTINCT FROM tk OR tk IS NOT DISTINCT FROM bk THEN ok ELSE tk END AS type, CASE WHEN cb THEN NULL WHEN ob = tb OR tb = bb THEN ob ELSE tb END AS body,
  'a,t' || ((k + 1) % 3) || ',t' || ((k + 2) % 3) AS tags, greatest('2024-0' || ((k + 1) % 9 + 1) || '-01', '2024-0' || ((k + 2) % 9 + 1) || '-01') AS updated,
  'actor:ours' AS actor, 'ours.md' AS refs,
  concat_ws(',', CASE WHEN ct THEN 'title' END, CASE WHEN ck THEN 'type' END, CASE WHEN cb THEN 'body' END) AS conflicts FROM y""")
def merged_documents(spark, sf_dir):
    m = merge.merged_fields(versions(spark, sf_dir))
    return m.select("path", "title", "type", "body", F.array_join("tags", ",").alias("tags"), "updated", "actor", F.array_join("refs", ",").alias("refs"), F.array_join("conflicts", ",").alias("conflicts"))


@query()
def merged_markdown(spark, sf_dir):
    """The same merge over whole texts, rendered; conflicts keep both."""
    v = versions(spark, sf_dir)
    text = lambda n: F.concat(frontmatter.rendered(lambda f: F.col(n)[f]), F.lit("\n"), F.col(n)["body"]).alias(n)
    return merge.merged_texts(v.select("path", text("base"), text("ours"), text("theirs")))


def key_lines(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    line = F.when(k % 4 == 0, F.concat(s("# "), "c_name")).when(k % 4 == 1, F.concat(s("human:"), k, s("  ssh-ed25519\tAAAA"), k)).when(k % 4 == 2, F.concat(s(" agent:"), k, s(" ssh-rsa KEY "))).otherwise(F.concat(s("bare "), k))
    return table(spark, sf_dir, "customer").select(line.alias("line"))


@query("""SELECT CASE WHEN c_custkey % 4 = 1 THEN 'human:' ELSE 'agent:' END || c_custkey AS principal, CASE WHEN c_custkey % 4 = 1 THEN 'human' ELSE 'agent' END AS role,
CASE WHEN c_custkey % 4 = 1 THEN 'ssh-ed25519' ELSE 'ssh-rsa' END AS key_type, CASE WHEN c_custkey % 4 = 1 THEN 'AAAA' || c_custkey ELSE 'KEY' END AS key FROM customer WHERE c_custkey % 4 IN (1, 2)""")
def allowed_signers(spark, sf_dir):
    return files.signers(key_lines(spark, sf_dir))


@query("""SELECT 'age1' || c_custkey AS recipient, CASE c_custkey % 3 WHEN 0 THEN 'device:' WHEN 1 THEN 'recovery:' ELSE 'x:' END || c_nationkey AS label,
CASE c_custkey % 3 WHEN 0 THEN 'device' WHEN 1 THEN 'recovery' ELSE 'other' END AS kind FROM customer WHERE c_custkey % 5 <> 0""")
def key_recipients(spark, sf_dir):
    k = F.col("c_custkey")
    label = F.concat(F.when(k % 3 == 0, "device:").when(k % 3 == 1, "recovery:").otherwise("x:"), "c_nationkey")
    lines = table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, F.concat(s("unreadable"), k, s(" l"))).otherwise(F.concat(s("age1"), k, s(" "), label)).alias("line"))
    return files.recipients(lines)


def commits(spark, sf_dir) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        F.sha1(k.cast("string")).alias("sha"), F.concat(s("p/"), "o_custkey", s(".md")).alias("path"), k.alias("ordinal"), F.when(k % 3 == 0, "N").otherwise("G").alias("validity"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.when(k % 2 == 0, "human:").otherwise("agent:"), "o_custkey")).alias("signer"),
        F.when(k % 7 == 0, F.array(s("a"), s("b"))).otherwise(F.array(s("a"))).alias("parents"),
        F.concat(s("Change "), k, s("\n\nLonger text.\n\nStore-Actor: agent "), k, s("\nStore-Source: import\n")).alias("message"),
    )


@query("""SELECT left(sha1(CAST(o_orderkey AS VARCHAR)), 12) AS sha, 'Change ' || o_orderkey AS subject FROM orders
WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)""")
def unsigned_commits(spark, sf_dir):
    c = commits(spark, sf_dir)
    return merge.unsigned_commits(c, c.filter("ordinal % 4 = 0"))


@query("""WITH l AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT 'p/' || o_custkey || '.md' AS path, CASE WHEN k % 2 = 0 THEN 'human' ELSE 'agent' END AS role FROM l WHERE k % 3 <> 0 AND k % 5 <> 0""")
def signer_roles(spark, sf_dir):
    return merge.last_signers(commits(spark, sf_dir)).select("path", derive.signer_role(F.col("signer")).alias("role"))


@query("SELECT left(sha1(CAST(o_orderkey AS VARCHAR)), 12) AS sha, 'agent ' || o_orderkey AS actor, 'import' AS source, CAST(NULL AS VARCHAR) AS session FROM orders")
def provenance_trailers(spark, sf_dir):
    t = lambda k: derive.trailer(F.col("message"), f"Store-{k}")
    return commits(spark, sf_dir).select(F.substring("sha", 1, 12).alias("sha"), t("Actor").alias("actor"), t("Source").alias("source"), t("Session").alias("session"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 IN (2, 3) THEN NULL WHEN c_custkey % 4 = 0 THEN 'user/' ELSE 'projects/one/' END
  || CASE WHEN c_custkey % 6 = 0 AND c_custkey % 4 = 0 THEN NULL ELSE c_custkey || '.md' END AS target,
CASE WHEN c_custkey % 5 = 0 THEN 'not in inbox' WHEN c_custkey % 4 = 3 THEN 'no scope' WHEN c_custkey % 4 = 2 THEN 'scope has no destination'
     WHEN c_custkey % 6 = 0 THEN 'destination exists' END AS why FROM customer""")
def promotions(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.concat(F.when(k % 5 == 0, "other/").otherwise("inbox/"), k, s(".md"))
    scope = F.when(k % 4 == 0, "user").when(k % 4 == 1, "project").when(k % 4 == 2, "org")
    target, why = derive.promotion(path, scope, s("one"), k % 6 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", target.alias("target"), why.alias("why"))


NOW = 1_000_000


@query(f"""WITH e AS (SELECT o_custkey AS t, o_orderkey AS k FROM orders),
s AS (SELECT t, coalesce(arg_max(k % 5 = 1, k) FILTER (WHERE k % 7 = 0), false) AS warm, coalesce(arg_max(k % 2 = 0, k) FILTER (WHERE k % 7 <> 0), false) AS running, max(k) AS last FROM e GROUP BY t)
SELECT t AS tenant_id FROM s WHERE running AND NOT warm AND last < (SELECT max(o_orderkey) FROM orders) - 500""")
def idle_tenants(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 7 == 0, "warm").when(k % 2 == 0, "started").otherwise("stopped")
    events = o.select(F.col("o_custkey").alias("tenant_id"), k.alias("at"), kind.alias("kind"), (k % 5 == 1).alias("flag"))
    now = o.agg(F.max("o_orderkey")).first()[0]
    return control_plane.idle_tenants(control_plane.latest_state(events), now, 500).select("tenant_id")


def devices(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("device_id"), F.col("s_nationkey").alias("tenant_id"), F.when(k % 3 != 0, F.concat(s("S"), k)).alias("serial"), F.when(k % 4 == 0, k * 10).alias("revoked_at")
    )


def tenants(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").filter(k % 6 != 0).select(k.alias("tenant_id"), F.lower(F.replace("n_name", s(" "), s("-"))).alias("slug"), (k % 5 != 0).alias("running"))


@query("""WITH r AS (SELECT l_suppkey, min(l_orderkey) AS k FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 10 ELSE k END AS revoked_at, s_suppkey % 4 <> 0 AND k IS NOT NULL AND s_suppkey % 3 <> 0 AS notify
FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey""")
def revoked_devices(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("device_id"), F.col("l_orderkey").alias("at"))
    return control_plane.revoked(devices(spark, sf_dir), asked).select("device_id", "revoked_at", "notify")


@query(f"""SELECT o_orderkey AS poll_id, CASE WHEN o_orderkey % 9 = 0 THEN 'invalid_grant' WHEN o_orderkey % 5 = 0 THEN 'expired_token' WHEN o_orderkey % 4 = 0 THEN 'authorization_pending'
  WHEN s_suppkey IS NULL OR n.n_nationkey IS NULL OR s_nationkey % 6 = 0 THEN 'server_error' WHEN s_suppkey % 3 = 0 THEN 'authorization_pending' ELSE 'approved' END AS state
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN nation n ON n.n_nationkey = s_nationkey""")
def grant_polls(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    polls = o.select(k.alias("poll_id"), F.concat(s("d"), k).alias("device_code"))
    tenant_of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"), F.col("s_nationkey").alias("tenant_id"))
    grants = o.filter(k % 9 != 0).join(tenant_of, "o_custkey", "left").select(
        F.concat(s("d"), k).alias("device_code"), F.when(k % 5 == 0, NOW).otherwise(NOW + 1).alias("expires_at"), F.when(k % 4 != 0, F.col("o_custkey")).alias("device_id"), "tenant_id"
    )
    return control_plane.poll_states(polls, grants, devices(spark, sf_dir), tenants(spark, sf_dir), NOW)


_ANSWERS = """d AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0),
t AS (SELECT n_nationkey, replace(lower(n_name), ' ', '-') AS slug FROM nation WHERE n_nationkey % 6 <> 0),
x AS (SELECT c_custkey, t.n_nationkey AS tenant, CASE WHEN c_custkey % 8 = 0 THEN 405 WHEN d.s_suppkey IS NULL THEN 401
    WHEN t.slug IS NULL OR t.slug <> replace(lower(n.n_name), ' ', '-') THEN 404 WHEN t.n_nationkey % 10 = 0 THEN 503 ELSE 200 END AS status
  FROM customer JOIN nation n ON n.n_nationkey = c_nationkey LEFT JOIN d ON d.s_suppkey = c_custkey % 12 LEFT JOIN t ON t.n_nationkey = d.s_nationkey),
a AS (SELECT c_custkey AS request_id, status, CASE WHEN status IN (200, 503) THEN tenant END AS tenant_id, status IN (200, 503) AND tenant % 5 = 0 AS start FROM x)"""


def requests(spark, sf_dir) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower(F.replace("n_name", s(" "), s("-"))).alias("asked"))
    address = F.concat(s("/"), "asked", s("/info/refs"))
    return c.join(n, "c_nationkey").select(k.alias("request_id"), F.concat(s("S"), k % 12).alias("serial"), address.alias("url"), F.when(k % 8 == 0, "PUT").otherwise("GET").alias("method"), (k * 3).alias("at"))


def answers(spark, sf_dir) -> DataFrame:
    """A fifth of the tenants is not running; of those with an even key the start fails."""
    started = tenants(spark, sf_dir).filter("not running").select("tenant_id", (F.col("tenant_id") % 2 != 0).alias("ok"))
    return control_plane.authorized(requests(spark, sf_dir), devices(spark, sf_dir), tenants(spark, sf_dir), started)


@query(f"WITH {_ANSWERS} SELECT request_id, status, coalesce(tenant_id, -1) AS tenant_id, coalesce(start, false) AS start FROM a")
def authorized_requests(spark, sf_dir):
    return answers(spark, sf_dir).withColumn("tenant_id", F.coalesce("tenant_id", F.lit(-1)))


@query(f"WITH {_ANSWERS} SELECT tenant_id, max(request_id) * 3 AS last_active, bool_or(start) AS start FROM a WHERE tenant_id IS NOT NULL GROUP BY tenant_id")
def touched_tenants(spark, sf_dir):
    found = answers(spark, sf_dir)
    asked = control_plane.starts(found).withColumn("start", F.lit(True))
    return control_plane.touched(requests(spark, sf_dir), found).join(asked, "tenant_id", "left").withColumn("start", F.coalesce("start", F.lit(False)))


# A history: order k has the parents k / 2 and, for every fifth, k / 3; keys that are no orders end it.
_GRAPH = """e AS (SELECT o_orderkey AS k, o_orderkey // 2 AS p FROM orders WHERE o_orderkey >= 2 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey >= 3 AND o_orderkey % 5 = 0),
g AS (SELECT k, p FROM e WHERE p IN (SELECT o_orderkey FROM orders))"""


def order_history(spark, sf_dir) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda x: F.floor(x).cast("long").cast("string")
    parents = F.when(k < 2, F.array().cast("array<string>")).when((k >= 3) & (k % 5 == 0), F.array(text(k / 2), text(k / 3))).otherwise(F.array(text(k / 2)))
    return o.select(k.cast("string").alias("sha"), parents.alias("parents"), (k % 7 == 0).alias("valid"), F.concat(s("Change "), k).alias("message"))


def some(spark, sf_dir, condition: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(condition).select(F.col("o_orderkey").cast("string").alias("sha"))


_RANGE = f"""WITH RECURSIVE {_GRAPH},
u(k) AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 = 5 UNION SELECT p FROM u JOIN g USING (k)),
s(k) AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 89 = 3 UNION SELECT p FROM s JOIN g USING (k)),
r AS (SELECT k FROM u EXCEPT SELECT k FROM s)"""


@query(f"{_RANGE} SELECT CAST(k AS VARCHAR) AS sha FROM r")
def commit_range(spark, sf_dir):
    h = history.History.of(order_history(spark, sf_dir))
    return h.between(some(spark, sf_dir, "o_orderkey % 89 = 3"), some(spark, sf_dir, "o_orderkey % 97 = 5"))


@query(f"{_RANGE} SELECT CAST(k AS VARCHAR) AS sha, 'Change ' || k AS subject FROM r WHERE k % 7 <> 0 AND NOT (k >= 3 AND k % 5 = 0)")
def unsigned_arrivals(spark, sf_dir):
    """Commits of a range that are no merges and have no valid signature."""
    c = order_history(spark, sf_dir)
    signed = c.select("sha", "parents", "message", F.when(F.col("valid"), "G").otherwise("N").alias("validity"), s("human:a").alias("signer"))
    return merge.unsigned_between(signed, history.History.of(c), some(spark, sf_dir, "o_orderkey % 89 = 3"), some(spark, sf_dir, "o_orderkey % 97 = 5"))


@query(f"""WITH RECURSIVE {_GRAPH},
m AS (SELECT max(o_orderkey) AS m FROM orders),
t AS (SELECT c_custkey AS pair, 0 AS side, (c_custkey * 31) % m AS k FROM customer, m UNION ALL SELECT c_custkey, 1, (c_custkey * 57) % m FROM customer, m),
a(pair, side, k) AS (SELECT pair, side, k FROM t WHERE k IN (SELECT o_orderkey FROM orders) UNION SELECT pair, side, p FROM a JOIN g USING (k)),
c AS (SELECT pair, k FROM a GROUP BY pair, k HAVING count(DISTINCT side) = 2)
SELECT pair, CAST(k AS VARCHAR) AS sha FROM c WHERE NOT EXISTS (SELECT 1 FROM g JOIN c d ON d.k = g.k WHERE d.pair = c.pair AND g.p = c.k)""")
def merge_bases(spark, sf_dir):
    """The best common ancestors of a pair of commits for each customer, all pairs at once."""
    m = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    k = F.col("c_custkey")
    side = lambda n, by: table(spark, sf_dir, "customer").select(k.alias("pair"), F.lit(n).alias("side"), (k * by % m).cast("string").alias("sha"))
    return history.History.of(order_history(spark, sf_dir)).merge_bases(side(0, 31).unionByName(side(1, 57)))


@query(f"""{_RANGE}
SELECT CAST(k AS VARCHAR) AS sha, 'new' AS kind FROM r UNION ALL
SELECT DISTINCT CAST(p AS VARCHAR), 'prerequisite' FROM g WHERE k IN (SELECT k FROM r) AND p NOT IN (SELECT k FROM r)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'ref' FROM orders WHERE o_orderkey % 97 = 5 AND o_orderkey <> 5""")
def bundled_commits(spark, sf_dir):
    """An incremental bundle, and what its import adds to a store that has what it builds on."""
    c, path = order_history(spark, sf_dir), f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    h, since = history.History.of(c), some(spark, sf_dir, "o_orderkey % 89 = 3")
    refs = some(spark, sf_dir, "o_orderkey % 97 = 5").select(F.concat(s("sync/"), "sha").alias("name"), "sha")
    sinks.export_commits(c, h, refs, path, since)
    here = c.join(h.between(since, refs.select("sha")), "sha", "left_anti")
    after, to_merge = sinks.import_commits(here, path, "sync/5")
    new = after.join(here, "sha", "left_anti").select("sha", s("new").alias("kind"))
    needed = spark.read.parquet(f"{path}/prerequisites").select("sha", s("prerequisite").alias("kind"))
    return new.unionByName(needed).unionByName(to_merge.select("sha", s("ref").alias("kind")))


@query("""WITH b AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 11 <> 0), a AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 17 <> 0)
SELECT 'f' || (p_partkey % 37) || '/g' || (p_partkey % 3) || '/' || p_partkey || '.md' AS path,
  CASE WHEN b.p_size IS NULL THEN 'added' WHEN a.p_size IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM b FULL JOIN a USING (p_partkey) WHERE b.p_size IS DISTINCT FROM a.p_size""")
def tree_changes(spark, sf_dir):
    """Two revisions of parts in nested folders: only folders whose hashes differ are opened."""
    k = F.col("p_partkey")
    folder, inner = F.concat(s("f"), k % 37), F.concat(s("g"), k % 3)

    def revision(parts: DataFrame) -> tuple[DataFrame, str]:
        hashed = lambda: F.md5(F.array_join(F.sort_array(F.collect_list(F.concat("name", s(":"), "hash"))), ","))
        leaf = parts.select(folder.alias("folder"), inner.alias("inner"), F.concat(k, s(".md")).alias("name"), F.md5(F.col("p_size").cast("string")).alias("hash"))
        of_inner = leaf.groupBy("folder", "inner").agg(hashed().alias("tree"))
        mid = of_inner.select("folder", F.col("inner").alias("name"), F.col("tree").alias("hash"))
        of_folder = mid.groupBy("folder").agg(hashed().alias("tree"))
        top = of_folder.select(F.col("folder").alias("name"), F.col("tree").alias("hash"))
        root = top.agg(hashed().alias("tree")).first()[0]
        entry = lambda x, kind: x.select("tree", "name", s(kind).alias("kind"), "hash")
        return (
            entry(leaf.join(of_inner, ["folder", "inner"]), "blob").unionByName(entry(mid.join(of_folder, "folder"), "tree")).unionByName(entry(top.withColumn("tree", F.lit(root)), "tree")), root
        )

    p = table(spark, sf_dir, "part")
    before, b = revision(p.filter("p_partkey % 11 <> 0"))
    after, a = revision(p.filter("p_partkey % 17 <> 0").withColumn("p_size", F.when(k % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))))
    return history.tree_changes(before.unionByName(after).distinct(), b, a).select("path", "change")


@query("""WITH v AS (SELECT 1 AS number, doc_id, text FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT 2, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'edited' ELSE text END FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT 3, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'edited' ELSE text END FROM documents WHERE doc_id % 2 <> 0),
n AS (SELECT DISTINCT number FROM v)
SELECT n.number, d.doc_id || '.md' AS path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM n CROSS JOIN documents d LEFT JOIN v a ON a.number = n.number AND a.doc_id = d.doc_id LEFT JOIN v b ON b.number = n.number - 1 AND b.doc_id = d.doc_id
WHERE (a.doc_id IS NULL) <> (b.doc_id IS NULL) OR (a.doc_id IS NOT NULL AND a.text IS DISTINCT FROM b.text)""")
def followed_versions(spark, sf_dir):
    """Three versions of the documents are published; a stream hands on what each changes."""
    d, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    edited = F.when(F.col("doc_id") % 5 == 0, "edited").otherwise(F.col("text"))
    for rows in (d.filter("doc_id % 7 <> 0"), d.filter("doc_id % 11 <> 0").withColumn("text", edited), d.filter("doc_id % 2 <> 0").withColumn("text", edited)):
        sinks.publish(rows.select(F.concat("doc_id", s(".md")).alias("path"), F.sha2(F.coalesce("text", s("")), 256).alias("digest")), base)

    def keep(changes: DataFrame, number: int) -> None:
        changes.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{base}/changes/version={number}")

    watch.following(spark, base, keep, f"{base}/state", ["digest"], once=True).awaitTermination()
    return spark.read.parquet(f"{base}/changes").select("number", "path", "change")


@query("""SELECT c_custkey AS connection_id FROM customer WHERE (c_custkey % 12) % 4 = 0 AND (c_custkey % 12) % 3 <> 0 AND (c_custkey % 12) IN (SELECT s_suppkey FROM supplier)""")
def connections_to_close(spark, sf_dir):
    k = F.col("c_custkey")
    connections = table(spark, sf_dir, "customer").select(k.alias("connection_id"), F.concat(s("S"), k % 12).alias("serial"))
    return control_plane.to_close(connections, devices(spark, sf_dir)).select("connection_id")


@query("""SELECT s_nationkey AS tenant_id, count(*) FILTER (WHERE s_suppkey % 5 <> 0) AS indexed, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS skipped_private
FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 GROUP BY 1""")
def tenant_snapshots(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 7 == 0, F.concat(s("age-encryption.org/v1\n"), k)).otherwise(F.concat(s("---\nvisibility: "), F.when(k % 5 == 0, "private").otherwise("team"), s("\n---\n"), "s_name"))
    blobs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tenant_id"), F.concat(s("a/"), k, F.when(k % 11 == 0, ".txt").otherwise(".md")).alias("path"), text.cast("binary").alias("content"))
    return files.snapshot(blobs, "2024-05-01")[1]


@query("""SELECT 'inbox/' || trim(regexp_replace(lower(role || ' turn ' || turn), '[^a-z0-9]+', '-', 'g'), '-') || '-' || (conv_id * 1000 + turn) || '.md' AS path,
  md5('---' || chr(10) || 'title: "' || role || ' turn ' || turn || '"' || chr(10) || 'type: feedback' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'scope: user' || chr(10) ELSE '' END
  || 'provenance:' || chr(10) || '  actor: "agent:' || conv_id || '"' || chr(10) || '  source: conversation' || chr(10) || 'confidence: proposed' || chr(10) || '---' || chr(10)
  || chr(10) || coalesce(text, '') || chr(10)) AS md5 FROM conversations""")
def remembered_items(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    title = F.concat("role", s(" turn "), "turn")
    text = frontmatter.remembered(title, s("feedback"), F.when(F.col("turn") % 2 == 0, "user"), F.concat(s("agent:"), "conv_id"), F.coalesce("text", s("")))
    return c.select(derive.inbox_path(title, F.col("conv_id") * 1000 + F.col("turn")).alias("path"), F.md5(text).alias("md5"))


@query("SELECT o_orderkey, strftime(CAST('1970-01-01' AS DATE) + CAST(o_orderkey % 40000 - 9000 AS INTEGER), '%Y-%m-%d') AS day FROM orders")
def civil_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", derive.civil_date(k % 40000 - 9000).alias("day"))


@query("""SELECT s_suppkey AS device_id, CASE WHEN s_suppkey % 5 = 0 THEN 'N' || s_suppkey WHEN s_suppkey % 3 <> 0 THEN 'S' || s_suppkey END AS serial FROM supplier""")
def certified_devices(spark, sf_dir):
    issued = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("device_id"), F.concat(s("N"), "s_suppkey").alias("serial"))
    return control_plane.with_certificates(devices(spark, sf_dir), issued).select("device_id", "serial")


@query("""SELECT o_orderkey AS grant_id FROM orders WHERE o_custkey % 10 = 3 AND o_orderkey % 900 + 600 > 1000""")
def live_grants(spark, sf_dir):
    """Grants of ten minutes that a code finds, by either kind of code."""
    k = F.col("o_orderkey")
    code = F.concat(s("c"), F.col("o_custkey") % 10)
    grants = table(spark, sf_dir, "orders").select(
        k.alias("grant_id"), F.when(k % 2 == 0, code).alias("device_code"), F.when(k % 2 == 1, code).alias("user_code"), (k % 900 + control_plane.GRANT_SECONDS).alias("expires_at")
    )
    return control_plane.live_grants(grants, s("c3"), 1000).select("grant_id")


@query("""SELECT c_custkey, replace(lower(n_name), ' ', '-') AS tenant, 'objects/' || c_custkey AS suffix FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def routes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lower(F.replace("n_name", s(" "), s("-"))).alias("slug"))
    url = F.concat(s("/"), "slug", s("/objects/"), "c_custkey")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").select("c_custkey", control_plane.tenant_of(url).alias("tenant"), control_plane.suffix_of(url).alias("suffix"))


@query("""SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 4 = 1 AS allowed FROM customer""")
def promotion_rights(spark, sf_dir):
    k = F.col("c_custkey")
    who = F.when(k % 3 == 0, F.concat(s("human:"), k)).when(k % 4 == 1, "agent:trusted").otherwise("agent:other")
    return table(spark, sf_dir, "customer").select("c_custkey", derive.may_promote(who, ["agent:trusted"]).alias("allowed"))


@query(f"""WITH {ITEMS_SQL} SELECT path, visibility = 'private' AS encrypt FROM items""")
def files_to_encrypt(spark, sf_dir):
    return items(spark, sf_dir).select("path", derive.needs_encryption(F.col("body").cast("binary"), F.col("visibility")).alias("encrypt"))


def scratch(spark) -> str:
    """A new folder of a query's own."""
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


@query(f"WITH {ITEMS_SQL} SELECT path, tier, tokens FROM items WHERE doc_id % 3 <> 0")
def published_items(spark, sf_dir):
    """The second of two published versions of an item table."""
    root, x = scratch(spark), items(spark, sf_dir).select("doc_id", "path", "tier", "tokens")
    sinks.publish(x, root)
    sinks.publish(x.filter("doc_id % 3 <> 0"), root)
    return sinks.published(spark, root).select("path", "tier", "tokens")


@query(f"""WITH {ITEMS_SQL}, t AS (SELECT '<context tier="0">' || chr(10) || chr(10) AS block UNION ALL
SELECT '## ' || title || chr(10) || chr(10) || '<!-- source: ' || path || ' -->' || chr(10) || chr(10) || body || chr(10) || chr(10) FROM items WHERE tier = 0 UNION ALL SELECT '</context>' || chr(10)),
l AS (SELECT unnest(string_split(left(block, length(block) - 1), chr(10))) AS line FROM t) SELECT line, count(*) AS times FROM l GROUP BY line""")
def tier_file_lines(spark, sf_dir):
    """The lines of a tier file that was written and read again."""
    path = scratch(spark)
    sinks.write_tier(materialize.blocks(items(spark, sf_dir), 0), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))


@query(f"WITH {ITEMS_SQL} SELECT path, tier, tokens FROM items")
def bundled_items(spark, sf_dir):
    """Items that went out as a bundle and came in again."""
    path = scratch(spark)
    sinks.export_bundle({"items": items(spark, sf_dir).select("path", "tier", "tokens"), "labels": table(spark, sf_dir, "labels")}, path)
    return sinks.import_bundle(spark, path)["items"]


@query(f"WITH {ITEMS_SQL} SELECT path FROM items WHERE doc_id <> (SELECT min(doc_id) FROM items)")
def forgotten_item(spark, sf_dir):
    x = items(spark, sf_dir)
    return incremental.forgotten(x, x.orderBy("doc_id").first().path, "human:me").select("path")


@query(f"WITH {ITEMS_SQL} SELECT path FROM items WHERE visibility = 'private'")
def forgotten_device(spark, sf_dir):
    """What has to be encrypted anew for the devices that are left."""
    recipients = table(spark, sf_dir, "supplier").select(F.concat(s("age1"), "s_suppkey").alias("recipient"), F.concat(s("device:"), "s_suppkey").alias("label"))
    return incremental.forgotten_device(recipients, "1", items(spark, sf_dir))[1]


@query("SELECT l_orderkey AS revision, 'p/' || l_partkey || '.md' AS path FROM lineitem WHERE l_partkey <> (SELECT min(l_partkey) FROM lineitem)")
def purged_history(spark, sf_dir):
    history = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("revision"), F.concat(s("p/"), "l_partkey", s(".md")).alias("path"))
    least = table(spark, sf_dir, "lineitem").agg(F.min("l_partkey")).first()[0]
    return incremental.purged(history, f"p/{least}.md")


@query("""SELECT s_nationkey AS tenant_id, 'a/' || s_suppkey || '.md' AS path, 2 AS tier, greatest(1, length(s_name) // 4) AS tokens, s_name AS body
FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 5 <> 0""")
def tenant_items(spark, sf_dir):
    """The items of the tenants' snapshots."""
    k = F.col("s_suppkey")
    text = F.when(k % 7 == 0, F.concat(s("age-encryption.org/v1\n"), k)).otherwise(F.concat(s("---\nvisibility: "), F.when(k % 5 == 0, "private").otherwise("team"), s("\n---\n"), "s_name"))
    blobs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("tenant_id"), F.concat(s("a/"), k, F.when(k % 11 == 0, ".txt").otherwise(".md")).alias("path"), text.cast("binary").alias("content"))
    return files.snapshot(blobs, "2024-05-01")[0].select("tenant_id", "path", "tier", "tokens", "body")


@query("""WITH i AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'a/b/' ELSE 'a/' END || 'N' || (p_partkey // 2) || '.md' AS path FROM part),
w AS (SELECT path AS source, unnest(['n' || (k // 2), 'b/N' || (k // 2), 'N' || (k // 2) || '|x', 'nowhere']) AS link FROM i),
n AS (SELECT source, string_split(link, '|')[1] || '.md' AS file FROM w)
SELECT DISTINCT source, (SELECT min(path) FROM i WHERE path = file OR lower(right(path, length(file) + 1)) = lower('/' || file)) AS target, 'mentions' AS type FROM n
WHERE (SELECT min(path) FROM i WHERE path = file OR lower(right(path, length(file) + 1)) = lower('/' || file)) IS NOT NULL""")
def folder_links(spark, sf_dir):
    """Names with and without folders, in another case, at the root and below."""
    k = F.col("p_partkey")
    n = F.floor(k / 2)
    path = F.concat(F.when(k % 4 == 0, "").when(k % 4 == 1, "a/b/").otherwise("a/"), s("N"), n, s(".md"))
    body = F.concat(s("[[n"), n, s("]] [[b/N"), n, s("]] [[N"), n, s("|x]] [[nowhere]]"))
    return graph.edges_of(table(spark, sf_dir, "part").select(path.alias("path"), body.alias("body"), F.array().cast("array<string>").alias("refs")))


@query("""WITH i AS (SELECT 'notes/' || p_partkey || '.md' AS path, p_partkey AS k, (SELECT max(p_partkey) FROM part) AS n FROM part)
SELECT a.path AS source, 'notes/' || CASE WHEN a.k % 7 = 1 THEN 1 ELSE a.k % a.n + 1 END || '.md' AS target, 'mentions' AS type FROM i a
WHERE a.k % 5 <> 2 AND CASE WHEN a.k % 7 = 1 THEN (SELECT min(k) FROM i WHERE k = 1 AND k % 5 <> 2) IS NOT NULL ELSE a.k % a.n + 1 IN (SELECT k FROM i) END""")
def refreshed_links(spark, sf_dir):
    """Links after a change set: some documents point elsewhere, some are gone; links to the latter dangle."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = part.agg(F.max("p_partkey")).first()[0]
    base = part.select(k.alias("k"), F.concat(s("notes/"), k, s(".md")).alias("path"), F.concat(s("[["), k % n + 1, s("]]")).alias("body"), F.array().cast("array<string>").alias("refs"))
    edges = graph.edges_of(base)
    gone = base.filter("k % 5 = 2")
    changed = base.filter("k % 7 = 1 and k % 5 <> 2").withColumn("body", s("[[1]]"))
    return graph.refreshed_edges(edges, changed, gone, base.join(gone, "path", "left_anti"))


@query("""WITH p AS (SELECT doc_id, 'dir with space/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path FROM documents WHERE doc_id % 6 = 5 AND doc_id % 4 <> 1)
SELECT 'inbox/' || trim(regexp_replace(lower('deletion of ' || path || ' needs confirmation'), '[^a-z0-9]+', '-', 'g'), '-') || '-7.md' AS path,
  '---' || chr(10) || 'title: "deletion of ' || path || ' needs confirmation"' || chr(10) || 'type: project-state' || chr(10) || 'provenance:' || chr(10) || '  actor: "agent:merge-resolver"' || chr(10)
  || '  source: conversation' || chr(10) || 'confidence: proposed' || chr(10) || '---' || chr(10) || chr(10) || 'Remove ' || path || '? It is kept with its edits, though one side (modify/delete by ours) removed it.' || chr(10) AS text FROM p""")
def deletion_questions(spark, sf_dir):
    found = files.unmerged(status_lines(spark, sf_dir)).select("path", merge.conflict_class(F.col("code")).alias("class"))
    return merge.deletion_questions(found, s(7), F.format_string("Remove %s? It is kept with its edits, though one side (%s) removed it.", "path", "class"))


#: State of each side by a number's remainder: b(ase), a change of ours or theirs, or - for nothing.
_SIDES = ("bbb", "obb", "btb", "-bb", "b-b", "-tb", "o-b", "--b", "o--", "-t-", "oob", "bb-")


@query(f"""WITH d AS (SELECT c_custkey AS k, ['{"', '".join(_SIDES)}'][c_custkey % {len(_SIDES)} + 1] AS sides FROM customer),
x AS (SELECT k, nullif(left(sides, 1), '-') AS o, nullif(substr(sides, 2, 1), '-') AS t, nullif(right(sides, 1), '-') AS b FROM d)
SELECT 'f/' || k || '.md' AS path, CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o WHEN o IS NOT DISTINCT FROM b THEN t ELSE coalesce(o, t) END || ' ' || k AS text,
  CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b OR o IS NOT DISTINCT FROM b THEN NULL WHEN o IS NULL THEN 'modify/delete by ours' WHEN t IS NULL THEN 'modify/delete by theirs' END AS class
FROM x WHERE CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o WHEN o IS NOT DISTINCT FROM b THEN t ELSE coalesce(o, t) END IS NOT NULL""")
def merged_trees(spark, sf_dir):
    """Three-way merge of trees where sides add, change and delete files: only a modification beats a deletion."""
    k = F.col("c_custkey")
    sides = F.element_at(F.array(*[s(x) for x in _SIDES]), (k % len(_SIDES) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(k.alias("k"), sides.alias("sides"), F.concat(s("f/"), k, s(".md")).alias("path"))

    def tree(place: int) -> DataFrame:
        state = F.substring("sides", place, 1)
        return c.filter(state != "-").select("path", F.concat(state, s(" "), "k").alias("text"))

    return merge.merged_trees(tree(3), tree(1), tree(2))


@query("""SELECT 'd' || l_orderkey AS path, CASE WHEN l_orderkey % 3 = 0 THEN 'second' WHEN l_orderkey % 5 = 0 THEN 'third' ELSE 'base' END AS text FROM (SELECT DISTINCT l_orderkey FROM lineitem)
WHERE l_orderkey % 3 = 0 OR l_orderkey % 7 <> 0""")
def folded_branches(spark, sf_dir):
    """Three branches of one base: the first changes nothing, the second changes thirds, the third fifths of the others and deletes sevenths."""
    k = F.col("l_orderkey")
    keys = table(spark, sf_dir, "lineitem").select(k).distinct().withColumn("path", F.concat(s("d"), k))
    branch = lambda text, rows: rows.select("path", text.alias("text"))
    base = branch(s("base"), keys)
    second = branch(F.when(k % 3 == 0, "second").otherwise("base"), keys)
    third = branch(F.when((k % 5 == 0) & (k % 3 != 0), "third").otherwise("base"), keys.filter("l_orderkey % 7 <> 0"))
    return merge.folded(base, [base, second, third])


@query("""SELECT n_nationkey + 1 AS tenant_id, lower(n_name) AS slug FROM nation UNION ALL
SELECT (SELECT max(n_nationkey) + 1 FROM nation) + row_number() OVER (ORDER BY 'r-' || lower(r_name)), 'r-' || lower(r_name) FROM region""")
def created_tenants(spark, sf_dir):
    old = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("tenant_id"), F.lower("n_name").alias("slug"), F.lit(True).alias("always_warm"), F.lit(False).alias("running"))
    return control_plane.created_tenants(old, table(spark, sf_dir, "region").select(F.concat(s("r-"), F.lower("r_name")).alias("slug"))).select("tenant_id", "slug")


def keyed_devices(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(k.alias("device_id"), F.col("s_nationkey").cast("long").alias("tenant_id"), F.concat(s("key "), k).alias("public_key"), F.concat(s("S"), k).alias("serial"), F.lit(None).cast("long").alias("revoked_at"))


@query("""WITH d AS (SELECT s_suppkey AS device_id, s_nationkey AS tenant_id, 'key ' || s_suppkey AS public_key FROM supplier),
fresh AS (SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY 'new ' || c_custkey) AS device_id, c_nationkey AS tenant_id, 'new ' || c_custkey AS public_key FROM customer),
every AS (SELECT * FROM d UNION ALL SELECT * FROM fresh)
SELECT q.public_key, device_id, tenant_id FROM (SELECT public_key FROM every UNION ALL SELECT 'unknown') q LEFT JOIN every e ON e.public_key = q.public_key""")
def registered_devices(spark, sf_dir):
    """Devices by their keys after some were registered, and a key that nobody has."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("tenant_id"), F.concat(s("new "), "c_custkey").alias("public_key"))
    every = control_plane.registered_devices(keyed_devices(spark, sf_dir), keys)
    asked = every.select("public_key").unionByName(spark.createDataFrame([("unknown",)], "public_key string"))
    return control_plane.found(every, asked, "public_key").select("public_key", "device_id", "tenant_id")


@query("""WITH g AS (SELECT o_orderkey AS grant_id, o_custkey % 25 AS tenant_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % (SELECT count(*) FROM supplier) + 1 WHEN o_orderkey % 4 = 1 THEN -1 END AS device_id FROM orders),
open_ones AS (SELECT grant_id, 'p' || grant_id || 'a' AS public_key FROM g WHERE grant_id % 3 = 0 AND (device_id IS NULL OR device_id NOT IN (SELECT s_suppkey FROM supplier))),
n AS (SELECT grant_id, (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY public_key) AS new_id FROM open_ones)
SELECT g.grant_id, tenant_id, coalesce(new_id, device_id) AS device_id FROM g LEFT JOIN n ON n.grant_id = g.grant_id""")
def approved_grants(spark, sf_dir):
    """Grants after thirds of them were approved twice; those that have a device keep it."""
    k = F.col("o_orderkey").cast("long")
    n = table(spark, sf_dir, "supplier").count()
    device = F.when(k % 4 == 0, k % n + 1).when(k % 4 == 1, F.lit(-1))
    grants = table(spark, sf_dir, "orders").select(k.alias("grant_id"), (F.col("o_custkey") % 25).cast("long").alias("tenant_id"), device.cast("long").alias("device_id"))
    asked = grants.filter("grant_id % 3 = 0").select("grant_id", F.explode(F.array(*[F.concat(s("p"), "grant_id", s(x)) for x in "ab"])).alias("public_key"))
    return control_plane.approved_grants(grants, keyed_devices(spark, sf_dir), asked)[0]


@query("""SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY 'd' || c_custkey) AS grant_id, c_nationkey AS tenant_id, 1600 AS expires_at FROM customer""")
def created_grants(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("long").alias("grant_id"), F.col("s_nationkey").cast("long").alias("tenant_id"), s("x").alias("device_code"), s("y").alias("user_code"),
        F.lit(1).cast("long").alias("expires_at"), F.lit(1).cast("long").alias("device_id"),
    )
    asked = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("tenant_id"), F.concat(s("d"), "c_custkey").alias("device_code"), F.concat(s("u"), "c_custkey").alias("user_code"))
    return control_plane.created_grants(old, asked, 1000).filter("expires_at > 1000").select("grant_id", "tenant_id", "expires_at")


@query("""SELECT c_custkey, c_name || ' é<' || c_custkey || '>%zz' AS form, replace(replace(replace(replace(c_name || ' & <"' || c_custkey || '">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
'0' || lower(hex(c_custkey)) AS serial FROM customer WHERE c_custkey < 16
UNION ALL SELECT c_custkey, c_name || ' é<' || c_custkey || '>%zz', replace(replace(replace(replace(c_name || ' & <"' || c_custkey || '">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
right('0000' || lower(hex(c_custkey)), 2 * ((length(hex(c_custkey)) + 1) // 2)) FROM customer WHERE c_custkey >= 16""")
def decoded_forms(spark, sf_dir):
    """Form values, HTML texts and certificate serials."""
    k = F.col("c_custkey")
    form = control_plane.form_decoded(F.concat(F.replace("c_name", s("#"), s("%23")), s("+%C3%a9%3C"), k, s("%3e%zz")))
    html = control_plane.html_escaped(F.concat("c_name", s(" & <\""), k, s("\">")))
    digits = F.hex(k)
    serial = F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(s("0"), digits)).otherwise(digits))
    return table(spark, sf_dir, "customer").select("c_custkey", form.alias("form"), html.alias("html"), control_plane.serial_hex(serial).alias("serial"))


@query("""SELECT 'origin/sync/d' || s_suppkey AS name, 'other device' AS what FROM supplier WHERE s_suppkey <> 3 AND s_suppkey % 2 = 1
UNION ALL SELECT 'other/sync/d' || s_suppkey, 'below' FROM supplier WHERE s_suppkey % 2 = 0""")
def device_refs(spark, sf_dir):
    k = F.col("s_suppkey")
    refs = table(spark, sf_dir, "supplier").select(F.concat(F.when(k % 2 == 1, "origin").otherwise("other"), s("/sync/d"), k).alias("name"))
    other = control_plane.other_device_refs(refs, "origin", "d3").withColumn("what", s("other device"))
    return other.unionByName(control_plane.refs_below(refs, "other").withColumn("what", s("below")))


@query("SELECT tier, step, slots FROM (VALUES (0, 60, 360), (1, 900, 1344), (2, 21600, 1460)) t(tier, step, slots) WHERE EXISTS (SELECT 1 FROM events)")
def tier_config(spark, sf_dir):
    """The tiers that a control plane starts with, where there are events to keep."""
    return control_plane.tier_table(spark).join(table(spark, sf_dir, "events").select(F.lit(True).alias("x")).limit(1)).drop("x")
