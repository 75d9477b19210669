from itertools import combinations

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillon.llm import mixture, queries


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= names


def first_of_each(rows):
    """Smallest ids of the groups that a Jaccard similarity of 0.8 of five-word shingles links, by comparing all pairs."""
    sets = []
    for i, text in sorted(rows):
        w = (text or "").lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}))
    label = {i: i for i, _ in sets}
    for (i, a), (j, b) in combinations(sets, 2):
        if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    return set(label.values())


def test_stages_keep_what_they_should(spark, sf):
    sf_dir = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        rows = out.collect()
        kept.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema)
    (before, good), (_, lines), (single_in, single), (_, mixed) = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in good}
    assert sum(labels.get(r.doc_id) == 1 and r.doc_id not in ids for r in before) == 0
    assert sum(labels.get(r.doc_id) == 0 and r.doc_id not in ids for r in before) > 0.5 * sum(v == 0 for v in labels.values())
    assert {r.doc_id for r in lines} <= ids
    assert sorted(r.doc_id for r in single) == sorted(first_of_each([(r.doc_id, r.text) for r in single_in]))
    texts = [r.text for r in single]
    assert len(set(texts)) == len(texts)
    taken = mixture.mix_documents(spark.createDataFrame(single, docs.schema)).collect()
    assert {r.doc_id for r in mixed} == {r.doc_id for r in taken if r.whole or (r.part and 2 * r.part >= r.size)}
    last = corpus_pipeline.pack_bins(spark, docs, sf_dir).collect()
    assert sum(r.size for r in last) == sum(len(r.text.split()) for r in mixed)


def test_groups_with_shared_ids(spark):
    rows = [(5, "a b c d e f g h", "s"), (3, "a b c d e f g h", "s"), (5, "quite another text stands here now", "s"), (None, "lonely words without an id at all", "t"), (7, None, "s"), (8, "", "s"), (9, "once only this", "s"), (9, "once only this", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, rows[1][1]), (5, rows[2][1]), (None, rows[3][1]), (7, None), (9, "once only this"), (9, "once only this")], key=str)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_clashing_names_and_odd_rows(spark, sf):
    """Columns named like the stages' own, null and empty texts, repeated rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for name in ("__score", "__KEY", "__doc", "__dropped", "__times", "score"):
        docs = docs.withColumn(name, F.lit("kept"))
    odd = docs.limit(2).withColumn("text", F.lit(None).cast("string"))
    docs = spark.createDataFrame(docs.unionByName(docs.limit(3)).unionByName(odd).unionByName(docs.limit(1).withColumn("text", F.lit(""))).collect(), docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["__score"] == "kept" and r["__KEY"] == "kept" for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)


def test_run_leaves_nothing_behind(spark, sf):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
