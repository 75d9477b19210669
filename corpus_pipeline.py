"""Corpus pipeline: filter, deduplicate, mix and pack the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import line_templates, mixture, near_copies, packing, quality_cnn
from quillon.llm.common import delete, fresh, made, mark, scratch, shared_dir, small, table, text_or_empty, written

#: A document whose probability of being good is below this goes.
LEAST_QUALITY = 0.3
#: Near duplicates: words of a shingle and differing bits of the fingerprints that are compared first.
SHINGLE, RADIUS = 5, 3


#: The tables of the stage that ran last.
_before: list[tuple[list, list]] = []


def staged(stage: Callable) -> Callable:
    """A stage that first deletes the tables of the stage before, whose result has been written by now.

    Tables that ``docs`` itself still reads stay.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            delete(spark, _before.pop(), docs)
        since = mark()
        out = stage(spark, docs, sf_dir)
        _before.append(made(since))
        return out

    return run


@staged
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, learnt on this table's labels, does not reject.

    Null and empty texts are scored as one empty chunk, very long ones whole. Repeated rows and ties
    are scored alike and stay or go together. Without labels all score one half and stay. Labels of
    ids that are null or missing here count for nothing. An empty table gives none; other columns
    are carried on, whatever their names.
    """
    net = quality_cnn.learnt(docs, table(spark, sf_dir, "labels"), ~quality_cnn.held_out())
    score = fresh(docs, "score")
    kept = quality_cnn.scored(docs, net, name=score).filter(F.col(score) >= LEAST_QUALITY)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@staged
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring template lines; those that lose all their lines go.

    n_chars, where the table has it, follows the text. Null and empty texts stay, exact copies are
    one text and stay or go together, texts and lines of any length are read whole. Of equally early
    places of a line (null ids are last) the smaller hash of the text keeps it. An empty table gives
    none; other columns are carried on, whatever their names.
    """
    kept = line_templates.deduplicated(docs, line_templates.Rule(every=True), emptied=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


@staged
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id (null is largest) of each group of near duplicates.

    Fingerprints within RADIUS bits are compared first, and candidates by leading shingles find what
    64 bits cannot tell; every link is verified on the shingles. Near duplicates share 0.8 or more of their different shingles (Jaccard), or are linked by such.
    A document is a doc_id with a text: rows that share both are one document, and of texts that
    share a doc_id the one with the smallest hash comes first. Null and empty texts, and texts of
    fewer words than a shingle, link only to equal word sequences. Texts of any length are read
    whole. An empty table gives none; other columns are carried on, whatever their names.
    """
    def key() -> Column:
        return F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.xxhash64(text_or_empty()).alias("h"))

    found = near_copies.near_copies(docs, SHINGLE, RADIUS, id_col=key())
    name = fresh(docs, "key")
    # Those that go are fewer than those that stay; where they are few, no text is shuffled.
    gone = small(written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), compact=True))
    return docs.withColumn(name, key()).join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks for, to within a document a source.

    A null source is a source. Null and empty texts have no words, so the mix takes none of them.
    Rows that repeat, share an id or have none count each. Texts are never cut. An empty table gives
    none; other columns are carried on, whatever their names.
    """
    return mixture.repeated_documents(docs)


@staged
def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the bins that they go to.

    Null and empty texts have no tokens; how they, very long texts (cut into pieces of a bin at
    most), repeated rows and ties are packed is stated at ``packed_documents``. Other columns are
    left out. An empty table gives none.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash and shingle near-dedup", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_bins),
]

#: SQL expresses neither the network nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
