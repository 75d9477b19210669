"""Vector search and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.search import HIT, Filter, Index, matches, search
from quillon.plans.tables import ranked, within_budget, written

FUSION_CONSTANT, LIST_LENGTH = 60, 40


class DimensionMismatch(ValueError):
    """No eligible vector has the query's dimension; ``stored`` lists those there are in the whole table."""

    def __init__(self, query: int, stored: list[int]):
        super().__init__(f"query has {query} dimensions, stored vectors have {stored}")
        self.query, self.stored = query, stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths and zero norms."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def decoded(blob: Column) -> Column:
    """A vector from little-endian float32 bytes; a partial value at the end is dropped."""

    def run(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in blobs:
            yield b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4"))

    return F.pandas_udf(run, "array<float>")(blob)


def encoded(vector: Column) -> Column:
    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in vectors:
            yield v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return F.pandas_udf(run, "binary")(vector)


def similarities(query: list[float]):
    """``cosine`` of vectors of the query's length with the query, a batch at a time; a null component counts as zero."""
    q = np.asarray(query, float)
    norm = float(np.sqrt(q @ q))

    def run(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in vectors:
            x = np.nan_to_num(np.array(v.tolist(), float).reshape(len(v), len(q)), nan=0.0)
            norms = np.sqrt((x * x).sum(axis=1)) * norm
            yield pd.Series(np.divide(x @ q, norms, out=np.zeros(len(x)), where=norms > 0))

    return F.pandas_udf(run, "double")


def nearest(items: DataFrame, query: list[float], where: Filter = Filter(), k: int = LIST_LENGTH) -> DataFrame:
    """(path, similarity, rank) of the k most similar items of the query's dimension."""
    eligible = items.filter((F.size("embedding") == len(query)) & where.condition())
    similarity = similarities(query)(F.col("embedding"))
    return ranked(eligible.select("path", similarity.alias("similarity")), [F.desc("similarity"), F.asc("path")], k)


def fused(*lists: DataFrame) -> DataFrame:
    """(path, score) by reciprocal ranks of any number of lists (path, rank)."""
    every = lists[0].select("path", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("path", "rank"))
    return every.groupBy("path").agg(F.sum(1 / (FUSION_CONSTANT + F.col("rank"))).alias("score"))


def stored_dimensions(items: DataFrame) -> DataFrame:
    """(dimensions, vectors): the dimensions that stored embeddings have, and how many have them."""
    return items.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dimensions")).agg(F.count("*").alias("vectors"))


def hybrid(index: Index, query, vector: list[float], where: Filter = Filter(), fall_back: bool = False) -> DataFrame:
    """Fuses the best LIST_LENGTH hits of the text and of the vector search.

    If the filters leave no vector of the query's dimension this is a DimensionMismatch, or the text
    search alone with ``fall_back``. Vectors are scanned once; only in that case are their dimensions
    looked up.
    """
    near = written(nearest(index.items, vector, where), compact=True)
    if near.isEmpty():
        if fall_back:
            return search(index, query, where)
        raise DimensionMismatch(len(vector), sorted(r.dimensions for r in stored_dimensions(index.items).collect()))
    meta = index.items.select("path", "title", "tier", "tokens")
    text = matches(index, query).join(index.items.filter(where.condition()).select("path"), "path", "left_semi")
    text = ranked(text, [F.desc("score"), F.asc("path")], LIST_LENGTH)
    both = fused(text, near).join(meta, "path").withColumn("hop_distance", F.lit(0))
    return within_budget(ranked(both, [F.desc("score"), F.asc("path")], where.limit), where.budget).select(*HIT)


def with_embeddings(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sets the embeddings of ``vectors`` (path, embedding); unknown paths change nothing."""
    v = vectors.select("path", F.col("embedding").alias("__new"))
    both = items.join(v, "path", "left").withColumn("embedding", F.coalesce("__new", "embedding"))
    return both.select(*items.columns)


def embedded_by(items: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], warning: str | None = None) -> DataFrame:
    """``items`` with embeddings of "title, blank line, body" by ``embed``, which gets a batch of texts in a task.

    A text that it cannot embed (None) stays without a vector. If a batch fails its texts are tried
    one by one, and those that fail stay without one too. ``warning`` names a column that says why.
    """

    def tried(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None if v is not None else "no embedding") for v in embed(texts)]
        except Exception as failed:
            return [(None, str(failed) or type(failed).__name__)] if len(texts) == 1 else [x for t in texts for x in tried([t])]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            found = tried(list(t)) if len(t) else []
            yield pd.DataFrame({"v": pd.Series([v for v, _ in found], dtype=object), "w": pd.Series([w for _, w in found], dtype=object)})

    made = F.pandas_udf(run, "v array<float>, w string")(F.concat("title", F.lit("\n\n"), "body"))
    x = items.withColumn("__embedded", made).withColumn("embedding", F.col("__embedded.v"))
    return (x.withColumn(warning, F.col("__embedded.w")) if warning else x).drop("__embedded")
