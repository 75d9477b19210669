"""Block matrix join of a query set with all rows of a vector table.

Queries and candidates are dealt into row and column blocks by a hash; each cell of the grid
holds one block of either and goes to one task at a time. A cell's size is bounded in rows and
bytes, whatever the table's size or skew: candidates are dealt by a hash of all of their row, and
of the row's place where rows repeat. Vectors of different lengths never meet, so each length has a
grid of its own: one very long vector does not make the blocks of the others smaller, and lengths
without a query are left out.

Before that, queries of the PILOTED lengths that have most of them meet a pilot block of PILOT
candidates. The k-th best score of the pilot goes with its query to every cell as a bound, so what a
cell keeps does not hang on the cell alone.
The pilot is only a source of bounds: it changes what work is done, and not what is found.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import small, written

#: Most queries and candidates in a cell, on average.
QUERY_BLOCK, CANDIDATE_BLOCK = 32768, 65536
#: Bytes of float64 vectors in either block of a cell, on average; a row for longer vectors.
BLOCK_BYTES = 32 << 20
#: Candidates of a pilot block at most; lengths that have one.
PILOT, PILOTED = 4096, 4
#: Least number of candidate blocks, for tasks enough on small tables, but where they would have fewer rows than LEAST_ROWS.
LEAST_BLOCKS, LEAST_ROWS = 24, 256


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero_ok: bool) -> DataFrame:
    """(id, v) of the rows that take part: id and vector not null, all components finite numbers.

    ``zero_ok`` admits vectors whose components are all zero (and empty ones).
    """
    # float32 vectors travel as such; tasks compute in float64.
    floats = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    v = F.col(vector_col) if floats else F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull()
    ok &= F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    if not zero_ok:
        ok &= F.exists(v, lambda x: x != 0)
    return vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int,
    cell: Callable[[pa.Table, pa.Table], pa.Table],
    score_type: str,
    best_first: Callable[[str], Column],
    pilot_order: Column,
) -> DataFrame:
    """The k best candidates of each query: (query_id, rank, vec_id, score).

    ``cell`` gets the queries (id, v, bound) and candidates (id, v) of a cell and returns at most k
    rows (query_id, vec_id, score) a query; candidates worse than the bound, where it is not null,
    may be left out. The pilot of a length is its first PILOT rows by ``pilot_order``. Repeated ids: rows that share a query's id are the query's
    own and are left out; the query is searched once, with the smallest of its vectors. Repeated
    candidates keep a rank each.
    """
    rows = rows.withColumn("d", F.size("v"))
    queries = written(rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")))
    asked = queries.groupBy("d").agg(F.count("*").alias("q"))
    sizes = written(rows.groupBy("d").agg(F.count("*").alias("n")).join(asked, "d"), compact=True)
    at_once = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.lit(1), "d"))))
    columns = F.greatest(F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / LEAST_ROWS)), F.ceil(F.col("n") / F.least(F.lit(CANDIDATE_BLOCK), at_once)))
    lines = F.ceil(F.col("q") / F.least(F.lit(QUERY_BLOCK), at_once))
    shapes = small(sizes.select("d", columns.alias("columns"), lines.alias("lines")))
    schema = f"query_id long, vec_id long, score {score_type}"
    every_line = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lines") - 1))
    queries = queries.join(shapes, "d").withColumn("line", F.pmod(F.xxhash64("id"), F.col("lines"))).drop("lines")
    most = [r.d for r in sizes.orderBy(F.desc("q"), "d").limit(PILOTED).collect()]
    pilots = [rows.filter(F.col("d") == d).orderBy(pilot_order).limit(min(PILOT, max(1, BLOCK_BYTES // (8 * max(1, d))))) for d in most] or [rows.limit(0)]
    pilot = written(reduce(DataFrame.unionByName, pilots)).join(shapes, "d").drop("columns").withColumn("line", every_line)
    unbounded = queries.filter(F.col("d").isin(most)).drop("columns").withColumn("bound", F.lit(None).cast(score_type))
    met = unbounded.groupBy("d", "line").cogroup(pilot.groupBy("d", "line")).applyInArrow(cell, schema)
    bounds = met.groupBy("query_id").agg(F.count("*").alias("n"), (F.max if best_first is F.asc else F.min)("score").alias("bound")).filter(F.col("n") >= k)
    # A row for each query; written, so that the pilot runs once.
    bounds = written(bounds.select(F.col("query_id").alias("id"), "bound"), compact=True)
    queries = queries.join(bounds, "id", "left")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)))
    # The place within the scan parts equal rows, so that no block fills with copies.
    candidates = rows.withColumn("at", F.monotonically_increasing_id()).join(shapes, "d")
    candidates = candidates.withColumn("block", F.pmod(F.xxhash64("id", "at"), F.col("columns"))).withColumn("line", every_line)
    queries, candidates = queries.drop("columns"), candidates.drop("columns", "lines", "at")
    best = queries.groupBy("d", "line", "block").cogroup(candidates.groupBy("d", "line", "block")).applyInArrow(cell, schema)
    order = Window.partitionBy("query_id").orderBy(best_first("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrices(block: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, float64 rows and places in the block by vector length, each ordered by id."""
    ids = block.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    v = block.column("v").combine_chunks()
    if isinstance(v, pa.ChunkedArray):
        v = v.chunk(0) if v.num_chunks else pa.array([], v.type)
    lengths = np.diff(v.offsets.to_numpy())
    flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = v.offsets.to_numpy()[:-1]
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(d)] = ids[at], flat[starts[at][:, None] + np.arange(d)].reshape(len(at), int(d)), at
    return out


def bounds_of(queries: pa.Table) -> np.ndarray:
    """The queries' bounds as float64, NaN where there is none."""
    return queries.column("bound").cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(np.float64)


def found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], score_type: pa.DataType) -> pa.Table:
    columns = [np.concatenate(x) if parts else [] for x in zip(*parts)] or [[], [], []]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), score_type))})
