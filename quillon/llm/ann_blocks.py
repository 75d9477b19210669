"""Nearest neighbours by a block matrix join over int8 codes.

Each vector is coded as int8 with a scale of its own, and the length of what the code leaves out
is kept. A tile's int8 product gives the distance of two coded vectors; the true distance differs
by no more than both remainders' lengths. Pairs whose lower bound is above the query's bound (the
k-th best of a pilot block), or else above the k-th smallest upper bound, or above the worst of a
full heap are discarded; the others are computed again in double precision and pushed on the
query's heap. Nothing is lost: the result equals brute force.

Codes and bounds are computed on vectors that a power of two brings into [0.5, 1), so components
of any finite size, largest and denormal ones too, neither overflow nor vanish.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import grid

QUERY_TILE, CANDIDATE_TILE = 128, 4096
#: Added to a bound's error, in units of a tile's largest component: squares below it vanish.
VANISHED = 2.0**-500
LARGEST = np.finfo(np.float64).max


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exponents, int8 codes, scales, squared lengths of the coded vectors and lengths of the remainders; all but codes in units of 2**exponent."""
    exponents = np.frexp(np.abs(x).max(axis=1))[1]
    x = np.ldexp(x, -exponents[:, None])
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return exponents, codes, scale, (back * back).sum(axis=1), np.sqrt(((x - back) ** 2).sum(axis=1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; a distance beyond the largest double is infinite."""
    with np.errstate(over="ignore"):
        square = ((a - b) ** 2).sum(axis=1)
    out = np.sqrt(square)
    # Squares overflow or lose digits: once more with the largest difference taken out.
    odd = np.flatnonzero(~((square > 1e-280) & (square < 1e300)))
    if len(odd):
        a = a[odd]
        with np.errstate(over="ignore"):
            half = np.where(np.isinf(a - b).any(axis=1), 0.5, 1.0)
            rest = a * half[:, None] - b * half[:, None]
            top = np.abs(rest).max(axis=1)
            out[odd] = top * np.sqrt(((rest / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1)) / half
    return out


def nearest_in_cell(k: int):
    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        parts, by_length, bounds = [], grid.matrices(candidates), grid.bounds_of(queries)
        for d, (query_ids, q, places) in grid.matrices(queries).items():
            if d not in by_length:
                continue
            ids, c, _ = by_length[d]
            bound = bounds[places]
            # Products of int8 codes are whole numbers that float32 holds exactly up to 2**24.
            exact = np.float32 if d * 127 * 127 < 2**24 else np.float64
            q_exp, q8, q_scale, q_len, q_rest = coded(q)
            c_exp, c8, c_scale, c_len, c_rest = coded(c)
            for at in range(0, len(q), QUERY_TILE):
                rows = slice(at, min(at + QUERY_TILE, len(q)))
                heaps: list[list[tuple[float, int]]] = [[] for _ in range(rows.stop - at)]
                q_tile = q8[rows].astype(exact)
                for to in range(0, len(c), CANDIDATE_TILE):
                    cut = slice(to, to + CANDIDATE_TILE)
                    # All in units of the tile's largest component.
                    unit = max(int(q_exp[rows].max()), int(c_exp[cut].max()))
                    fq, fc = np.ldexp(1.0, q_exp[rows] - unit)[:, None], np.ldexp(1.0, c_exp[cut] - unit)
                    square = q_len[rows, None] * fq * fq + c_len[cut] * fc * fc
                    slack = q_rest[rows, None] * fq + c_rest[cut] * fc
                    slack += 1e-9 * (slack + np.sqrt(square)) + VANISHED
                    product = (q_tile @ c8[cut].astype(exact).T).astype(np.float64)
                    product *= q_scale[rows, None] * fq
                    product *= c_scale[cut] * fc
                    square -= 2 * product
                    middle = np.sqrt(np.maximum(square, 0, out=square), out=square)
                    with np.errstate(over="ignore"):
                        lower = np.minimum(np.ldexp(middle - slack, unit), LARGEST)
                    # The query's own row is no candidate.
                    own = ids[cut] == query_ids[rows, None]
                    limit = np.where(np.isnan(bound[rows]), np.inf, bound[rows])
                    if np.isinf(limit).any() and lower.shape[1] > k:
                        with np.errstate(over="ignore"):
                            upper = np.where(own, np.inf, np.ldexp(middle + slack, unit))
                        limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
                    limit = np.minimum(limit, [-h[0][0] if len(h) == k else np.inf for h in heaps])
                    left_rows, left_places = np.nonzero((lower <= limit[:, None]) & ~own)
                    starts = np.searchsorted(left_rows, np.arange(len(heaps) + 1))
                    for i in np.unique(left_rows):
                        heap, left = heaps[i], left_places[starts[i] : starts[i + 1]]
                        exactly = distances(c[cut][left], q[at + i])
                        if len(left) > k:  # ids ascend, so a stable sort leaves ties to the smaller
                            first = np.argsort(exactly, kind="stable")[:k]
                            left, exactly = left[first], exactly[first]
                        for s, j in zip(exactly, ids[cut][left]):
                            item = (-float(s), -int(j))
                            if len(heap) < k:
                                heapq.heappush(heap, item)
                            elif item > heap[0]:
                                heapq.heapreplace(heap, item)
                for i, heap in enumerate(heaps):
                    if heap:
                        s, j = np.array([-x[0] for x in heap]), np.array([-x[1] for x in heap])
                        parts.append((np.full(len(heap), query_ids[at + i]), j, s))
        return grid.found(parts, pa.float64())

    return cell


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows (Euclidean) of each row whose id is divisible by ``every``.

    Returns query_id, rank, vec_id, score. Rows whose id or vector is null, whose vector holds
    null or non-finite components or is zero (or empty) take no part; a query meets candidates of
    its own length only, so a query may have fewer than k rows, or none. Ties go to the smaller
    id. Finite components of any size count; a distance beyond the largest double is infinite. Rows
    that share the query's id are its own; of repeated query rows the one with the smallest vector
    is searched. Other columns are ignored. An empty table gives no rows.
    """
    rows = grid.usable(vectors, id_col, vector_col, zero_ok=False)
    return grid.top_k(rows, F.col("id") % every == 0, k, nearest_in_cell(k), "double", F.asc, F.xxhash64("id", "v"))
