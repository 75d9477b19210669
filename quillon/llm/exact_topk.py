"""Exact top-k inner products by columnar branch and bound.

Candidates are laid out vertically, a contiguous column for each dimension. Dimensions are taken
in blocks, those with the most mass first; after each block a candidate can gain no more than the
product of the lengths of its and the query's remaining parts. Candidates that cannot reach the
bound of any query of a tile are compacted away before the next block. A query's bound is the k-th
best of a pilot block, the candidates with the largest lengths, or else of the sums so far.

Sums of integers below 2**53 are exact in double precision; by Cauchy and Schwarz those of two
vectors are if the product of their lengths is below it. Rows that are longer take the same bounds
with the rounding error added, and only what is left at the end is summed in whole numbers.
Scores are ranked as whole numbers of any size; only what is shown is held to the range of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import grid

#: Dimensions of a block; partial products that are held at a time.
DIMENSION_BLOCK, PRODUCTS = 16, 1 << 21
#: Lengths of queries and candidates up to which all their sums are exact.
SHORT_QUERY, SHORT_CANDIDATE = 2.0**26, 2.0**27
#: Components from which all doubles are whole numbers, and exponents that rows are brought below.
WHOLE, HIGH = 2.0**60, 480
#: Scores are shown within the range of a long; those at its ends carry a key that orders them.
LEAST, MOST = -(2**63), 2**63 - 1
SCORE = "struct<score: bigint, beyond: binary>"
SCORE_ARROW = pa.struct([("score", pa.int64()), ("beyond", pa.binary())])


def key(score: int) -> bytes:
    """Bytes that stand in the order of the whole numbers."""
    n = (abs(score).bit_length() + 7) // 8
    size = n.to_bytes(2, "big") + abs(score).to_bytes(n, "big")
    return b"\1" + size if score >= 0 else b"\0" + bytes(255 - x for x in size)


def number(key: bytes) -> int:
    """The whole number of a key."""
    return int.from_bytes(key[3:], "big") if key[0] else -int.from_bytes(bytes(255 - x for x in key[3:]), "big")


def scored(scores: list[int]) -> pa.Array:
    """Whole numbers of any size as SCORE."""
    shown = pa.array([max(LEAST, min(MOST, s)) for s in scores], pa.int64())
    return pa.StructArray.from_arrays([shown, pa.array([None if LEAST < s < MOST else key(s) for s in scores], pa.binary())], ["score", "beyond"])


def bounds_of(queries: pa.Table) -> list[int | None]:
    """The queries' bounds as whole numbers."""
    found = queries.column("bound").to_pylist()
    return [None if b is None or b["score"] is None else b["score"] if b["beyond"] is None else number(b["beyond"]) for b in found]


def integers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(64 x) of each row in units of 2**exponent, without rounding, and the exponents, most of them 0."""
    top = np.abs(x).max(axis=1, initial=0)
    exponents = np.maximum(0, np.frexp(top)[1] - HIGH)
    with np.errstate(over="ignore"):
        small = np.floor(64.0 * np.where(np.abs(x) < WHOLE, x, 0))
    return np.where(np.abs(x) < WHOLE, np.ldexp(small, -exponents[:, None]), np.ldexp(x, 6 - exponents[:, None])), exponents


def whole(x: float) -> int:
    """floor(64 x); large doubles are whole numbers already."""
    return int(x) * 64 if abs(x) >= WHOLE else int(np.floor(64.0 * x))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Columns:
    """Candidates in vertical layout, with the lengths of what remains of them after each block."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids = ids
        self.order = np.argsort(-(codes * codes).sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(codes[:, self.order].T)
        self.cuts = list(range(0, codes.shape[1], DIMENSION_BLOCK)) or [0]
        self.rest = self.remaining(self.columns.T)

    def remaining(self, rows: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt((rows[:, a + DIMENSION_BLOCK :] ** 2).sum(axis=1)) for a in self.cuts]

    def best(self, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
        """(ids, scores) of the k best for each query of a tile; all sums are exact."""
        q = q[:, self.order]
        q_rest, ids, rest, at = self.remaining(q), self.ids, self.rest, slice(None)
        partial = np.zeros((len(q), len(ids)))
        for b, a in enumerate(self.cuts):
            partial += q[:, a : a + DIMENSION_BLOCK] @ self.columns[a : a + DIMENSION_BLOCK, at]
            if b == len(self.cuts) - 1 or len(ids) <= k:
                continue
            gain = np.outer(q_rest[b], rest[b][at] * (1 + 1e-12)) + 1e-6
            limit = bound
            if np.isnan(limit).any():  # one more than k, as the query's own row may be among them
                low = partial - gain
                kth = np.partition(low, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] if len(ids) > k + 1 else np.full(len(q), -np.inf)
                limit = np.fmax(limit, kth)
            keep = (partial + gain >= limit[:, None]).any(axis=0)
            if 2 * keep.sum() < len(keep):
                partial, ids = np.ascontiguousarray(partial[:, keep]), ids[keep]
                at = np.flatnonzero(keep) if isinstance(at, slice) else at[keep]
        partial[ids == query_ids[:, None]] = -np.inf
        for i, scores in enumerate(partial):
            left = np.flatnonzero(scores >= bound[i]) if not np.isnan(bound[i]) else np.flatnonzero(scores > -np.inf)
            if len(left) > 4 * k:
                least = np.partition(scores[left], len(left) - k)[len(left) - k]
                left = left[scores[left] >= least]
            left = left[best_of(scores[left], ids[left], k)]
            yield ids[left], scores[left].astype(np.int64).tolist()


def best_long(query_id: int, q: np.ndarray, raw_q: np.ndarray, q_exp: int, ids: np.ndarray, c: np.ndarray, raw_c: np.ndarray, c_exp: np.ndarray, bound: int | None, k: int):
    """(ids, scores) of the k best for one query, for vectors of any finite size.

    Blocks of dimensions as above, with bounds that hold the rounding error too, in units of the
    largest scale. Candidates whose sums may be rounded are summed in whole numbers at the end,
    equal vectors once.
    """
    left = np.flatnonzero(ids != query_id)
    order = np.argsort(-(c * c).sum(axis=0), kind="stable")
    q, c = q[order], c[:, order]
    lengths = np.sqrt((q * q).sum()) * np.sqrt((c * c).sum(axis=1))
    scale = c_exp + q_exp
    error = np.where((lengths < 2.0**53) & (scale == 0), 0.0, (len(q) + 4) * 2.0**-52 * lengths)
    partial = np.zeros(len(left))
    unit = int(scale.max(initial=0))
    # Rounded down: bounds are shifted, and a shifted number is a float to 53 bits.
    least = -np.inf if bound is None else np.nextafter(float(bound >> unit), -np.inf)
    for a in list(range(0, len(q), DIMENSION_BLOCK)) or [0]:
        b = a + DIMENSION_BLOCK
        partial = partial + c[left, a:b] @ q[a:b]
        gain = np.sqrt((q[b:] ** 2).sum()) * np.sqrt((c[left, b:] ** 2).sum(axis=1)) * (1 + 1e-12)
        gain = np.where(gain > 0, gain + 1e-6, 0.0) + error[left]
        low, high = (np.ldexp(x, scale[left] - unit) for x in (partial - gain, partial + gain))
        limit = max(least, np.partition(low, len(left) - k)[len(left) - k]) if len(left) > k else least
        keep = high >= limit
        left, partial = left[keep], partial[keep]
    known: dict[bytes, int] = {}
    codes, scores = [whole(x) for x in raw_q], []
    for j, s in zip(left, partial):
        if error[j] == 0:
            scores.append(int(s))
            continue
        same = raw_c[j].tobytes()
        if same not in known:
            known[same] = sum(x * whole(y) for x, y in zip(codes, raw_c[j]))
        scores.append(known[same])
    order = sorted(range(len(left)), key=lambda i: (-scores[i], ids[left[i]]))[:k]
    return ids[left[order]], [scores[i] for i in order]


def best_in_cell(k: int):
    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        parts, by_length, bounds = [], grid.matrices(candidates), bounds_of(queries)
        for d, (query_ids, raw_q, places) in grid.matrices(queries).items():
            if d not in by_length:
                continue
            ids, raw_c, _ = by_length[d]
            exact = [bounds[i] for i in places]
            # Sums of short rows are below 2**53, so a larger bound is as good as any that they cannot reach.
            bound = np.array([np.nan if b is None else float(max(-(2**60), min(2**60, b))) for b in exact])
            (q, q_exp), (c, c_exp) = integers(raw_q), integers(raw_c)
            short_q = (q_exp == 0) & (np.sqrt((q * q).sum(axis=1)) < SHORT_QUERY)
            short_c = (c_exp == 0) & (np.sqrt((c * c).sum(axis=1)) < SHORT_CANDIDATE)
            columns, long_c = Columns(ids[short_c], c[short_c]), np.flatnonzero(~short_c)
            places = np.flatnonzero(short_q)
            at_once = max(1, PRODUCTS // max(1, len(columns.ids)))
            for at in range(0, len(places), at_once):
                tile = places[at : at + at_once]
                for i, (j, s) in zip(tile, columns.best(query_ids[tile], q[tile], bound[tile], k)):
                    if len(long_c):
                        more = best_long(query_ids[i], q[i], raw_q[i], 0, ids[long_c], c[long_c], raw_c[long_c], c_exp[long_c], exact[i], k)
                        j, s = np.concatenate([j, more[0]]), s + more[1]
                        order = sorted(range(len(j)), key=lambda n: (-s[n], j[n]))[:k]
                        j, s = j[order], [s[n] for n in order]
                    parts.append((np.full(len(j), query_ids[i]), j, s))
            for i in np.flatnonzero(~short_q):
                j, s = best_long(query_ids[i], q[i], raw_q[i], int(q_exp[i]), ids, c, raw_c, c_exp, exact[i], k)
                parts.append((np.full(len(j), query_ids[i]), j, s))
        columns = [np.concatenate([p[n] for p in parts]) if parts else [] for n in (0, 1)]
        scores = scored([s for p in parts for s in p[2]])
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": scores.cast(SCORE_ARROW)})

    return cell


def best(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each row whose id is divisible by ``every``.

    Components count as floor(64 x). Returns query_id, rank, vec_id, score. Rows whose id or
    vector is null or whose vector holds null or non-finite components take no part; zero vectors
    do. A query meets candidates of its own length only (empty vectors meet empty ones, score 0).
    Components of any finite size count exactly, and so do ranks; scores beyond a long are shown as
    the end of its range. Ties go to the smaller id. Rows that share the query's id are its own; of repeated
    query rows the one with the smallest vector is searched. Other columns are ignored. An empty
    table gives no rows.
    """
    rows = grid.usable(vectors, id_col, vector_col, zero_ok=True)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = grid.top_k(rows, F.col("id") % every == 0, k, best_in_cell(k), SCORE, F.desc, length.desc())
    return found.withColumn("score", F.col("score.score"))
