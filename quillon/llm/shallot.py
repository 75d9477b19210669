"""Centroid clustering in whole numbers by Shallot search.

Vectors become integers, centroids are integers, and so are all distances that decide. Each vector
remembers its centroid, the one that was second nearest, an upper bound of its distance to the
first and a lower bound of that to all others. Bounds move with the centroids. Where they no longer
tell the nearest centroid, the distance to the first and then to the second is taken anew, the
closer of the two becomes the centre of a search, and the centroids around the centre are scanned
in the order of their distance from it. The ball that the search must cover has the radius of the
distance to the centre plus that to the second nearest seen so far, so it shrinks as it goes.

Vectors are kept in blocks, a row each, with their state and the block's sums for each cluster. A
round reads the blocks of the round before, writes them with the new state and shuffles nothing;
the sums, a few thousand numbers for each block, are then added up by Spark. Only centroids, ``k``
times the length of a vector, pass the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import bounded_batches, dropped, written

#: Vectors of a block at most.
BLOCK = 8192
#: Components from which doubles are whole numbers.
WHOLE = 2.0**53
#: Sums are handed on in digits of so many bits, as they can go beyond a long.
DIGIT = 40
#: What bounds in doubles are widened by.
SLACK = 1e-9
MOST = 2**63 - 1
#: Places of a block's sums that are no component: the number of vectors and their squared distances.
COUNT, INERTIA = -1, -2

BLOCKS = "ids binary, given binary, wide boolean, codes binary, near binary, second binary, upper binary, lower binary, sums array<struct<cluster:int,place:int,digit:int,value:long>>"


def narrow_limit(width: int) -> int:
    """Integers below which a squared distance of ``width`` components is exact in 64 bits, with room to spare."""
    return min(2**31 - 1, math.isqrt(2**61 // max(1, width)))


def whole(x: float, scale: int) -> int:
    """floor(scale x) of a double, without rounding."""
    return int(x) * scale if abs(x) >= WHOLE else math.floor(x * scale)


def length(squared) -> float:
    """The square root as a double, infinite beyond its range."""
    try:
        return math.sqrt(squared)
    except OverflowError:
        return math.inf


def lengths(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float)) if squared.dtype != object else np.array([length(int(x)) for x in squared], float)


@dataclass
class Centroids:
    """The centroids of a round, as Python integers, with what the search needs to know of them."""

    rows: list[list[int]]

    def __post_init__(self):
        k, width = len(self.rows), len(self.rows[0])
        limit = narrow_limit(width)
        self.exact = np.empty((k, width), object)
        self.exact[:] = self.rows
        self.wide = np.array([any(abs(x) >= limit for x in r) for r in self.rows])
        self.narrow = np.zeros((k, width), np.int64)
        self.narrow[~self.wide] = self.exact[~self.wide].astype(np.int64)
        apart = np.array([[length(sum((x - y) ** 2 for x, y in zip(a, b))) for b in self.rows] for a in self.rows])
        #: The others around each centroid, nearest first, and how far they are.
        self.order = np.array([sorted((j for j in range(k) if j != i), key=lambda j: (apart[i, j], j)) for i in range(k)], np.int32).reshape(k, k - 1)
        self.apart = np.take_along_axis(apart, self.order.astype(np.int64), axis=1) if k > 1 else apart[:, :0]

    def squared(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows ``x`` to their centroids ``at``; objects where 64 bits may not do."""
        if x.dtype != object and not self.wide.any():
            d = x - self.narrow[at]
            return np.einsum("ij,ij->i", d, d)
        out = np.empty(len(x), object)
        far = self.wide[at] if x.dtype != object else np.ones(len(x), bool)
        if not far.all():
            d = x[~far] - self.narrow[at[~far]]
            out[~far] = np.einsum("ij,ij->i", d, d).astype(object)
        if far.any():
            d = x[far].astype(object) - self.exact[at[far]]
            out[far] = (d * d).sum(axis=1)
        return out

    def moved(self, before: Centroids) -> list[float]:
        return [length(sum((x - y) ** 2 for x, y in zip(a, b))) for a, b in zip(self.rows, before.rows)]


@dataclass
class State:
    near: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @staticmethod
    def fresh(n: int, k: int) -> State:
        """Nothing is known: the first search starts from centroids 0 and 1."""
        return State(np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))

    def follow(self, moved: list[float]) -> None:
        """Moves the bounds with the centroids: the lower one by the farthest that any other centroid moved."""
        if len(moved) > 1:
            far = np.array(moved)
            first, next_ = np.argsort(-far, kind="stable")[:2]
            with np.errstate(invalid="ignore"):
                self.lower = np.nan_to_num(self.lower - np.where(self.near == first, far[next_], far[first]) * (1 + SLACK), nan=-np.inf)
        self.upper = self.upper + np.array(moved)[self.near] * (1 + SLACK)


def search(x: np.ndarray, c: Centroids, s: State) -> int:
    """Brings ``s`` to the nearest centroids of ``x`` (ties to the smaller number); returns how many vectors were scanned."""
    k = len(c.rows)
    if k == 1:
        return 0
    half = c.apart[:, 0] / 2 * (1 - SLACK)
    # Strictly nearer than all others: nothing to do.
    todo = np.flatnonzero(s.upper >= np.maximum(s.lower, half[s.near]))
    if len(todo):
        first = c.squared(x[todo], s.near[todo])
        s.upper[todo] = lengths(first) * (1 + SLACK)
        again = s.upper[todo] >= np.maximum(s.lower[todo], half[s.near[todo]])
        todo, first = todo[again], first[again]
    if not len(todo):
        return 0
    rows, near, second = x[todo], s.near[todo], s.second[todo]
    other = c.squared(rows, second)
    swap = (other < first) | ((other == first) & (second < near))
    swap = swap.astype(bool)
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    first, other = np.where(swap, other, first), np.where(swap, first, other)
    # The centre stays; the nearest and second nearest seen so far change.
    centre, known, reach, remembered = near.copy(), second.copy(), lengths(first), lengths(other)
    active = np.arange(len(todo))
    for t in range(k - 1):
        with np.errstate(invalid="ignore"):
            active = active[c.apart[centre[active], t] <= (reach[active] + remembered[active]) * (1 + SLACK)]
        if not len(active):
            break
        at = c.order[centre[active], t]
        new = at != known[active]
        i, at = active[new], at[new]
        if not len(i):
            continue
        d = c.squared(rows[i], at)
        closer = ((d < first[i]) | ((d == first[i]) & (at < near[i]))).astype(bool)
        between = (~closer & (d < other[i])).astype(bool)
        a, b = i[closer], i[between]
        second[a], other[a], near[a], first[a] = near[a], first[a], at[closer], d[closer]
        second[b], other[b] = at[between], d[between]
        changed = np.concatenate([a, b])
        remembered[changed] = lengths(other[changed])
    s.near[todo], s.second[todo] = near, second
    s.upper[todo], s.lower[todo] = lengths(first) * (1 + SLACK), lengths(other) * (1 - SLACK)
    return len(todo)


def digits(value: int) -> Iterator[tuple[int, int]]:
    """(digit, value): a number in signed digits of DIGIT bits."""
    sign, value, n = (-1 if value < 0 else 1), abs(value), 0
    while value or n == 0:
        yield n, sign * (value & ((1 << DIGIT) - 1))
        value, n = value >> DIGIT, n + 1


def sums_of(x: np.ndarray, squared: np.ndarray, near: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(cluster, place, digit, value): the block's exact sums for each cluster that it has vectors of."""
    out = []
    for cluster in np.unique(near).tolist():
        of = near == cluster
        values = {COUNT: int(of.sum()), INERTIA: int(sum(squared[of].tolist()))} | dict(enumerate(x[of].sum(axis=0).tolist()))
        out += [(cluster, place, n, v) for place, value in values.items() for n, v in digits(int(value))]
    return out


def packed(x: np.ndarray) -> bytes:
    """Integers of 32 bits, or text where they are wider."""
    return x.astype(np.int32).tobytes() if x.dtype != object else "\n".join(",".join(map(str, r)) for r in x.tolist()).encode()


def unpacked(codes: bytes, wide: bool, width: int) -> np.ndarray:
    if not wide:
        return np.frombuffer(codes, np.int32).reshape(-1, width).astype(np.int64)
    lines = codes.decode().split("\n")
    out = np.empty((len(lines), width), object)
    out[:] = [[int(v) for v in line.split(",")] for line in lines]
    return out


def block_row(x: np.ndarray, ids: bytes, given: bytes, s: State, c: Centroids) -> dict:
    squared = c.squared(x, s.near)
    keys = ("cluster", "place", "digit", "value")
    return {
        "ids": ids, "given": given, "wide": x.dtype == object, "codes": packed(x), "near": s.near.astype(np.int32).tobytes(), "second": s.second.astype(np.int32).tobytes(),
        "upper": s.upper.tobytes(), "lower": s.lower.tobytes(), "sums": [dict(zip(keys, r)) for r in sums_of(x, squared, s.near)],
    }


ARROW = pa.schema(
    [("ids", pa.binary()), ("given", pa.binary()), ("wide", pa.bool_()), ("codes", pa.binary()), ("near", pa.binary()), ("second", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()),
     ("sums", pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())])))]
)


def usable(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors of ``width`` components, none of them null or not finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    floats = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    return vectors.filter(v.isNotNull() & (F.size(v) == width) & finite).select(F.col(id_col).cast("long").alias("id"), (v if floats else v.cast("array<double>")).alias("v"))


def start(rows: DataFrame, k: int, seed: str, scale: int) -> Centroids | None:
    """The ``k`` vectors whose sha256 of seed and id is smallest; fewer if there are fewer ids, None without any."""
    chosen = rows.filter("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    found = chosen.orderBy("h", "v").limit(k).collect()
    return Centroids([[whole(x, scale) for x in r.v] for r in found]) if found else None


def first_blocks(rows: DataFrame, width: int, scale: int, c: Centroids) -> DataFrame:
    limit = narrow_limit(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            ids, given = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            is_wide = (np.abs(raw) * scale >= limit - 1).any(axis=1)
            for wide in (False, True):
                places = np.flatnonzero(is_wide == wide)
                for at in range(0, len(places), BLOCK):
                    part = places[at : at + BLOCK]
                    if wide:
                        x = np.empty((len(part), width), object)
                        x[:] = [[whole(v, scale) for v in r] for r in raw[part].tolist()]
                    else:
                        x = np.floor(raw[part] * scale).astype(np.int64)
                    s = State.fresh(len(x), len(c.rows))
                    search(x, c, s)
                    yield pa.RecordBatch.from_pylist([block_row(x, ids[part].astype(np.int64).tobytes(), given[part].tobytes(), s, c)], ARROW)

    return rows.select("id", "v").mapInArrow(run, BLOCKS)


def next_blocks(blocks: DataFrame, width: int, c: Centroids, moved: list[float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(ARROW.names[:-1]).to_pylist():
                x = unpacked(r["codes"], r["wide"], width)
                state = [np.frombuffer(r[n], t).copy() for n, t in (("near", np.int32), ("second", np.int32), ("upper", float), ("lower", float))]
                s = State(*state)
                s.follow(moved)
                search(x, c, s)
                yield pa.RecordBatch.from_pylist([block_row(x, r["ids"], r["given"], s, c)], ARROW)

    return blocks.mapInArrow(run, BLOCKS)


def totals(blocks: DataFrame) -> dict[tuple[int, int], int]:
    """The exact sum of all blocks for each cluster and place; at most clusters times width + 2 numbers, of a few digits."""
    each = blocks.select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.place", "s.digit").agg(F.sum(F.col("s.value").cast("decimal(38,0)")).alias("value"))
    out: dict[tuple[int, int], int] = {}
    for r in each.collect():
        key = (r.cluster, r.place)
        out[key] = out.get(key, 0) + (int(r.value) << (DIGIT * r.digit))
    return out


def means(c: Centroids, found: dict[tuple[int, int], int]) -> Centroids:
    """The floor of the mean of each cluster's vectors; a centroid without vectors stays."""
    return Centroids([[found.get((i, j), 0) // n for j in range(len(r))] if (n := found.get((i, COUNT), 0)) else r for i, r in enumerate(c.rows)])


def clustered(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, second): a row for each vector that takes part.

    Vectors that are null, not ``width`` long, or hold null or non-finite components take no part.
    Components count as floor(``scale`` x), of any finite size, without rounding; squared distances
    and their sums are exact and shown up to the largest long. Centroids start as the ``k`` vectors
    whose sha256 of ``seed``:id is smallest (of rows that share an id, the smaller vector first;
    rows without an id start none, but are assigned). After each of ``rounds`` rounds a centroid
    becomes the floor of the mean of its vectors; one without vectors stays. Ties go to the smaller
    number. With fewer vectors than ``k`` there are as many centroids as vectors. Repeated rows
    each count and each get their row. Other columns are ignored. Without vectors there are no rows.
    second is the centroid remembered as second nearest, null where there is one only.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, width, id_col, vector_col)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, second int"
    c = start(rows, k, seed, scale)
    if c is None:
        return spark.createDataFrame([], schema)
    blocks = written(first_blocks(rows, width, scale, c))
    found = totals(blocks)
    for _ in range(rounds):
        c, before, old = means(c, found), c, blocks
        blocks = written(next_blocks(old, width, c, c.moved(before)))
        found = totals(blocks)
        dropped(old)
    inertia = [found.get((i, INERTIA), 0) for i in range(len(c.rows))]
    shown = np.array([min(x, MOST) for x in inertia], np.int64)
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.rows]
    total = min(sum(inertia), MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, near = unpacked(r["codes"], r["wide"], width), np.frombuffer(r["near"], np.int32)
                squared = c.squared(x, near)
                squared = squared if squared.dtype != object else np.array([min(v, MOST) for v in squared.tolist()], np.int64)
                second = np.frombuffer(r["second"], np.int32)
                columns = [
                    pa.array(np.frombuffer(r["ids"], np.int64), mask=~np.frombuffer(r["given"], bool)), pa.array(near), pa.array(squared), pa.array(shown[near]),
                    pa.array(np.full(len(near), total, np.int64)), pa.array(digests).take(pa.array(near)), pa.array(second, mask=second == near),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "second"])

    return blocks.select("ids", "given", "wide", "codes", "near", "second").mapInArrow(run, schema)
