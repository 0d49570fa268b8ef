"""Nearest neighbours by collision counting over single projections.

Every projection of a block of vectors is one sorted array. A query opens a
window around its own projection in each array and widens all windows step by
step (a larger radius covers more of the same arrays: virtual rehashing). A
vector that falls into enough windows is verified by its true distance. The
search ends when ten verified vectors lie within the radius, at which a true
neighbour falls short of the threshold only if it misses its expected number of
collisions by more than ``MISS_DEVIATIONS`` standard deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch
from .groups import numbers

PROJECTIONS = 32
HALF_WINDOW = 1.15  # in units of the radius; a vector at the radius falls inside with probability 0.75
MISS_DEVIATIONS = 1.0
GROWTH = 1.2
DATA_BLOCK = 16_384
QUERY_BLOCK = 1024


def usable_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct ``(key, _v array<double>)`` without NULL, zero, incomplete or non-finite vectors."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(F.col(key), v.alias("_v"))


class SortedProjections:
    """The sorted arrays of one block of vectors."""

    def __init__(self, data: np.ndarray, seed: int = 7):
        n, dim = data.shape
        self.data, self.n = data, n
        self.directions = np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, PROJECTIONS))
        values = data @ self.directions
        order = np.argsort(values, axis=0, kind="stable")
        self.ids = order.T.ravel()
        self.low, self.span = values.min(), max(float(np.ptp(values)), 1e-300)
        self.flat = np.take_along_axis(values, order, axis=0).T
        self.threshold = max(1, math.floor(PROJECTIONS * 0.75 - MISS_DEVIATIONS * math.sqrt(PROJECTIONS * 0.1875)))
        self.typical = float(np.sqrt(((data - data.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
        # one search over all arrays: each is moved by its own multiple of a safe distance
        self.step = 4.0 * self.span + 1.0
        self.keys = (self.flat - self.low + np.arange(PROJECTIONS)[:, None] * self.step).ravel()

    def _bounds(self, query: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        base = np.arange(PROJECTIONS) * self.step
        low = np.clip(query - half - self.low, -1e-9 * self.span, 1.5 * self.span) + base
        high = np.clip(query + half - self.low, -1e-9 * self.span, 1.5 * self.span) + base
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")

    def _covered(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        sizes = end - begin
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.ids[where], minlength=self.n)

    def nearest(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the ``k`` nearest found, ``skip`` left out."""
        projected = query @ self.directions
        seen = np.zeros(self.n, dtype=np.int64)
        done = skip.copy()
        at, to = self._bounds(projected, 0.0)
        seen += self._covered(at, to)
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        radius = 0.05 * self.typical
        while True:
            low, high = self._bounds(projected, HALF_WINDOW * radius)
            seen += self._covered(low, at) + self._covered(to, high)
            at, to = low, high
            new = np.flatnonzero((seen >= self.threshold) & ~done)
            if len(new):
                done[new] = True
                gap = self.data[new] - query
                found = np.concatenate([found, new])
                distance = np.concatenate([distance, np.sqrt((gap * gap).sum(axis=1))])
                if len(found) > 4 * k:
                    keep = np.argpartition(distance, k)[: k + 1]
                    limit = distance[keep].max()
                    keep = np.flatnonzero(distance <= limit)
                    found, distance = found[keep], distance[keep]
            enough = len(found) >= k and np.partition(distance, k - 1)[k - 1] <= radius
            if enough or done.all() or (to - at).sum() == self.n * PROJECTIONS:
                break
            radius *= GROWTH
        if len(found) < k and not done.all():
            rest = np.flatnonzero(~done)
            gap = self.data[rest] - query
            found = np.concatenate([found, rest])
            distance = np.concatenate([distance, np.sqrt((gap * gap).sum(axis=1))])
        return found, distance


def search(
    scratch: Scratch, vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` nearest found for each query vector.

    Data blocks meet query blocks, so a task holds one of each whatever the
    size of the table; each block gives its ``k`` best per query and the best of
    those remain. Unusable vectors take no part. Repeated rows count once; an id with
    several vectors is as near as the nearest of them. Vectors are compared with
    those of equal length only. Ties go to the smaller id. Without queries or
    candidates there are no rows.
    """
    usable = scratch.keep(usable_vectors(vectors, key, vector).distinct().select(F.col(key).alias("_id"), "_v"))
    total, asked = usable.agg(F.count("*"), F.count_if(is_query(F.col("_id")))).first()
    blocks, waves = max(1, math.ceil(total / DATA_BLOCK)), max(1, math.ceil(asked / QUERY_BLOCK))
    spread = lambda seed, n: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sized = usable.withColumn("_dim", F.size("_v"))
    data = sized.withColumn("_b", spread(1, blocks)).withColumn("_q", every(waves))
    queries = sized.filter(is_query(F.col("_id"))).withColumn("_q", spread(2, waves)).withColumn("_b", every(blocks))

    def local(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if data.num_rows and queries.num_rows:
            width = data.column("_dim")[0].as_py()
            ids = data.column("_id").to_numpy()
            arrays = SortedProjections(numbers(data.column("_v").combine_chunks(), width))
            parts = []
            for own, query in zip(queries.column("_id").to_numpy(), numbers(queries.column("_v").combine_chunks(), width)):
                found, distance = arrays.nearest(query, k, ids == own)
                # ids may repeat: keep the best of each before cutting
                order = np.lexsort((ids[found], distance))
                _, first = np.unique(ids[found][order], return_index=True)
                best = order[np.sort(first)][:k]
                parts.append((np.full(len(best), own), ids[found][best], distance[best]))
            out = [np.concatenate(x) for x in zip(*parts)]
        return pa.table({"query_id": out[0], "_id": out[1], "score": out[2]})

    near = data.groupBy("_dim", "_b", "_q").cogroup(queries.groupBy("_dim", "_b", "_q")).applyInArrow(
        local, "query_id long, _id long, score double"
    )
    best = near.groupBy("query_id", "_id").agg(F.min("score").alias("score"))
    ranked = best.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("score", "_id"))), 1, k).alias("_best")
    )  # at most k for each data block
    rows = ranked.select("query_id", F.posexplode("_best").alias("_at", "_row"))
    return rows.select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_row._id").alias(key), F.col("_row.score").alias("score")
    )
