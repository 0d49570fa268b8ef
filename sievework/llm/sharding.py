"""Sharding: a Feistel permutation of global row numbers, with cycle walking.

The permutation of ``0 … n-1`` depends only on ``(n, seed)``. Position
``p = forward(row)`` lies in shard ``p mod shards`` at slot ``p div shards``, so
shard sizes differ by one at most, slots have no gaps, and shard and slot of any
row (and the row of any slot) can be computed without data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, numbered

ROUNDS = 6


class Permutation:
    """A seeded bijection of ``0 … n-1``.

    The number is cut into two halves of ``half`` bits with ``4**half >= n``;
    values outside ``0 … n-1`` are permuted again until they fall inside, which
    takes less than four steps on average.
    """

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.Generator(np.random.PCG64([seed, 4])).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ key
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        shift = np.uint64(self.half)
        left, right = x >> shift, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return left << shift | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while len(out_of_range := np.flatnonzero(out >= np.uint64(self.n))):
            out[out_of_range] = self._once(out[out_of_range], back)
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, False)

    def inverse(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)


def shard_documents(
    scratch: Scratch, docs: DataFrame, shards: int, seed: int = 0, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, size, text_crc32, row, shard, slot)`` for every row of ``docs``.

    Rows are numbered in the order (key, CRC, size), NULL keys first; rows that
    agree in all three are interchangeable, so reruns and other partitions give
    the same table. NULL texts have no bytes (size 1, CRC 0). An empty table
    gives an empty table. Other columns of ``docs`` are not read.
    """
    bytes_of = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(bytes_of) + 1).cast("long").alias("_size"),
        F.crc32(bytes_of).alias("_crc"),
    )
    rows = numbered(scratch, narrow, ["_key", "_crc", "_size"], "_row")
    permutation = Permutation(rows.count(), seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(row.to_numpy()))

    placed = rows.withColumn("_place", place("_row"))
    return placed.select(
        F.col("_key").alias(key),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_row").alias("row"),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / shards).cast("long").alias("slot"),
    )
