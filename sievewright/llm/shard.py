"""Reproducible shuffle into shards: a keyed permutation of the global row numbers.

Row numbers 0 … n-1 follow a total order of the table. A Feistel network permutes the smallest
even-bit domain that holds n; numbers that leave the range are sent through it again (cycle
walking) until they fall inside, so the result permutes exactly 0 … n-1. The permuted number p
gives shard ``p % shards`` and slot ``p // shards``: counts differ by one at most, slots have no gaps,
and both directions can be computed for one row without looking at any other.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.numbering import number_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 6


class Permutation:
    """A keyed bijection of 0 … n-1, computed on arrays."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        rng = np.random.default_rng(seed)
        self.keys = rng.integers(1, 2**63, size=ROUNDS, dtype=np.uint64)

    @staticmethod
    def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in keys:
            left, right = right, left ^ (self._mix(right, key) & self.mask)
        # halves swapped at the end: the same network with its keys reversed is the inverse
        return (right << self.half) | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        y = self._once(np.asarray(x, dtype=np.uint64), keys)
        outside = np.flatnonzero(y >= self.n)
        while len(outside):
            y[outside] = self._once(y[outside], keys)
            outside = outside[y[outside] >= self.n]
        return y.astype(np.int64)

    def forward(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self.keys)

    def inverse(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self.keys[::-1])


def row_of(n: int, shards: int, seed: int, shard: int, slot: int) -> int:
    """The row number that sits in a slot of a shard."""
    return int(Permutation(n, seed).inverse(np.array([slot * shards + shard]))[0])


def shard_rows(df: DataFrame, order: list[Column], shards: int = 16, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (int, 0 … shards-1) and ``slot`` (long, gapless from 0).

    ``order`` fixes the row numbers and should tell different rows apart; rows equal in it follow
    their position in the input. NULLs sort first, copies of a row get slots of their own, an
    empty table stays empty. Columns of ``df`` named shard or slot are replaced. Shuffles: one,
    by range, on the columns of ``df`` (pass keys, not texts, and join if texts are long).
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    plain = df.drop("shard", "slot")
    numbered = number_rows(plain, order, "__row")
    n = numbered.count()

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).forward(rows.to_numpy()))

    return numbered.withColumn("__place", place("__row")).select(
        *plain.columns,
        (F.col("__place") % shards).cast("int").alias("shard"),
        F.expr(f"__place div {shards}").alias("slot"),
    )
