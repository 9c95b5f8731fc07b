"""Bloom filters of bounded size: what they let through by chance costs rows, never results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 1 << 26  # 8 MB


def places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = h.view(np.uint64)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)) % np.uint64(size), ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(17)) % np.uint64(size)


def build(hashes: DataFrame, name: str) -> np.ndarray:
    """The filter of a column of 64-bit hashes, as words of 64 bits; at most MOST_BITS, whatever the input."""
    size = max(1 << 16, min(MOST_BITS, 1 << int(np.ceil(np.log2(max(1, hashes.count()) * 12)))))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = places(b.column(0).to_numpy(zero_copy_only=False), size)
            p = np.unique(np.concatenate([one, two]).astype(np.int64))
            yield pa.record_batch([pa.array(p >> 6), pa.array(np.left_shift(np.int64(1), p & 63))], ["word", "bit"])

    words = hashes.select(name).where(F.col(name).isNotNull()).mapInArrow(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table


def held(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    one, two = places(h, len(table) * 64)
    bit = lambda p: table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)).astype(np.int64)
    return (bit(one) & bit(two) & 1).astype(bool)


def contains(spark: SparkSession, table: np.ndarray) -> Callable[[str], Column]:
    """The filter as a condition on a column; only the hashes go to Python."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(held(shared.value, h.to_numpy(np.int64)))

    return may
