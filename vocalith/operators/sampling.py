"""Deterministic samples and splits by a hash of a key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def order(key: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of the hash: a uniform sample, equal for equal seeds."""
    return df.orderBy(order(F.col(key), seed), key).limit(n)


def sample_by(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each value of `by`; only each task's first n of a value are shuffled (window group limit)."""
    w = W.partitionBy(by).orderBy(order(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def top(df: DataFrame, by: list[str], n: int, *keys: Column) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*keys)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
