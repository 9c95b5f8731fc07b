"""Ranks and exact quantiles of groups of any size.

Values are counted first, so a value that repeats is one row; the distinct values of a large group are spread over blocks
between approximate quantiles, so that a group with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 20000  # distinct values of a group that one task may order


def before(counts: DataFrame, by: list[str], v: str, n: str, block: int = BLOCK) -> DataFrame:
    """counts(by..., v, n, ...): one row per group and value -> with _before, the rows of the group with a smaller value, and
    _all, the rows of the group."""
    size = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_d"), F.sum(n).alias("_all"))
    bounds = counts.join(size.where(F.col("_d") > block).select(*by), by) if by else counts.crossJoin(F.broadcast(size.where(F.col("_d") > block).select()))  # one row at most
    bounds = bounds.groupBy(*by).agg(F.percentile_approx(v, [i / 128 for i in range(1, 128)], 10000).alias("_bounds"))
    spread = counts.join(size.drop("_d"), by) if by else counts.crossJoin(F.broadcast(size.drop("_d")))  # one row
    spread = spread.join(bounds, by, "left") if by else spread.join(F.broadcast(bounds), F.lit(True), "left")  # one row at most
    spread = spread.withColumn("_blk", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(v))), F.lit(0))).drop("_bounds")
    part = spread.groupBy(*by, "_blk").agg(F.sum(n).alias("_in"))
    start = part.withColumn("_start", F.sum("_in").over(W.partitionBy(*by).orderBy("_blk")) - F.col("_in")).drop("_in")  # at most 128 rows a group
    w = W.partitionBy(*by, "_blk").orderBy(v)
    return spread.join(F.broadcast(start) if not by else start, [*by, "_blk"]).withColumn("_before", F.col("_start") + F.sum(n).over(w) - F.col(n)).drop("_start", "_blk")


def value_counts(df: DataFrame, by: list[str], v: str, *more: Column) -> DataFrame:
    """(by..., v, n, ...): rows of each value, null and NaN left out."""
    return df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).groupBy(*by, v).agg(F.count(F.lit(1)).alias("n"), *more)


def quantiles(df: DataFrame, by: list[str], v: str, points: dict[str, float], block: int = BLOCK) -> DataFrame:
    """(by..., name...): exact quantiles with linear interpolation between the two values about the place."""
    c = before(value_counts(df, by, v), by, v, "n", block)
    out = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_all") - 1)
        value = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("n")), F.col(v).cast("double")))
        lo, hi = value(F.floor(at)), value(F.ceil(at))
        out.append((lo + F.max(at - F.floor(at)) * (hi - lo)).alias(name))
    return c.groupBy(*by).agg(*out)
