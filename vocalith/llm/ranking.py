"""One ranking from several differently scaled scores.

Each score becomes its empirical percentile within the group, ties sharing the mean place; the percentile goes through the
inverse normal distribution; the weighted mean of these orders the items. No score decides by its unit or range. The weighted
mean of the percentiles themselves is given beside it: normal scores stretch the ends, so that an item first in two of three
scores can pass one that is high in all three; where every place is to count alike, order by `percentile`.

Ranks are counted over distinct values in blocks bounded by approximate quantiles, so that a group with a third of all
rows is spread over many tasks, and a value that repeats is one row before anything is sorted.

Defined results: an item with a null or NaN score, a null id or a null group is left out; a repeated item counts once;
a group of one item has percentile 0.5; equal combined scores are ordered by id; infinite scores take the end places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 20000  # rows of a block, about

# Coefficients of Acklam's rational approximation of the inverse normal distribution (fixed values)
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), as a built-in expression (relative error below 1.2e-9)."""
    poly = lambda cs, x: reduce(lambda acc, c: acc * x + F.lit(c), cs[1:], F.lit(cs[0]))
    low = F.sqrt(-2 * F.ln(p))
    high = F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    r = q * q
    tail = lambda x: poly(C, x) / (poly(D, x) * x + 1)
    return F.when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(poly(A, r) * q / (poly(B, r) * r + 1))


def places(long: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """long(grp, item, k, v): one value of score k per item, rows items or fewer -> (grp, k, v, n, place): the mean place of each value,
    from 1."""
    counts = long.groupBy("grp", "k", "v").agg(F.count(F.lit(1)).alias("c"))
    whole = long.groupBy("grp", "k").agg(F.count(F.lit(1)).alias("n"))
    big = whole.where(F.col("n") > block).select("grp", "k")
    # the bounds of blocks: approximate quantiles, as many as a group of all rows would need; groups of up to block rows have one block
    most = 10000
    n_blocks = max(2, min(most // 2, -(-rows // block)))
    bounds = (
        long.join(big, ["grp", "k"])
        .groupBy("grp", "k")
        .agg(F.percentile_approx("v", [i / n_blocks for i in range(1, n_blocks)], most).alias("bounds"))
    )
    spread = counts.join(whole, ["grp", "k"]).join(bounds, ["grp", "k"], "left")
    spread = spread.withColumn("blk", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("v"))), F.lit(0))).drop("bounds")
    total = spread.groupBy("grp", "k", "blk").agg(F.sum("c").alias("in_blk"))
    start = total.withColumn("start", F.sum("in_blk").over(W.partitionBy("grp", "k").orderBy("blk")) - F.col("in_blk")).drop("in_blk")
    w = W.partitionBy("grp", "k", "blk").orderBy("v")
    return spread.join(start, ["grp", "k", "blk"]).select("grp", "k", "v", "n", (F.col("start") + F.sum("c").over(w) - (F.col("c") - 1) / 2).alias("place"))


def combine(items: DataFrame, group: str, item: str, weights: dict[str, float], block: int = BLOCK) -> DataFrame:
    """items(group, item, one column per score) -> (group, item, n, percentile, combined), one row per item with all scores."""
    names = sorted(weights)
    cols = [F.col(k).cast("double").alias(f"s{i}") for i, k in enumerate(names)]
    base = items.select(F.col(group).alias("grp"), F.col(item).alias("item"), *cols)
    ok = reduce(lambda a, b: a & b, [F.col(f"s{i}").isNotNull() & ~F.isnan(f"s{i}") for i in range(len(names))])
    base = base.where("grp is not null and item is not null").where(ok).dropDuplicates(["item"])
    long = base.select("grp", "item", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), (F.col(f"s{i}") + 0.0).alias("v")) for i in range(len(names))])).alias("x")).select("grp", "item", "x.k", "x.v")
    p = (F.col("place") - 0.5) / F.col("n")
    at = places(long, items.count(), block).select("grp", "k", "v", "n", p.alias("p"), inverse_normal(p).alias("z"))
    weight = F.element_at(F.array(*[F.lit(float(weights[k])) for k in names]), F.col("k") + 1)
    scale = float(sum(weights.values())) or 1.0
    mean = lambda c: F.sum(F.round(F.col(c), 12) * weight) / scale
    out = long.join(at, ["grp", "k", "v"]).groupBy("grp", "item").agg(F.first("n").alias("n"), F.round(mean("p"), 9).alias("percentile"), mean("z").alias("combined"))
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), "n", "percentile", "combined")


def highest(ranked: DataFrame, group: str, item: str, k: int, by: str = "combined", block: int = 64) -> DataFrame:
    """The k items of each group that stand highest by `by`; first within hashed parts of a group, then among these."""
    parts = ranked.withColumn("part", F.pmod(F.xxhash64(item), F.lit(block)))
    order = [F.desc(by), F.col(item)]
    first = parts.withColumn("r", F.row_number().over(W.partitionBy(group, "part").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("r") <= k).drop("part").withColumnRenamed("r", "place")
