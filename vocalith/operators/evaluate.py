"""Measures of detection quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def auc(df: DataFrame, score: str, positive: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., auc): the area under the curve by average ranks over distinct scores; 0 where a class is empty."""
    c = ranks.before(ranks.value_counts(df, list(by), score, F.sum(positive.cast("long")).alias("_p")), list(by), score, "n")
    rank = F.col("_before") + (F.col("n") + 1) / 2
    got = c.groupBy(*by).agg(F.sum(rank * F.col("_p")).alias("_rank"), F.sum("_p").alias("_np"), (F.sum("n") - F.sum("_p")).alias("_nn"))
    area = F.try_divide(F.col("_rank") - F.col("_np") * (F.col("_np") + 1) / 2, F.col("_np") * F.col("_nn"))
    return got.select(*by, F.coalesce(area, F.lit(0.0)).alias("auc"))


def recall(df: DataFrame, flagged: str, by: str) -> DataFrame:
    """(by, n, hits, recall), rows without `by` left out."""
    hit = F.coalesce(F.col(flagged), F.lit(False)).cast("int")
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("recall"))


def stability(sets: DataFrame, key: str, item: str) -> DataFrame:
    """sets(key, item) -> (n_sets, jaccard): mean pairwise overlap of the sets; 1 for a single one, 0 for none."""
    s = sets.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct()
    size = s.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # keys are the few seeds of a calibration; items meet only where they are equal
    both = s.alias("x").join(s.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.k") < F.col("y.k"))).groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b")).agg(F.count(F.lit(1)).alias("both"))
    pairs = size.select(F.col("k").alias("a"), F.col("n").alias("na")).join(size.select(F.col("k").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    j = F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("both", F.lit(0)))
    n = size.agg(F.count(F.lit(1)).alias("n_sets"))
    return n.crossJoin(F.broadcast(pairs.agg(F.avg(j).alias("j")))).select("n_sets", F.round(F.when(F.col("n_sets") == 1, 1.0).otherwise(F.coalesce("j", F.lit(0.0))), 6).alias("jaccard"))
