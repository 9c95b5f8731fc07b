"""Score cutoffs that keep a target fraction of each source's records.

A mergeable quantile sketch with bounded rank error is built per source; it is asked for the ranks just below and just
above the target, which bracket the cutoff. A second pass counts the records above the bracket and the ties of every
value inside it, so cutoff and kept size are exact. A bracket that the counts refute is widened.

Defined results: null and NaN scores, null sources and repeated records do not count; a source without a target or whose
fraction admits no value keeps nothing (cutoff null); a fraction of 1 or more keeps all; an infinite score is a score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 4096  # size of a sketch; its rank error stays below MARGIN with high probability, and is checked
MARGIN = 0.004
GRID = 500  # ranks at which a sketch is asked; the two about the target make the bracket


def sketches(scored: DataFrame) -> DataFrame:
    """scored(source, score) -> (source, sketch, n); partial sketches are merged, so a large source is no hot spot."""
    return scored.groupBy("source").agg(F.kll_sketch_agg_double("score", F.lit(K)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def cutoffs(scored: DataFrame, targets: DataFrame) -> DataFrame:
    """scored(source, score double), targets(source, keep_fraction) -> (source, n, keep_fraction, cutoff, kept, ties)."""
    scored = scored.where("source is not null and score is not null and not isnan(score)").select("source", "score")
    goal = targets.where("source is not null").groupBy("source").agg(F.min("keep_fraction").alias("f"))
    base = sketches(scored.withColumn("score", F.greatest(F.least("score", F.lit(1.7e308)), F.lit(-1.7e308)))).join(goal, "source").where("f is not null")
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    at_or = lambda x: F.element_at("grid", F.greatest(F.lit(0), F.least(F.lit(GRID), x)).cast("int") + 1)
    rows = base.select("source", "n", "f", grid.alias("grid")).select("source", "n", "f", at_or(F.floor((1 - F.col("f") - MARGIN) * GRID)).alias("lo"), at_or(F.ceil((1 - F.col("f") + MARGIN) * GRID)).alias("hi")).collect()
    spark = scored.sparkSession
    inf = float("inf")
    at = {r["source"]: [r["n"], r["f"], r["lo"] if abs(r["lo"]) < 1.6e308 and r["f"] + MARGIN + 1 / GRID < 1 else -inf, r["hi"] if abs(r["hi"]) < 1.6e308 and r["f"] - MARGIN - 1 / GRID > 0 else inf] for r in rows}
    schema = "source string, n long, f double, lo double, hi double"
    while True:
        bracket = F.broadcast(spark.createDataFrame([(k, *v) for k, v in at.items()], schema))  # a row per source with a target
        seen = scored.join(bracket, "source")
        inside = seen.where("score between lo and hi").groupBy("source", "n", "f", "score").agg(F.count(F.lit(1)).alias("ties"))
        some = lambda c: F.sum(F.when(c, 1).otherwise(0))
        above = seen.groupBy("source").agg(some(F.col("score") > F.col("hi")).alias("above"), some(F.col("score") >= F.col("hi")).alias("most"), some(F.col("score") >= F.col("lo")).alias("least"))
        wrong = False
        for r in above.collect():
            n, f, lo, hi = at[r["source"]]
            # the value at hi must be kept and that at lo must not, else the cutoff may lie outside
            sides = [-inf if r["least"] / n <= f else lo, inf if r["most"] / n > f else hi]
            wrong |= sides != [lo, hi]
            at[r["source"]][2:] = sides
        if not wrong:
            break
    w = W.partitionBy("source").orderBy(F.desc("score"))
    run = inside.join(above.select("source", "above"), "source").withColumn("kept", F.col("above") + F.sum("ties").over(w))
    best = run.where(F.col("kept") / F.col("n") <= F.col("f")).groupBy("source").agg(F.min("score").alias("cutoff"), F.max("kept").alias("kept"), F.min_by("ties", "score").alias("ties"))
    return bracket.select("source", "n", F.col("f").alias("keep_fraction")).join(best, "source", "left").select("source", "n", "keep_fraction", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("ties", F.lit(0)).alias("ties"))


def kept(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of records(source, score, ...) at or above their source's cutoff."""
    cut = F.broadcast(cuts.where("cutoff is not null").select("source", F.col("cutoff").alias("_cutoff")))  # a row per source
    return records.join(cut, "source").where(F.col("score") >= F.col("_cutoff")).drop("_cutoff")
