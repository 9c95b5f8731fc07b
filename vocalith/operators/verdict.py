"""From scores to verdicts: thresholds, arbitration between stages, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks

INELIGIBLE = ("atypical", "atypical_file", "excluded_path", "auto_generated")


def thresholds(df: DataFrame, by: list[str], score: str, mode: str = "max", pct: float = 95.0, k: float = 1.5) -> DataFrame:
    """(by..., t): the greatest score of each group, an exact percentile, or the upper quartile plus k interquartile ranges."""
    if mode == "iqr":
        q = ranks.quantiles(df, by, score, {"_lo": 0.25, "_hi": 0.75})
        return q.select(*by, (F.col("_hi") + k * (F.col("_hi") - F.col("_lo"))).alias("t"))
    if mode == "percentile":
        return ranks.quantiles(df, by, score, {"t": pct / 100})
    return df.groupBy(*by).agg(F.max(score).alias("t"))


def arbitrate(imports: Column, bpe: Column, contribution: Column, limit: Column) -> Column:
    """The winning stage: the greatest ratio of score to threshold, call receivers before imports before tokens."""
    base = F.greatest(limit, F.lit(1e-7))
    call = F.when((bpe <= limit) & (bpe + contribution > limit), F.struct(((bpe + contribution) / base).alias("ratio"), F.lit(3).alias("order"), F.lit("call_receiver").alias("reason")))
    imp = F.when(imports >= 1, F.struct(imports.cast("double").alias("ratio"), F.lit(2).alias("order"), F.lit("import").alias("reason")))
    tok = F.when(bpe > limit, F.struct((bpe / base).alias("ratio"), F.lit(1).alias("order"), F.lit("bpe").alias("reason")))
    return F.coalesce(F.greatest(call, imp, tok)["reason"], F.lit("none"))


def eligible(reason: Column) -> Column:
    return ~F.coalesce(reason, F.lit("none")).isin(*INELIGIBLE)
