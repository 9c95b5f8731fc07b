"""Queries of the problem of document languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, table(spark, d, "lang_labels"))
    return language.segments(docs, model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d)
    stated = table(spark, d, "documents").where("doc_id is not null").select("doc_id", language.code_of(F.col("lang")).alias("stated")).dropDuplicates(["doc_id"])
    # a document's segments are a few rows: they go through one group, so that whole documents are kept or left
    per = seg.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg_no", "lang"))).alias("segs")).join(stated, "doc_id")
    wrong = F.col("stated").isNull() | (F.size("segs") > 1) | (F.col("segs")[0]["lang"] != F.col("stated"))
    return per.where(wrong).select("doc_id", F.explode("segs").alias("s")).select("doc_id", "s.seg_no", "s.lang")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language with its confidence and place."""
    return _segments(spark, d).select("doc_id", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "first_char", "last_char", "n_words")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language most of a document's words are in, with the confidence of its stretches."""
    by = _segments(spark, d).groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
    best = by.groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct("n", "lang")).alias("b"), F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_langs"))
    return best.select("doc_id", "b.lang", F.round("b.confidence", 6).alias("confidence"), "n_words", "n_langs")


QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}
SQL: dict[str, str] = {}
