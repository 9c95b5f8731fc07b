"""Queries of the problems on documents: leaks of evaluation items, packing, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leaks, packing


# ---- problem 8


def _passages(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", F.when(F.col("item_kind") == "hunk", "code").otherwise("prose").alias("kind"), "text")
    return leaks.leaks(table(spark, d, "documents"), items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation item: the documents it leaked into and the largest share held by one."""
    return _passages(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max("held"), 6).alias("most_held"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Each touched document without the leaked passages: characters removed and the text left."""
    spans = _passages(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first_char", "last_char"))).alias("spans"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(spans, "doc_id")
    # kept pieces: from the furthest end so far to the next passage
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    step = lambda acc, s: F.struct(F.greatest(acc.at, s.last_char).alias("at"), F.concat(acc.kept, F.substring(F.col("text"), acc.at + 1, F.greatest(F.lit(0), s.first_char - acc.at))).alias("kept"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc.kept, F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    out = docs.select("doc_id", F.length("text").alias("n_before"), done.alias("text"))
    return out.select("doc_id", (F.col("n_before") - F.length("text")).alias("n_removed"), "text")


# ---- problem 7


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sizes(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).where("part_no = 1 and n_parts > 1").select("doc_id")


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of a text larger than a container, with its container."""
    return _placed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well the containers are filled."""
    per = _placed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    total = F.sum("used")
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_items"), total.alias("n_tokens"), F.max("used").alias("fullest"),
        F.round(F.try_divide(total, F.count(F.lit(1)) * packing.CAPACITY), 6).alias("filled"),
    )


QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}
# sizes lie so far from a container's that a count of words and marks tells the same documents
SQL = {"p7_found": r"SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) > 2048"}
