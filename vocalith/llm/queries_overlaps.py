"""Queries of the problem of entries that occur on both sides of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .overlaps import overlaps


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    e, linked, by_place = overlaps(table(spark, d, "manifest_entries"))
    held = e.where("side <> 'train' and cls is not null").select(F.col("entry_id").alias("eid"), F.col("cls").alias("ecls"))
    train = e.where("side = 'train' and cls is not null").select(F.col("entry_id").alias("tid"), F.col("cls").alias("tcls"))
    pairs = linked.join(held, "ecls").join(train, "tcls").select("eid", "tid").unionByName(by_place)
    return pairs.select(F.least("eid", "tid").alias("entry_id_a"), F.greatest("eid", "tid").alias("entry_id_b"))


def p4_entries(spark: SparkSession, d: str) -> DataFrame:
    """One row per evaluation entry that also occurs in training: its class and the number of training entries it meets."""
    e, linked, by_place = overlaps(table(spark, d, "manifest_entries"))
    sizes = e.where("side = 'train' and cls is not null").groupBy(F.col("cls").alias("tcls")).agg(F.count(F.lit(1)).alias("n"))
    per = linked.join(sizes, "tcls").groupBy(F.col("ecls").alias("cls")).agg(F.sum("n").alias("n_links"))
    ours = e.where("side <> 'train'").select("entry_id", "label", "scope", "cls")
    by_content = ours.join(per, "cls").select("entry_id", "label", "scope", F.col("cls").alias("class_id"), "n_links")
    placed = by_place.groupBy(F.col("eid").alias("entry_id")).agg(F.count(F.lit(1)).alias("n_links"))
    return by_content.unionByName(ours.join(placed, "entry_id").select("entry_id", "label", "scope", F.lit(None).cast("string").alias("class_id"), "n_links"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per split label and scope: evaluation entries, and those that also occur in training."""
    hit = p4_entries(spark, d).groupBy("label", "scope").agg(F.count(F.lit(1)).alias("n_overlapping"), F.sum("n_links").alias("n_links"))
    label = F.lower(F.trim("set"))
    every = table(spark, d, "manifest_entries").select("entry_id", label.alias("label"), "scope").where("entry_id is not null and label is not null and not startswith(label, 'train')").dropDuplicates(["entry_id"])
    return every.groupBy("label", "scope").agg(F.count(F.lit(1)).alias("n_entries")).join(hit, ["label", "scope"], "left").select("label", "scope", "n_entries", F.coalesce("n_overlapping", F.lit(0)).alias("n_overlapping"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}
SQL: dict[str, str] = {}
