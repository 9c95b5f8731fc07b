"""Queries of the problems on vectors: neighbours and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import groups, neighbours
from .common import corpus_key

FIELDS = {"hunk": "hunk_embedding", "context": "context_embedding"}
LEAST = 0.92


# ---- problem 3


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = neighbours.row_pairs(table(spark, d, "feature_rows").select("row_id", *FIELDS.values()), "row_id", FIELDS, LEAST)
    return got.select(F.col("field").alias("vec_field"), F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per usable vector: its class (equal vectors are one) and how many other classes have a cosine of LEAST or more."""
    close, members = neighbours.pairs(table(spark, d, "feature_rows").select("row_id", *FIELDS.values()), "row_id", FIELDS, LEAST)
    links = close.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    got = members.distinct().join(links, "cls", "left")
    return got.select(F.col("field").alias("vec_field"), F.col("id").alias("row_id"), F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten rows most like each row whose id is divisible by 20, by either vector."""
    got = neighbours.nearest(table(spark, d, "feature_rows").select("row_id", *FIELDS.values()), "row_id", FIELDS, "row_id % 20 = 0")
    return got.select(F.col("field").alias("vec_field"), F.col("id").alias("row_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 3).alias("cosine"), "place")


# ---- problem 5


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feature_rows").select("row_id", corpus_key(F.col("corpus")).alias("source"), F.col("features.cluster_id").alias("cluster_id"), F.col("hunk_embedding").alias("vec"))
    return groups.grouped(rows)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = _grouped(spark, d)
    names = F.broadcast(groups.named(g).where("group_id is not null"))  # a row per group
    return g.join(names, ["source", "grp"]).where("cluster_id is null or cluster_id <> group_id").select("row_id", F.col("group_id").alias("cluster_id"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group: its id, rows, rows whose stored id differs, and its three most typical rows."""
    g = _grouped(spark, d)
    names = F.broadcast(groups.named(g))  # a row per group
    wrong = g.join(names, ["source", "grp"]).groupBy("source", "grp", "group_id", "size").agg(F.count_if(F.col("cluster_id").isNull() | (F.col("cluster_id") != F.col("group_id"))).alias("n_wrong"))
    rows = groups.typical(g).groupBy("source", "grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "row_id"))), lambda x: x["row_id"]).alias("typical"))
    return wrong.join(rows, ["source", "grp"]).select(F.col("source").alias("corpus"), "grp", F.col("group_id").alias("cluster_id"), "size", "n_wrong", "typical")


QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}
_ONE = (
    "rows AS MATERIALIZED (SELECT vec_field, row_id, any_value(v) AS v FROM (SELECT 'hunk' AS vec_field, row_id, hunk_embedding AS v FROM feature_rows"
    " UNION ALL SELECT 'context', row_id, context_embedding FROM feature_rows) WHERE v IS NOT NULL AND len(v) = 64"
    " AND NOT list_bool_or(list_transform(v, lambda x: isnan(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0)) GROUP BY ALL)"
)
SQL = {
    "p3_found": "WITH " + _ONE + ", fixed AS MATERIALIZED (SELECT vec_field, row_id, v::FLOAT[64] AS v FROM rows)"
    " SELECT a.vec_field, a.row_id AS row_id_a, b.row_id AS row_id_b FROM fixed a JOIN fixed b ON a.vec_field = b.vec_field AND a.row_id < b.row_id"
    " WHERE array_cosine_similarity(a.v, b.v) >= 0.92",
}
