"""Ranges of a commit history held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def reachable(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """edges(sha, parent), heads(ref, sha) -> (ref, sha): the heads of each ref and all their forebears. A level of the history a round, for
    all refs at once, with one join of the newly reached commits, so that the work follows the commits reached and no depth is fixed."""
    seen = front = cut(heads.select("ref", "sha").where("ref is not null and sha is not null").distinct())
    up = edges.where("sha is not null and parent is not null").select("sha", "parent")
    while True:
        above = front.join(up, "sha").select("ref", F.col("parent").alias("sha")).distinct()
        front = cut(above.join(seen, ["ref", "sha"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def commit_ranges(edges: DataFrame, ranges: DataFrame) -> DataFrame:
    """edges(sha, parent), one row a parent; ranges(ref, start, end) -> (ref, sha): the commits that the end reaches and the start does
    not. Without a start they are the end's own commits, without those that its parents reach."""
    parents = ranges.where("start is null").select("ref", F.col("end").alias("sha")).join(edges, "sha").select("ref", F.col("parent").alias("sha"))
    start = ranges.select("ref", F.col("start").alias("sha")).unionByName(parents)
    return reachable(edges, ranges.select("ref", F.col("end").alias("sha"))).join(reachable(edges, start), ["ref", "sha"], "left_anti")
