"""Modules that belong to a repository: its packages, their dependencies and compiler path aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resolve(spark: SparkSession, packages: list[str], configs: list[str]) -> DataFrame:
    """JSON texts of package and compiler files -> (spec, kind); kind is exact or prefix. Broken JSON says nothing."""
    pk = spark.createDataFrame([(x,) for x in packages], "js string").select(F.from_json("js", "name string, dependencies map<string, string>, devDependencies map<string, string>").alias("p"))
    exact = pk.select(F.explode(F.concat(F.array("p.name"), *[F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("p.dependencies", "p.devDependencies")])).alias("spec")).select("spec", F.lit("exact").alias("kind"))
    cf = spark.createDataFrame([(x,) for x in configs], "js string").select(F.from_json("js", "compilerOptions struct<paths: map<string, array<string>>>").alias("c"))
    alias = cf.select(F.explode(F.map_keys("c.compilerOptions.paths")).alias("raw"))
    star = F.col("raw").endswith("/*")
    alias = alias.select(F.when(star, F.expr("left(raw, length(raw) - 2)")).otherwise(F.col("raw")).alias("spec"), F.when(star, "prefix").otherwise("exact").alias("kind"))
    return exact.unionByName(alias).where("spec is not null").distinct()
