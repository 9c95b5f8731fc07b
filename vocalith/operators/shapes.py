"""Shape primitives: how far a fragment's form lies from that of its cluster.

A primitive is a value per file, of a text and its language or of tables, and a rule that turns a fragment's value and its cluster's
baseline into a score up to 5. Register one with `register`; all abstain (0) without a baseline or in a cluster of fewer than MIN_CLUSTER files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import parse

MIN_CLUSTER = 10
CAP = 5.0
PRIMITIVES: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if name in PRIMITIVES:
            raise ValueError(f"{name} is registered already")
        PRIMITIVES[name] = f
        return f

    return add


def baselines(values: DataFrame, least: int = 3) -> DataFrame:
    """values(cluster_id, value) of normal files -> (cluster_id, mean, std, n), for clusters with enough values."""
    g = values.groupBy("cluster_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
    return g.where(F.col("n") >= least)


def two_sided(value: Column, mean: Column, std: Column) -> Column:
    return F.least(F.lit(CAP), F.greatest(F.lit(0.0), F.abs(value - mean) / F.greatest(std, F.lit(1e-6)) - 1))


def below(value: Column, mean: Column, std: Column) -> Column:
    return F.least(F.lit(CAP), F.greatest(F.lit(0.0), (mean - value) / F.greatest(std, F.lit(1e-6)) - 1))


def score(hunks: DataFrame, base: DataFrame, sizes: DataFrame, rule: Callable = two_sided) -> DataFrame:
    """hunks(key..., cluster_id, value) with s: the rule's score, 0 where it abstains."""
    j = hunks.join(base, "cluster_id", "left").join(sizes, "cluster_id", "left")
    s = F.when((F.col("size") >= MIN_CLUSTER) & F.col("mean").isNotNull() & F.col("value").isNotNull(), rule(F.col("value"), F.col("mean"), F.col("std"))).otherwise(0.0)
    return j.select(*hunks.columns, s.alias("s"))


@register("typical_call_density")
def typical_share(calls: DataFrame, typical: DataFrame, key: str) -> DataFrame:
    """calls(key, cluster_id, callee) with nulls -> (key, cluster_id, value): the share of calls among typical(cluster_id, callee)."""
    t = typical.select("cluster_id", "callee", F.lit(1.0).alias("hit"))
    return calls.join(t, ["cluster_id", "callee"], "left").groupBy(key, "cluster_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("value"))


def typical_callees(by_cluster: DataFrame, k: int = 10) -> DataFrame:
    """The k callees in most files of each cluster, by name where equal."""
    w = W.partitionBy("cluster_id").orderBy(F.desc("n_files"), "callee")
    return by_cluster.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("cluster_id", "callee")


@register("namespace_jsd")
def namespace_divergence(hunk: DataFrame, cluster: DataFrame, key: str) -> DataFrame:
    """hunk(key, cluster_id, ns, n), cluster(cluster_id, ns, n) -> (key, cluster_id, value): 5 * sqrt of the Jensen-Shannon
    divergence in bits; names outside the cluster share one bucket."""
    known = cluster.select("cluster_id", "ns", F.lit(True).alias("known"))
    p = hunk.join(known, ["cluster_id", "ns"], "left").groupBy(key, "cluster_id", F.when(F.col("known"), F.col("ns")).otherwise("<other>").alias("ns")).agg(F.sum("n").alias("n"))
    p = p.join(p.groupBy(key, "cluster_id").agg(F.sum("n").alias("t")), [key, "cluster_id"]).select(key, "cluster_id", "ns", (F.col("n") / F.col("t")).alias("p"))
    q = cluster.join(cluster.groupBy("cluster_id").agg(F.sum("n").alias("t")), "cluster_id").select("cluster_id", "ns", (F.col("n") / F.col("t")).alias("q"))
    # terms of shared names need both sides; the rest of q adds q * log2(q / (q / 2)) = q in all, so it is 1 less the shared q
    j = p.join(q, ["cluster_id", "ns"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    m = (F.col("p") + F.col("q")) / 2
    term = F.col("p") * F.log2(F.col("p") / m) + F.when(F.col("q") > 0, F.col("q") * F.log2(F.col("q") / m)).otherwise(0.0)
    d = j.groupBy(key, "cluster_id").agg((F.sum(term) + 1 - F.sum("q")).alias("two"))
    return d.select(key, "cluster_id", (CAP * F.sqrt(F.greatest(F.lit(0.0), F.col("two") / 2))).alias("value"))


register("call_scope_fraction")(parse.module_scope_share)
register("except_return_raise_ratio")(parse.handler_ratio)
register("fall_through_guards")(parse.guards)
