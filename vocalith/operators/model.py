"""Models of a corpus as tables: token frequencies, vocabularies, callees and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


def token_counts(files: DataFrame, tokens: Column) -> DataFrame:
    """(token, n): occurrences over all files."""
    return files.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def total(counts: DataFrame) -> DataFrame:
    """One row: the occurrences of all tokens, 1 where there are none."""
    return counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))


def surprises(own: DataFrame, generic: DataFrame) -> DataFrame:
    """(token, s): how surprising each token of either table is in the corpus `own`."""
    both = own.select("token", F.col("n").alias("own")).join(generic.select("token", F.col("n").alias("gen")), "token", "full")
    ot, gt = total(own).select(F.col("total").alias("ot")), total(generic).select(F.col("total").alias("gt"))
    # one row each: the join adds two columns
    both = both.crossJoin(F.broadcast(ot)).crossJoin(F.broadcast(gt))
    return both.select("token", V.surprise(F.coalesce("gen", F.lit(0)), F.col("gt"), F.coalesce("own", F.lit(0)), F.col("ot")).alias("s"))


def bpe_scores(hunks: DataFrame, key: str, tokens: Column, own: DataFrame, generic: DataFrame) -> DataFrame:
    """(key, bpe): the greatest surprise over a fragment's meaningful tokens, over all if none is, 0 without tokens. Each
    fragment sends each of its tokens once; tokens of neither table have equal chances and a surprise of their own."""
    toks = F.array_distinct(tokens)
    good = F.filter(toks, T.meaningful)
    base = hunks.select(key, F.explode_outer(F.when(F.size(good) > 0, good).otherwise(toks)).alias("token"))
    s = with_surprise(base, own, generic)
    return s.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("token").isNotNull(), F.col("s"))), F.lit(0.0)).alias("bpe"))


def with_surprise(tokens: DataFrame, own: DataFrame, generic: DataFrame) -> DataFrame:
    """tokens(..., token) with s; the totals are one row, joined on, so nothing is computed ahead."""
    totals = total(own).select(F.col("total").alias("_ot")).crossJoin(F.broadcast(total(generic).select(F.col("total").alias("_gt"))))
    unseen = totals.select(V.surprise(F.lit(0), F.col("_gt"), F.lit(0), F.col("_ot")).alias("_unseen"))
    j = tokens.join(surprises(own, generic), "token", "left").crossJoin(F.broadcast(unseen))
    return j.select(*tokens.columns, F.coalesce("s", "_unseen").alias("s"))


def callee_files(files: DataFrame, file_key: str, callees: Column) -> DataFrame:
    """(file_key, callee): each callee of a file once."""
    return files.select(file_key, F.explode(F.array_distinct(callees)).alias("callee"))


def attested(calls: DataFrame) -> DataFrame:
    """(callee, root): the callees of the corpus."""
    return calls.select("callee").distinct().withColumn("root", T.namespace(F.col("callee")))


def resolve(hunk_calls: DataFrame, key: str, known: DataFrame, alpha: float = 2.0, root_bonus: float = 2.0) -> DataFrame:
    """hunk_calls(key, callee) -> (key, callee, known, root_known, w): the weight of each distinct callee without clusters."""
    c = hunk_calls.select(key, "callee").distinct().withColumn("root", T.namespace(F.col("callee")))
    c = c.join(known.select("callee", F.lit(True).alias("known")), "callee", "left")
    c = c.join(known.select("root").distinct().withColumn("root_known", F.lit(True)), "root", "left")
    w = F.when(F.col("known"), 0.0).when(F.col("root_known"), alpha + root_bonus).otherwise(alpha)
    return c.select(key, "callee", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("root_known", F.lit(False)).alias("root_known"), w.alias("w"))


def contributions(resolved: DataFrame, key: str, cap: float = 5.0) -> DataFrame:
    return resolved.groupBy(key).agg(F.least(F.sum("w"), F.lit(cap)).alias("contribution"))


def cluster_callees(calls: DataFrame, clusters: DataFrame, file_key: str) -> DataFrame:
    """(cluster_id, callee, n_files): in how many files of a cluster a callee stands."""
    return calls.distinct().join(clusters, file_key).groupBy("cluster_id", "callee").agg(F.count(F.lit(1)).alias("n_files"))


def cluster_weights(hunk_calls: DataFrame, key: str, known: DataFrame, by_cluster: DataFrame, sizes: DataFrame, beta: float = 5.0, tau: int = 2, size_min: int = 10) -> DataFrame:
    """hunk_calls(key, cluster_id, callee) -> (key, callee, w) with the cluster and rarity rules."""
    c = resolve(hunk_calls, key, known).join(hunk_calls.select(key, "cluster_id").distinct(), key)
    c = c.join(by_cluster, ["cluster_id", "callee"], "left").join(sizes, "cluster_id", "left")
    rare = (F.lit(tau) > 0) & (F.col("size") >= size_min) & (F.col("n_files") <= tau)
    return c.select(key, "callee", F.when(~F.col("known"), F.col("w")).when(F.col("cluster_id").isNull(), 0.0).when(F.col("n_files").isNull() | rare, beta).otherwise(0.0).alias("w"))


def nearest_cluster(bags: DataFrame, key: str, cluster_bags: DataFrame) -> DataFrame:
    """bags(key, callee), cluster_bags(cluster_id, callee), both without repeats -> (key, cluster_id, j): the cluster of greatest
    Jaccard similarity, the least id of several; overlaps come from a join on the callee, and where there is none the least
    cluster of all is taken. A fragment without callees has no row."""
    size = bags.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    other = cluster_bags.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("b"))
    shared = bags.join(cluster_bags, "callee").groupBy(key, "cluster_id").agg(F.count(F.lit(1)).alias("i"))
    j = F.col("i") / (F.col("a") + F.col("b") - F.col("i"))
    best = shared.join(size, key).join(other, "cluster_id").withColumn("j", j).groupBy(key).agg(F.max_by(F.struct("cluster_id", "j"), F.struct("j", -F.col("cluster_id"))).alias("x"))
    least = other.agg(F.min("cluster_id").alias("least"))
    return size.select(key).join(best, key, "left").crossJoin(F.broadcast(least)).select(key, F.coalesce("x.cluster_id", "least").alias("cluster_id"), F.coalesce("x.j", F.lit(0.0)).alias("j"))


def foreign(specs: DataFrame, modules: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of specs(..., spec) neither in modules(spec) nor beginning with one of prefixes(prefix), the few that compiler
    settings name."""
    return specs.join(modules.select("spec").distinct(), "spec", "left_anti").join(F.broadcast(prefixes.select("prefix")), F.col("spec").startswith(F.col("prefix")), "left_anti")
