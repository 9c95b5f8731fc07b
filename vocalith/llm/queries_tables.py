"""Queries of the problems on tables: splits, cutoffs and rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, remove, shared_path, table
from .common import corpus_key, fixture_key, number, once
from . import cutoffs, ranking, splits


# ---- problem 1


def _fixture_rows(spark: SparkSession, d: str, with_free: bool) -> DataFrame:
    """(row_id, node, ingested_at): the fixture of each row, or the row itself where it has none."""
    f = table(spark, d, "feature_rows").select("row_id", corpus_key(F.col("corpus")).alias("corpus"), "fixture_id")
    f = f.withColumn("fixture", fixture_key(F.col("fixture_id")))
    node = F.when(F.col("fixture").isNotNull() & F.col("corpus").isNotNull(), F.concat_ws("/", "corpus", "fixture"))
    if with_free:
        return once(f.select("row_id", F.coalesce(node, F.concat(F.lit("row:"), F.col("row_id").cast("string"))).alias("node")), "row_id")
    return once(f.where(node.isNotNull()).select("row_id", node.alias("node")), "row_id")


def _renames(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "fixture_renames").select(corpus_key(F.col("corpus")).alias("c"), fixture_key(F.col("old_id")).alias("x"), fixture_key(F.col("new_id")).alias("y"), "renamed_at")
    return r.where("c is not null and x is not null and y is not null").select(F.concat_ws("/", "c", "x").alias("a"), F.concat_ws("/", "c", "y").alias("b"), "renamed_at")


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _fixture_rows(spark, d, False)
    comps = splits.extend(None, _count(rows), _renames(spark, d), table(spark, d, "splits"))
    mine = rows.join(comps.select("node", "component"), "node").select("row_id", "component")
    first = mine.groupBy("component").agg(F.min("row_id").alias("first_row_id"))
    return mine.join(first, "component").where("row_id > first_row_id").select("first_row_id", "row_id")


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _fixture_rows(spark, d, True)
    return rows, splits.extend(None, _count(rows), _renames(spark, d), table(spark, d, "splits"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every row."""
    rows, comps = _placed(spark, d)
    return rows.join(comps.select("node", "component", "split"), "node").select("row_id", "component", "split")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split: rows, components, share reached and share wanted."""
    _, comps = _placed(spark, d)
    per = comps.groupBy("split").agg(F.sum("n").alias("n_rows"), F.countDistinct("component").alias("n_components"))
    total = comps.agg(F.sum("n").alias("total"))
    want = table(spark, d, "splits").where("split_name is not null").groupBy(F.col("split_name").alias("split")).agg(F.min("share").alias("wanted"))
    return want.join(per, "split", "left").crossJoin(F.broadcast(total)).select("split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_components", F.lit(0)).alias("n_components"), F.round(F.coalesce("n_rows", F.lit(0)) / F.col("total"), 6).alias("reached"), "wanted")


def p1_increment(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, the rows and renames of before a date and those after it, with the table written between them: what the second
    batch kept, added and quarantined, with the records of both. The date is where four fifths of the rows have come in."""
    rows = _fixture_rows(spark, d, True)
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    stamps = table(spark, d, "feature_rows").where("row_id is not null").groupBy("row_id").agg(F.min(seconds("ingested_at")).alias("at"))
    mid = stamps.agg(F.percentile_approx("at", 0.8).alias("m")).first()["m"]
    mid = F.lit(float(mid) if mid is not None else 0.0)
    rows = rows.join(stamps, "row_id").select("row_id", "node", F.coalesce(F.col("at") > mid, F.lit(True)).alias("late"))
    links, shares = _renames(spark, d).withColumn("late", F.coalesce(seconds("renamed_at") > mid, F.lit(False))), table(spark, d, "splits")
    path = shared_path(spark, "components")
    splits.write(splits.extend(None, _count(rows.where("not late")), links.where("not late"), shares), path)
    one = splits.read(spark, path)
    two = splits.extend(one, _count(rows.where("late")), links, shares)
    was = one.select("node", F.col("split").alias("was"))
    state = F.when(F.col("quarantined"), "quarantined").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("split"), "kept").otherwise("moved")
    out = cut(two.join(was, "node", "left").groupBy(state.alias("state"), "split").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n").alias("n_rows")))
    remove(spark, path)
    return out


# ---- problem 2


def _controls(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feature_rows").where("is_break = false").select("row_id", corpus_key(F.col("corpus")).alias("source"), number(F.col("features.adjusted_bpe")).alias("score"))
    return once(f.where("source is not null and score is not null"), "row_id")


def _keep(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "targets").select(corpus_key(F.col("name")).alias("source"), "keep_fraction")


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus: controls, cutoff, rows kept and ties at the cutoff."""
    return cutoffs.cutoffs(_controls(spark, d), _keep(spark, d)).withColumnRenamed("source", "corpus")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scored = _controls(spark, d)
    return cutoffs.kept(scored, cutoffs.cutoffs(scored, _keep(spark, d))).select("row_id")


# ---- problem 6


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feature_rows").select("row_id", "run_id", *[number(F.col(f"features.{k}")).alias(k) for k in SCORES])
    return ranking.combine(f, "run_id", "row_id", {k: 1.0 for k in SCORES}).where("n >= 20")


SCORES = ("adjusted_bpe", "bpe_score", "import_score")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # each place counts alike here, which the normal scores' mean does not give
    return ranking.highest(_ranked(spark, d), "run_id", "row_id", 3, "percentile").select("run_id", "row_id")


def p6_combined(spark: SparkSession, d: str) -> DataFrame:
    """The combined score of every row of the runs with at least 20 complete rows."""
    return _ranked(spark, d).select("run_id", "row_id", "n", F.round("percentile", 6).alias("percentile"), F.round("combined", 6).alias("combined"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}

_CORPUS = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-')"
_FIX = (
    r"regexp_replace(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim({0})), '^.*[/\\:]', '')), '\.[a-z]{{1,4}}$', ''),"
    r" '[^\p{{L}}\p{{N}}]+', '_', 'g'), '_'), '(^|[^0-9])0+([0-9])', '\1\2', 'g')"
)
_ROWS = "(SELECT row_id, any_value(" + _CORPUS.format("corpus") + ") AS corpus, any_value(fixture_id) AS fixture_id FROM feature_rows GROUP BY row_id)"
_LINKS = "(SELECT " + _CORPUS.format("corpus") + " || '/' || " + _FIX.format("old_id") + " AS a, " + _CORPUS.format("corpus") + " || '/' || " + _FIX.format("new_id") + " AS b FROM fixture_renames)"
_CONTROLS = (
    "controls AS (SELECT row_id, any_value(" + _CORPUS.format("corpus") + ") AS corpus, any_value(features.adjusted_bpe) AS score FROM feature_rows"
    " WHERE is_break = false AND features.adjusted_bpe IS NOT NULL AND NOT isnan(features.adjusted_bpe) GROUP BY row_id),"
    " sized AS (SELECT c.*, count(*) OVER (PARTITION BY c.corpus) AS n, t.keep_fraction,"
    " count(*) OVER (PARTITION BY c.corpus ORDER BY score DESC) AS kept, count(*) OVER (PARTITION BY c.corpus, score) AS ties"
    " FROM controls c JOIN targets t ON c.corpus = " + _CORPUS.format("t.name") + "),"
    " cuts AS (SELECT corpus, min(score) AS cutoff FROM sized WHERE kept / n <= keep_fraction GROUP BY corpus)"
)

_PLACE = "(rank() OVER (PARTITION BY run_id ORDER BY {0}) + (count(*) OVER (PARTITION BY run_id, {0}) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY run_id)"
_SCORES = "s AS (SELECT row_id, any_value(run_id) AS run_id, " + ", ".join(f"any_value(features.{k}) AS {k}" for k in SCORES) + " FROM feature_rows GROUP BY row_id), ok AS (SELECT * FROM s WHERE run_id IS NOT NULL AND " + " AND ".join(f"NOT isnan({k})" for k in SCORES) + ")"

SQL = {
    "p6_found": f"WITH {_SCORES}, p AS (SELECT run_id, row_id, count(*) OVER (PARTITION BY run_id) AS n, round(({' + '.join(_PLACE.format(k) for k in SCORES)}) / 3, 9) AS p FROM ok),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, row_id) AS r FROM p WHERE n >= 20) SELECT run_id, row_id FROM r WHERE r <= 3",
    "p1_found": "WITH RECURSIVE links AS MATERIALIZED (SELECT a, b FROM " + _LINKS + " UNION SELECT b, a FROM " + _LINKS + "),"
    " reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),"
    " roots AS (SELECT node, least(node, min(other)) AS root FROM reach GROUP BY node),"
    " mine AS (SELECT row_id, corpus || '/' || " + _FIX.format("fixture_id") + " AS node FROM " + _ROWS + " WHERE fixture_id IS NOT NULL),"
    " comp AS (SELECT row_id, min(row_id) OVER (PARTITION BY coalesce(root, mine.node)) AS first_row_id FROM mine LEFT JOIN roots ON mine.node = roots.node)"
    " SELECT first_row_id, row_id FROM comp WHERE row_id > first_row_id",
    "p2_found": "WITH " + _CONTROLS + " SELECT s.row_id FROM sized s JOIN cuts c ON s.corpus = c.corpus WHERE s.score >= c.cutoff",
    "p2_cutoffs": "WITH " + _CONTROLS + " SELECT s.corpus, any_value(n)::BIGINT AS n, any_value(keep_fraction) AS keep_fraction, any_value(c.cutoff) AS cutoff,"
    " coalesce(max(kept) FILTER (score >= c.cutoff), 0)::BIGINT AS kept, coalesce(max(ties) FILTER (score = c.cutoff), 0)::BIGINT AS ties"
    " FROM sized s LEFT JOIN cuts c ON s.corpus = c.corpus GROUP BY s.corpus",
}
