"""Queries of sorts, limits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions import vectors as V
from ..operators import ranks, sampling
from ..operators.verdict import arbitrate
from ..session import table
from ..sources.tables import CODE_SQL, HUNKS_SQL, SCORED_SQL, code, hunks, scored
from .q_aggregates import BPE, bpe, counts, token_surprises
from .q_text import specs
from .registry import query

MD5 = "md5('0:' || {0})"


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs FROM hunks1 ORDER BY commit_sha, file_path, hs LIMIT 25")
def srt1_limit(spark: SparkSession, d: str) -> DataFrame:
    return hunks(spark, d).select("commit_sha", "file_path", "hs").orderBy("commit_sha", "file_path", "hs").limit(25)


@query(f"WITH {CODE_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM code) GROUP BY name ORDER BY n DESC, name LIMIT 50")
def srt2_top_names(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).select(F.explode(T.identifiers(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(50)


@query(f"WITH {BPE}, r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY round(s, 6) DESC, token) AS r FROM hs), k AS (SELECT r.entry_id, r.token, c.text FROM r JOIN code c USING (entry_id) WHERE r <= 8) SELECT entry_id, token, row_number() OVER (PARTITION BY entry_id ORDER BY instr(text, token), token) AS place FROM k")
def srt3_top_spans(spark: SparkSession, d: str) -> DataFrame:
    """The eight most surprising tokens of each fragment, put back into the order of the text."""
    own, gen = counts(spark, d)
    s = token_surprises(spark, d, own, gen)
    top = sampling.top(s, ["entry_id"], 8, F.desc(F.round("s", 6)), F.col("token")).drop("place")
    j = top.join(code(spark, d).select("entry_id", "text"), "entry_id").withColumn("at", F.expr("instr(text, token)"))
    return j.select("entry_id", "token", F.row_number().over(W.partitionBy("entry_id").orderBy("at", "token")).cast("long").alias("place"))


@query(f"WITH {SCORED_SQL}, t AS (SELECT row_id FROM scored WHERE is_break = false AND bpe_score IS NOT NULL ORDER BY bpe_score DESC, row_id LIMIT 40), r AS (SELECT row_id FROM scored WHERE is_break = false AND bpe_score IS NOT NULL ORDER BY {MD5.format('row_id')}, row_id LIMIT 20) SELECT row_id FROM t UNION SELECT row_id FROM r")
def srt4_heap_and_sample(spark: SparkSession, d: str) -> DataFrame:
    """The forty highest controls, and a sample of twenty of all, each once."""
    s = scored(spark, d).where("is_break = false and bpe_score is not null").select("row_id", "bpe_score")
    top = s.orderBy(F.desc("bpe_score"), "row_id").limit(40).select("row_id")
    return top.union(sampling.sample(s, "row_id", 20).select("row_id")).distinct()


@query(f"SELECT doc_id FROM documents ORDER BY {MD5.format('doc_id')}, doc_id LIMIT 100")
def srt5_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query(f"WITH {CODE_SQL} SELECT lang, entry_id FROM (SELECT lang, entry_id, row_number() OVER (PARTITION BY lang ORDER BY {MD5.format('entry_id')}, entry_id) AS r FROM code) WHERE r <= 50")
def srt6_sample_by_language(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_by(code(spark, d).select("lang", "entry_id"), "lang", "entry_id", 50)


@query(f"SELECT commit_sha, file_path, hs, he FROM (SELECT DISTINCT commit_sha, file_path, hunk_start_line AS hs, hunk_end_line AS he FROM hunks WHERE commit_sha IS NOT NULL) ORDER BY md5('0:' || commit_sha || '|' || file_path || '|' || hs || '|' || he) LIMIT 60")
def srt7_sample_distinct(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hunks").where("commit_sha is not null").select("commit_sha", "file_path", F.col("hunk_start_line").alias("hs"), F.col("hunk_end_line").alias("he")).distinct()
    return sampling.sample(h.withColumn("k", F.concat_ws("|", "commit_sha", "file_path", "hs", "he")), "k", 60).drop("k")


@query(f"WITH {CODE_SQL}, s AS (SELECT entry_id, row_number() OVER (ORDER BY {MD5.format('entry_id')}, entry_id) AS r FROM code WHERE side = 'train') SELECT row_number() OVER (ORDER BY entry_id) AS ordinal, entry_id FROM s WHERE r <= 100")
def srt8_sample_in_order(spark: SparkSession, d: str) -> DataFrame:
    """A hundred files without replacement, in their own order."""
    s = sampling.sample(code(spark, d).where("side = 'train'").select("entry_id"), "entry_id", 100)
    return s.select(F.row_number().over(W.orderBy("entry_id")).cast("long").alias("ordinal"), "entry_id")


@query(f"WITH {SCORED_SQL}, s AS (SELECT row_id, corpus, row_number() OVER (PARTITION BY corpus ORDER BY {MD5.format('row_id')}, row_id) AS r FROM scored WHERE is_break = false) SELECT row_id, CASE WHEN r <= 30 THEN 'calibration' ELSE 'control' END AS part FROM s WHERE r <= 60")
def srt9_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus thirty rows for calibration and thirty others as controls."""
    s = scored(spark, d).where("is_break = false").select("row_id", "corpus")
    t = sampling.top(s, ["corpus"], 60, sampling.order(F.col("row_id")), F.col("row_id"))
    return t.select("row_id", F.when(F.col("place") <= 30, "calibration").otherwise("control").alias("part"))


@query(f"WITH {HUNKS_SQL}, s AS (SELECT commit_sha, file_path, hs, row_number() OVER (PARTITION BY corpus ORDER BY epoch, commit_sha, file_path, hs) AS r, count(*) OVER (PARTITION BY corpus) AS n FROM hunks1 WHERE epoch IS NOT NULL) SELECT commit_sha, file_path, hs, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM s")
def srt10_time_split(spark: SparkSession, d: str) -> DataFrame:
    """The first four fifths of each corpus' fragments by time, and the rest."""
    h = hunks(spark, d).where("epoch is not null").select("corpus", "commit_sha", "file_path", "hs", "epoch")
    # whole times are counted and put in order; only the fragments of the one time that the cut falls into are ordered by name
    c = ranks.before(ranks.value_counts(h, ["corpus"], "epoch"), ["corpus"], "epoch", "n").withColumn("_cut", F.floor(F.col("_all") * 0.8))
    j = h.join(c, ["corpus", "epoch"])
    sure = j.where("_before + n <= _cut or _before >= _cut").select("commit_sha", "file_path", "hs", F.when(F.col("_before") < F.col("_cut"), "train").otherwise("test").alias("part"))
    at = j.where("_before + n > _cut and _before < _cut").withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy("corpus").orderBy("commit_sha", "file_path", "hs")))
    return sure.unionByName(at.select("commit_sha", "file_path", "hs", F.when(F.col("_r") <= F.col("_cut"), "train").otherwise("test").alias("part")))


@query(f"WITH {SCORED_SQL}, b AS (SELECT corpus, file_path, max(bpe_score) AS best FROM scored WHERE bpe_score >= 3 GROUP BY corpus, file_path) SELECT s.row_id, row_number() OVER (ORDER BY b.best DESC, s.corpus, s.file_path, s.hunk_start_line, s.row_id) AS place FROM scored s JOIN b ON s.corpus = b.corpus AND s.file_path = b.file_path WHERE s.bpe_score >= 3 ORDER BY place LIMIT 200")
def srt11_output_order(spark: SparkSession, d: str) -> DataFrame:
    """Files by their highest score, hits by line: the first 200 of the report."""
    s = scored(spark, d).where("bpe_score >= 3")
    b = s.groupBy("corpus", "file_path").agg(F.max("bpe_score").alias("best"))
    top = s.join(b, ["corpus", "file_path"]).orderBy(F.desc("best"), "corpus", "file_path", "hunk_start_line", "row_id").limit(200)
    return top.select("row_id", F.row_number().over(W.orderBy(F.desc("best"), "corpus", "file_path", "hunk_start_line", "row_id")).cast("long").alias("place"))


@query(f"WITH {SCORED_SQL}, b AS (SELECT corpus, file_path, max(bpe_score) AS best FROM scored WHERE bpe_score >= 3 GROUP BY corpus, file_path) SELECT s.row_id, row_number() OVER (ORDER BY b.best DESC, s.corpus, s.file_path, s.hunk_start_line, s.row_id) AS place FROM scored s JOIN b ON s.corpus = b.corpus AND s.file_path = b.file_path WHERE s.bpe_score >= 3")
def srt11_output_order_whole(spark: SparkSession, d: str) -> DataFrame:
    """Files by their highest score, hits by line: every hit of the report with its place in it."""
    s = scored(spark, d).where("bpe_score >= 3").select("row_id", "corpus", "file_path", "hunk_start_line", "bpe_score")
    f = s.groupBy("corpus", "file_path").agg((-F.max("bpe_score")).alias("down"), F.count(F.lit(1)).alias("hits"))
    # hits of files with a higher score are counted in blocks; files of one score follow by corpus, then by name
    above = ranks.before(f.groupBy("down").agg(F.sum("hits").alias("n")), [], "down", "n").select("down", "_before")
    c = f.groupBy("down", "corpus").agg(F.sum("hits").alias("n")).withColumn("_corpora", F.sum("n").over(W.partitionBy("down").orderBy("corpus")) - F.col("n")).drop("n")
    at = f.withColumn("_files", F.sum("hits").over(W.partitionBy("down", "corpus").orderBy("file_path")) - F.col("hits")).join(c, ["down", "corpus"]).join(above, "down")
    line = F.row_number().over(W.partitionBy("corpus", "file_path").orderBy("hunk_start_line", "row_id"))
    return s.join(at, ["corpus", "file_path"]).select("row_id", (F.col("_before") + F.col("_corpora") + F.col("_files") + line).cast("long").alias("place"))


@query(f"WITH {SCORED_SQL} SELECT corpus, row_id, place FROM (SELECT corpus, row_id, row_number() OVER (PARTITION BY corpus ORDER BY bpe_score DESC, row_id) AS place FROM scored WHERE is_break = false AND bpe_score IS NOT NULL) WHERE place <= 5")
def srt12_top_controls(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("is_break = false and bpe_score is not null").select("corpus", "row_id", "bpe_score")
    return sampling.top(s, ["corpus"], 5, F.desc("bpe_score"), F.col("row_id")).select("corpus", "row_id", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT ON (corpus, category) corpus, category, fixture_id FROM fixtures ORDER BY corpus, category, fixture_id")
def srt13_one_per_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fixtures").groupBy("corpus", "category").agg(F.min("fixture_id").alias("fixture_id"))


@query(f"WITH {SCORED_SQL}, x AS (SELECT row_id, coalesce(import_score, 0) AS i, coalesce(bpe_score, 0) AS b, least(5.0, 2.0 * n_unattested_callees + 2.0 * n_attested_root_only) AS c, 3.0 AS t FROM scored WHERE n_unattested_callees IS NOT NULL AND n_attested_root_only IS NOT NULL), y AS (SELECT row_id, CASE WHEN b <= t AND b + c > t THEN (b + c) / t END AS rc, CASE WHEN i >= 1 THEN i END AS ri, CASE WHEN b > t THEN b / t END AS rb FROM x) SELECT row_id, CASE WHEN rc IS NOT NULL AND rc >= coalesce(ri, -1) AND rc >= coalesce(rb, -1) THEN 'call_receiver' WHEN ri IS NOT NULL AND ri >= coalesce(rb, -1) THEN 'import' WHEN rb IS NOT NULL THEN 'bpe' ELSE 'none' END AS reason FROM y")
def srt14_arbitration(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("n_unattested_callees is not null and n_attested_root_only is not null")
    c = F.least(F.lit(5.0), 2.0 * F.col("n_unattested_callees") + 2.0 * F.col("n_attested_root_only"))
    return s.select("row_id", arbitrate(F.coalesce("import_score", F.lit(0.0)), F.coalesce("bpe_score", F.lit(0.0)), c, F.lit(3.0)).alias("reason"))


@query(f"WITH {SCORED_SQL} SELECT row_id, round(3.0 - bpe_score, 6) AS short_by FROM scored WHERE is_break AND NOT (coalesce(stage1_flagged, false) OR coalesce(stage2_flagged, false)) AND bpe_score IS NOT NULL")
def srt15_misses(spark: SparkSession, d: str) -> DataFrame:
    """Breaks that no stage flagged, with their distance to a threshold of 3."""
    s = scored(spark, d).where("is_break and not (coalesce(stage1_flagged, false) or coalesce(stage2_flagged, false)) and bpe_score is not null")
    return s.select("row_id", F.round(3.0 - F.col("bpe_score"), 6).alias("short_by")).orderBy("short_by", "row_id")


# ---- set operations


@query(f"WITH {CODE_SQL}, {HUNKS_SQL} SELECT source, count(*) AS n FROM (SELECT 'workdir' AS source FROM code UNION ALL SELECT substr(commit_sha, 1, 7) FROM hunks1) GROUP BY source")
def set1_chain(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of the working tree and of commits in one bag, repeats kept."""
    w, c = code(spark, d).select(F.lit("workdir").alias("source")), hunks(spark, d).select(F.substring("commit_sha", 1, 7).alias("source"))
    return w.unionByName(c).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT spec FROM (SELECT unnest(regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*')) AS spec FROM documents) UNION SELECT 'left.pad' UNION SELECT name FROM targets")
def set2_modules(spark: SparkSession, d: str) -> DataFrame:
    s = specs(spark, d).select("spec")
    return s.union(spark.createDataFrame([("left.pad",)], "spec string")).union(table(spark, d, "targets").select(F.col("name").alias("spec"))).distinct()


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT fixture_id FROM fixtures WHERE corpus < 'l' INTERSECT SELECT fixture_id FROM fixtures WHERE corpus >= 'l') UNION ALL SELECT 'first', count(*) FROM (SELECT DISTINCT fixture_id FROM fixtures WHERE corpus < 'l' EXCEPT SELECT fixture_id FROM fixtures WHERE corpus >= 'l')")
def set3_intersection(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fixtures")
    a, b = f.where("corpus < 'l'").select("fixture_id"), f.where("corpus >= 'l'").select("fixture_id")
    n = lambda x, k: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "first"))


@query(f"WITH {CODE_SQL}, i AS (SELECT entry_id, lang, list_distinct(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS bag FROM code), f AS (SELECT lang, arg_min(bag, entry_id) AS first FROM i GROUP BY lang) SELECT entry_id, round(len(list_intersect(bag, first)) / (len(bag) + len(first) - len(list_intersect(bag, first))), 6) AS j FROM i JOIN f USING (lang)")
def set4_bags(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of each file's identifiers with those of the first file of its language."""
    i = code(spark, d).select("entry_id", "lang", F.array_distinct(T.identifiers(F.col("text"))).alias("bag"))
    first = i.groupBy("lang").agg(F.min_by("bag", "entry_id").alias("first"))
    return i.join(F.broadcast(first), "lang").select("entry_id", F.round(V.jaccard(F.col("bag"), F.col("first")), 6).alias("j"))  # a row per language


@query(f"WITH {SCORED_SQL}, {BPE} SELECT source, count(*) AS n, round(avg(score), 5) AS mean FROM (SELECT 'stored' AS source, bpe_score AS score FROM scored UNION ALL SELECT 'held', bpe FROM bpe) GROUP BY source")
def set5_tagged(spark: SparkSession, d: str) -> DataFrame:
    a = scored(spark, d).select(F.lit("stored").alias("source"), F.col("bpe_score").alias("score"), "row_id")
    b = bpe(spark, d).select(F.lit("held").alias("source"), F.col("bpe").alias("score"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"))
