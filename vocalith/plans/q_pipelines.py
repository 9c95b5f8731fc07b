"""Queries of the composite operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate
from ..operators.verdict import eligible
from ..session import cut, remove, shared_path, table
from ..sources.tables import CODE_SQL, SCORED_SQL, code, scored
from . import pipelines as P
from .q_aggregates import AUC, BPE, FLAG, INEL, flagged
from .q_filters import typicality
from .registry import SQL, query
from .samples import by_hand

_CALLS = r"""calls AS (SELECT entry_id, corpus, side, unnest(list_distinct(regexp_extract_all(regexp_replace(text, '\b(def|function|class|if|for|while|with|switch|catch|return|await|new|in|not|and|or|is)\b', chr(1), 'g'), '([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\(', 1))) AS callee FROM code),
 att AS (SELECT DISTINCT callee, string_split(callee, '.')[1] AS root FROM calls WHERE side = 'train')"""
_PLAIN = "con AS (SELECT entry_id, least(sum(CASE WHEN callee IN (SELECT callee FROM att) THEN 0.0 WHEN string_split(callee, '.')[1] IN (SELECT root FROM att) THEN 4.0 ELSE 2.0 END), 5.0) AS con FROM calls WHERE side = 'held' GROUP BY entry_id)"
_STATIC = "cc AS (SELECT corpus, callee, count(*) AS nf FROM calls WHERE side = 'train' GROUP BY corpus, callee), cs AS (SELECT corpus, count(*) AS size FROM code WHERE side = 'train' GROUP BY corpus), con AS (SELECT h.entry_id, least(sum(CASE WHEN a.callee IS NULL THEN CASE WHEN string_split(h.callee, '.')[1] IN (SELECT root FROM att) THEN 4.0 ELSE 2.0 END WHEN c.nf IS NULL OR s.size >= 10 AND c.nf <= 2 THEN 5.0 ELSE 0.0 END), 5.0) AS con FROM calls h LEFT JOIN (SELECT DISTINCT callee FROM att) a ON a.callee = h.callee LEFT JOIN cc c ON c.corpus = h.corpus AND c.callee = h.callee LEFT JOIN cs s ON s.corpus = h.corpus WHERE h.side = 'held' GROUP BY h.entry_id)"
_T = 3.0
_VERDICT = f"v AS (SELECT b.entry_id, b.bpe, coalesce(con, 0.0) AS con, CASE WHEN bpe <= {_T} AND bpe + coalesce(con, 0) > {_T} THEN 'call_receiver' WHEN bpe > {_T} THEN 'bpe' ELSE 'none' END AS reason FROM bpe b LEFT JOIN con USING (entry_id))"


def _model(spark: SparkSession, d: str) -> P.Model:
    return P.fit(code(spark, d).where("side = 'train'"), table(spark, d, "documents"))


def _held(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).where("side = 'held'")


def _held_in_files(spark: SparkSession, d: str) -> DataFrame:
    """As _held, with atypical_file: whether the stored fragments of the file hold 100 leaves, more than 80 % of them literals."""
    t = typicality(code(spark, d).select("corpus", "path", "text", "lang")).select("corpus", "path", "t.n_leaves", (F.col("t.n_leaves") * F.col("t.literal_ratio")).alias("l"))
    f = t.groupBy("corpus", "path").agg(F.sum("n_leaves").alias("n"), F.sum("l").alias("l"))
    return _held(spark, d).join(f.where("n >= 100 and l / n > 0.8").select("corpus", "path", F.lit(True).alias("atypical_file")), ["corpus", "path"], "left")


def _guarded(spark: SparkSession, d: str, hunks: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    m = P.fit(code(spark, d).where("side = 'train'"), table(spark, d, "documents"), parsed=True)
    return P.guarded(P.stages(P.blanked(hunks), m, **how), hunks, m)


@query(f"WITH {BPE}, {_CALLS}, {_PLAIN}, {_VERDICT} SELECT entry_id, 0.0::DOUBLE AS import_score, round(bpe, 6) AS bpe, con::DOUBLE AS contribution, reason, reason <> 'none' AS flagged, round(CASE WHEN reason = 'call_receiver' THEN bpe + con ELSE bpe END, 6)::DOUBLE AS score FROM v")
def pip1_score_hunk(spark: SparkSession, d: str) -> DataFrame:
    """Every fragment under test with its stage scores, the winning stage and the verdict."""
    v = P.verdicts(P.stages(_held(spark, d), _model(spark, d)), F.lit(_T))
    return v.select("entry_id", "import_score", F.round("bpe", 6).alias("bpe"), "contribution", "reason", "flagged", F.round("score", 6).alias("score"))


@query()
def pip1_score_hunk_parsed(spark: SparkSession, d: str) -> DataFrame:
    """All stages: typicality, foreign imports, callees with the guard against cut texts, tokens, arbitration."""
    v = P.verdicts(_guarded(spark, d, _held_in_files(spark, d)), F.lit(_T))
    return v.select("entry_id", "import_score", F.round("bpe", 6).alias("bpe"), "contribution", "reason", "flagged", F.round("score", 6).alias("score"))


@query(f"WITH {BPE}, {_CALLS}, {_STATIC}, {_VERDICT} SELECT entry_id, con::DOUBLE AS contribution, reason FROM v")
def pip1_score_hunk_clustered(spark: SparkSession, d: str) -> DataFrame:
    """The same with the cluster and rarity rules."""
    return P.verdicts(P.stages(_held(spark, d), _model(spark, d), routing="static", tau=2), F.lit(_T)).select("entry_id", "contribution", "reason")


@query()
def pip1_score_hunk_clustered_parsed(spark: SparkSession, d: str) -> DataFrame:
    """All stages with the cluster and rarity rules."""
    return P.verdicts(_guarded(spark, d, _held_in_files(spark, d), routing="static", tau=2), F.lit(_T)).select("entry_id", "contribution", "reason")


@query(f"WITH {BPE}, {_CALLS} SELECT 'own' AS name, count(*) AS n FROM own UNION ALL SELECT 'generic', count(*) FROM gen UNION ALL SELECT 'known', count(*) FROM (SELECT DISTINCT callee FROM att) UNION ALL SELECT 'by_cluster', count(*) FROM (SELECT DISTINCT corpus, callee FROM calls WHERE side = 'train') UNION ALL SELECT 'sizes', count(DISTINCT corpus) FROM code WHERE side = 'train'")
def pip2_fit(spark: SparkSession, d: str) -> DataFrame:
    """The model written as tables and read again: rows of each."""
    path = shared_path(spark, "model")
    _model(spark, d).write(path)
    m = P.Model.read(spark, path)
    out = None
    for name in ("own", "generic", "known", "by_cluster", "sizes"):
        n = getattr(m, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_TBPE = BPE.replace("side = 'held'", "side = 'train'")


@query(f"WITH {_TBPE} SELECT entry_id, round(bpe, 6) AS score FROM bpe")
def pip3_calibration_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the corpus' own fragments, without callee weights."""
    s = P.stages(code(spark, d).where("side = 'train'"), _model(spark, d), alpha=0.0)
    return s.select("entry_id", F.round(F.col("bpe") + F.col("contribution"), 6).alias("score"))


@query(f"WITH {_TBPE}, s AS (SELECT seed, bpe, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || entry_id), entry_id) AS r FROM bpe CROSS JOIN range(0, 7) x(seed)), per AS (SELECT seed, quantile_cont(bpe, 0.95) AS t FROM s WHERE r <= 100 GROUP BY seed) SELECT round(median(t), 6) AS threshold FROM per")
def pip4_calibrate(spark: SparkSession, d: str) -> DataFrame:
    """The threshold: median over seven seeds of the 95 % percentile of a hundred fragments."""
    t = P.calibrate(code(spark, d).where("side = 'train'"), _model(spark, d), 100, 7, "percentile", 95)
    return t.select(F.round("threshold", 6).alias("threshold"))


@query(f"WITH {CODE_SQL}, {_CALLS}, cc AS (SELECT corpus, callee, count(*) AS nf FROM calls WHERE side = 'train' GROUP BY corpus, callee), cs AS (SELECT corpus, count(*) AS size FROM code WHERE side = 'train' GROUP BY corpus), f AS (SELECT h.entry_id, h.corpus, bool_or(a.callee IS NOT NULL AND s.size >= 10 AND c.nf <= 2) AS fired FROM calls h LEFT JOIN (SELECT DISTINCT callee FROM att) a ON a.callee = h.callee LEFT JOIN cc c ON c.corpus = h.corpus AND c.callee = h.callee LEFT JOIN cs s ON s.corpus = h.corpus WHERE h.side = 'train' GROUP BY 1, 2) SELECT corpus, round(avg(coalesce(fired, false)::INT), 6) AS rate, avg(coalesce(fired, false)::INT) < 0.05 AS keep FROM f GROUP BY corpus")
def pip5_auto_detect(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus whether the rarity rule is kept: it must fire on fewer than 5 % of the corpus' own fragments."""
    m = _model(spark, d)
    calls = code(spark, d).where("side = 'train'").select("entry_id", F.col("corpus").alias("cluster_id"), F.explode(F.array_distinct(T.callees(F.col("text")))).alias("callee"))
    c = calls.join(m.by_cluster, ["cluster_id", "callee"], "left").join(m.sizes, "cluster_id", "left").join(m.known.select("callee", F.lit(True).alias("known")), "callee", "left")
    f = c.groupBy("entry_id", F.col("cluster_id").alias("corpus")).agg(F.coalesce(F.bool_or(F.col("known") & (F.col("size") >= 10) & (F.col("n_files") <= 2)), F.lit(False)).cast("int").alias("fired"))
    return f.groupBy("corpus").agg(F.round(F.avg("fired"), 6).alias("rate"), (F.avg("fired") < 0.05).alias("keep"))


@query(f"WITH {BPE}, {_CALLS}, {_PLAIN}, n AS (SELECT entry_id, count(*) AS n FROM calls GROUP BY entry_id) SELECT c.entry_id, round(b.bpe, 6) AS bpe, coalesce(con, 0.0)::DOUBLE AS contribution, coalesce(n, 0) AS n_callees, length(c.text) AS n_chars, round(b.bpe + coalesce(con, 0), 6)::DOUBLE AS adjusted FROM code c JOIN bpe b USING (entry_id) LEFT JOIN con USING (entry_id) LEFT JOIN n USING (entry_id)")
def pip6_features(spark: SparkSession, d: str) -> DataFrame:
    """A feature row per fragment under test."""
    h = _held(spark, d)
    return _features(h, P.stages(h, _model(spark, d)))


def _features(h: DataFrame, s: DataFrame, *more: str) -> DataFrame:
    n = h.select("entry_id", F.size(F.array_distinct(T.callees(F.col("text")))).cast("long").alias("n_callees"), F.length("text").cast("long").alias("n_chars"))
    return s.join(n, "entry_id").select("entry_id", *more, F.round("bpe", 6).alias("bpe"), "contribution", "n_callees", "n_chars", F.round(F.col("bpe") + F.col("contribution"), 6).alias("adjusted"))


@query()
def pip6_features_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The same of all stages, with the import score."""
    h = _held_in_files(spark, d)
    return _features(h, _guarded(spark, d, h), "import_score")


@query(f"WITH {BPE}, k AS (SELECT entry_id, any_value(is_break) AS is_break FROM manifest_entries GROUP BY entry_id) SELECT k.is_break, count(*) AS n, round(avg(bpe), 5) AS mean, round(max(bpe), 5) AS best FROM bpe JOIN k USING (entry_id) GROUP BY k.is_break")
def pip7_fixtures_and_controls(spark: SparkSession, d: str) -> DataFrame:
    s = P.stages(_held(spark, d), _model(spark, d), alpha=0.0)
    k = table(spark, d, "manifest_entries").select("entry_id", "is_break").dropDuplicates(["entry_id"])
    return s.join(k, "entry_id").groupBy("is_break").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bpe"), 5).alias("mean"), F.round(F.max("bpe"), 5).alias("best"))


def corpus_report(spark: SparkSession, d: str) -> DataFrame:
    """(corpus, auc, recall, fp, threshold): recall is the mean over categories, false positives are of eligible controls."""
    s = flagged(spark, d).persist()
    auc = evaluate.auc(s.where("is_break is not null"), "bpe_score", F.col("is_break"), ("corpus",))
    hit = F.col("flagged").cast("int")
    rec = s.where("is_break and category is not null").groupBy("corpus", "category").agg(F.avg(hit).alias("r")).groupBy("corpus").agg(F.avg("r").alias("recall"))
    fp = s.where((F.col("is_break") == False) & eligible(F.col("scorer_reason"))).groupBy("corpus").agg(F.avg(hit).alias("fp"))  # noqa: E712
    t = s.where("is_break = false").groupBy("corpus").agg(F.max("bpe_score").alias("threshold"))
    return auc.join(rec, "corpus", "left").join(fp, "corpus", "left").join(t, "corpus", "left")


@query(f"WITH {SCORED_SQL}, {AUC}, rec AS (SELECT corpus, avg(r) AS recall FROM (SELECT corpus, category, avg({FLAG}::INT) AS r FROM scored WHERE is_break AND category IS NOT NULL GROUP BY corpus, category) GROUP BY corpus), fp AS (SELECT corpus, avg({FLAG}::INT) AS fp FROM scored WHERE is_break = false AND coalesce(scorer_reason, 'none') NOT IN {INEL} GROUP BY corpus), t AS (SELECT corpus, max(bpe_score) AS threshold FROM scored WHERE is_break = false GROUP BY corpus) SELECT corpus, round(auc, 5) AS auc, round(recall, 5) AS recall, round(fp, 5) AS fp, round(threshold, 5) AS threshold FROM a LEFT JOIN rec USING (corpus) LEFT JOIN fp USING (corpus) LEFT JOIN t USING (corpus)")
def pip8_corpus_run(spark: SparkSession, d: str) -> DataFrame:
    r = corpus_report(spark, d)
    return r.select("corpus", *[F.round(c, 5).alias(c) for c in ("auc", "recall", "fp", "threshold")])


@query(f"WITH {BPE}, {_CALLS}, {_PLAIN}, {_VERDICT}, f AS (SELECT c.entry_id, c.corpus, c.path, c.start, v.bpe, v.reason, CASE WHEN v.bpe >= {_T} + 1.5 THEN 'foreign' WHEN v.bpe >= {_T} + 0.5 THEN 'suspicious' ELSE 'unusual' END AS severity FROM v JOIN code c USING (entry_id) WHERE v.reason <> 'none' AND NOT regexp_matches(c.path, '/net/')) SELECT entry_id, reason, severity FROM f WHERE severity <> 'unusual'")
def pip9_check(spark: SparkSession, d: str) -> DataFrame:
    """What a check reports: flagged fragments of files in scope, at least suspicious, files by highest score, hits by line."""
    c = _held(spark, d).where(~T.glob(F.col("path"), "*/net/*"))
    return _hits(c, P.stages(c, _model(spark, d)))


def _hits(c: DataFrame, s: DataFrame) -> DataFrame:
    v = P.verdicts(s, F.lit(_T)).withColumn("severity", T.severity(F.col("bpe"), F.lit(_T)))
    hits = v.where(F.col("flagged") & (T.severity_rank(F.col("severity")) >= 1)).join(c.select("entry_id", "corpus", "path", "start"), "entry_id")
    best = hits.groupBy("corpus", "path").agg(F.max("bpe").alias("best"))
    return hits.join(best, ["corpus", "path"]).orderBy(F.desc("best"), "corpus", "path", "start", "entry_id").select("entry_id", "reason", "severity")


@query()
def pip9_check_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The same report of all stages."""
    c = _held_in_files(spark, d).where(~T.glob(F.col("path"), "*/net/*"))
    return _hits(c, _guarded(spark, d, c))


@query(f"WITH {SCORED_SQL}, {AUC} SELECT corpus, round(auc, 4) AS auc FROM a")
def pip10_stored_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON and read again."""
    path = shared_path(spark, "report")
    corpus_report(spark, d).write.json(path)
    return spark.read.schema("corpus string, auc double").json(path).select("corpus", F.round("auc", 4).alias("auc"))


@query(SQL["pip8_corpus_run"])
def snk6_report_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object per corpus with its measures."""
    path = shared_path(spark, "corpus-json")
    pip8_corpus_run(spark, d).write.json(path)
    return spark.read.schema("corpus string, auc double, recall double, fp double, threshold double").json(path)


@query(f"WITH {CODE_SQL} SELECT lang, 3.0::DOUBLE AS threshold FROM code WHERE side = 'train' GROUP BY lang")
def snk4_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each language written as JSON of version 2 and read again."""
    langs = [r["lang"] for r in code(spark, d).where("side = 'train'").select("lang").distinct().collect()]  # a row per language
    got = P.read_config(P.config({x: 3.0 for x in langs}, 100, 7))
    return spark.createDataFrame(sorted(got.items()), "lang string, threshold double")


_REPORT = (
    f"WITH {SCORED_SQL}, {AUC}, sf AS (SELECT *, {FLAG} AS flagged FROM scored), rec AS (SELECT corpus, avg(r) AS recall FROM (SELECT corpus, category, avg(flagged::INT) AS r FROM sf WHERE is_break AND category IS NOT NULL GROUP BY corpus, category) GROUP BY corpus), fp AS (SELECT corpus, avg(flagged::INT) AS fp FROM sf WHERE is_break = false AND coalesce(scorer_reason, 'none') NOT IN {INEL} GROUP BY corpus), ends AS (SELECT corpus, min(bpe_score) FILTER (is_break) AS lo, max(bpe_score) FILTER (NOT is_break) AS hi, count(*) FILTER (is_break) AS n_fix, count(*) FILTER (NOT is_break) AS n_ctrl FROM sf GROUP BY corpus)"
    " SELECT 'headline' AS section, corpus, '| ' || coalesce(corpus::VARCHAR, '-') || ' | ' || coalesce((floor(round(auc, 9) * 1e4 + 0.5) / 1e4)::DECIMAL(30,4)::VARCHAR, '-') || ' | ' || coalesce((floor(round(recall, 9) * 1e4 + 0.5) / 1e4)::DECIMAL(30,4)::VARCHAR, '-') || ' | ' || coalesce((floor(round(fp, 9) * 1e4 + 0.5) / 1e4)::DECIMAL(30,4)::VARCHAR, '-') || ' | ' || coalesce((floor(round(lo - hi, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce(n_fix::VARCHAR, '-') || ' | ' || coalesce(n_ctrl::VARCHAR, '-') || ' | ' || coalesce((floor(round(hi, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' AS line FROM a JOIN ends USING (corpus) LEFT JOIN rec USING (corpus) LEFT JOIN fp USING (corpus)"
    " UNION ALL SELECT 'category', corpus, '| ' || coalesce(category::VARCHAR, '-') || ' | ' || coalesce(n::VARCHAR, '-') || ' | ' || coalesce(hits::VARCHAR, '-') || ' | ' || coalesce((floor(round(mean, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(lo, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(hi, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' FROM (SELECT corpus, category, count(*) AS n, sum(flagged::INT)::BIGINT AS hits, avg(bpe_score) AS mean, min(bpe_score) AS lo, max(bpe_score) AS hi FROM sf WHERE is_break AND category IS NOT NULL GROUP BY corpus, category)"
    " UNION ALL SELECT 'difficulty', corpus, '| ' || coalesce(difficulty::VARCHAR, '-') || ' | ' || coalesce(n::VARCHAR, '-') || ' | ' || coalesce(hits::VARCHAR, '-') || ' | ' || coalesce((floor(round(mean, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(lo, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(hi, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' FROM (SELECT corpus, difficulty, count(*) AS n, sum(flagged::INT)::BIGINT AS hits, avg(bpe_score) AS mean, min(bpe_score) AS lo, max(bpe_score) AS hi FROM sf WHERE is_break AND difficulty IS NOT NULL GROUP BY corpus, difficulty)"
    " UNION ALL SELECT 'distribution', corpus, '| ' || 'breaks' || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.0), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.25), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.5), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.75), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.95), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 1.0), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' FROM sf WHERE is_break GROUP BY corpus"
    " UNION ALL SELECT 'distribution', corpus, '| ' || 'controls' || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.0), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.25), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.5), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.75), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 0.95), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' | ' || coalesce((floor(round(quantile_cont(bpe_score, 1.0), 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' FROM sf WHERE NOT is_break GROUP BY corpus"
    " UNION ALL SELECT 'stages', corpus, '| ' || coalesce(reason::VARCHAR, '-') || ' | ' || coalesce(b::VARCHAR, '-') || ' | ' || coalesce(c::VARCHAR, '-') || ' |' FROM (SELECT corpus, coalesce(scorer_reason, 'none') AS reason, count(*) FILTER (is_break) AS b, count(*) FILTER (NOT is_break) AS c FROM sf GROUP BY 1, 2)"
    " UNION ALL SELECT 'missed', corpus, '| ' || coalesce(row_id::VARCHAR, '-') || ' | ' || coalesce(fixture_id::VARCHAR, '-') || ' | ' || coalesce(category::VARCHAR, '-') || ' | ' || coalesce((floor(round(bpe_score, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' FROM sf WHERE is_break AND NOT flagged"
    " UNION ALL SELECT 'top_controls', corpus, '| ' || coalesce(row_id::VARCHAR, '-') || ' | ' || coalesce((floor(round(bpe_score, 9) * 1e3 + 0.5) / 1e3)::DECIMAL(30,3)::VARCHAR, '-') || ' |' FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY bpe_score DESC, row_id) AS r FROM sf WHERE NOT is_break AND bpe_score IS NOT NULL) WHERE r <= 5"
)


@query(_REPORT)
def snk7_report(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the markdown report by section: headline, categories, difficulties, distribution, stages, missed, top controls."""
    return P.report(corpus_report(spark, d), flagged(spark, d))


@query(f"WITH {SCORED_SQL} SELECT DISTINCT corpus FROM scored WHERE corpus IS NOT NULL")
def snk7_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The report written as a text of a part per corpus and read again: the corpora whose headline stands in it."""
    path = shared_path(spark, "markdown")
    P.markdown(P.report(corpus_report(spark, d), flagged(spark, d))).select("line").write.text(path)
    out = cut(spark.read.text(path).where("value like '## %: headline'").select(F.expr("substring(value, 4, length(value) - 13)").alias("corpus")))
    remove(spark, path)
    return out


_FILES = ((1, "c", "python", "import os\nimport json\n\ndef load(path):\n    return json.loads(read(path))\n"), (2, "c", "python", "import os\n\ndef save(path, x):\n    write(path, json.dumps(x))\n"))
_HUNKS = (
    (11, "c", "python", "import evilmod\nimport otherbad\n\ndef load(path):\n    return json.loads(read(path))\n"), (12, "c", "python", "import os\n\ndef load(path):\n    return json.loads(read(path))\n"),
    (13, "c", "python", "[1, 2, 3, 4, 5, 6]\n"), (14, "c", "python", "# auto-generated by a tool\nimport evilmod\n"),
)


@query(by_hand([(True, 11, 2.0, "import", True), (True, 12, 0.0, "none", False), (True, 13, 0.0, "atypical", False), (True, 14, 1.0, "import", True), (False, 11, 2.0, "import", True), (False, 12, 0.0, "none", False), (False, 13, 0.0, "none", False), (False, 14, 0.0, "auto_generated", False)], "typical, entry_id, import_score, reason, flagged"))
def pip1_score_samples(spark: SparkSession, d: str) -> DataFrame:
    """All stages over small texts, with typicality and, without it, the gate of generated files."""
    frame = lambda rows: spark.createDataFrame(rows, "entry_id int, corpus string, lang string, text string")
    m, h = P.fit(frame(_FILES), spark.createDataFrame([("some words of prose",)], "text string"), parsed=True), frame(_HUNKS)
    one = lambda typical: P.verdicts(P.guarded(P.stages(P.blanked(h), m), h, m, typical=typical), F.lit(50.0)).select(F.lit(typical).alias("typical"), "entry_id", "import_score", "reason", "flagged")
    return one(True).unionByName(one(False))


@query()
def pip1_score_hunk_routed(spark: SparkSession, d: str) -> DataFrame:
    """All stages, with clusters of the corpus' files by signature and each fragment sent to the one it is most like."""
    m = P.fit(P.clustered(code(spark, d).where("side = 'train'")), table(spark, d, "documents"), cluster="cluster_id", parsed=True)
    h = _held_in_files(spark, d)
    v = P.verdicts(P.guarded(P.stages(P.blanked(h), m, routing="nearest", tau=2), h, m), F.lit(_T))
    return v.select("entry_id", "import_score", F.round("bpe", 6).alias("bpe"), "contribution", "reason", "flagged", F.round("score", 6).alias("score"))


_TWO_KINDS = tuple((k, "c", "python", "a.x(1)\nb.y(2)\n" if k % 2 else "c.z(1)\nd.w(2)\n") for k in range(8))
_ROUTED = ((21, "c", "python", "a.x(1)\nb.y(2)\nc.z(3)\n"), (22, "c", "python", "a.x(1)\nb.y(2)\n"), (23, "c", "python", "a.x(1)\nb.y(2)\nnone()\n"), (24, "c", "python", "c.z(1)\nd.w(2)\nd.other(3)\n"), (25, "c", "python", "x = 1\n"))


@query(by_hand([(21, 5.0), (22, 0.0), (23, 2.0), (24, 4.0), (25, 0.0)], "entry_id, contribution"))
def pip2_routed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Files of two kinds in clusters by signature: a callee that the nearest cluster lacks weighs five, an unknown one two, or four where
    its root is known."""
    frame = lambda rows: spark.createDataFrame(rows, "entry_id int, corpus string, lang string, text string")
    m = P.fit(P.clustered(frame(_TWO_KINDS), k=2), spark.createDataFrame([("some words",)], "text string"), cluster="cluster_id")
    return P.stages(frame(_ROUTED), m, routing="nearest").select("entry_id", "contribution")
