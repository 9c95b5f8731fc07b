"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluate, learn, model, ranks, sampling
from ..operators.verdict import eligible, thresholds
from ..session import table
from ..sources.tables import CODE_SQL, HUNKS_SQL, SCORED_SQL, code, hunks, scored
from .q_joins import CENTROIDS, CLUSTERED, COUNTS, HELD, TOK, centroids, clustered, counts, held_calls, train_calls
from .q_text import CALLS_SQL
from .registry import query

QUANTS = {"q_min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q_max": 1.0}
QUANTS_SQL = ", ".join(f"round(quantile_cont(bpe_score, {p}), 6) AS {k}" for k, p in QUANTS.items())
INEL = "('atypical', 'atypical_file', 'excluded_path', 'auto_generated')"


@query(f"WITH {COUNTS} SELECT token, n, greatest((SELECT sum(n) FROM own), 1)::BIGINT AS total FROM own")
def agg1_token_frequency(spark: SparkSession, d: str) -> DataFrame:
    own, _ = counts(spark, d)
    return own.crossJoin(F.broadcast(model.total(own)))  # one row


@query(f"WITH {HELD} SELECT count(DISTINCT callee) AS n_callees, count(DISTINCT root) AS n_roots FROM att")
def agg2_distinct_callees(spark: SparkSession, d: str) -> DataFrame:
    return model.attested(train_calls(spark, d)).agg(F.countDistinct("callee").alias("n_callees"), F.countDistinct("root").alias("n_roots"))


@query(f"WITH {CLUSTERED} SELECT corpus AS cluster_id, callee, n_files FROM cc")
def agg3_cluster_callees(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d).where("side = 'train'")
    return model.cluster_callees(train_calls(spark, d).select("entry_id", "callee"), c.select("entry_id", F.col("corpus").alias("cluster_id")), "entry_id")


@query("SELECT k.k AS cluster_id, count(f.row_id) AS size FROM range(0, (SELECT coalesce(max(features.cluster_id), -1) + 1 FROM feature_rows)) k(k) LEFT JOIN (SELECT DISTINCT row_id, features.cluster_id AS c FROM feature_rows) f ON f.c = k.k GROUP BY k.k")
def agg4_cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clusters from 0 to the greatest, the empty ones too."""
    f = table(spark, d, "feature_rows").select("row_id", F.col("features.cluster_id").cast("long").alias("cluster_id")).distinct()
    n = f.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    most = n.agg(F.max("cluster_id").alias("m")).first()["m"]
    return spark.range(0 if most is None else most + 1).select(F.col("id").alias("cluster_id")).join(n, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).alias("size"))


@query("SELECT spec, count(DISTINCT doc_id) AS n_files FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*')) AS spec FROM documents) GROUP BY spec")
def agg5_import_counts(spark: SparkSession, d: str) -> DataFrame:
    from .q_text import specs

    return specs(spark, d).groupBy("spec").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {CODE_SQL} SELECT corpus, name, count(*) AS n FROM (SELECT corpus, unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM code) GROUP BY corpus, name")
def agg6_identifier_counts(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).select("corpus", F.explode(T.identifiers(F.col("text"))).alias("name")).groupBy("corpus", "name").agg(F.count(F.lit(1)).alias("n"))


BPE = (
    f"{COUNTS}, tot AS (SELECT greatest((SELECT sum(n) FROM own), 1) AS ot, greatest((SELECT sum(n) FROM gen), 1) AS gt),"
    f" ht AS (SELECT entry_id, lang, list_distinct(regexp_extract_all(text, {TOK})) AS ts FROM code WHERE side = 'held'),"
    r" hm AS (SELECT entry_id, CASE WHEN len(list_filter(ts, lambda x: length(x) >= 3 AND regexp_matches(x, '[\p{L}\p{N}]'))) > 0 THEN list_filter(ts, lambda x: length(x) >= 3 AND regexp_matches(x, '[\p{L}\p{N}]')) ELSE ts END AS ts FROM ht),"
    " hx AS (SELECT entry_id, unnest(ts) AS token FROM hm),"
    " hs AS (SELECT x.entry_id, x.token, ln(coalesce(g.n, 0) / gt + 1e-7) - ln(coalesce(o.n, 0) / ot + 1e-7) AS s FROM hx x LEFT JOIN own o ON x.token = o.token LEFT JOIN gen g ON x.token = g.token CROSS JOIN tot),"
    " bpe AS (SELECT c.entry_id, coalesce(max(s), 0.0) AS bpe FROM (SELECT entry_id FROM code WHERE side = 'held') c LEFT JOIN hs USING (entry_id) GROUP BY c.entry_id)"
)


def bpe(spark: SparkSession, d: str) -> DataFrame:
    own, gen = counts(spark, d)
    return model.bpe_scores(code(spark, d).where("side = 'held'"), "entry_id", T.word_tokens(F.col("text")), own, gen)


@query(f"WITH {BPE} SELECT entry_id, round(bpe, 6) AS bpe FROM bpe")
def agg7_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe(spark, d).select("entry_id", F.round("bpe", 6).alias("bpe"))


@query(f"WITH {HELD} SELECT entry_id, least(sum(CASE WHEN callee IN (SELECT callee FROM att) THEN 0.0 WHEN root IN (SELECT root FROM att) THEN 4.0 ELSE 2.0 END), 5.0)::DOUBLE AS contribution FROM hc GROUP BY entry_id")
def agg8_capped_weights(spark: SparkSession, d: str) -> DataFrame:
    return model.contributions(model.resolve(held_calls(spark, d), "entry_id", model.attested(train_calls(spark, d))), "entry_id")


@query(f"WITH {HELD} SELECT entry_id, count(DISTINCT callee) AS n FROM hc WHERE callee NOT IN (SELECT callee FROM att) GROUP BY entry_id")
def agg9_distinct_foreign(spark: SparkSession, d: str) -> DataFrame:
    return held_calls(spark, d).join(train_calls(spark, d).select("callee").distinct(), "callee", "left_anti").groupBy("entry_id").agg(F.countDistinct("callee").alias("n"))


@query(f"WITH {SCORED_SQL} SELECT corpus, round(coalesce(max(bpe_score), 0), 6) AS t_max, round(coalesce(quantile_cont(bpe_score, 0.95), 0), 6) AS t_p95, round(coalesce(quantile_cont(bpe_score, 0.75) + 1.5 * (quantile_cont(bpe_score, 0.75) - quantile_cont(bpe_score, 0.25)), 0), 6) AS t_iqr FROM scored WHERE is_break = false GROUP BY corpus")
def agg10_thresholds(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("is_break = false").select("corpus", "bpe_score")
    out = None
    for name, mode in (("t_max", "max"), ("t_p95", "percentile"), ("t_iqr", "iqr")):
        t = thresholds(s, ["corpus"], "bpe_score", mode).select("corpus", F.round(F.coalesce("t", F.lit(0.0)), 6).alias(name))
        out = t if out is None else out.join(t, "corpus", "left")
    return out


_SEEDS = "seeds AS (SELECT seed, corpus, bpe_score, row_id, row_number() OVER (PARTITION BY seed, corpus ORDER BY md5(seed || ':' || row_id), row_id) AS r FROM scored CROSS JOIN range(0, 7) s(seed) WHERE is_break = false AND bpe_score IS NOT NULL), per AS (SELECT seed, corpus, max(bpe_score) AS t FROM seeds WHERE r <= 50 GROUP BY seed, corpus)"


def seed_samples(spark: SparkSession, d: str, n: int = 50, seeds: int = 7) -> DataFrame:
    """(seed, corpus, row_id, bpe_score): n controls of each corpus for each seed, in one job without a loop."""
    s = scored(spark, d).where("is_break = false and bpe_score is not null").select("corpus", "row_id", "bpe_score")
    s = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    h = F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("row_id").cast("string")))
    return sampling.top(s, ["seed", "corpus"], n, h, F.col("row_id")).drop("place")


@query(f"WITH {SCORED_SQL}, {_SEEDS} SELECT corpus, round(median(t), 6) AS t FROM per GROUP BY corpus")
def agg11_seed_median(spark: SparkSession, d: str) -> DataFrame:
    """The median over seeds of the greatest score of each seed's sample."""
    per = seed_samples(spark, d).groupBy("seed", "corpus").agg(F.max("bpe_score").alias("t"))
    return per.groupBy("corpus").agg(F.round(F.median("t"), 6).alias("t"))


@query(f"WITH {SCORED_SQL} SELECT corpus, {QUANTS_SQL} FROM scored GROUP BY corpus")
def agg12_percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = ranks.quantiles(scored(spark, d).select("corpus", "bpe_score"), ["corpus"], "bpe_score", QUANTS)
    return q.select("corpus", *[F.round(c, 6).alias(c) for c in QUANTS])


@query(f"WITH {SCORED_SQL} SELECT is_break, round(quantile_cont(bpe_score, 0.9), 6) AS q90, {QUANTS_SQL} FROM scored WHERE is_break IS NOT NULL GROUP BY is_break")
def agg13_distribution(spark: SparkSession, d: str) -> DataFrame:
    q = ranks.quantiles(scored(spark, d).where("is_break is not null").select("is_break", "bpe_score"), ["is_break"], "bpe_score", {"q90": 0.9, **QUANTS})
    return q.select("is_break", *[F.round(c, 6).alias(c) for c in ("q90", *QUANTS)])


AUC = "p AS (SELECT corpus, bpe_score AS s, sum(is_break::INT) AS p, count(*) AS c FROM scored WHERE is_break IS NOT NULL AND bpe_score IS NOT NULL GROUP BY corpus, bpe_score), r AS (SELECT *, sum(c) OVER (PARTITION BY corpus ORDER BY s) - (c - 1) / 2 AS r FROM p), a AS (SELECT corpus, CASE WHEN sum(p) * (sum(c) - sum(p)) > 0 THEN (sum(r * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(c) - sum(p))) ELSE 0.0 END AS auc FROM r GROUP BY corpus)"


@query(f"WITH {SCORED_SQL}, {AUC} SELECT corpus, round(auc, 6) AS auc FROM a")
def agg14_auc(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("is_break is not null")
    return evaluate.auc(s, "bpe_score", F.col("is_break"), ("corpus",)).select("corpus", F.round("auc", 6).alias("auc"))


FLAG = "(coalesce(stage1_flagged, false) OR coalesce(stage2_flagged, false))"


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("flagged", F.coalesce("stage1_flagged", F.lit(False)) | F.coalesce("stage2_flagged", F.lit(False)))


@query(f"WITH {SCORED_SQL} SELECT 'difficulty' AS kind, difficulty AS grp, count(*) AS n, sum({FLAG}::INT)::BIGINT AS hits, round(avg({FLAG}::INT), 6) AS recall FROM scored WHERE is_break AND difficulty IS NOT NULL GROUP BY difficulty UNION ALL SELECT 'category', category, count(*), sum({FLAG}::INT)::BIGINT, round(avg({FLAG}::INT), 6) FROM scored WHERE is_break AND category IS NOT NULL GROUP BY category")
def agg15_recall(spark: SparkSession, d: str) -> DataFrame:
    b = flagged(spark, d).where("is_break")
    one = lambda k: evaluate.recall(b, "flagged", k).select(F.lit(k).alias("kind"), F.col(k).alias("grp"), "n", "hits", "recall")
    return one("difficulty").unionByName(one("category"))


@query(f"WITH {SCORED_SQL} SELECT corpus, round(coalesce(avg({FLAG}::INT), 0), 6) AS fp FROM scored WHERE is_break = false AND coalesce(scorer_reason, 'none') NOT IN {INEL} GROUP BY corpus")
def agg16_false_positives(spark: SparkSession, d: str) -> DataFrame:
    s = flagged(spark, d).where((F.col("is_break") == False) & eligible(F.col("scorer_reason")))  # noqa: E712
    return s.groupBy("corpus").agg(F.round(F.coalesce(F.avg(F.col("flagged").cast("int")), F.lit(0.0)), 6).alias("fp"))


@query(f"WITH {SCORED_SQL} SELECT scorer_reason AS reason, count(*) AS n FROM scored WHERE is_break GROUP BY scorer_reason")
def agg17_stages(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where("is_break").groupBy(F.col("scorer_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED_SQL}, {_SEEDS} SELECT corpus, round(coalesce(stddev_pop(t) / nullif(avg(t), 0), 0), 6) AS cv FROM per GROUP BY corpus")
def agg18_threshold_cv(spark: SparkSession, d: str) -> DataFrame:
    per = seed_samples(spark, d).groupBy("seed", "corpus").agg(F.max("bpe_score").alias("t"))
    return per.groupBy("corpus").agg(F.round(F.coalesce(F.try_divide(F.stddev_pop("t"), F.avg("t")), F.lit(0.0)), 6).alias("cv"))


@query(
    f"WITH {SCORED_SQL}, {_SEEDS}, st AS (SELECT seed, row_id FROM seeds WHERE r <= 50), n AS (SELECT seed, count(*) AS n FROM st GROUP BY seed), b AS (SELECT x.seed AS a, y.seed AS b, count(*) AS shared FROM st x JOIN st y ON x.row_id = y.row_id AND x.seed < y.seed GROUP BY 1, 2)"
    " SELECT (SELECT count(*) FROM n) AS n_sets, round(avg(coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0))), 6) AS jaccard FROM n p JOIN n q ON p.seed < q.seed LEFT JOIN b ON b.a = p.seed AND b.b = q.seed"
)
def agg19_stability(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.stability(seed_samples(spark, d), "seed", "row_id")


@query(f"WITH {SCORED_SQL} SELECT corpus, round(min(bpe_score) FILTER (is_break) - max(bpe_score) FILTER (NOT is_break), 6) AS gap FROM scored GROUP BY corpus")
def agg20_separation(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bpe_score")
    return scored(spark, d).groupBy("corpus").agg(F.round(F.min(F.when(F.col("is_break"), b)) - F.max(F.when(~F.col("is_break"), b)), 6).alias("gap"))


@query("SELECT category, count(*) AS n, round(avg(hunk_end_line - hunk_start_line + 1), 6) AS mean_lines, min(hunk_start_line) AS first, max(hunk_end_line) AS last, string_agg(corpus || '/' || fixture_id, ',' ORDER BY corpus || '/' || fixture_id) AS ids FROM fixtures GROUP BY category")
def agg21_category_table(spark: SparkSession, d: str) -> DataFrame:
    ident = F.concat("corpus", F.lit("/"), "fixture_id")
    return table(spark, d, "fixtures").groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hunk_end_line") - F.col("hunk_start_line") + 1), 6).alias("mean_lines"), F.min("hunk_start_line").alias("first"), F.max("hunk_end_line").alias("last"),
        F.array_join(F.sort_array(F.collect_list(ident)), ",").alias("ids"),
    )


@query(f"WITH {SCORED_SQL} SELECT corpus, file_path, round(max(bpe_score), 6) AS best, count(*) FILTER (bpe_score >= 4.5) AS n_foreign, count(*) FILTER (bpe_score >= 3.5 AND bpe_score < 4.5) AS n_suspicious FROM scored GROUP BY corpus, file_path")
def agg22_tiers(spark: SparkSession, d: str) -> DataFrame:
    sev = T.severity(F.col("bpe_score"), F.lit(3.0))
    return scored(spark, d).groupBy("corpus", "file_path").agg(F.round(F.max("bpe_score"), 6).alias("best"), F.count_if(sev == "foreign").alias("n_foreign"), F.count_if(sev == "suspicious").alias("n_suspicious"))


@query(f"WITH {CLUSTERED}, f AS (SELECT h.entry_id, bool_or(c.n_files <= 2 AND s.size >= 10 AND h.callee IN (SELECT callee FROM att)) AS fired FROM hc h LEFT JOIN cc c ON h.corpus = c.corpus AND h.callee = c.callee LEFT JOIN cs s ON h.corpus = s.corpus GROUP BY h.entry_id) SELECT count(*) AS n_hunks, sum(coalesce(fired, false)::INT)::BIGINT AS n_fired, round(sum(coalesce(fired, false)::INT) / greatest(count(*), 1), 6) AS rate, sum(coalesce(fired, false)::INT) / greatest(count(*), 1) < 0.05 AS keep FROM f")
def agg23_rare_rule(spark: SparkSession, d: str) -> DataFrame:
    """How often the rarity rule fires; it is kept below 5 %."""
    calls, known, by, sizes = clustered(spark, d)
    c = calls.join(by, ["cluster_id", "callee"], "left").join(sizes, "cluster_id", "left").join(known.select("callee", F.lit(True).alias("known")), "callee", "left")
    fired = c.groupBy("entry_id").agg(F.coalesce(F.bool_or((F.col("n_files") <= 2) & (F.col("size") >= 10) & F.col("known")), F.lit(False)).cast("int").alias("fired"))
    rate = F.sum("fired") / F.greatest(F.count(F.lit(1)), F.lit(1))
    return fired.agg(F.count(F.lit(1)).alias("n_hunks"), F.sum("fired").alias("n_fired"), F.round(rate, 6).alias("rate"), (rate < 0.05).alias("keep"))


@query(f"WITH {HUNKS_SQL}, t AS (SELECT corpus, t.text AS x, count(*) AS c FROM (SELECT corpus, unnest(tokens) AS t FROM hunks1) GROUP BY 1, 2) SELECT corpus, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy FROM t GROUP BY corpus")
def agg24_entropy(spark: SparkSession, d: str) -> DataFrame:
    c = hunks(spark, d).select("corpus", F.explode("tokens").alias("t")).groupBy("corpus", F.col("t.text").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").cast("double")
    return c.groupBy("corpus").agg(F.round(F.log2(n) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n, 6).alias("entropy"))


@query(f"WITH {CALLS_SQL}, b AS (SELECT entry_id, corpus, list_distinct(list(callee)) AS bag FROM calls GROUP BY entry_id, corpus), f AS (SELECT corpus, arg_min(bag, entry_id) AS first FROM b GROUP BY corpus) SELECT entry_id, round(len(list_intersect(bag, first)) / (len(bag) + len(first) - len(list_intersect(bag, first))), 6) AS jaccard, round(len(list_intersect(bag, first)) / len(bag), 6) AS inside FROM b JOIN f USING (corpus)")
def agg25_bags(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each file's callees with those of its corpus' first file."""
    c = code(spark, d).select("entry_id", "corpus", F.array_distinct(T.callees(F.col("text"))).alias("bag")).where(F.size("bag") > 0)
    first = c.groupBy("corpus").agg(F.min_by("bag", "entry_id").alias("first"))
    inside = F.size(F.array_intersect("bag", "first")) / F.size("bag")
    return c.join(F.broadcast(first), "corpus").select("entry_id", F.round(V.jaccard(F.col("bag"), F.col("first")), 6).alias("jaccard"), F.round(inside, 6).alias("inside"))  # a row per corpus


@query(f"WITH {CLUSTERED} SELECT h.entry_id, count(*) AS n_distinct, count(*) FILTER (a.callee IS NULL) AS n_unattested, count(*) FILTER (a.callee IS NULL AND h.root IN (SELECT root FROM att)) AS n_root_only, count(*) FILTER (a.callee IS NOT NULL AND c.n_files IS NULL) AS n_cluster_absent FROM hc h LEFT JOIN (SELECT DISTINCT callee FROM att) a ON h.callee = a.callee LEFT JOIN cc c ON h.corpus = c.corpus AND h.callee = c.callee GROUP BY h.entry_id")
def agg26_callee_features(spark: SparkSession, d: str) -> DataFrame:
    calls, known, by, _ = clustered(spark, d)
    r = model.resolve(calls, "entry_id", known).join(calls.select("entry_id", "cluster_id").distinct(), "entry_id").join(by, ["cluster_id", "callee"], "left")
    n = lambda c: F.count_if(F.expr(c))
    return r.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_distinct"), n("not known").alias("n_unattested"), n("not known and root_known").alias("n_root_only"), n("known and n_files is null").alias("n_cluster_absent"))


@query(f"WITH {SCORED_SQL} SELECT corpus, cluster_id, round(avg(n_distinct_identifiers), 6) AS mean, round(stddev_pop(n_distinct_identifiers), 6) AS std FROM scored WHERE cluster_id IS NOT NULL GROUP BY corpus, cluster_id HAVING count(n_distinct_identifiers) >= 3")
def agg27_cluster_baselines(spark: SparkSession, d: str) -> DataFrame:
    x = "n_distinct_identifiers"
    g = scored(spark, d).where("cluster_id is not null").groupBy("corpus", "cluster_id").agg(F.count(x).alias("c"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))
    return g.where("c >= 3").drop("c")


@query(f"WITH {CENTROIDS}, nn AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS nn FROM long GROUP BY vec_id), m AS (SELECT label, dim, avg(x::DOUBLE / nn) AS m, count(*) AS c FROM long JOIN nn USING (vec_id) GROUP BY label, dim), s AS (SELECT label, sqrt(sum(m * m)) AS s FROM m GROUP BY label) SELECT label, dim, round(m / s, 6) AS v FROM m JOIN s USING (label) WHERE c >= 5")
def agg28_unit_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Normalised means of normalised vectors, of groups of at least five."""
    e = table(spark, d, "embeddings").withColumn("u", F.transform("embedding", lambda x: x.cast("double") / V.norm(F.col("embedding"))))
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("c")).where("c >= 5").select("label")
    c = centroids(e, "label", "u").join(n, "label")
    return c.select("label", F.posexplode("centroid").alias("p", "x"), V.norm(F.col("centroid")).alias("len")).select("label", (F.col("p") + 1).cast("long").alias("dim"), F.round(F.col("x") / F.col("len"), 6).alias("v"))


@query("WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) SELECT a.label, a.dim AS i, b.dim AS j, round(avg(a.x * b.x) - avg(a.x) * avg(b.x) + CASE WHEN a.dim = b.dim THEN 0.001 ELSE 0 END, 6) AS cov FROM l a JOIN l b ON a.vec_id = b.vec_id WHERE a.dim <= b.dim AND b.dim <= 8 GROUP BY a.label, a.dim, b.dim")
def agg29_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Regularised covariance of the first eight dimensions of each group, as sums over all rows."""
    e = table(spark, d, "embeddings").select("label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v"))
    i, j = F.explode(F.sequence(F.lit(1), F.lit(8))), F.explode(F.sequence(F.col("i"), F.lit(8)))
    p = e.select("label", "v", i.alias("i")).select("label", "v", "i", j.alias("j")).select("label", "i", "j", F.element_at("v", F.col("i")).alias("a"), F.element_at("v", F.col("j")).alias("b"))
    cov = F.avg(F.col("a") * F.col("b")) - F.avg("a") * F.avg("b") + F.when(F.col("i") == F.col("j"), 0.001).otherwise(0.0)
    return p.groupBy("label", "i", "j").agg(F.round(cov, 6).alias("cov")).select("label", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "cov")


@query()
def agg29_covariance_whole(spark: SparkSession, d: str) -> DataFrame:
    """Regularised covariance of each group over all dimensions, and its inverse."""
    c = learn.covariances(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "i", "j", F.round("cov", 6).alias("cov"), F.round("inverse", 6).alias("inverse"))


@query(f"WITH {BPE}, r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY s DESC, token) AS r FROM hs) SELECT entry_id, round(avg(s), 6) AS mean, round(max(s), 6) AS best, round(avg(s) FILTER (r <= 3), 6) AS top3, round(quantile_cont(s, 0.95), 6) AS p95 FROM r GROUP BY entry_id")
def agg30_token_level(spark: SparkSession, d: str) -> DataFrame:
    """Mean, greatest, mean of the three greatest and 95th percentile of the surprises of a fragment."""
    own, gen = counts(spark, d)
    s = token_surprises(spark, d, own, gen)
    top3 = F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 3)
    mean3 = F.aggregate(top3, F.lit(0.0), lambda a, x: a + x) / F.size(top3)
    return s.groupBy("entry_id").agg(F.round(F.avg("s"), 6).alias("mean"), F.round(F.max("s"), 6).alias("best"), F.round(mean3, 6).alias("top3"), F.round(F.percentile("s", 0.95), 6).alias("p95"))


def token_surprises(spark: SparkSession, d: str, own: DataFrame, gen: DataFrame) -> DataFrame:
    """(entry_id, token, s): the meaningful tokens of each fragment under test with their surprise, each once."""
    toks = F.array_distinct(T.word_tokens(F.col("text")))
    good = F.filter(toks, T.meaningful)
    t = code(spark, d).where("side = 'held'").select("entry_id", F.explode(F.when(F.size(good) > 0, good).otherwise(toks)).alias("token"))
    return model.with_surprise(t, own, gen).select("entry_id", "token", "s")


@query("WITH l AS (SELECT label = 0 AS y, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), p AS (SELECT dim, x, sum(y::INT) AS p, count(*) AS c FROM l GROUP BY dim, x), r AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY x) - (c - 1) / 2 AS r FROM p), a AS (SELECT dim, (sum(r * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(c) - sum(p))) AS a FROM r GROUP BY dim) SELECT dim, round(greatest(a, 1 - a), 6) AS auc FROM a")
def agg31_auc_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Per dimension the area under the curve for group 0, turned to at least one half."""
    x = table(spark, d, "embeddings").select((F.col("label") == 0).alias("y"), F.posexplode("embedding").alias("p", "x")).select("y", (F.col("p") + 1).cast("long").alias("dim"), F.col("x").cast("double").alias("x"))
    return evaluate.auc(x, "x", F.col("y"), ("dim",)).select("dim", F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("auc"))


@query(f"WITH {SCORED_SQL} SELECT category, count(*) AS n, sum({FLAG}::INT)::BIGINT AS hits, round(avg(bpe_score), 6) AS mean, round(min(bpe_score), 6) AS lo, round(max(bpe_score), 6) AS hi, string_agg(DISTINCT fixture_id, ',' ORDER BY fixture_id) AS ids FROM scored WHERE is_break AND category IS NOT NULL GROUP BY category")
def agg21_category_scores(spark: SparkSession, d: str) -> DataFrame:
    """Hits and scores of each category's breaks, with the fixtures they come from."""
    b = flagged(spark, d).where("is_break and category is not null")
    return b.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("int")).alias("hits"), F.round(F.avg("bpe_score"), 6).alias("mean"), F.round(F.min("bpe_score"), 6).alias("lo"), F.round(F.max("bpe_score"), 6).alias("hi"),
        F.nullif(F.array_join(F.sort_array(F.collect_set("fixture_id")), ","), F.lit("")).alias("ids"),
    )


@query(f"WITH {SCORED_SQL}, e AS (SELECT min(bpe_score) AS lo, max(bpe_score) AS hi FROM scored) SELECT is_break, least(floor((bpe_score - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM scored CROSS JOIN e WHERE bpe_score IS NOT NULL AND is_break IS NOT NULL AND hi > lo GROUP BY 1, 2")
def agg31_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Scores of breaks and controls in twenty bins of equal width."""
    s = scored(spark, d).where("bpe_score is not null")
    e = s.agg(F.min("bpe_score").alias("lo"), F.max("bpe_score").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 20
    j = s.where("is_break is not null").crossJoin(F.broadcast(e)).where("hi > lo")  # one row
    return j.groupBy("is_break", F.least(F.floor((F.col("bpe_score") - F.col("lo")) / width), F.lit(19)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
