"""Queries of joins: vocabularies, clusters, languages, parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import model
from ..session import table
from ..sources.tables import CODE_SQL, HUNKS_SQL, SCORED_SQL, code, hunks, scored
from .q_text import CALLS_SQL, specs
from .registry import query

_SPECS = "specs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*'))) AS spec FROM documents), mods AS (SELECT DISTINCT spec FROM specs WHERE doc_id % 2 = 0)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Specifiers of the odd documents, and the modules that the even ones attest."""
    s = specs(spark, d)
    return s.where("doc_id % 2 = 1"), s.where("doc_id % 2 = 0").select("spec").distinct()


@query(f"WITH {_SPECS} SELECT doc_id, spec FROM specs WHERE doc_id % 2 = 1 AND spec NOT IN (SELECT spec FROM mods)")
def jn1_foreign_exact(spark: SparkSession, d: str) -> DataFrame:
    new, mods = _halves(spark, d)
    return new.join(mods, "spec", "left_anti").select("doc_id", "spec")


@query(f"WITH {_SPECS} SELECT doc_id, spec FROM specs WHERE doc_id % 2 = 1 AND spec NOT IN (SELECT spec FROM mods) AND NOT starts_with(spec, 'net.') AND NOT starts_with(spec, 'core.s')")
def jn2_foreign_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Foreign to the exact modules and to a fixed list of prefixes."""
    new, mods = _halves(spark, d)
    prefixes = spark.createDataFrame([("net.",), ("core.s",)], "prefix string")
    return model.foreign(new, mods, prefixes).select("doc_id", "spec")


_MODULES = "specs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*'))) AS spec FROM documents), mods AS (SELECT spec FROM specs GROUP BY spec HAVING count(*) > 1)"


def attested_modules(spark: SparkSession, d: str) -> DataFrame:
    """(spec, n): the modules that two documents or more name, so that another document attests each, and in how many they stand."""
    return specs(spark, d).groupBy("spec").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"WITH {_MODULES} SELECT doc_id, spec FROM specs WHERE spec NOT IN (SELECT spec FROM mods)")
def jn1_foreign_exact_whole(spark: SparkSession, d: str) -> DataFrame:
    """The specifiers of every document that no other document attests."""
    return specs(spark, d).join(attested_modules(spark, d), "spec", "left_anti").select("doc_id", "spec")


@query(f"WITH {_MODULES} SELECT doc_id, spec FROM specs WHERE spec NOT IN (SELECT spec FROM mods) AND NOT starts_with(spec, 'net.') AND NOT starts_with(spec, 'core.s')")
def jn2_foreign_prefix_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same, foreign also to a fixed list of prefixes."""
    prefixes = spark.createDataFrame([("net.",), ("core.s",)], "prefix string")
    return model.foreign(specs(spark, d), attested_modules(spark, d), prefixes).select("doc_id", "spec")


def held_calls(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, corpus, callee) of the fragments under test, each callee once."""
    return code(spark, d).where("side = 'held'").select("entry_id", "corpus", F.explode(F.array_distinct(T.callees(F.col("text")))).alias("callee"))


def train_calls(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, corpus, callee) of the corpus."""
    return code(spark, d).where("side = 'train'").select("entry_id", "corpus", F.explode(F.array_distinct(T.callees(F.col("text")))).alias("callee"))


HELD = f"{CALLS_SQL}, hc AS (SELECT DISTINCT entry_id, corpus, callee, string_split(callee, '.')[1] AS root FROM calls WHERE side = 'held'), tc AS (SELECT DISTINCT entry_id, corpus, callee, string_split(callee, '.')[1] AS root FROM calls WHERE side = 'train'), att AS (SELECT DISTINCT callee, root FROM tc)"


@query(f"WITH {HELD} SELECT entry_id, callee FROM hc WHERE callee NOT IN (SELECT callee FROM att)")
def jn3_unattested(spark: SparkSession, d: str) -> DataFrame:
    return held_calls(spark, d).join(train_calls(spark, d).select("callee").distinct(), "callee", "left_anti").select("entry_id", "callee")


@query(f"WITH {HELD} SELECT entry_id, callee, root IN (SELECT root FROM att) AS root_known FROM hc WHERE callee NOT IN (SELECT callee FROM att)")
def jn4_root_attested(spark: SparkSession, d: str) -> DataFrame:
    r = model.resolve(held_calls(spark, d), "entry_id", model.attested(train_calls(spark, d)))
    return r.where("not known").select("entry_id", "callee", "root_known")


# clusters: the corpus of a file stands for its cluster
CLUSTERED = f"{HELD}, cc AS (SELECT corpus, callee, count(*) AS n_files FROM tc GROUP BY corpus, callee), cs AS (SELECT corpus, count(*) AS size FROM code WHERE side = 'train' GROUP BY corpus)"


def clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(calls under test, attested, callees by cluster, cluster sizes); a corpus is a cluster."""
    t = train_calls(spark, d)
    by = t.groupBy(F.col("corpus").alias("cluster_id"), "callee").agg(F.count(F.lit(1)).alias("n_files"))
    sizes = code(spark, d).where("side = 'train'").groupBy(F.col("corpus").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"))
    return held_calls(spark, d).withColumnRenamed("corpus", "cluster_id"), model.attested(t), by, sizes


@query(f"WITH {CLUSTERED} SELECT h.entry_id, h.callee, coalesce(c.n_files, 0) AS n_files FROM hc h LEFT JOIN cc c ON h.corpus = c.corpus AND h.callee = c.callee")
def jn5_cluster_membership(spark: SparkSession, d: str) -> DataFrame:
    calls, _, by, _ = clustered(spark, d)
    return calls.join(by, ["cluster_id", "callee"], "left").select("entry_id", "callee", F.coalesce("n_files", F.lit(0)).alias("n_files"))


TOK = r"'[\p{L}\p{N}_]+'"
COUNTS = f"{CODE_SQL}, own AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {TOK})) AS token FROM code WHERE side = 'train') GROUP BY token), gen AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {TOK})) AS token FROM documents) GROUP BY token)"


def counts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Token counts of the corpus and of the generic baseline."""
    return model.token_counts(code(spark, d).where("side = 'train'"), T.word_tokens(F.col("text"))), model.token_counts(table(spark, d, "documents"), T.word_tokens(F.col("text")))


@query(f"WITH {COUNTS} SELECT DISTINCT t.token, coalesce(o.n, 0) AS own, coalesce(g.n, 0) AS gen FROM (SELECT unnest(regexp_extract_all(text, {TOK})) AS token FROM code WHERE side = 'held') t LEFT JOIN own o ON t.token = o.token LEFT JOIN gen g ON t.token = g.token")
def jn6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    own, gen = counts(spark, d)
    t = code(spark, d).where("side = 'held'").select(F.explode(T.word_tokens(F.col("text"))).alias("token")).distinct()
    return t.join(own.withColumnRenamed("n", "own"), "token", "left").join(gen.withColumnRenamed("n", "gen"), "token", "left").select("token", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("gen", F.lit(0)).alias("gen"))


# clusters numbered by corpus name
_NUM = f"{HELD}, num AS (SELECT corpus, row_number() OVER (ORDER BY corpus) - 1 AS cluster_id FROM (SELECT DISTINCT corpus FROM tc)), cb AS (SELECT DISTINCT n.cluster_id, t.callee FROM tc t JOIN num n USING (corpus)), hb AS (SELECT entry_id, callee FROM hc), a AS (SELECT entry_id, count(*) AS a FROM hb GROUP BY entry_id), b AS (SELECT cluster_id, count(*) AS b FROM cb GROUP BY cluster_id), i AS (SELECT entry_id, cluster_id, count(*) AS i FROM hb JOIN cb USING (callee) GROUP BY entry_id, cluster_id), j AS (SELECT a.entry_id, b.cluster_id, coalesce(i, 0) / (a + b - coalesce(i, 0)) AS j FROM a CROSS JOIN b LEFT JOIN i ON i.entry_id = a.entry_id AND i.cluster_id = b.cluster_id), best AS (SELECT DISTINCT ON (entry_id) entry_id, cluster_id, j FROM j ORDER BY entry_id, j DESC, cluster_id)"


def numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(bags of the fragments under test, bags of the numbered clusters)"""
    t = train_calls(spark, d)
    names = sorted(r["corpus"] for r in t.select("corpus").distinct().collect())  # a row per corpus
    num = spark.createDataFrame(list(enumerate(names)), "cluster_id long, corpus string")
    return held_calls(spark, d).select("entry_id", "callee"), t.join(F.broadcast(num), "corpus").select("cluster_id", "callee").distinct()


@query(f"WITH {_NUM} SELECT c.entry_id, coalesce(n.cluster_id, best.cluster_id) AS cluster_id FROM (SELECT entry_id, corpus FROM code WHERE side = 'held' AND entry_id IN (SELECT entry_id FROM hb)) c LEFT JOIN (SELECT * FROM num WHERE cluster_id % 2 = 0) n ON c.corpus = n.corpus JOIN best ON best.entry_id = c.entry_id")
def jn7_route(spark: SparkSession, d: str) -> DataFrame:
    """The known cluster of a file (those of even number are known), else the nearest."""
    bags, clusters = numbered(spark, d)
    near = model.nearest_cluster(bags, "entry_id", clusters)
    names = sorted(r["corpus"] for r in train_calls(spark, d).select("corpus").distinct().collect())  # a row per corpus
    known = spark.createDataFrame([(i, x) for i, x in enumerate(names) if i % 2 == 0], "known long, corpus string")
    f = code(spark, d).where("side = 'held'").select("entry_id", "corpus").join(F.broadcast(known), "corpus", "left")
    return f.join(near, "entry_id").select("entry_id", F.coalesce("known", "cluster_id").alias("cluster_id"))


@query(f"WITH {_NUM} SELECT entry_id, cluster_id, round(j, 6) AS j FROM best")
def jn8_nearest_cluster(spark: SparkSession, d: str) -> DataFrame:
    return model.nearest_cluster(*_swap(numbered(spark, d))).select("entry_id", "cluster_id", F.round("j", 6).alias("j"))


def _swap(x: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, str, DataFrame]:
    return x[0], "entry_id", x[1]


@query("SELECT f.corpus, f.fixture_id, h.n_hosts FROM fixtures f JOIN (SELECT corpus, host_file, count(*) AS n_hosts FROM fixtures WHERE host_file IS NOT NULL GROUP BY corpus, host_file) h ON f.corpus = h.corpus AND f.host_file = h.host_file")
def jn9_host_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fixtures")
    h = f.where("host_file is not null").groupBy("corpus", "host_file").agg(F.count(F.lit(1)).alias("n_hosts"))
    return f.join(h, ["corpus", "host_file"]).select("corpus", "fixture_id", "n_hosts")


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs, m.scorer FROM hunks1 h JOIN (VALUES ('python', 'py'), ('typescript', 'ts')) m(lang, scorer) ON h.language = m.lang")
def jn10_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Fragments to the scorer of their language; those of others are skipped."""
    m = spark.createDataFrame([("python", "py"), ("typescript", "ts")], "language string, scorer string")
    return hunks(spark, d).join(F.broadcast(m), "language").select("commit_sha", "file_path", "hs", "scorer")  # a row per language


@query(f"WITH {COUNTS} SELECT DISTINCT x.name, coalesce(o.n, 0) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM code WHERE side = 'held') x LEFT JOIN own o ON x.name = o.token")
def jn11_evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    own, _ = counts(spark, d)
    names = code(spark, d).where("side = 'held'").select(F.explode(T.identifiers(F.col("text"))).alias("name")).distinct()
    return names.join(own, names["name"] == own["token"], "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"WITH {SCORED_SQL}, a AS (SELECT row_id, coalesce(stage1_flagged, false) AS f, scorer_reason AS r, bpe_score AS b FROM scored WHERE row_id % 3 <> 0), b AS (SELECT row_id, coalesce(stage2_flagged, false) AS f, scorer_reason AS r FROM scored WHERE row_id % 3 <> 1)"
    " SELECT CASE WHEN a.row_id IS NULL THEN 'added' WHEN b.row_id IS NULL THEN 'removed' WHEN a.f = b.f THEN 'match' WHEN abs(a.b - 3.0) < 0.45 OR a.r = 'call_receiver' AND a.b < 3.0 THEN 'threshold' WHEN a.r = 'import' THEN 'config' ELSE 'mismatch' END AS verdict, count(*) AS n FROM a FULL JOIN b ON a.row_id = b.row_id GROUP BY 1"
)
def jn12_parity(spark: SparkSession, d: str) -> DataFrame:
    """Two runs compared by a full join: matches, threshold noise within 15 %, changes and one-sided rows."""
    s = scored(spark, d)
    a = s.where("row_id % 3 <> 0").select(F.col("row_id").alias("ra"), F.coalesce("stage1_flagged", F.lit(False)).alias("fa"), F.col("scorer_reason").alias("r"), F.col("bpe_score").alias("b"))
    b = s.where("row_id % 3 <> 1").select(F.col("row_id").alias("rb"), F.coalesce("stage2_flagged", F.lit(False)).alias("fb"))
    verdict = F.when(F.col("ra").isNull(), "added").when(F.col("rb").isNull(), "removed").when(F.col("fa") == F.col("fb"), "match")
    verdict = verdict.when((F.abs(F.col("b") - 3.0) < 0.45) | ((F.col("r") == "call_receiver") & (F.col("b") < 3.0)), "threshold").when(F.col("r") == "import", "config").otherwise("mismatch")
    return a.join(b, F.col("ra") == F.col("rb"), "full").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


CENTROIDS = "long AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), cen AS (SELECT label, dim, avg(x::DOUBLE) AS m FROM long GROUP BY label, dim)"


def centroids(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, centroid): the mean vector of each group, by dimension."""
    long = df.select(by, F.posexplode(vec).alias("dim", "x"))
    m = long.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


@query(f"WITH {CENTROIDS}, s AS (SELECT l.vec_id, sum(l.x::DOUBLE * c.m) AS ab, sum(l.x::DOUBLE * l.x::DOUBLE) AS aa, sum(c.m * c.m) AS bb FROM long l JOIN cen c ON l.label = c.label AND l.dim = c.dim GROUP BY l.vec_id) SELECT vec_id, round(1 - ab / (sqrt(aa) * sqrt(bb)), 6) AS distance FROM s")
def jn13_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of each vector to its group's centroid."""
    e = table(spark, d, "embeddings")
    c = centroids(e, "label", "embedding")
    return e.join(F.broadcast(c), "label").select("vec_id", F.round(1 - V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("distance"))  # a row per label


@query("WITH q AS (SELECT vec_id, label, embedding::FLOAT[64] AS v FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id, label, embedding::FLOAT[64] AS v FROM embeddings) SELECT q.vec_id, round(max(array_cosine_similarity(q.v, r.v)), 4) AS best FROM q JOIN r ON q.label = r.label AND q.vec_id <> r.vec_id GROUP BY q.vec_id")
def jn14_nearest_in_group(spark: SparkSession, d: str) -> DataFrame:
    """For the stated queries, ids divisible by 20, the most similar vector of their group."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("v"))
    return q.join(e, "label").where("q <> vec_id").groupBy(F.col("q").alias("vec_id")).agg(F.round(F.max(V.cosine(F.col("v"), F.col("embedding"))), 4).alias("best"))
