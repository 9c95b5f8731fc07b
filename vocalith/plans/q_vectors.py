"""Queries of hashing, clustering and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import hashing, learn, ranks
from ..session import table
from ..sources.tables import SCORED_SQL, code, scored
from .q_joins import CENTROIDS, CLUSTERED, centroids, clustered
from .q_text import CALLS_SQL
from . import samples
from .registry import query

N_PERM = 128
A, B = hashing.parameters(N_PERM, 0)
_PARAMS = "(VALUES " + ", ".join(f"({i}, {a}::HUGEINT, {b}::HUGEINT)" for i, (a, b) in enumerate(zip(A, B))) + ") pr(i, a, b)"
_BASE = "(('0x' || substr(m, 15, 2) || substr(m, 13, 2) || substr(m, 11, 2) || substr(m, 9, 2) || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::UBIGINT % 2147483647)"


@query(f"SELECT i, a::BIGINT AS a, b::BIGINT AS b FROM {_PARAMS}")
def ml1_minhash_parameters(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(A, B))], "i int, a long, b long")


@query(f"WITH {CALLS_SQL}, bag AS (SELECT DISTINCT entry_id, md5(callee) AS m FROM calls), s AS (SELECT entry_id, i, min((a * {_BASE}::HUGEINT + b) % 2147483647)::BIGINT AS v FROM bag CROSS JOIN {_PARAMS} GROUP BY entry_id, i) SELECT c.entry_id, p.i, coalesce(s.v, 0)::BIGINT AS v FROM code c CROSS JOIN (SELECT i FROM {_PARAMS}) p LEFT JOIN s ON s.entry_id = c.entry_id AND s.i = p.i")
def ml2_minhash(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of each file's callees; zeros for a file without."""
    sig = hashing.signature(F.array_distinct(T.callees(F.col("text"))), N_PERM)
    return code(spark, d).select("entry_id", F.posexplode(sig).alias("i", "v"))


@query()
def ml3_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Files clustered by their scaled signatures; at most eight clusters."""
    s = code(spark, d).where("side = 'train'").select("entry_id", F.transform(hashing.signature(F.array_distinct(T.callees(F.col("text"))), N_PERM), lambda x: x / F.lit(float(hashing.PRIME))).alias("sig"))
    return learn.kmeans(s, "sig", 8).select("entry_id", "cluster_id")


def _vecs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feature_rows").where("row_id is not null and size(hunk_embedding) = 64 and size(context_embedding) = 64").select("row_id", F.regexp_replace(F.lower(F.trim("corpus")), "_", "-").alias("corpus"), "is_break", F.col("hunk_embedding").alias("h"), F.col("context_embedding").alias("c")).dropDuplicates(["row_id"])
    bad = lambda c: F.exists(c, lambda x: F.isnan(x))
    return f.where(~bad("h") & ~bad("c"))


VECS = "v AS (SELECT DISTINCT ON (row_id) row_id, replace(lower(trim(corpus)), '_', '-') AS corpus, is_break, hunk_embedding AS h, context_embedding AS c FROM feature_rows WHERE row_id IS NOT NULL AND len(hunk_embedding) = 64 AND len(context_embedding) = 64 AND len(list_filter(hunk_embedding, lambda x: isnan(x))) = 0 AND len(list_filter(context_embedding, lambda x: isnan(x))) = 0), hl AS (SELECT row_id, corpus, is_break, unnest(h)::DOUBLE AS x, unnest(c)::DOUBLE AS y, generate_subscripts(h, 1) AS dim FROM v)"


@query()
def ml4_pca(spark: SparkSession, d: str) -> DataFrame:
    """Whitened principal components of the vectors, fitted on the normal ones."""
    return learn.reduce(_vecs(spark, d), "h", 8, F.col("is_break") == False, whiten=True).select("row_id", F.transform("z", lambda x: F.round(x, 4)).alias("z"))  # noqa: E712


@query(f"WITH {VECS}, k AS (SELECT corpus, dim, avg(x) AS m FROM hl WHERE is_break = false GROUP BY corpus, dim), g AS (SELECT dim, avg(x) AS m FROM hl WHERE is_break = false GROUP BY dim), s AS (SELECT l.row_id, sum(x * m) AS ab, sum(x * x) AS aa, sum(m * m) AS bb FROM hl l JOIN k ON l.corpus = k.corpus AND l.dim = k.dim GROUP BY l.row_id) SELECT row_id, round(1 - ab / nullif(sqrt(aa) * sqrt(bb), 0), 5) AS distance FROM s")
def ml5_centroid_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance to the centroid of the corpus' normal rows; null for a vector without length."""
    v = _vecs(spark, d)
    c = centroids(v.where("is_break = false"), "corpus", "h")
    return v.join(F.broadcast(c), "corpus").select("row_id", F.round(1 - V.cosine(F.col("h"), F.col("centroid")), 5).alias("distance"))  # a row per corpus


@query(f"WITH {VECS}, s AS (SELECT row_id, sum(x * y) AS ab, sum(x * x) AS aa, sum(y * y) AS bb FROM hl GROUP BY row_id) SELECT row_id, round(1 - ab / nullif(sqrt(aa) * sqrt(bb), 0), 5) AS divergence FROM s")
def ml6_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _vecs(spark, d).select("row_id", F.round(1 - V.cosine(F.col("h"), F.col("c")), 5).alias("divergence"))


@query()
def ml7_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return learn.mahalanobis(e, "label", "embedding").select("vec_id", F.round("d2", 4).alias("d2"))


@query()
def ml8_whitened_distance(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance to the group's mean among whitened components."""
    z = learn.reduce(table(spark, d, "embeddings"), "embedding", 16, whiten=True).select("vec_id", "label", "z")
    c = centroids(z, "label", "z")
    return z.join(F.broadcast(c), "label").select("vec_id", F.round(V.squared_distance(F.col("z"), F.col("centroid")), 4).alias("d2"))  # a row per label


_RIDGE = 1e-3


@query(
    "WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT label, dim, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM l GROUP BY label, dim),"
    f" t AS (SELECT l.vec_id, l.label, sum(pow(x - s / n, 2) / (q / n - pow(s / n, 2) + {_RIDGE})) AS inside, sum(pow(x - (s - x) / (n - 1), 2) / ((q - x * x) / (n - 1) - pow((s - x) / (n - 1), 2) + {_RIDGE})) AS outside FROM l JOIN m USING (label, dim) WHERE n > 1 GROUP BY l.vec_id, l.label)"
    " SELECT vec_id, label, round(outside / inside, 6) AS ratio, outside / inside > 5 AS suspect FROM t WHERE inside > 0"
)
def ml9_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    """How much further a vector lies from its group, in the group's own variances, when it is left out of mean and variances."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    flat = e.select("label", F.posexplode("x").alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    g = flat.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "s", "q"))), lambda t: F.struct(t["s"].alias("s"), t["q"].alias("q"))).alias("m"), F.max("n").alias("n")).where("n > 1")
    n = F.col("n")

    def far(mean, square, x):  # noqa: ANN001, ANN202
        return F.pow(x - mean, F.lit(2)) / (square - mean * mean + _RIDGE)

    inside = F.zip_with("x", "m", lambda x, m: far(m["s"] / n, m["q"] / n, x))
    outside = F.zip_with("x", "m", lambda x, m: far((m["s"] - x) / (n - 1), (m["q"] - x * x) / (n - 1), x))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    t = e.join(F.broadcast(g), "label").select("vec_id", "label", total(inside).alias("inside"), total(outside).alias("outside")).where("inside > 0")  # a row per label
    ratio = F.col("outside") / F.col("inside")
    return t.select("vec_id", "label", F.round(ratio, 6).alias("ratio"), (ratio > 5).alias("suspect"))


@query(f"WITH {SCORED_SQL}, t AS (SELECT corpus, quantile_cont(bpe_score, 0.99) AS t FROM scored WHERE is_break = false GROUP BY corpus) SELECT s.corpus, round(any_value(t), 6) AS t, count(*) FILTER (s.bpe_score > t) AS n_flagged FROM scored s JOIN t ON s.corpus = t.corpus GROUP BY s.corpus")
def ml10_quantile_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Per corpus the 99 % quantile of the normal rows, and the rows strictly above it."""
    s = scored(spark, d)
    t = ranks.quantiles(s.where("is_break = false").select("corpus", "bpe_score"), ["corpus"], "bpe_score", {"t": 0.99})
    return s.join(F.broadcast(t), "corpus").groupBy("corpus").agg(F.round(F.first("t"), 6).alias("t"), F.count_if(F.col("bpe_score") > F.col("t")).alias("n_flagged"))  # a row per corpus


@query(f"WITH {SCORED_SQL}, m AS (SELECT corpus, avg(bpe_score) AS mb, greatest(stddev_pop(bpe_score), 1e-6) AS sb, avg(n_distinct_identifiers) AS mi, greatest(stddev_pop(n_distinct_identifiers), 1e-6) AS si FROM scored WHERE is_break = false GROUP BY corpus) SELECT row_id, round(greatest((bpe_score - mb) / sb, (n_distinct_identifiers - mi) / si), 5) AS z FROM scored JOIN m USING (corpus)")
def ml11_max_z(spark: SparkSession, d: str) -> DataFrame:
    """The greater of two standard scores; a missing one leaves the other."""
    s = scored(spark, d)
    dev = lambda c: F.greatest(F.stddev_pop(c), F.lit(1e-6))
    m = s.where("is_break = false").groupBy("corpus").agg(F.avg("bpe_score").alias("mb"), dev("bpe_score").alias("sb"), F.avg("n_distinct_identifiers").alias("mi"), dev("n_distinct_identifiers").alias("si"))
    return s.join(F.broadcast(m), "corpus").select("row_id", F.round(F.greatest((F.col("bpe_score") - F.col("mb")) / F.col("sb"), (F.col("n_distinct_identifiers") - F.col("mi")) / F.col("si")), 5).alias("z"))  # a row per corpus


@query()
def ml12_classifiers(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression and a perceptron by five folds: group 0 against the others."""
    e = table(spark, d, "embeddings").select("embedding", (F.col("label") == 0).cast("int").alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).alias("fold"))
    one = lambda k: learn.folds(e, "embedding", "y", "fold", k).withColumn("kind", F.lit(k))
    return one("logistic").unionByName(one("perceptron"))


# Callees by what they reach, exact names and beginnings (fixed values)
RULES = (
    *(("network", c, False) for c in ("fetch", "XMLHttpRequest", "WebSocket", "EventSource", "requests.get", "requests.post", "requests.put", "requests.patch", "requests.delete", "requests.head", "requests.options", "requests.request", "requests.Session", "httpx.get", "httpx.post", "httpx.put", "httpx.patch", "httpx.delete", "httpx.AsyncClient", "httpx.Client", "aiohttp.ClientSession", "aiohttp.request", "urllib.request.urlopen", "urllib.urlopen", "urlopen", "urllib3.PoolManager", "urllib3.request", "tornado.httpclient.HTTPClient", "tornado.httpclient.AsyncHTTPClient")),
    *(("network", c, True) for c in ("axios.", "got.", "ky.", "request.", "superagent.")),
    *(("nondeterminism", c, False) for c in ("Math.random", "Date.now", "performance.now", "random.random", "random.randint", "random.choice", "random.sample", "random.uniform", "random.seed", "random.shuffle", "time.time", "time.monotonic")),
    *(("crypto", c, True) for c in ("crypto.", "secrets.")),
    *(("env", c, True) for c in ("process.env.", "os.environ.", "os.getenv")),
)
# Python modules that a file must import before their callees count (fixed values)
GATED = ("aiohttp", "httpx", "os", "random", "requests", "secrets", "time", "tornado", "urllib", "urllib3")
_RULES = "(VALUES " + ", ".join(f"('{k}', '{c}', {str(p).lower()})" for k, c, p in RULES) + ") r(kind, name, is_prefix)"
_IMPORTED = r"'(?m)^\s*(?:import|from)\s+' || root || '\b'"
_KINDS = """c AS (SELECT entry_id, text, callee, string_split(callee, '.')[1] AS root FROM (SELECT DISTINCT entry_id, text, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)\\(', 1)) AS callee FROM src)),
 h AS (SELECT entry_id, kind, count(*) AS n FROM c JOIN {rules} ON CASE WHEN is_prefix THEN starts_with(callee, name) ELSE callee = name END WHERE root NOT IN {gated} OR regexp_matches(text, {imported}) GROUP BY entry_id, kind),
 x AS (SELECT entry_id, 'throws' AS kind, len(regexp_extract_all(text, '\\b(?:throw\\s+new|raise)\\s+[A-Za-z_]\\w*\\s*\\(')) AS n FROM src) SELECT entry_id, kind, n FROM h UNION ALL SELECT entry_id, kind, n FROM x WHERE n > 0""".format(rules=_RULES, gated=str(GATED), imported=_IMPORTED)
_CALLING = ((1, "import requests\nrequests.get(u)\nrandom.random()\n"), (2, "requests.get(u)\nfetch(u)\n"), (3, "from os import path\nos.getenv('X')\nprocess.env.get(a)\nMath.random()\nDate.now()\n"), (4, "raise ValueError(x)\nthrow new Error(y)\nraise x\n"))


def rule_hits(c: DataFrame) -> DataFrame:
    """c(entry_id, text) -> (entry_id, kind, n): distinct callees that fixed rules name, by kind, those of a Python module only in texts
    that import it, and thrown or raised calls."""
    rules = F.broadcast(c.sparkSession.createDataFrame([*RULES], "kind string, name string, is_prefix boolean"))  # a fixed list
    found = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\("), 1)
    modules = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w*)\b"), 1))
    calls = c.select("entry_id", modules.alias("modules"), F.explode(F.array_distinct(found)).alias("callee")).withColumn("root", T.namespace(F.col("callee")))
    calls = calls.where(~F.col("root").isin(*GATED) | F.array_contains("modules", F.col("root")))
    hit = calls.join(rules, F.when(F.col("is_prefix"), F.col("callee").startswith(F.col("name"))).otherwise(F.col("callee") == F.col("name")))
    n = F.regexp_count("text", F.lit(r"\b(?:throw\s+new|raise)\s+[A-Za-z_]\w*\s*\("))
    return hit.groupBy("entry_id", "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(c.select("entry_id", F.lit("throws").alias("kind"), n.cast("long").alias("n")).where("n > 0"))


@query(f"WITH {CALLS_SQL}, src AS (SELECT entry_id, text FROM code), {_KINDS}")
def ml15_rules(spark: SparkSession, d: str) -> DataFrame:
    """Callees that fixed rules name, and thrown or raised calls, of the stored sources."""
    return rule_hits(code(spark, d).select("entry_id", "text"))


@query(f"WITH src AS (SELECT * FROM {samples.values(_CALLING, 'entry_id, text')}), {_KINDS}")
def ml15_rules_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """The same of sources that call what the rules name, with and without its import."""
    return rule_hits(spark.createDataFrame(_CALLING, "entry_id int, text string"))


@query(f"WITH {CLUSTERED} SELECT h.entry_id, h.callee, round(coalesce(c.n_files, 0) / s.size, 6) AS share FROM hc h JOIN cs s ON h.corpus = s.corpus LEFT JOIN cc c ON h.corpus = c.corpus AND h.callee = c.callee")
def ml16_cluster_frequency(spark: SparkSession, d: str) -> DataFrame:
    calls, _, by, sizes = clustered(spark, d)
    return calls.join(sizes, "cluster_id").join(by, ["cluster_id", "callee"], "left").select("entry_id", "callee", F.round(F.coalesce("n_files", F.lit(0)) / F.col("size"), 6).alias("share"))
