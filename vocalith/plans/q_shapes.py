"""Queries of the shape primitives; a corpus is a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators import shapes
from ..sources.tables import code
from . import samples
from .q_joins import CLUSTERED, clustered
from .registry import query

_SIZES = "cs AS (SELECT corpus, count(*) AS size FROM code WHERE side = 'train' GROUP BY corpus)"
_Z2 = "CASE WHEN size >= 10 AND mean IS NOT NULL AND value IS NOT NULL THEN least(5.0, greatest(0.0, abs(value - mean) / greatest(std, 1e-6) - 1)) ELSE 0.0 END"
_Z1 = "CASE WHEN size >= 10 AND mean IS NOT NULL AND value IS NOT NULL THEN least(5.0, greatest(0.0, (mean - value) / greatest(std, 1e-6) - 1)) ELSE 0.0 END"


def _all_calls(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).select("entry_id", F.col("corpus").alias("cluster_id"), "side", F.explode(T.callees(F.col("text"))).alias("callee"))


@query(
    f"WITH {CLUSTERED}, top AS (SELECT corpus, callee FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n_files DESC, callee) AS r FROM cc) WHERE r <= 10),"
    " val AS (SELECT c.entry_id, c.corpus, c.side, avg(CASE WHEN t.callee IS NOT NULL THEN 1.0 ELSE 0.0 END) AS value FROM calls c LEFT JOIN top t ON c.corpus = t.corpus AND c.callee = t.callee GROUP BY c.entry_id, c.corpus, c.side),"
    " b AS (SELECT corpus, avg(value) AS mean, stddev_pop(value) AS std FROM val WHERE side = 'train' GROUP BY corpus HAVING count(*) >= 3)"
    f" SELECT v.entry_id, round({_Z1}, 5)::DOUBLE AS s FROM val v LEFT JOIN b ON v.corpus = b.corpus LEFT JOIN cs ON v.corpus = cs.corpus WHERE side = 'held'"
)
def shp1_typical_call_density(spark: SparkSession, d: str) -> DataFrame:
    _, _, by, sizes = clustered(spark, d)
    top = F.broadcast(shapes.typical_callees(by))  # ten rows a cluster
    calls = _all_calls(spark, d)
    share = lambda side: shapes.typical_share(calls.where(F.col("side") == side), top, "entry_id")
    return shapes.score(share("held"), shapes.baselines(share("train")), sizes, shapes.below).select("entry_id", F.round("s", 5).alias("s"))


@query(
    f"WITH {CLUSTERED}, n AS (SELECT entry_id, corpus, side, string_split(callee, '.')[1] AS ns, count(*) AS n FROM calls GROUP BY ALL), q0 AS (SELECT corpus, ns, sum(n) AS n FROM n WHERE side = 'train' GROUP BY corpus, ns), q AS (SELECT corpus, ns, n / sum(n) OVER (PARTITION BY corpus) AS q FROM q0),"
    " p0 AS (SELECT h.entry_id, h.corpus, CASE WHEN q.ns IS NULL THEN '<other>' ELSE h.ns END AS ns, sum(h.n) AS n FROM n h LEFT JOIN q ON q.corpus = h.corpus AND q.ns = h.ns WHERE side = 'held' GROUP BY 1, 2, 3), p AS (SELECT entry_id, corpus, ns, n / sum(n) OVER (PARTITION BY entry_id) AS p FROM p0),"
    " u AS (SELECT e.entry_id, coalesce(p.p, 0) AS p, q.q FROM (SELECT DISTINCT entry_id, corpus FROM p) e JOIN q ON q.corpus = e.corpus LEFT JOIN p ON p.entry_id = e.entry_id AND p.ns = q.ns UNION ALL SELECT entry_id, p, 0 FROM p WHERE ns = '<other>'),"
    " d AS (SELECT entry_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM u GROUP BY entry_id) SELECT entry_id, round(5 * sqrt(greatest(0, d)), 5) AS s FROM d"
)
def shp2_namespace_jsd(spark: SparkSession, d: str) -> DataFrame:
    n = _all_calls(spark, d).withColumn("ns", T.namespace(F.col("callee"))).groupBy("entry_id", "cluster_id", "side", "ns").agg(F.count(F.lit(1)).alias("n"))
    cluster = n.where("side = 'train'").groupBy("cluster_id", "ns").agg(F.sum("n").alias("n"))
    return shapes.namespace_divergence(n.where("side = 'held'").drop("side"), cluster, "entry_id").select("entry_id", F.round("value", 5).alias("s"))


def _valued(spark: SparkSession, d: str, f) -> DataFrame:  # noqa: ANN001
    """Two-sided scores of the fragments under test, for a value by parser."""
    return _by_parser(code(spark, d), f)


def _by_parser(files: DataFrame, f) -> DataFrame:  # noqa: ANN001
    c = files.select("entry_id", F.col("corpus").alias("cluster_id"), "side", P.column(f, "double")("text", "lang").alias("value"))
    sizes = c.where("side = 'train'").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return shapes.score(c.where("side = 'held'").select("entry_id", "cluster_id", "value"), shapes.baselines(c.where("side = 'train'").select("cluster_id", "value")), sizes).select("entry_id", F.round("value", 5).alias("value"), F.round("s", 5).alias("s"))


@query()
def shp3_call_scope_parsed(spark: SparkSession, d: str) -> DataFrame:
    return _valued(spark, d, shapes.PRIMITIVES["call_scope_fraction"])


@query()
def shp4_handlers_parsed(spark: SparkSession, d: str) -> DataFrame:
    return _valued(spark, d, shapes.PRIMITIVES["except_return_raise_ratio"])


@query()
def shp5_guards_parsed(spark: SparkSession, d: str) -> DataFrame:
    return _valued(spark, d, shapes.PRIMITIVES["fall_through_guards"])


# the same over small files whose values can be counted by hand: twelve normal ones in a cluster, and fragments under test


def _small(body, tests: tuple) -> list:  # noqa: ANN001
    return [(k, "c", "python", "train", body(k)) for k in range(12)] + [(100 + i, "c", "python", "held", t) for i, t in enumerate(tests)]


def _hand(values: list, tests: tuple) -> str:
    rows = [(k, v, False) for k, v in enumerate(values)] + [(100 + i, v, True) for i, v in enumerate(tests)]
    return (
        f"WITH r AS (SELECT * FROM {samples.values(rows, 'entry_id, value, test')}), b AS (SELECT avg(value) AS mean, stddev_pop(value) AS std FROM r WHERE NOT test HAVING count(value) >= 3), z AS (SELECT 12 AS size)"
        f" SELECT entry_id, round(value, 5)::DOUBLE AS value, round({_Z2}, 5)::DOUBLE AS s FROM r LEFT JOIN b ON true CROSS JOIN z WHERE test"
    )


def _scored(spark: SparkSession, rows: list, name: str) -> DataFrame:
    return _by_parser(spark.createDataFrame(rows, "entry_id int, corpus string, lang string, side string, text string"), shapes.PRIMITIVES[name])


_SCOPE = _small(lambda k: "def f():\n" + "    g()\n" * (k % 4) + "    pass\n" + "h()\n" * (4 - k % 4), ("h()\n", "def f():\n    g()\n", "x = 1\n", "class A:\n    K = g()\n    def f(self):\n        h()\n"))


@query(_hand([(4 - k % 4) / 4 for k in range(12)], (1.0, 0.0, None, 0.5)))
def shp3_call_scope(spark: SparkSession, d: str) -> DataFrame:
    """Share of calls outside functions; a fragment without calls abstains."""
    return _scored(spark, _SCOPE, "call_scope_fraction")


_HANDLING = _small(lambda k: "".join(f"def f{i}():\n    try:\n        a()\n    except E:\n        {'return 1' if i < k % 3 else 'raise'}\n" for i in range(3)), ("try:\n    a()\nexcept E:\n    raise\n", "def f():\n    try:\n        a()\n    except E:\n        return 1\n", "def f():\n    return 1\n"))


@query(_hand([(k % 3) / 3 for k in range(12)], (0.0, 1.0, None)))
def shp4_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Returns among the returns and raises of handlers; a return outside of them does not count."""
    return _scored(spark, _HANDLING, "except_return_raise_ratio")


_GUARDED = _small(lambda k: "def f(a):\n" + "    if a:\n        pass\n" * (k % 3) + "    return a\n", ("def f(a):\n    return a\n    if a:\n        pass\n", "def f(a):\n" + "    if a:\n        pass\n" * 6 + "    return a\n", "def f(a):\n    if a:\n        pass\n", "x = 1\n"))


@query(_hand([float(k % 3) for k in range(12)], (0.0, 6.0, 0.0, None)))
def shp5_guards(spark: SparkSession, d: str) -> DataFrame:
    """Ifs before the first return of a function; one without a return has none."""
    return _scored(spark, _GUARDED, "fall_through_guards")
