"""Queries of the evidence behind a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling
from ..session import table
from ..sources.tables import CODE_SQL, code
from .q_aggregates import BPE, counts, token_surprises
from .q_joins import CLUSTERED, attested_modules, clustered
from .q_text import specs
from .registry import query


@query(f"WITH {BPE}, r AS (SELECT h.*, row_number() OVER (PARTITION BY h.entry_id ORDER BY round(s, 6) DESC, h.token) AS r FROM hs h WHERE regexp_matches(h.token, '^[A-Za-z_]')) SELECT r.entry_id, r.token AS name, coalesce(o.n, 0) AS n_repo FROM r LEFT JOIN own o ON o.token = r.token WHERE r <= 8")
def evd1_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Up to eight surprising identifiers of each fragment and how often the corpus has them, 0 kept."""
    own, gen = counts(spark, d)
    s = token_surprises(spark, d, own, gen).where(F.col("token").rlike("^[A-Za-z_]"))
    top = sampling.top(s, ["entry_id"], 8, F.desc(F.round("s", 6)), F.col("token"))
    return top.join(own, "token", "left").select("entry_id", F.col("token").alias("name"), F.coalesce("n", F.lit(0)).alias("n_repo"))


_SP = "sp AS (SELECT doc_id, spec, min(pos) AS pos FROM (SELECT doc_id, unnest(x) AS spec, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*') AS x FROM documents)) GROUP BY doc_id, spec), mods AS (SELECT DISTINCT spec FROM sp WHERE doc_id % 2 = 0)"


@query(f"WITH {_SP}, f AS (SELECT * FROM sp WHERE doc_id % 2 = 1 AND spec NOT IN (SELECT spec FROM mods)) SELECT doc_id, string_agg(spec, ', ' ORDER BY pos) AS foreign_specs, (SELECT count(*) FROM mods) AS attested FROM f GROUP BY doc_id")
def evd2_imports(spark: SparkSession, d: str) -> DataFrame:
    """Foreign specifiers of each document in order of their first place, and how many the corpus attests."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("\\b[a-z]+\\.[a-z][a-z_0-9]*"), 0)).alias("pos", "spec")).groupBy("doc_id", "spec").agg(F.min("pos").alias("pos"))
    mods = s.where("doc_id % 2 = 0").select("spec").distinct()
    f = s.where("doc_id % 2 = 1").join(mods, "spec", "left_anti")
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "spec"))), lambda x: x["spec"]), ", ")
    return f.groupBy("doc_id").agg(names.alias("foreign_specs")).crossJoin(F.broadcast(mods.agg(F.count(F.lit(1)).alias("attested"))))  # one row


@query()
def evd2_imports_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the specifiers that no other attests, in order, the span of the first (1-based line; first and last column),
    how many modules are attested, and the ten commonest of them."""
    pattern = "\\b[a-z]+\\.[a-z][a-z_0-9]*"
    # what stands before and between the matches gives the place of each: the gaps up to it and the matches before it
    t = table(spark, d, "documents").select("doc_id", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("found"))
    s = t.select("doc_id", "gaps", "found", F.posexplode(F.array_distinct("found")).alias("_", "spec")).withColumn("pos", F.array_position("found", F.col("spec")).cast("int"))
    before = F.concat(F.array_join(F.transform(F.slice("found", 1, F.col("pos") - 1), lambda x, i: F.concat(F.get("gaps", i), x)), ""), F.get("gaps", F.col("pos") - 1))
    column = F.length(F.substring_index("before", "\n", -1)) + 1
    line = F.length("before") - F.length(F.replace("before", F.lit("\n"))) + 1
    at = s.withColumn("before", before).select("doc_id", "spec", "pos", line.alias("line"), column.alias("start"), (column + F.length("spec") - 1).alias("stop"))  # numbers only are shuffled
    mods = attested_modules(spark, d)
    f = at.join(mods, "spec", "left_anti").select("doc_id", F.struct("pos", "spec", "line", "start", "stop").alias("x"))
    out = f.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    out = out.select("doc_id", F.array_join("x.spec", ", ").alias("foreign_specs"), *[F.get("x", F.lit(0))[c].alias(c) for c in ("line", "start", "stop")])
    names = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "spec"))), lambda x: x["spec"]), ", ").alias(c)
    common = mods.orderBy(F.desc("n"), "spec").limit(10).agg(names("common"))
    return out.crossJoin(F.broadcast(mods.agg(F.count(F.lit(1)).alias("attested")))).crossJoin(F.broadcast(common))  # one row each


@query(f"WITH {CLUSTERED}, u AS (SELECT entry_id, corpus, string_agg(callee, ', ' ORDER BY callee) AS names FROM hc WHERE callee NOT IN (SELECT callee FROM att) GROUP BY entry_id, corpus), t AS (SELECT corpus, string_agg(callee, ', ' ORDER BY n_files DESC, callee) AS common FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n_files DESC, callee) AS r FROM cc) WHERE r <= 3 GROUP BY corpus) SELECT u.entry_id, u.names, t.common FROM u LEFT JOIN t USING (corpus)")
def evd3_callees(spark: SparkSession, d: str) -> DataFrame:
    """Unattested callees of each fragment, and the commonest of its cluster."""
    calls, known, by, _ = clustered(spark, d)
    u = calls.join(known.select("callee"), "callee", "left_anti").groupBy("entry_id", "cluster_id").agg(F.array_join(F.sort_array(F.collect_list("callee")), ", ").alias("names"))
    top = sampling.top(by, ["cluster_id"], 3, F.desc("n_files"), F.col("callee")).groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "callee"))), lambda x: x["callee"]), ", ").alias("common"))
    return u.join(F.broadcast(top), "cluster_id", "left").select("entry_id", "names", "common")  # a row per cluster


@query(f"WITH {CODE_SQL}, i AS (SELECT spec AS name, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*')) AS spec FROM documents) GROUP BY spec ORDER BY n DESC, name LIMIT 50), d AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM code WHERE side = 'train') GROUP BY name) SELECT 'imports' AS kind, name, n FROM i UNION ALL SELECT 'identifiers', name, n FROM d")
def evd4_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The evidence table of a corpus: its fifty commonest modules and all identifiers."""
    i = specs(spark, d).groupBy(F.col("spec").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(50)
    n = code(spark, d).where("side = 'train'").select(F.explode(T.identifiers(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return i.select(F.lit("imports").alias("kind"), "name", "n").unionByName(n.select(F.lit("identifiers").alias("kind"), "name", "n"))


@query(
    f"WITH {CLUSTERED}, u AS (SELECT entry_id, list(callee ORDER BY callee) AS xs FROM hc WHERE callee NOT IN (SELECT callee FROM att) GROUP BY entry_id), n AS (SELECT count(DISTINCT callee) AS n FROM att)"
    " SELECT entry_id, array_to_string(list_slice(xs, 1, 3), ', ') || CASE WHEN len(xs) > 3 THEN ' (+' || (len(xs) - 3) || ' more)' ELSE '' END AS names, CASE WHEN n < 30 THEN 'never seen in repo' ELSE '0 of ' || format('{:,}', n) || ' callees in repo' END AS rarity, format('{:,}', n) || '×' AS frequency FROM u CROSS JOIN n"
)
def evd5_layout(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a report: three names and how many more, the rarity, a count."""
    calls, known, _, _ = clustered(spark, d)
    u = calls.join(known.select("callee"), "callee", "left_anti").groupBy("entry_id").agg(F.sort_array(F.collect_list("callee")).alias("xs"))
    n = known.agg(F.countDistinct("callee").alias("n"))
    return u.crossJoin(F.broadcast(n)).select("entry_id", T.overflow(F.col("xs")).alias("names"), T.rarity(F.lit(0), F.col("n"), "repo", "callees in repo").alias("rarity"), T.frequency(F.col("n")).alias("frequency"))  # one row


@query(f"WITH {BPE}, top AS (SELECT entry_id, token FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY round(s, 6) DESC, token) AS r FROM hs) WHERE r <= 3), l AS (SELECT t.entry_id, c.start + len(string_split(substr(c.text, 1, instr(c.text, t.token)), chr(10))) - 1 AS line FROM top t JOIN code c USING (entry_id)) SELECT DISTINCT entry_id, line FROM l")
def evd6_lines(spark: SparkSession, d: str) -> DataFrame:
    """The file lines at which a fragment's three most surprising tokens first stand."""
    own, gen = counts(spark, d)
    top = sampling.top(token_surprises(spark, d, own, gen), ["entry_id"], 3, F.desc(F.round("s", 6)), F.col("token"))
    j = top.join(code(spark, d).select("entry_id", "start", "text"), "entry_id")
    return j.select("entry_id", (F.col("start") + F.size(F.split(F.expr("substring(text, 1, instr(text, token))"), "\n")) - 1).cast("long").alias("line")).distinct()


@query(f"WITH {BPE} SELECT entry_id, '{{\"bpe\":' || CASE WHEN bpe >= 3 THEN 'true' ELSE 'false' END || '}}' AS js FROM bpe")
def snk9_evidence_json(spark: SparkSession, d: str) -> DataFrame:
    from .q_aggregates import bpe

    return bpe(spark, d).select("entry_id", F.to_json(F.struct((F.col("bpe") >= 3).alias("bpe"))).alias("js"))


@query(f"WITH {CODE_SQL} SELECT path, string_agg(format('{{:>5}}  {{}}', start, entry_id), chr(10) ORDER BY start, entry_id) AS body FROM code WHERE side = 'held' GROUP BY path")
def snk8_grouped_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a check report: one block per file, hits by line."""
    line = F.format_string("%5d  %d", "start", "entry_id")
    rows = F.sort_array(F.collect_list(F.struct("start", "entry_id", line.alias("line"))))
    return code(spark, d).where("side = 'held'").groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))
