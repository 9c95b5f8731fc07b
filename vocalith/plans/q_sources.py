"""Queries of sources and sinks over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql import Window as W

from ..functions import text as T
from ..session import shared_path, table
from ..sources import jsonl, modules
from ..sources.tables import CODE_SQL, HUNKS_SQL, code, hunks
from .registry import SQL, query

LINES = r"CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n\z', ''), chr(10)) END"


@query(f"WITH {HUNKS_SQL} SELECT h.commit_sha, h.file_path, h.hs, h.he FROM hunks1 h WHERE h.parent_sha IS NOT NULL AND regexp_matches(lower(h.file_path), '\\.(py|tsx?|jsx?)$')")
def src1_walk_repo(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of commits with one parent and of supported files."""
    return hunks(spark, d).where(F.col("parent_sha").isNotNull() & T.language(F.col("file_path"), T.EXTRACT_LANGUAGE).isNotNull()).select("commit_sha", "file_path", "hs", "he")


@query(f"WITH {HUNKS_SQL} SELECT h.commit_sha, h.file_path, h.hs, h.he FROM hunks1 h WHERE h.parent_sha IS NOT NULL AND h.commit_sha IN (SELECT commit_sha FROM hunks1 GROUP BY commit_sha HAVING count(*) >= 3)")
def src2_walk_commits(spark: SparkSession, d: str) -> DataFrame:
    """The walk restricted to a set of commits: those with three fragments or more."""
    h = hunks(spark, d)
    wanted = h.groupBy("commit_sha").count().where("count >= 3").select("commit_sha")
    return h.where("parent_sha is not null").join(wanted, "commit_sha", "left_semi").select("commit_sha", "file_path", "hs", "he")


@query(f"WITH {CODE_SQL} SELECT entry_id, path, 1 AS start_line, len({LINES}) AS end_line FROM code WHERE side = 'held' AND path NOT IN (SELECT path FROM code WHERE side = 'train') AND len({LINES}) > 0")
def src6_untracked(spark: SparkSession, d: str) -> DataFrame:
    """Files that the corpus doesn't hold, each as one fragment over all its lines; empty ones are skipped."""
    c = code(spark, d)
    new = c.where("side = 'held'").join(c.where("side = 'train'").select("path").distinct(), "path", "left_anti")
    n = F.size(T.lines(F.col("text")))
    return new.where(n > 0).select("entry_id", "path", F.lit(1).alias("start_line"), n.cast("long").alias("end_line"))


@query(f"WITH {HUNKS_SQL} SELECT file_path, hs, he, substr(commit_sha, 1, 7) AS source FROM hunks1")
def src7_committed(spark: SparkSession, d: str) -> DataFrame:
    return hunks(spark, d).select("file_path", "hs", "he", F.substring("commit_sha", 1, 7).alias("source"))


@query("SELECT DISTINCT f.file_path AS path FROM feature_rows f WHERE regexp_matches(file_path, '\\.(py|ts|tsx)$') AND NOT list_has_any(list_slice(string_split(file_path, '/'), 1, -2), ['node_modules', '.git', '.tox', '.eggs', '__pycache__', 'build', 'dist', '.venv', 'venv', '.mypy_cache', '.pytest_cache', '.ruff_cache', 'test', 'tests', '__tests__', 'benchmarks']) AND NOT regexp_matches(list_last(string_split(file_path, '/')), '^test_|\\.test\\.|\\.spec\\.')")
def src8_source_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of a corpus, without excluded directories and tests."""
    parts = F.split("file_path", "/")
    ok = F.col("file_path").rlike("\\.(py|ts|tsx)$") & ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.lit(list(T.CORPUS_EXCLUDED))) & ~F.element_at(parts, -1).rlike("^test_|\\.test\\.|\\.spec\\.")
    return table(spark, d, "feature_rows").where(ok).select(F.col("file_path").alias("path")).distinct()


@query("SELECT DISTINCT file_path AS path FROM feature_rows WHERE regexp_matches(file_path, '\\.(py|ts|tsx|js|jsx)$')")
def src9_all_source_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feature_rows").where(F.col("file_path").rlike("\\.(py|ts|tsx|js|jsx)$")).select(F.col("file_path").alias("path")).distinct()


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs, he, len(tokens) AS n_tokens FROM hunks1")
def src10_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fragments written as JSON lines and read again with the fixed schema; blank lines are skipped."""
    path = shared_path(spark, "jsonl")
    h = hunks(spark, d)
    jsonl.write(h.select("commit_sha", "file_path", F.col("hs").alias("hunk_start_line"), F.col("he").alias("hunk_end_line"), F.col("tokens").alias("hunk_tokens")), path)
    return jsonl.read(spark, path).select("commit_sha", "file_path", F.col("hunk_start_line").alias("hs"), F.col("hunk_end_line").alias("he"), F.size("hunk_tokens").cast("long").alias("n_tokens"))


@query(f"WITH {HUNKS_SQL} SELECT file_path, language, hs, he, commit_sha FROM hunks1 WHERE hs IS NOT NULL AND he IS NOT NULL")
def src11_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """Five of the fields: the scan reads no token arrays."""
    h = table(spark, d, "hunks").where("commit_sha is not null and hunk_start_line is not null and hunk_end_line is not null")
    return h.select("file_path", "language", F.col("hunk_start_line").alias("hs"), F.col("hunk_end_line").alias("he"), "commit_sha").dropDuplicates(["commit_sha", "file_path", "hs", "he"])


@query("SELECT tok AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS tok FROM documents) GROUP BY tok")
def src12_generic_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The generic baseline as token counts, stored as one JSON map and exploded from it."""
    counts = table(spark, d, "documents").select(F.explode(T.word_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # maps of about ten thousand tokens: their number follows the vocabulary
    blocks = max(1, counts.count() // 10_000)
    stored = counts.groupBy(F.pmod(F.xxhash64("token"), F.lit(blocks)).alias("block")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "n")))).alias("js"))
    return stored.select(F.explode(F.from_json("js", T_.MapType(T_.StringType(), T_.LongType()))).alias("token", "n"))


@query("SELECT corpus, count(*) AS n_fixtures, count(DISTINCT category) AS n_categories, count(*) FILTER (host_file IS NOT NULL) AS n_hosted FROM fixtures GROUP BY corpus")
def src13_manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fixtures").groupBy("corpus").agg(F.count(F.lit(1)).alias("n_fixtures"), F.countDistinct("category").alias("n_categories"), F.count("host_file").alias("n_hosted"))


@query("SELECT name, language, p.pr AS pr, p.sha AS sha FROM (SELECT name, language, unnest(prs) AS p FROM targets)")
def src14_targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "targets").select("name", "language", F.explode("prs").alias("p")).select("name", "language", "p.pr", "p.sha")


@query(f"WITH {CODE_SQL}, f AS (SELECT corpus, path, min(entry_id) AS first_id, max(stop) AS longest FROM code GROUP BY corpus, path) SELECT c.entry_id, f.first_id, f.longest FROM code c JOIN f ON c.corpus = f.corpus AND c.path = f.path")
def src15_file_at_commit(spark: SparkSession, d: str) -> DataFrame:
    """Fragments joined with the file they come from, each file resolved once."""
    c = code(spark, d)
    f = c.groupBy("corpus", "path").agg(F.min("entry_id").alias("first_id"), F.max("stop").alias("longest"))
    return c.select("entry_id", "corpus", "path").join(f, ["corpus", "path"]).select("entry_id", "first_id", "longest")


@query(f"WITH {CODE_SQL} SELECT entry_id, array_to_string(list_slice({LINES}, 2, 4), chr(10)) AS hunk FROM code")
def src16_fixture_slice(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 4 of a file."""
    return code(spark, d).select("entry_id", F.array_join(F.slice(T.lines(F.col("text")), 2, 3), "\n").alias("hunk"))


@query("SELECT * FROM (VALUES ('@app/core', 'exact'), ('@app/ui', 'prefix'), ('@lib', 'exact'), ('app', 'exact'), ('tools', 'exact'), ('left-pad', 'exact')) t(spec, kind)")
def src18_repo_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules that a package file and compiler paths name, exact or by prefix."""
    return modules.resolve(spark, ['{"name": "app", "dependencies": {"left-pad": "1"}}', '{"name": "tools"}'], ['{"compilerOptions": {"paths": {"@app/core": ["x"], "@app/ui/*": ["y/*"], "@lib": ["z"]}}}'])


@query(f"WITH {CODE_SQL} SELECT lang, count(*) AS n_files FROM code WHERE side = 'train' GROUP BY lang")
def src19_corpus_by_language(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).where("side = 'train'").groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path FROM hunks1")
def snk1_atomic_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "atomic")
    jsonl.write(hunks(spark, d).select("commit_sha", "file_path"), path)
    return spark.read.schema("commit_sha string, file_path string").json(path)


@query(f"WITH {CODE_SQL} SELECT DISTINCT path AS value FROM code WHERE side = 'train'")
def snk2_corpus_list(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "list")
    code(spark, d).where("side = 'train'").select("path").distinct().write.text(path)
    return spark.read.text(path)


@query("SELECT corpus, count(*) AS n, sum(features.n_returns)::BIGINT AS returns FROM (SELECT DISTINCT ON (row_id) * FROM feature_rows) WHERE corpus IN (SELECT name FROM targets) GROUP BY corpus")
def snk5_feature_json(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows as JSON with sorted keys, and read again."""
    path = shared_path(spark, "features")
    f = table(spark, d, "feature_rows").dropDuplicates(["row_id"])
    names = sorted(f.select("features.*").drop("ast_node_type_counts").columns)
    f.select(F.to_json(F.struct("corpus", F.struct(*[F.col(f"features.{n}") for n in names]).alias("features"), "row_id")).alias("value")).write.text(path)
    back = spark.read.schema("corpus string, features struct<n_returns: int>, row_id long").json(path)
    return back.join(F.broadcast(table(spark, d, "targets").select(F.col("name").alias("corpus"))), "corpus", "left_semi").groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.sum("features.n_returns").alias("returns"))


@query("SELECT replace(lower(trim(corpus)), '_', '-') AS corpus, count(*) AS n, sum(features.n_returns)::BIGINT AS returns FROM (SELECT DISTINCT ON (row_id) * FROM feature_rows) GROUP BY 1")
def snk5_feature_json_whole(spark: SparkSession, d: str) -> DataFrame:
    """All feature rows as JSON with sorted keys under the standard spelling of their corpus, and read again."""
    path = shared_path(spark, "features")
    f = table(spark, d, "feature_rows").dropDuplicates(["row_id"])
    names = sorted(f.select("features.*").columns)
    own = F.regexp_replace(F.lower(F.trim("corpus")), "_", "-").alias("corpus")
    # the keys of a map are put in order too
    value = lambda n: F.map_from_entries(F.array_sort(F.map_entries(f"features.{n}"))).alias(n) if n == "ast_node_type_counts" else F.col(f"features.{n}")
    f.select(F.to_json(F.struct(own, F.struct(*[value(n) for n in names]).alias("features"), "row_id")).alias("value")).write.text(path)
    back = spark.read.schema("corpus string, features struct<n_returns: int>, row_id long").json(path)
    return back.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.sum("features.n_returns").alias("returns"))


@query(SQL["src12_generic_baseline"])
def snk3_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The generic baseline as a stored table."""
    path = shared_path(spark, "baseline")
    src12_generic_baseline(spark, d).write.parquet(path)
    return spark.read.parquet(path)
