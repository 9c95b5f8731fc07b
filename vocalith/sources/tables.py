"""The concepts of the engine over the stored tables: source files, fragments, scored fragments, prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SCORE_LANGUAGE, language
from ..session import table


def clean_path(c):  # noqa: ANN001, ANN201
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[/\\\\]+", "/"), "^(\\./)+", "")


def code(spark: SparkSession, d: str) -> DataFrame:
    """Source files: (entry_id, corpus, path, lang, side, start, stop, text), side being train or held."""
    m = table(spark, d, "manifest_entries").where("entry_id is not null and hunk_content is not null and file is not null").dropDuplicates(["entry_id"])
    path = clean_path(F.col("file"))
    side = F.when(F.lower(F.trim("set")).startswith("train"), "train").otherwise("held")
    return m.select("entry_id", F.col("scope").alias("corpus"), path.alias("path"), language(path, SCORE_LANGUAGE).alias("lang"), side.alias("side"), F.col("hunk_start_line").alias("start"), F.col("hunk_end_line").alias("stop"), F.col("hunk_content").alias("text"))


# The same rows in SQL
CODE_SQL = r"""code AS (SELECT entry_id, any_value(scope) AS corpus, any_value(regexp_replace(regexp_replace(lower(trim(file)), '[/\\]+', '/', 'g'), '^(\./)+', '')) AS path,
 any_value(CASE WHEN lower(trim(file)) LIKE '%.py' THEN 'python' ELSE 'typescript' END) AS lang,
 any_value(CASE WHEN starts_with(lower(trim("set")), 'train') THEN 'train' ELSE 'held' END) AS side,
 any_value(hunk_start_line) AS start, any_value(hunk_end_line) AS stop, any_value(hunk_content) AS text
 FROM manifest_entries WHERE entry_id IS NOT NULL AND hunk_content IS NOT NULL AND file IS NOT NULL GROUP BY entry_id)"""


MILLISECONDS = 100_000_000_000  # a greater epoch is in milliseconds: as seconds it would lie beyond the year 5000


def hunks(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of commits, each once: (commit_sha, corpus, file_path, language, hs, he, tokens, before, after, parent_sha, epoch)."""
    h = table(spark, d, "hunks").where("commit_sha is not null").dropDuplicates(["commit_sha", "corpus", "file_path", "hunk_start_line", "hunk_end_line"])
    stamp = F.try_to_number(F.nullif(F.trim("author_date_iso"), F.lit("")), F.lit("9999999999999")).cast("bigint")
    stamp = F.when(stamp >= MILLISECONDS, F.floor(stamp / 1000)).otherwise(stamp)
    return h.select(
        "commit_sha", "corpus", "file_path", "language", F.col("hunk_start_line").alias("hs"), F.col("hunk_end_line").alias("he"),
        F.col("hunk_tokens").alias("tokens"), F.col("context_before").alias("before"), F.col("context_after").alias("after"), "parent_sha", stamp.alias("epoch"),
    )


HUNKS_SQL = """hunks1 AS (SELECT commit_sha, corpus, file_path, hunk_start_line AS hs, hunk_end_line AS he, any_value(language) AS language, any_value(hunk_tokens) AS tokens,
 any_value(context_before) AS before, any_value(context_after) AS after, any_value(parent_sha) AS parent_sha, any_value(CASE WHEN try_cast(nullif(trim(author_date_iso), '') AS BIGINT) >= 100000000000 THEN try_cast(nullif(trim(author_date_iso), '') AS BIGINT) // 1000 ELSE try_cast(nullif(trim(author_date_iso), '') AS BIGINT) END) AS epoch
 FROM hunks WHERE commit_sha IS NOT NULL GROUP BY commit_sha, corpus, file_path, hunk_start_line, hunk_end_line)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored fragments, each row once, with the features as columns."""
    f = table(spark, d, "feature_rows").where("row_id is not null")
    keep = ["row_id", "run_id", "corpus", "is_break", "fixture_id", "category", "difficulty", "file_path", "hunk_start_line", "hunk_end_line"]
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    feats = ["stage1_flagged", "stage2_flagged", "scorer_reason", "n_distinct_callees", "n_unattested_callees", "n_attested_root_only", "n_cluster_absent_callees", "cluster_id", "hunk_callee_bag_size", "file_callee_bag_size", "n_returns", "n_throws", "n_awaits", "max_nesting_depth", "n_distinct_identifiers", "parse_fragment_flag"]
    own = F.regexp_replace(F.lower(F.trim("corpus")), "_", "-").alias("corpus")
    cols = [own if c == "corpus" else F.col(c) for c in keep]
    return f.select(*cols, *[num(f"features.{c}").alias(c) for c in ("bpe_score", "adjusted_bpe", "import_score")], *[F.col(f"features.{c}").alias(c) for c in feats]).dropDuplicates(["row_id"])


SCORED_SQL = """scored AS (SELECT row_id, any_value(run_id) AS run_id, any_value(replace(lower(trim(corpus)), '_', '-')) AS corpus, any_value(is_break) AS is_break, any_value(fixture_id) AS fixture_id,
 any_value(category) AS category, any_value(difficulty) AS difficulty, any_value(file_path) AS file_path, any_value(hunk_start_line) AS hunk_start_line, any_value(hunk_end_line) AS hunk_end_line,
 any_value(CASE WHEN NOT isnan(features.bpe_score) THEN features.bpe_score END) AS bpe_score, any_value(CASE WHEN NOT isnan(features.adjusted_bpe) THEN features.adjusted_bpe END) AS adjusted_bpe,
 any_value(CASE WHEN NOT isnan(features.import_score) THEN features.import_score END) AS import_score, any_value(features.stage1_flagged) AS stage1_flagged, any_value(features.stage2_flagged) AS stage2_flagged,
 any_value(features.scorer_reason) AS scorer_reason, any_value(features.n_distinct_callees) AS n_distinct_callees, any_value(features.n_unattested_callees) AS n_unattested_callees,
 any_value(features.n_attested_root_only) AS n_attested_root_only, any_value(features.n_cluster_absent_callees) AS n_cluster_absent_callees, any_value(features.cluster_id) AS cluster_id,
 any_value(features.n_distinct_identifiers) AS n_distinct_identifiers, any_value(features.max_nesting_depth) AS max_nesting_depth, any_value(features.parse_fragment_flag) AS parse_fragment_flag
 FROM feature_rows WHERE row_id IS NOT NULL GROUP BY row_id)"""
