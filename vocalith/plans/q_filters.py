"""Queries of filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators.verdict import eligible
from ..session import table
from ..sources.tables import CODE_SQL, HUNKS_SQL, SCORED_SQL, code, hunks, scored
from .q_text import LINES
from .registry import query

_EX_DIRS = ", ".join(f"'{x}'" for x in T.SAMPLE_EXCLUDED)


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs FROM hunks1 WHERE regexp_matches(lower(file_path), '\\.(tsx?|jsx?|py)$')")
def flt1_supported(spark: SparkSession, d: str) -> DataFrame:
    return hunks(spark, d).where(T.extension(F.col("file_path")).isin(*T.EXTRACT_LANGUAGE)).select("commit_sha", "file_path", "hs")


@query(f"WITH {SCORED_SQL} SELECT row_id FROM scored WHERE regexp_matches(file_path, '^src/.*\\.(py|ts)$') AND NOT regexp_matches(file_path, '^.*/net/.*$')")
def flt2_globs(spark: SparkSession, d: str) -> DataFrame:
    """Only src/*.py and src/*.ts, without */net/*; the exclusion wins."""
    p = F.col("file_path")
    return scored(spark, d).where((T.glob(p, "src/*.py") | T.glob(p, "src/*.ts")) & ~T.glob(p, "*/net/*")).select("row_id")


_EXCLUDED = f"(len(list_filter(list_slice(string_split(path, '/'), 1, -2), lambda x: x IN ({_EX_DIRS}) OR starts_with(x, 'test') OR x = '__tests__')) > 0 OR regexp_matches(list_last(string_split(path, '/')), '^test_|^conftest\\.py$|\\.test\\.|\\.spec\\.|\\.config\\.|^\\..*rc\\.'))"


@query(f"WITH {CODE_SQL}, p AS (SELECT entry_id, path FROM code UNION ALL SELECT entry_id, replace(path, 'fixtures/', 'src/') FROM code) SELECT entry_id, path, {_EXCLUDED} AS is_excluded FROM p")
def flt3_excluded_path(spark: SparkSession, d: str) -> DataFrame:
    c = code(spark, d).select("entry_id", "path")
    both = c.unionByName(c.select("entry_id", F.regexp_replace("path", "fixtures/", "src/").alias("path")))
    return both.select("entry_id", "path", T.excluded(F.col("path")).alias("is_excluded"))


_ASSIGN = r"len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[A-Za-z_][\w.\[\]]* = [\[{(]'))) / greatest(1, len(list_filter(ls, lambda x: trim(x) <> '')))"


@query(f"WITH {CODE_SQL}, l AS (SELECT *, {LINES} AS ls FROM code) SELECT entry_id FROM l WHERE lang IN ('python', 'typescript') AND NOT regexp_matches(path, '/net/') AND NOT ({_ASSIGN}) > 0.65")
def flt4_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """In scope: a supported language, no excluded directory, and not mostly data by a line pattern."""
    c = code(spark, d).withColumn("ls", T.lines(F.col("text")))
    data = F.size(F.filter("ls", lambda x: x.rlike(r"^\s*[A-Za-z_][\w.\[\]]* = [\[{(]"))) / F.greatest(F.lit(1), F.size(F.filter("ls", lambda x: F.trim(x) != "")))
    return c.where(F.col("lang").isNotNull() & ~F.col("path").rlike("/net/") & ~(data > 0.65)).select("entry_id")


def _ratio(spark: SparkSession, d: str, lang: str) -> DataFrame:
    c = code(spark, d).where(F.col("lang") == lang)
    r = P.column(P.data_ratio, "double")("text", "lang")
    return c.select("entry_id", F.round(r, 6).alias("ratio")).withColumn("dominant", F.col("ratio") > 0.65)


@query()
def flt5_data_dominant_python(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d, "python")


@query()
def flt6_data_dominant_typescript(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d, "typescript")


def typicality(df: DataFrame) -> DataFrame:
    names = ("literal_ratio", "control_density", "entropy", "distinct_ratio", "n_leaves")
    s = P.struct_column(P.typicality, names, "literal_ratio double, control_density double, entropy double, distinct_ratio double, n_leaves int")
    return df.withColumn("t", s("text", "lang"))


_TOKT = f"{HUNKS_SQL}, tok AS (SELECT commit_sha, file_path, hs, unnest(tokens) AS t FROM hunks1), leaf AS (SELECT commit_sha, file_path, hs, t.text AS text, t.node_type IN ('string', 'integer') AS lit FROM tok WHERE t.node_type IN ('string', 'integer', 'identifier', 'property_identifier'))"
_FEAT = f"{_TOKT}, c AS (SELECT commit_sha, file_path, hs, text, count(*) AS c, sum(lit::INT) AS l FROM leaf GROUP BY ALL), f AS (SELECT commit_sha, file_path, hs, sum(c)::BIGINT AS n_leaves, sum(l) / sum(c) AS literal_ratio, count(*) / sum(c) AS distinct_ratio, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM c GROUP BY commit_sha, file_path, hs)"


def leaf_features(spark: SparkSession, d: str) -> DataFrame:
    """Typicality of fragments from their stored tokens: named leaves, literal and distinct shares, entropy in bits."""
    t = hunks(spark, d).select("commit_sha", "file_path", "hs", F.explode("tokens").alias("t"))
    named = t.where(F.col("t.node_type").isin("string", "integer", "identifier", "property_identifier")).select("commit_sha", "file_path", "hs", "t.text", F.col("t.node_type").isin("string", "integer").cast("int").alias("lit"))
    c = named.groupBy("commit_sha", "file_path", "hs", "text").agg(F.count(F.lit(1)).alias("c"), F.sum("lit").alias("l"))
    n = F.sum("c")
    return c.groupBy("commit_sha", "file_path", "hs").agg(n.alias("n_leaves"), (F.sum("l") / n).alias("literal_ratio"), (F.count(F.lit(1)) / n).alias("distinct_ratio"), (F.log2(n.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / n).alias("entropy"))


@query(f"WITH {_FEAT} SELECT commit_sha, file_path, hs, n_leaves, round(literal_ratio, 6) AS literal_ratio, round(distinct_ratio, 6) AS distinct_ratio, round(entropy, 6) AS entropy FROM f")
def flt7_typicality(spark: SparkSession, d: str) -> DataFrame:
    f = leaf_features(spark, d)
    return f.select("commit_sha", "file_path", "hs", "n_leaves", *[F.round(c, 6).alias(c) for c in ("literal_ratio", "distinct_ratio", "entropy")])


@query()
def flt7_typicality_parsed(spark: SparkSession, d: str) -> DataFrame:
    return typicality(code(spark, d).select("entry_id", "text", "lang")).select("entry_id", "t.*")


@query(f"WITH {_FEAT} SELECT commit_sha, file_path, hs FROM f WHERE n_leaves >= 5 AND literal_ratio > 0.8")
def flt8_atypical_hunk(spark: SparkSession, d: str) -> DataFrame:
    return leaf_features(spark, d).where("n_leaves >= 5 and literal_ratio > 0.8").select("commit_sha", "file_path", "hs")


@query(f"WITH {_TOKT}, f AS (SELECT corpus, file_path, count(*) AS n, avg(lit::INT) AS r FROM leaf JOIN (SELECT DISTINCT commit_sha, file_path, hs, corpus FROM hunks1) USING (commit_sha, file_path, hs) GROUP BY corpus, file_path) SELECT corpus, file_path, n, round(r, 6) AS literal_ratio, n >= 100 AND r > 0.8 AS atypical FROM f")
def flt9_atypical_file(spark: SparkSession, d: str) -> DataFrame:
    t = hunks(spark, d).select("corpus", "file_path", F.explode("tokens").alias("t")).where(F.col("t.node_type").isin("string", "integer", "identifier", "property_identifier"))
    f = t.groupBy("corpus", "file_path").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("t.node_type").isin("string", "integer").cast("int")).alias("r"))
    return f.select("corpus", "file_path", "n", F.round("r", 6).alias("literal_ratio"), ((F.col("n") >= 100) & (F.col("r") > 0.8)).alias("atypical"))


_MARK = "|".join(m.replace("'", "''") for m in T.GENERATED_MARKERS)
_MARK_PY = "|".join((*T.GENERATED_MARKERS, *T.PYTHON_MARKERS))


@query(
    f"WITH {CODE_SQL}, two AS (SELECT entry_id, lang, text FROM code UNION ALL SELECT -entry_id, lang, CASE WHEN lang = 'python' THEN '# Rendered by Templite' ELSE '// @generated - do not edit' END || chr(10) || text FROM code), l AS (SELECT *, {LINES} AS ls FROM two)"
    f" SELECT entry_id, len(list_filter(list_slice(ls, 1, 20), lambda x: regexp_matches(ltrim(x), '^(#|//|/\\*|\\*)') AND (regexp_matches(lower(x), '{_MARK}') OR lang = 'python' AND regexp_matches(lower(x), '{_MARK_PY}')))) > 0 AS is_generated FROM l"
)
def flt10_auto_generated(spark: SparkSession, d: str) -> DataFrame:
    """Files as they are, and once more with a generator's header (negative id)."""
    c = code(spark, d).select("entry_id", "lang", "text")
    head = F.when(F.col("lang") == "python", "# Rendered by Templite").otherwise("// @generated - do not edit")
    two = c.unionByName(c.select((-F.col("entry_id")).alias("entry_id"), "lang", F.concat(head, F.lit("\n"), F.col("text")).alias("text")))
    return two.select("entry_id", T.generated(T.lines(F.col("text")), F.col("lang")).alias("is_generated"))


@query()
def flt11_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Whether the text of an entry does not stand on its own."""
    c = code(spark, d).select("entry_id", "lang", "text")
    return c.select("entry_id", P.column(P.fragment, "boolean")("text", "lang").alias("is_fragment"))


@query(f"WITH {CODE_SQL}, t AS (SELECT entry_id, list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS ts FROM code), g AS (SELECT entry_id, ts, list_filter(ts, lambda x: length(x) >= 3 AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS good FROM t) SELECT entry_id, CASE WHEN len(good) > 0 THEN len(good) ELSE len(ts) END AS n FROM g")
def flt12_meaningful(spark: SparkSession, d: str) -> DataFrame:
    t = code(spark, d).select("entry_id", F.array_distinct(T.word_tokens(F.col("text"))).alias("ts")).withColumn("good", F.filter("ts", T.meaningful))
    return t.select("entry_id", F.when(F.size("good") > 0, F.size("good")).otherwise(F.size("ts")).cast("long").alias("n"))


@query(f"WITH {CODE_SQL} SELECT entry_id FROM code WHERE stop - start >= 5")
def flt13_min_lines(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).where("stop - start >= 5").select("entry_id")


@query(f"WITH {SCORED_SQL} SELECT row_id FROM scored WHERE bpe_score >= 3.5")
def flt14_min_severity(spark: SparkSession, d: str) -> DataFrame:
    """At least suspicious at a threshold of 3."""
    return scored(spark, d).where(T.severity_rank(T.severity(F.col("bpe_score"), F.lit(3.0))) >= 1).select("row_id")


@query(f"WITH {SCORED_SQL} SELECT row_id FROM scored WHERE coalesce(stage1_flagged, false) OR coalesce(stage2_flagged, false) OR bpe_score >= 2.5")
def flt15_display(spark: SparkSession, d: str) -> DataFrame:
    """Flagged rows, and all with at least an overriding score."""
    flagged = F.coalesce("stage1_flagged", F.lit(False)) | F.coalesce("stage2_flagged", F.lit(False))
    return scored(spark, d).where(flagged | (F.col("bpe_score") >= 2.5)).select("row_id")


@query(f"WITH {SCORED_SQL} SELECT row_id FROM scored WHERE is_break = false AND coalesce(scorer_reason, 'none') NOT IN ('atypical', 'atypical_file', 'excluded_path', 'auto_generated')")
def flt16_eligible(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).where((F.col("is_break") == False) & eligible(F.col("scorer_reason"))).select("row_id")  # noqa: E712


_PY, _TS = (", ".join(f"'{x}'" for x in xs) for xs in (T.PYTHON_NOISE, T.TYPESCRIPT_NOISE))


@query(f"WITH {CODE_SQL} SELECT lang, name, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM code) WHERE NOT (lang = 'python' AND name IN ({_PY}) OR lang = 'typescript' AND name IN ({_TS})) GROUP BY lang, name")
def flt17_noise(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers without the words of the language."""
    noise = spark.createDataFrame([("python", x) for x in T.PYTHON_NOISE] + [("typescript", x) for x in T.TYPESCRIPT_NOISE], "lang string, name string")
    n = code(spark, d).select("lang", F.explode(T.identifiers(F.col("text"))).alias("name")).groupBy("lang", "name").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(noise), ["lang", "name"], "left_anti")  # a fixed list


@query("SELECT commit_sha, file_path FROM hunks WHERE commit_sha IS NOT NULL AND file_path IS NOT NULL AND hunk_start_line >= 0 AND hunk_end_line > hunk_start_line AND parent_sha IS NOT NULL AND try_cast(nullif(trim(author_date_iso), '') AS BIGINT) IS NOT NULL")
def flt18_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Records with missing or unreadable fields are skipped."""
    stamp = F.try_to_number(F.nullif(F.trim("author_date_iso"), F.lit("")), F.lit("9999999999999"))
    return table(spark, d, "hunks").where(F.col("commit_sha").isNotNull() & F.col("file_path").isNotNull() & (F.col("hunk_start_line") >= 0) & (F.col("hunk_end_line") > F.col("hunk_start_line")) & F.col("parent_sha").isNotNull() & stamp.isNotNull()).select("commit_sha", "file_path")


@query("SELECT name, pos FROM (VALUES ('skeinly', 0), ('quarvel', 1), ('nosuch', 2), ('gantrix', 3)) r(name, pos) WHERE name IN (SELECT name FROM targets)")
def flt19_select_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Corpora by name in the order asked for; unknown ones are no rows."""
    asked = spark.createDataFrame([(x, i) for i, x in enumerate(("skeinly", "quarvel", "nosuch", "gantrix"))], "name string, pos int")
    return asked.join(table(spark, d, "targets").select("name"), "name", "left_semi")
