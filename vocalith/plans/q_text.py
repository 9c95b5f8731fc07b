"""Queries of projections and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..session import table
from ..sources.tables import CODE_SQL, HUNKS_SQL, SCORED_SQL, code, hunks, scored
from .registry import query

LINES = r"CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n\z', ''), chr(10)) END"
_L = f"{CODE_SQL}, l AS (SELECT *, {LINES} AS ls FROM code)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).withColumn("ls", T.lines(F.col("text")))


@query(f"WITH {_L} SELECT entry_id, array_to_string(list_slice(ls, greatest(1, 5 - 3), 4), chr(10)) AS before, array_to_string(list_slice(ls, 5, least(8, len(ls))), chr(10)) AS hunk, array_to_string(list_slice(ls, 9, least(11, len(ls))), chr(10)) AS after FROM l WHERE len(ls) >= 5")
def prj1_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines 5 to 8 with three lines of context, clamped to the file."""
    part = lambda a, n: F.array_join(F.slice("ls", a, n), "\n")
    return _lines(spark, d).where(F.size("ls") >= 5).select("entry_id", part(2, 3).alias("before"), part(5, 4).alias("hunk"), part(9, 3).alias("after"))


@query(f"WITH {_L} SELECT entry_id, array_to_string(list_slice(ls, 3, (stop - start) // 2 + 2), chr(10)) AS hunk FROM l WHERE start >= 0 AND (stop - start) // 2 + 2 <= len(ls)")
def prj2_hunk_slice(spark: SparkSession, d: str) -> DataFrame:
    """A slice by bounds, dropped where it is out of bounds."""
    half = F.floor((F.col("stop") - F.col("start")) / 2).cast("int")
    return _lines(spark, d).where((F.col("start") >= 0) & (half + 2 <= F.size("ls"))).select("entry_id", F.array_join(F.slice("ls", F.lit(3), F.greatest(half, F.lit(0))), "\n").alias("hunk"))


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs, t.text AS text, t.start_line - hs AS line FROM (SELECT commit_sha, file_path, hs, unnest(tokens) AS t FROM hunks1)")
def prj3_token_lines(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with lines relative to their fragment."""
    h = hunks(spark, d)
    moved = F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), (t["start_line"] - F.col("hs")).alias("line")))
    return h.select("commit_sha", "file_path", "hs", F.explode(moved).alias("t")).select("commit_sha", "file_path", "hs", "t.text", "t.line")


_CASE = "CASE WHEN e = '.py' THEN 'python' WHEN e IN ('.ts', '.tsx') THEN 'typescript' WHEN e IN ('.js', '.jsx') THEN '{js}' END"
_EXT = "(SELECT *, lower(regexp_extract(file_path, '(\\.[^./\\\\]+)$', 1)) AS e FROM hunks1)"


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs, {_CASE.format(js='javascript')} AS lang FROM {_EXT}")
def prj4_language_extract(spark: SparkSession, d: str) -> DataFrame:
    return hunks(spark, d).select("commit_sha", "file_path", "hs", T.language(F.col("file_path"), T.EXTRACT_LANGUAGE).alias("lang"))


@query(f"WITH {HUNKS_SQL} SELECT commit_sha, file_path, hs, {_CASE.format(js='typescript')} AS lang FROM {_EXT}")
def prj5_language_score(spark: SparkSession, d: str) -> DataFrame:
    return hunks(spark, d).select("commit_sha", "file_path", "hs", T.language(F.col("file_path"), T.SCORE_LANGUAGE).alias("lang"))


@query(f"WITH {CODE_SQL} SELECT corpus, lang, count(*) AS n FROM code GROUP BY corpus, lang")
def prj6_by_language(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).groupBy("corpus", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CODE_SQL}, n AS (SELECT corpus, lang, count(*) AS n, min(entry_id) AS first FROM code GROUP BY corpus, lang) SELECT DISTINCT ON (corpus) corpus, lang FROM n ORDER BY corpus, n DESC, first")
def prj7_dominant_language(spark: SparkSession, d: str) -> DataFrame:
    """The commonest language of each corpus, the first seen of several."""
    n = code(spark, d).groupBy("corpus", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first"))
    return n.groupBy("corpus").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


@query(f"WITH {_L} SELECT entry_id, array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^\\s*(#|//)') THEN '' ELSE x END), chr(10)) AS body FROM l")
def prj8_blank_prose(spark: SparkSession, d: str) -> DataFrame:
    """Comment lines blanked, the number of lines kept."""
    return _lines(spark, d).select("entry_id", F.array_join(F.transform("ls", lambda x: F.when(x.rlike("^\\s*(#|//)"), "").otherwise(x)), "\n").alias("body"))


@query(f"WITH {_L} SELECT entry_id, list_transform(list_filter(range(1, len(ls) + 1), lambda i: i BETWEEN 2 AND 6 AND regexp_matches(ls[i], '^\\s*(#|//)')), lambda i: i - 1)::INT[] AS prose FROM l")
def prj9_local_prose(spark: SparkSession, d: str) -> DataFrame:
    """Comment lines of a file, numbered within the fragment of lines 2 to 6."""
    at = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike("^\\s*(#|//)"), i + 1)), lambda i: i.isNotNull() & i.between(2, 6))
    return _lines(spark, d).select("entry_id", F.transform(at, lambda i: i - 1).alias("prose"))


def _parsed(spark: SparkSession, d: str, f, returns: str, name: str, lang: str | None = None) -> DataFrame:  # noqa: ANN001
    c = code(spark, d)
    c = c.where(F.col("lang") == lang) if lang else c
    return c.select("entry_id", P.column(f, returns)("text", "lang").alias(name))


@query()
def prj10_prose_python(spark: SparkSession, d: str) -> DataFrame:
    """Lines of comments and long strings of Python files."""
    return _parsed(spark, d, P.prose_lines, "array<int>", "prose", "python")


@query()
def prj11_prose_typescript(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, P.prose_lines, "array<int>", "prose", "typescript")


@query(f"WITH {_L}, f AS (SELECT corpus, arg_min(ls, entry_id) AS host FROM l GROUP BY corpus) SELECT entry_id, array_to_string(list_concat(list_concat(list_slice(host, 1, least(4, len(host))), ls), list_slice(host, 5, len(host))), chr(10)) AS body, least(4, len(host)) + 1 AS start_line, least(4, len(host)) + len(ls) AS end_line FROM l JOIN f USING (corpus)")
def prj12_inject(spark: SparkSession, d: str) -> DataFrame:
    """Each fragment set into its corpus' first file before line 5, appended where the file is shorter; bounds move along."""
    c = _lines(spark, d)
    hosts = c.groupBy("corpus").agg(F.min_by("ls", "entry_id").alias("host"))
    at = F.least(F.lit(4), F.size("host"))
    body = F.concat(F.slice("host", F.lit(1), at), F.col("ls"), F.slice("host", F.lit(5), F.greatest(F.size("host") - 4, F.lit(0))))
    return c.join(F.broadcast(hosts), "corpus").select("entry_id", F.array_join(body, "\n").alias("body"), (at + 1).cast("long").alias("start_line"), (at + F.size("ls")).cast("long").alias("end_line"))  # a host per corpus


_DOTS = "(SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b[a-z]+\\.[a-z][a-z_0-9]*'))) AS spec FROM documents)"


def specs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, spec): the dotted module names of each document once."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\b[a-z]+\\.[a-z][a-z_0-9]*"), 0))).alias("spec"))


@query(f"SELECT DISTINCT spec, string_split(spec, '.')[1] AS top FROM {_DOTS}")
def prj15_top_level(spark: SparkSession, d: str) -> DataFrame:
    return specs(spark, d).select("spec", T.top_level(F.col("spec")).alias("top")).distinct()


KEYWORDS = r"\b(def|function|class|if|for|while|with|switch|catch|return|await|new|in|not|and|or|is)\b"
_CALLS = rf"calls AS (SELECT entry_id, corpus, lang, side, path, unnest(regexp_extract_all(regexp_replace(text, '{KEYWORDS}', chr(1), 'g'), '([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)\(', 1)) AS callee FROM code)"
CALLS_SQL = f"{CODE_SQL}, {_CALLS}"


@query(f"WITH {CALLS_SQL} SELECT DISTINCT callee, string_split(callee, '.')[1] AS root FROM calls")
def prj16_callee_root(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).select(F.explode(T.callees(F.col("text"))).alias("callee")).distinct().withColumn("root", T.namespace(F.col("callee")))


@query("SELECT x AS raw, regexp_replace(x, '^[\"''`]|[\"''`]$', '', 'g') AS bare, starts_with(regexp_replace(x, '^[\"''`]|[\"''`]$', '', 'g'), './') OR starts_with(regexp_replace(x, '^[\"''`]|[\"''`]$', '', 'g'), '../') AS relative FROM (SELECT DISTINCT unnest(regexp_extract_all(hunk_content, '''[^''\\n]*''')) AS x FROM manifest_entries)")
def prj17_quotes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "manifest_entries").select(F.explode(F.regexp_extract_all("hunk_content", F.lit("'[^'\\n]*'"), 0)).alias("raw")).distinct()
    return q.select("raw", T.unquote(F.col("raw")).alias("bare")).withColumn("relative", T.relative(F.col("bare")))


@query(f"WITH {HUNKS_SQL}, s AS (SELECT commit_sha, file_path, hs, list_transform(before, lambda t: t.text) AS b, list_transform(tokens, lambda t: t.text) AS h, list_transform(after, lambda t: t.text) AS a FROM hunks1), r AS (SELECT *, least(len(h), 16) AS nh, greatest(0, 16 - len(h)) AS room FROM s), w AS (SELECT *, least(len(b), room // 2 + greatest(0, room - room // 2 - len(a))) AS nb FROM r) SELECT commit_sha, file_path, hs, array_to_string(list_concat(list_concat(list_slice(b, len(b) - nb + 1, len(b)), list_slice(h, 1, nh)), list_slice(a, 1, least(len(a), room - nb))), ' ') AS window_text FROM w")
def prj18_token_window(spark: SparkSession, d: str) -> DataFrame:
    """A window of 16 tokens about a fragment: its head, then the end of what stands before and the start of what follows."""
    text = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<text:string,node_type:string,start_line:int,end_line:int>>")), lambda t: t["text"])
    s = hunks(spark, d).select("commit_sha", "file_path", "hs", text("before").alias("b"), text("tokens").alias("h"), text("after").alias("a"))
    room = F.greatest(F.lit(0), 16 - F.size("h"))
    half = F.floor(room / 2).cast("int")
    nb = F.least(F.size("b"), half + F.greatest(F.lit(0), room - half - F.size("a")))
    win = F.concat(F.slice("b", F.size("b") - nb + 1, nb), F.slice("h", F.lit(1), F.least(F.size("h"), F.lit(16))), F.slice("a", F.lit(1), F.least(F.size("a"), room - nb)))
    return s.select("commit_sha", "file_path", "hs", F.array_join(win, " ").alias("window_text"))


@query(f"WITH {SCORED_SQL} SELECT row_id, CASE WHEN bpe_score >= 3.0 + 1.5 THEN 'foreign' WHEN bpe_score >= 3.0 + 0.5 THEN 'suspicious' ELSE 'unusual' END AS severity FROM scored")
def prj19_severity(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("row_id", T.severity(F.col("bpe_score"), F.lit(3.0)).alias("severity"))


@query(f"WITH {SCORED_SQL} SELECT row_id, CASE WHEN hunk_start_line = hunk_end_line THEN 'L' || hunk_start_line ELSE 'L' || hunk_start_line || '-' || hunk_end_line END AS label, CASE scorer_reason WHEN 'import' THEN 'foreign import' WHEN 'call_receiver' THEN 'unfamiliar call' WHEN 'bpe' THEN 'rare tokens' WHEN 'none' THEN 'below threshold' ELSE scorer_reason END AS why FROM scored WHERE hunk_start_line IS NOT NULL AND hunk_end_line IS NOT NULL")
def prj20_labels(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("hunk_start_line is not null and hunk_end_line is not null")
    return s.select("row_id", T.line_label(F.col("hunk_start_line"), F.col("hunk_end_line")).alias("label"), T.friendly_reason(F.col("scorer_reason")).alias("why"))


# ---- extraction


@query()
def ext3_import_spans(spark: SparkSession, d: str) -> DataFrame:
    """Imports with their places, by parser, over files that begin with an import of each module they call."""
    c = code(spark, d)
    root = F.transform(F.slice(F.array_sort(F.array_distinct(T.callees(F.col("text")))), 1, 3), T.namespace)
    head = F.when(F.col("lang") == "python", F.array_join(F.transform(root, lambda r: F.concat(F.lit("import "), r)), "\n")).otherwise(F.array_join(F.transform(root, lambda r: F.concat(F.lit("import '"), r, F.lit("';"))), "\n"))
    full = c.withColumn("text", F.concat_ws("\n", head, "text"))
    spans = P.column(P.import_spans, "array<struct<spec: string, line: int, col0: int, col1: int>>")
    return full.select("entry_id", F.explode(spans("text", "lang")).alias("s")).select("entry_id", "s.*")


@query(f"WITH {CALLS_SQL} SELECT entry_id, callee, count(*) AS n FROM calls GROUP BY entry_id, callee")
def ext5_callees(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).select("entry_id", F.explode(T.callees(F.col("text"))).alias("callee")).groupBy("entry_id", "callee").agg(F.count(F.lit(1)).alias("n"))


@query()
def ext5_callees_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Callees by parser; roots that are no name stay null so that they count."""
    return _parsed(spark, d, P.callees, "array<string>", "callees").select("entry_id", F.explode_outer("callees").alias("callee"))


@query()
def ext6_sampleable_python(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, P.sampleable, "array<struct<first: int, last: int>>", "u", "python").select("entry_id", F.explode("u").alias("u")).select("entry_id", "u.first", "u.last")


@query()
def ext7_sampleable_typescript(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, P.sampleable, "array<struct<first: int, last: int>>", "u", "typescript").select("entry_id", F.explode("u").alias("u")).select("entry_id", "u.first", "u.last")


@query(f"WITH {CODE_SQL} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*\\b')) AS name FROM code) GROUP BY name")
def ext8_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return code(spark, d).select(F.explode(T.identifiers(F.col("text"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS n_tokens FROM documents")
def ext9_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {CODE_SQL}, p AS (SELECT entry_id, text, instr(text, 'o') AS pos FROM code), x AS (SELECT entry_id, regexp_extract(substr(text, 1, pos - 1), '[A-Za-z0-9_]*$', 0) || regexp_extract(substr(text, pos), '^[A-Za-z0-9_]*', 0) AS name FROM p WHERE pos > 0) SELECT entry_id, name FROM x WHERE regexp_matches(name, '^[A-Za-z_]')")
def ext10_expand_identifier(spark: SparkSession, d: str) -> DataFrame:
    """A place within a text expanded to the identifier about it."""
    p = code(spark, d).withColumn("at", F.instr("text", "o")).where("at > 0")
    name = F.concat(F.regexp_extract(F.expr("substring(text, 1, at - 1)"), "[A-Za-z0-9_]*\\z", 0), F.regexp_extract(F.expr("substring(text, at)"), "^[A-Za-z0-9_]*", 0))
    return p.select("entry_id", name.alias("name")).where(F.col("name").rlike("^[A-Za-z_]"))


@query()
def ext11_shape(spark: SparkSession, d: str) -> DataFrame:
    """Returns, throws, awaits, nesting, identifiers and whether the text is a fragment."""
    c = code(spark, d)
    names = ("n_returns", "n_throws", "n_awaits", "max_nesting", "n_identifiers")
    s = P.struct_column(P.shape, names, ", ".join(f"{n} int" for n in names))
    return c.select("entry_id", s("text", "lang").alias("s"), P.column(P.fragment, "boolean")("text", "lang").alias("is_fragment")).select("entry_id", "s.*", "is_fragment")
