"""Queries of operators on source texts, fixtures and histories that the tables do not hold, over the small sources of `samples`.

The rows of the parsers are compared with rows worked out by hand; the others with SQL over the same sources.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as T
from ..operators import history
from ..session import cut, shared_path
from ..sources import git
from . import samples as S
from .q_sources import LINES
from .registry import query


def sources(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([x for x in S.SOURCES if not ids or x[0] in ids], "id int, lang string, text string")


def _values(spark: SparkSession, f: Callable, returns: str, name: str, *ids: int) -> DataFrame:
    return sources(spark, *ids).select("id", P.column(f, returns)("text", "lang").alias(name))


@query(S.by_hand([(1, "__future__"), (1, "os"), (1, "json"), (1, "alpha"), (1, "gamma")], "id, module"))
def ext1_imports(spark: SparkSession, d: str) -> DataFrame:
    """Top-level names of absolute imports of Python; a text that does not parse has none."""
    return _values(spark, lambda t, g: P.python_imports(t), "array<string>", "m", 1, 3, 10).select("id", F.explode("m").alias("module"))


@query(S.by_hand([(2, "react"), (2, "side-effect"), (2, "@scope/pkg/types"), (2, "fs")], "id, spec"))
def ext2_imports_typescript(spark: SparkSession, d: str) -> DataFrame:
    """Full specifiers of imports, side effects and required modules that are not relative; errors do no harm."""
    return _values(spark, lambda t, g: P.typescript_imports(t), "array<string>", "m", 2, 5).select("id", F.explode("m").alias("spec"))


@query(S.by_hand([(1, "__future__", 3, 5, 15), (1, "os", 4, 7, 9), (1, "json", 4, 11, 15), (1, "alpha", 5, 7, 17), (1, "gamma", 6, 5, 16), (2, "react", 2, 33, 38), (2, "side-effect", 4, 8, 19), (2, "@scope/pkg/types", 5, 24, 40), (2, "fs", 6, 20, 22)], "id, spec, line, col0, col1"))
def ext3_import_places(spark: SparkSession, d: str) -> DataFrame:
    """Imports with their places, in order."""
    return _values(spark, P.import_spans, "array<struct<spec: string, line: int, col0: int, col1: int>>", "s").select("id", F.explode("s").alias("s")).select("id", "s.*")


_LINE_IMPORT = r"^\s*(?:import|from)\s+([A-Za-z_]\w*)"


@query(f"SELECT DISTINCT id, regexp_extract(x, '{_LINE_IMPORT}', 1) AS module FROM (SELECT id, unnest(string_split(text, chr(10))) AS x FROM {S.values(S.SOURCES, 'id, lang, text')} WHERE lang = 'python') WHERE regexp_matches(x, '{_LINE_IMPORT}')")
def ext4_import_lines(spark: SparkSession, d: str) -> DataFrame:
    """Imports by the look of lines, also where the text does not parse."""
    return _values(spark, lambda t, g: P.import_names_by_line(t) if g == "python" else [], "array<string>", "m").select("id", F.explode("m").alias("module"))


@query(S.by_hand([(1, c) for c in ("ValueError", "os.path.join", "str", "os.getenv", "self.run", "j.dumps", "print", "print", "first")] + [(2, c) for c in ("require", "require", "go", "helper.run", "fetch")], "id, callee"))
def ext5_callees_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Dotted callees by parser."""
    return _values(spark, P.callees, "array<string>", "c", 1, 2).select("id", F.explode_outer("c").alias("callee"))


@query(S.by_hand([(1, 13, 21), (1, 23, 34)], "id, first, last"))
def ext6_units_python(spark: SparkSession, d: str) -> DataFrame:
    """Functions and classes on module level, decorators left out."""
    return _values(spark, P.sampleable, "array<struct<first: int, last: int>>", "u", 1, 3).select("id", F.explode("u").alias("u")).select("id", "u.*")


@query(S.by_hand([(2, 10, 14), (2, 15, 17), (2, 18, 18), (2, 19, 19), (2, 20, 20)], "id, first, last"))
def ext7_units_typescript(spark: SparkSession, d: str) -> DataFrame:
    """Functions, classes, interfaces, type aliases and declarators that hold a function."""
    return _values(spark, P.sampleable, "array<struct<first: int, last: int>>", "u", 2).select("id", F.explode("u").alias("u")).select("id", "u.*")


@query(S.by_hand([(1, 3, 2, 1, 3, False), (3, 0, 0, 0, 0, True), (4, 0, 0, 0, 0, False), (5, 0, 0, 0, 1, True)], "id, n_returns, n_throws, n_awaits, max_nesting, is_fragment"))
def ext11_shape_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Returns, throws, awaits, nesting, and whether a text does not stand on its own."""
    s = P.struct_column(P.shape, ("n_returns", "n_throws", "n_awaits", "max_nesting", "n_identifiers"), "n_returns int, n_throws int, n_awaits int, max_nesting int, n_identifiers int")
    return sources(spark, 1, 3, 4, 5).select("id", s("text", "lang").alias("s"), P.column(P.fragment, "boolean")("text", "lang").alias("is_fragment")).select("id", "s.n_returns", "s.n_throws", "s.n_awaits", "s.max_nesting", "is_fragment")


@query(S.by_hand([(4, k, n) for k, n in (("Module", 1), ("Assign", 2), ("Name", 3), ("Store", 2), ("Load", 1), ("Constant", 2), ("BinOp", 1), ("Add", 1))], "id, node_type, n"))
def ext11_node_types(spark: SparkSession, d: str) -> DataFrame:
    """The twenty commonest kinds of nodes."""
    return _values(spark, lambda t, g: P.node_types(t), "map<string,int>", "m", 4).select("id", F.explode("m").alias("node_type", "n"))


@query(S.by_hand([(1, [1, 2, 6, 14, 19, 20]), (3, []), (10, [])], "id, prose"))
def prj10_prose_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Lines of docstrings, long strings and comments of Python; none where it does not parse."""
    return _values(spark, P.prose_lines, "array<int>", "prose", 1, 3, 10)


@query(S.by_hand([(2, [1, 8, 9, 16]), (5, [])], "id, prose"))
def prj11_prose_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Lines that comments of TypeScript touch."""
    return _values(spark, P.prose_lines, "array<int>", "prose", 2, 5)


def _blanked(rows: tuple, text: str) -> str:
    return "\n".join("" if i in rows else x for i, x in enumerate(text.split("\n"), 1))


@query(S.by_hand([(1, _blanked((1, 2, 6, 14, 19, 20), S.PYTHON)), (2, _blanked((1, 8, 9, 16), S.TYPESCRIPT))], "id, body"))
def prj8_blanked_samples(spark: SparkSession, d: str) -> DataFrame:
    """Lines of prose emptied, as found by parser."""
    return _values(spark, P.blank_prose, "string", "body", 1, 2)


@query(S.by_hand([(1, "\n".join(S.PYTHON.split("\n")[2:8])), (3, "import os\nfrom lib.sub import y"), (10, "")], "id, imports"))
def prj14_import_block(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a text's imports."""
    return _values(spark, lambda t, g: P.import_block(t), "string", "imports", 1, 3, 10)


_FIX = f"f AS (SELECT id, {LINES} AS ls, first, last, host, host_at FROM {S.values(S.FIXTURES, 'id, text, first, last, host, host_at')})"
_STRIP = r"s AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, '^\s*(//|#)\s*Break\s*:')) AS kept, len(list_filter(ls[1:greatest(first - 1, 0)], lambda x: NOT regexp_matches(x, '^\s*(//|#)\s*Break\s*:'))) AS before, len(list_filter(ls[greatest(first, 1):last], lambda x: NOT regexp_matches(x, '^\s*(//|#)\s*Break\s*:'))) AS inside FROM f)"


def fixtures(spark: SparkSession) -> DataFrame:
    f = spark.createDataFrame(S.FIXTURES, "id int, text string, first int, last int, host string, host_at int")
    return f.withColumn("ls", T.lines(F.col("text")))


@query(f"WITH {_FIX}, {_STRIP}, g AS (SELECT *, first >= 1 AND last <= len(ls) AND inside > 0 AS ok FROM s) SELECT id, array_to_string(CASE WHEN ok THEN kept ELSE ls END, chr(10)) AS body, (CASE WHEN ok THEN before + 1 ELSE first END)::INT AS first, (CASE WHEN ok THEN before + inside ELSE last END)::INT AS last FROM g")
def prj13_strip_break_marks(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name the fixture taken out and the bounds moved along."""
    s = fixtures(spark).select("id", T.strip_marks(F.col("ls"), F.col("first"), F.col("last")).alias("s"))
    return s.select("id", F.array_join("s.ls", "\n").alias("body"), "s.first", "s.last")


@query(f"WITH {_FIX}, h AS (SELECT id, ls, first, last, host_at, CASE WHEN host = '' THEN [] ELSE string_split(regexp_replace(host, '\\n\\z', ''), chr(10)) END AS hl FROM f WHERE first >= 1 AND last >= first AND host_at >= 1), i AS (SELECT *, least(host_at - 1, len(hl)) AS above FROM h) SELECT id, array_to_string(list_concat(list_concat(hl[1:above], ls), hl[above + 1:]), chr(10)) AS body, (above + first)::INT AS first, (above + last)::INT AS last FROM i")
def prj12_inject_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Each fixture set into its own host at its own line; wrong bounds give no row."""
    s = fixtures(spark).select("id", T.inject(F.col("ls"), F.col("first"), F.col("last"), T.lines(F.col("host")), F.col("host_at")).alias("s")).where("s is not null")
    return s.select("id", F.array_join("s.ls", "\n").alias("body"), "s.first", "s.last")


@query(S.by_hand([(6, round(2 / 3, 6), True), (7, 0.0, False), (10, 0.0, False)], "id, ratio, dominant"))
def flt5_data_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Share of lines that assign literal containers, Python."""
    return _values(spark, P.data_ratio, "double", "r", 6, 7, 10).select("id", F.round("r", 6).alias("ratio"), (F.col("r") > 0.65).alias("dominant"))


@query(S.by_hand([(5, 0.0, False), (8, 1.0, True), (9, round(2 / 3, 6), True)], "id, ratio, dominant"))
def flt6_data_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """The same of TypeScript."""
    return _values(spark, P.data_ratio, "double", "r", 5, 8, 9).select("id", F.round("r", 6).alias("ratio"), (F.col("r") > 0.65).alias("dominant"))


@query(S.by_hand([(4, 0.4, 0.0, 5), (10, 0.0, 0.0, 0), (11, 0.5, 0.0, 4)], "id, literal_ratio, control_density, n_leaves"))
def flt7_typicality_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Leaves, literals among them and control words by parser."""
    t = P.struct_column(P.typicality, ("literal_ratio", "control_density", "entropy", "distinct_ratio", "n_leaves"), "literal_ratio double, control_density double, entropy double, distinct_ratio double, n_leaves int")
    return sources(spark, 4, 10, 11).select("id", t("text", "lang").alias("t")).select("id", "t.literal_ratio", "t.control_density", "t.n_leaves")


@query(S.by_hand([(1, False), (2, False), (3, True), (5, True), (10, False)], "id, is_fragment"))
def flt11_fragments_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Texts that do not stand on their own."""
    return _values(spark, P.fragment, "boolean", "is_fragment", 1, 2, 3, 5, 10)


@query(S.by_hand([(1, round(3 / 9, 6), 0.5, 0.5), (2, 1.0, 0.0, 1.0), (3, None, None, None), (4, None, None, None)], "id, scope, handlers, guards"))
def shp3_values_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """What three shape primitives measure: calls outside functions (all of them in TypeScript, whose functions have another name in the
    grammar), returns among returns and raises of handlers, ifs before the first return."""
    v = lambda f: F.round(P.column(f, "double")("text", "lang"), 6)
    return sources(spark, 1, 2, 3, 4).select("id", v(P.module_scope_share).alias("scope"), v(P.handler_ratio).alias("handlers"), v(P.guards).alias("guards"))


@query(
    f"WITH RECURSIVE e AS (SELECT * FROM {S.values(S.EDGES, 'sha, parent')}), r AS (SELECT * FROM {S.values(S.RANGES, 'ref, a, b')}),"
    " ends AS (SELECT ref, b AS sha, true AS wanted FROM r UNION ALL SELECT ref, coalesce(a, e.parent), false FROM r LEFT JOIN e ON r.a IS NULL AND e.sha = r.b),"
    " w AS (SELECT * FROM ends WHERE sha IS NOT NULL UNION SELECT w.ref, e.parent, w.wanted FROM w JOIN e ON e.sha = w.sha WHERE e.parent IS NOT NULL)"
    " SELECT ref, sha FROM w GROUP BY ref, sha HAVING bool_and(wanted)"
)
def src3_commit_range(spark: SparkSession, d: str) -> DataFrame:
    """The commits of ranges A..B, and of single references, by parents; a merge has two."""
    return history.commit_ranges(spark.createDataFrame(S.EDGES, "sha string, parent string"), spark.createDataFrame(S.RANGES, "ref string, start string, end string"))


_LONG = "list_transform(range(1, 131), lambda i: 'L' || i)"


def _about(spark: SparkSession) -> DataFrame:
    ls = F.transform(F.sequence(F.lit(1), F.lit(130)), lambda i: F.concat(F.lit("L"), i.cast("string")))
    b = spark.createDataFrame(S.BOUNDS, "id int, hs int, he int")
    return b.select("id", T.context(ls, F.col("hs"), F.col("he")).alias("c")).where("c is not null")


@query(f"SELECT id, array_to_string(ls[greatest(hs - 50, 0) + 1:hs], ' ') AS before, array_to_string(ls[hs + 1:he], ' ') AS hunk, array_to_string(ls[he + 1:least(he + 50, 130)], ' ') AS after FROM (SELECT *, {_LONG} AS ls FROM {S.values(S.BOUNDS, 'id, hs, he')}) WHERE hs >= 0 AND he <= 130")
def prj1_context_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with up to fifty lines before and behind them."""
    part = lambda c: F.array_join(f"c.{c}", " ").alias(c)
    return _about(spark).select("id", part("before"), part("hunk"), part("after"))


@query(f"SELECT id, array_to_string(ls[hs + 1:he], ' ') AS hunk FROM (SELECT *, {_LONG} AS ls FROM {S.values(S.BOUNDS, 'id, hs, he')}) WHERE hs >= 0 AND he <= 130")
def prj2_slices_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Fragments by their bounds, dropped where these lie outside the text."""
    return _about(spark).select("id", F.array_join("c.hunk", " ").alias("hunk"))


@query(S.by_hand([(1,), (4,), (9,)], "id"))
def flt4_scope_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Files that a check looks at: of a language, not excluded by their path, not mostly data."""
    paths = spark.createDataFrame(S.PATHS, "id int, path string, of int")
    known = paths.where(T.language(F.col("path"), T.SCORE_LANGUAGE).isNotNull() & ~T.excluded(F.col("path")))
    src = sources(spark).select(F.col("id").alias("of"), P.column(P.data_ratio, "double")("text", "lang").alias("r"))
    return known.join(src, "of").where("r <= 0.65").select("id")


def _repository(spark: SparkSession) -> str:
    """A small repository in the shared folder with changes of its working tree, its index and a new file; needs the git program."""
    root = shared_path(spark, "repository").removeprefix("file:")
    os.makedirs(root)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", root, *a], check=True, capture_output=True)

    def write(name: str, text: str) -> None:
        with open(os.path.join(root, name), "w") as f:
            f.write(text)

    run("init", "-q", ".")
    write("a.py", "one\ntwo\n"), write("s.py", "1\n2\n3\n")
    run("add", "."), run("commit", "-qm", "1")
    write("s.py", "1\nTWO\n3\nfour\n")
    run("add", "s.py")
    write("s.py", "not in the index\n"), write("a.py", "ONE\ntwo\n"), write("new.ts", "x\ny"), write("empty.ts", "")
    return root


@query(S.by_hand([("workdir", "a.py", 0, 1, "ONE\ntwo\n"), ("workdir", "s.py", 0, 1, "not in the index\n"), ("staged", "s.py", 1, 2, "1\nTWO\n3\nfour\n"), ("staged", "s.py", 3, 4, "1\nTWO\n3\nfour\n"), ("untracked", "new.ts", 0, 2, "x\ny")], "source, path, first, behind, content"))
def src4_working_tree(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of a repository: working tree against index, index against the last commit with the index's content, and new files."""
    root = _repository(spark)
    spark.dataSource.register(git.GitHunks)
    out = None
    for mode in ("workdir", "staged", "untracked"):
        got = spark.read.format("git_hunks").option("mode", mode).load(root)
        got = got.select(F.lit(mode).alias("source"), "path", F.col("hunk_start").alias("first"), F.col("hunk_end").alias("behind"), F.decode("content", "UTF-8").alias("content"))
        out = got if out is None else out.unionByName(got)
    out = cut(out)
    shutil.rmtree(root, ignore_errors=True)
    return out
