"""Expressions on paths, lines and names, all of built-in functions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language (fixed values): as extracted, and as scored, where JavaScript counts as TypeScript
EXTRACT_LANGUAGE = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python"}
SCORE_LANGUAGE = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript"}

# Directories left out when normal fragments are sampled, and when a corpus is collected (fixed values)
SAMPLE_EXCLUDED = ("test", "tests", "doc", "docs", "examples", "example", "migrations", "migration", "benchmarks", "benchmark", "fixtures", "scripts", "build", "dist", "__pycache__", ".git", ".history", ".tox", ".eggs")
CORPUS_EXCLUDED = ("node_modules", ".git", ".tox", ".eggs", "__pycache__", "build", "dist", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", "test", "tests", "__tests__", "benchmarks")

# Words that say nothing of a repository (fixed values): keywords, literals and implicit names of each language
PYTHON_NOISE = ("False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield", "match", "case", "self", "cls")
TYPESCRIPT_NOISE = ("abstract", "any", "as", "asserts", "assert", "async", "await", "boolean", "break", "case", "catch", "class", "const", "constructor", "continue", "debugger", "declare", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "from", "function", "get", "global", "if", "implements", "import", "in", "infer", "instanceof", "interface", "is", "keyof", "let", "module", "namespace", "never", "new", "null", "number", "object", "of", "package", "private", "protected", "public", "readonly", "require", "return", "satisfies", "set", "static", "string", "super", "switch", "symbol", "this", "throw", "true", "try", "type", "typeof", "undefined", "unique", "unknown", "var", "void", "while", "with", "yield", "arguments")

# Header phrases of generated files (fixed values); the strong ones count within the first ten lines on their own
STRONG_MARKERS = ("do not edit", "do not modify")
GENERATED_MARKERS = ("auto generated", "auto-generated", "autogenerated", "auto_generated", "automatically generated", "automatically-generated", "automatically created", "machine generated", "machine-generated", "machine created", "programmatically generated", "computer generated", "computer-generated", "generated by", "generated file", "generated code", "generated from", "generated source", "this file was generated", "this file is generated", "this file has been generated", "this file was automatically", "this file is automatically", "this is a generated file", "this file was created by", "this module is generated", "@generated", "@ generated", "do not edit", "do not modify", "do not change this file", "please do not edit", "please do not modify", "source of this file is", "created by transcrypt", "output of", "produced by", "compiled from", "transpiled from")
PYTHON_MARKERS = ("created by pythran", "rendered by templite")


def lines(c: Column) -> Column:
    """The lines of a text: any line end, no empty element for a last line end, no lines for an empty text."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), "\n\\z", "")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(t, "\n"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))


def language(path: Column, table: dict[str, str]) -> Column:
    """The language of a path by its extension; null where the table has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), extension(path))


def top_level(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


namespace = top_level  # of a callee: what stands before its first dot


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"'`]|[\"'`]$", "")


def relative(spec: Column) -> Column:
    return spec.startswith("./") | spec.startswith("../")


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]*\b"), 0)


def word_tokens(c: Column) -> Column:
    """The default tokenizer: runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}_]+"), 0)


def meaningful(token: Column) -> Column:
    return (F.length(token) >= 3) & token.rlike("[\\p{L}\\p{N}]")


def callees(c: Column) -> Column:
    """Dotted callees by pattern: a chain of names before an opening bracket that is no keyword or definition."""
    return F.regexp_extract_all(F.regexp_replace(c, "(?m)\\b(def|function|class|if|for|while|with|switch|catch|return|await|new|in|not|and|or|is)\\b", "\u0001"), F.lit("([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)\\("), 1)


def glob(path: Column, pattern: str) -> Column:
    """Shell patterns whose * also crosses /."""
    return path.rlike("^" + fnmatch.translate(pattern).removesuffix("\\Z").removesuffix("\\z") + "$")


def excluded(path: Column, dirs: tuple[str, ...] = SAMPLE_EXCLUDED) -> Column:
    """Whether a path relative to its root is a test, configuration or otherwise excluded file."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    above = F.slice(parts, 1, F.size(parts) - 1)
    in_dir = F.exists(above, lambda d: d.isin(*dirs) | d.startswith("test") | (d == "__tests__"))
    return in_dir | name.startswith("test_") | (name == "conftest.py") | name.contains(".test.") | name.contains(".spec.") | name.contains(".config.") | name.rlike("^\\..*rc\\.")


def generated(text_lines: Column, language_name: Column, head: int = 20) -> Column:
    """Whether a comment among the first lines says that the file is generated."""
    comment = lambda x: F.ltrim(x).startswith("#") | F.ltrim(x).startswith("//") | F.ltrim(x).startswith("/*") | F.ltrim(x).startswith("*")
    marked = lambda x, ms: x.rlike("|".join(re.escape(m).replace("\\ ", " ").replace("\\-", "-") for m in ms))
    strong = F.exists(F.slice(text_lines, 1, 10), lambda x: comment(x) & marked(F.lower(x), STRONG_MARKERS))
    any_of = F.exists(F.slice(text_lines, 1, head), lambda x: comment(x) & (marked(F.lower(x), GENERATED_MARKERS) | ((language_name == "python") & marked(F.lower(x), PYTHON_MARKERS))))
    return strong | any_of


def severity(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold + 1.5, "foreign").when(score >= threshold + 0.5, "suspicious").otherwise("unusual")


def severity_rank(name: Column) -> Column:
    return F.when(name == "foreign", 2).when(name == "suspicious", 1).otherwise(0)


def line_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("L%d", start)).otherwise(F.format_string("L%d-%d", start, end))


REASONS = {"import": "foreign import", "call_receiver": "unfamiliar call", "bpe": "rare tokens", "none": "below threshold"}


def friendly_reason(reason: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), reason), reason)


def overflow(names: Column, k: int = 3) -> Column:
    """The first k names, and how many more there are."""
    more = F.size(names) - k
    return F.when(more > 0, F.concat(F.array_join(F.slice(names, 1, k), ", "), F.format_string(" (+%d more)", more))).otherwise(F.array_join(names, ", "))


def frequency(count: Column) -> Column:
    return F.concat(F.format_number(count, 0), F.lit("×"))


def rarity(flagged: Column, total: Column, where: str, label: str, floor: int = 30) -> Column:
    return F.when(total < floor, F.lit(f"never seen in {where}")).otherwise(F.concat(flagged.cast("string"), F.lit(" of "), F.format_number(total, 0), F.lit(f" {label}")))


# ---- fragments and what stands about them


def context(text_lines: Column, start: Column, end: Column, n: int = 50) -> Column:
    """A struct (before, hunk, after) of lines: the fragment, bounds 0-indexed and half-open, and up to n lines on either side; null
    where the bounds lie outside the text."""
    above = F.greatest(start - n, F.lit(0))
    good = (start >= 0) & (start <= end) & (end <= F.size(text_lines))
    part = lambda a, b: F.slice(text_lines, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.when(good, F.struct(part(above, start).alias("before"), part(start, end).alias("hunk"), part(end, F.least(end + n, F.size(text_lines))).alias("after")))


# ---- fixtures set into other files

BREAK_MARK = r"^\s*(//|#)\s*Break\s*:"  # a line that names the fixture (fixed value)


def strip_marks(text_lines: Column, start: Column, end: Column) -> Column:
    """A struct (ls, first, last): the lines without those that name the fixture, and the bounds, 1-indexed and inclusive, of the lines
    of the fragment that are left. Bounds outside the text, or a fragment of such lines alone, leave all as it is."""
    kept = F.filter(text_lines, lambda x: ~x.rlike(BREAK_MARK))
    before = F.size(F.filter(F.slice(text_lines, F.lit(1), F.greatest(start - 1, F.lit(0))), lambda x: ~x.rlike(BREAK_MARK)))
    inside = F.size(F.filter(F.slice(text_lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), lambda x: ~x.rlike(BREAK_MARK)))
    good = (start >= 1) & (end <= F.size(text_lines)) & (inside > 0)
    return F.when(good, F.struct(kept.alias("ls"), (before + 1).alias("first"), (before + inside).alias("last"))).otherwise(F.struct(text_lines.alias("ls"), start.cast("int").alias("first"), end.cast("int").alias("last")))


def inject(text_lines: Column, start: Column, end: Column, host_lines: Column, at: Column) -> Column:
    """A struct (ls, first, last): the lines set into the host's before its line `at` (at its end where it is shorter) and where the
    fragment's bounds have gone; null for bounds or places below 1 or in the wrong order."""
    above = F.least(at - 1, F.size(host_lines)).cast("int")
    whole = F.concat(F.slice(host_lines, F.lit(1), above), text_lines, F.slice(host_lines, above + 1, F.size(host_lines)))
    return F.when((start >= 1) & (end >= start) & (at >= 1), F.struct(whole.alias("ls"), (above + start).cast("int").alias("first"), (above + end).cast("int").alias("last")))
