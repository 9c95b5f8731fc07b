"""What needs a parser: Python by the standard library's syntax tree, TypeScript by a small lexer.

All are plain functions of a text; `column` makes an Arrow-batched column function of one.
"""

from __future__ import annotations

import ast
import io
import math
import re
import tokenize
import warnings
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

warnings.filterwarnings("ignore", category=SyntaxWarning)
LITERALS = (ast.Constant, ast.JoinedStr)
_TS_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|[^\s\w]", re.S)


def tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_imports(text: str) -> list[str]:
    """Top-level names of absolute imports; none where the text does not parse."""
    t = tree(text)
    out: list[str] = []
    for n in ast.walk(t) if t else ():
        if isinstance(n, ast.Import):
            out += [a.name.split(".")[0] for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.level == 0 and n.module:
            out.append(n.module.split(".")[0])
    return list(dict.fromkeys(out))


_TS_IMPORT = re.compile(r"(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['\"]([^'\"]+)['\"]")


def typescript_imports(text: str) -> list[str]:
    """Full specifiers of imports that are not relative."""
    return list(dict.fromkeys(s for s in _TS_IMPORT.findall(text) if not s.startswith(("./", "../"))))


def import_spans(text: str, lang: str) -> list[tuple[str, int, int, int]]:
    """(specifier, line, first and last byte column) of each import, in order, repeats kept."""
    out = []
    if lang == "python":
        t = tree(text)
        rows = text.split("\n")
        for n in ast.walk(t) if t else ():
            if isinstance(n, ast.Import):
                out += [(a.name.split(".")[0], a.lineno, a.col_offset, a.col_offset + len(a.name.encode())) for a in n.names]
            elif isinstance(n, ast.ImportFrom) and n.level == 0 and n.module:
                at = rows[n.lineno - 1].find(n.module, n.col_offset + 4)
                at = max(at, 0)
                b = len(rows[n.lineno - 1][:at].encode())
                out.append((n.module.split(".")[0], n.lineno, b, b + len(n.module.encode())))
    else:
        for m in _TS_IMPORT.finditer(text):
            if not m.group(1).startswith(("./", "../")):
                line = text.count("\n", 0, m.start(1)) + 1
                start = text.rfind("\n", 0, m.start(1)) + 1
                b = len(text[start : m.start(1)].encode())
                out.append((m.group(1), line, b, b + len(m.group(1).encode())))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _dotted(n: ast.expr) -> str | None:
    parts: list[str] = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    if isinstance(n, ast.Name):
        return ".".join([n.id, *reversed(parts)])
    if isinstance(n, ast.Call) and parts:
        return ".".join(["<call>", *reversed(parts)])
    return None


def python_callees(text: str) -> list[str | None]:
    """Dotted callees in order; a chain on a call begins with <call>, other roots are null but counted."""
    t = tree(text)
    calls = [n for n in ast.walk(t) if isinstance(n, ast.Call)] if t else []
    return [_dotted(c.func) for c in sorted(calls, key=lambda c: (c.lineno, c.col_offset))]


_TS_CALL = re.compile(r"((?:\.\s*)?[A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\(")
# words of the grammar that are no leaves of their own (fixed values)
_TS_GRAMMAR = frozenset("abstract as async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in instanceof interface keyof let namespace new of private protected public readonly return satisfies set static switch throw try type typeof var void while with yield".split())
_TS_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "constructor", "super", "typeof", "await"}


def _blank(text: str) -> str:
    """A TypeScript text with its comments and strings blanked."""
    return _TS_TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.group()[0] in "\"'`" or m.group()[:2] in ("//", "/*") else m.group(), text)


_BODY = re.compile(r"\s*(?::\s*[\w<>\[\]|., ]+)?\{")


def _declares(plain: str, i: int) -> bool:
    """Whether the brackets that open at i are those of a method that is declared: a body follows them."""
    depth = 0
    for k in range(i, len(plain)):
        depth += (plain[k] == "(") - (plain[k] == ")")
        if not depth:
            return _BODY.match(plain, k + 1) is not None
    return False


def typescript_callees(text: str) -> list[str | None]:
    out: list[str | None] = []
    plain = _blank(text)
    for m in _TS_CALL.finditer(plain):
        name = re.sub(r"\s", "", m.group(1))
        before = plain[: m.start(1)].rstrip()
        if name.startswith("."):
            out.append("<call>" + name if before.endswith(")") else None)
        elif name in _TS_KEYWORDS or re.search(r"\bfunction$", before) or _declares(plain, m.end() - 1):
            continue
        else:
            out.append(name)
    return out


def callees(text: str, lang: str) -> list[str | None]:
    return python_callees(text) if lang == "python" else typescript_callees(text)


def sampleable(text: str, lang: str) -> list[tuple[int, int]]:
    """(first, last line) of the functions and classes of a module; decorators are left out."""
    if lang == "python":
        t = tree(text)
        return [(n.lineno, n.end_lineno or n.lineno) for n in (t.body if t else []) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    out, plain = [], _blank(text)
    head = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\b|class\b|interface\b|type\s+\w+\s*=|(?:const|let|var)\s+\w+[^=\n]*=\s*(?:async\s*)?(?:\(|function\b|class\b|\w+\s*=>))", re.M)
    for m in head.finditer(plain):
        depth, i, seen = 0, m.start(), False
        while i < len(plain):
            ch = plain[i]
            if ch in "{([":
                depth, seen = depth + 1, seen or ch == "{"
            elif ch in "})]":
                depth -= 1
                if depth == 0 and seen and ch == "}":
                    break
            elif ch == ";" and depth == 0:
                break
            i += 1
        out.append((plain.count("\n", 0, m.start()) + 1, plain.count("\n", 0, i) + 1))
    return out


def prose_lines(text: str, lang: str) -> list[int]:
    """1-indexed lines of comments, docstrings and strings over several lines; none where Python does not parse."""
    rows: set[int] = set()
    if lang == "python":
        t = tree(text)
        if t is None:
            return []
        for n in ast.walk(t):
            if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
                rows.update(range(n.body[0].lineno, (n.body[0].end_lineno or 0) + 1))
            if isinstance(n, ast.Constant) and isinstance(n.value, str) and (n.end_lineno or n.lineno) > n.lineno:
                rows.update(range(n.lineno, (n.end_lineno or 0) + 1))
        try:
            rows.update(k.start[0] for k in tokenize.generate_tokens(io.StringIO(text).readline) if k.type == tokenize.COMMENT)
        except (tokenize.TokenError, IndentationError):
            pass
    else:
        for m in _TS_TOKEN.finditer(text):
            if m.group()[:2] in ("//", "/*"):
                first = text.count("\n", 0, m.start()) + 1
                rows.update(range(first, first + m.group().count("\n") + 1))
    return sorted(rows)


def blank_prose(text: str, lang: str) -> str:
    """A text with its lines of prose emptied, the number of lines kept."""
    rows = set(prose_lines(text, lang))
    return "\n".join("" if i in rows else x for i, x in enumerate(text.split("\n"), 1)) if rows else text


def import_block(text: str) -> str:
    """The lines of a Python text's imports on module level; where it does not parse, the lines that begin like one."""
    rows = text.splitlines()
    t = tree(text)
    if t is None:
        return "\n".join(x for x in rows if re.match(r"(?:import |from )\S", x))
    return "\n".join(x for n in t.body if isinstance(n, (ast.Import, ast.ImportFrom)) for x in rows[n.lineno - 1 : n.end_lineno])


_IMPORT_LINE = re.compile(r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", re.M)


def import_names_by_line(text: str) -> list[str]:
    """Top-level names of imports by the look of lines, whether or not the text parses; also those in prose."""
    return sorted(set(_IMPORT_LINE.findall(text)))


def data_ratio(text: str, lang: str) -> float:
    """Share of non-blank lines covered by assignments of containers at least 80 % of whose values are literals."""
    full = sum(1 for x in text.split("\n") if x.strip())
    rows: set[int] = set()
    if lang == "python":
        t = tree(text)
        bodies = [t.body] + [n.body for n in t.body if isinstance(n, ast.ClassDef)] if t else []
        for n in (x for b in bodies for x in b):
            value = n.value if isinstance(n, (ast.Assign, ast.AnnAssign)) else None
            if isinstance(value, (ast.List, ast.Tuple, ast.Set)):
                inside: list = value.elts
            elif isinstance(value, ast.Dict):
                inside = value.values
            else:
                continue
            if not inside or sum(isinstance(v, (*LITERALS, ast.UnaryOp)) for v in inside) / len(inside) >= 0.8:
                rows.update(range(n.lineno, (n.end_lineno or n.lineno) + 1))
    else:
        plain = _blank(text)
        for m in re.finditer(r"^(?:export\s+)?(?:const|let|var)\s+\w+[^=\n]*=\s*([\[{])", plain, re.M):
            depth, i = 0, m.start(1)
            while i < len(plain):
                depth += (plain[i] in "[{(") - (plain[i] in "]})")
                if not depth:
                    break
                i += 1
            inside = text[m.start(1) + 1 : i]
            values = [re.sub(r"^\s*[\w'\"]+\s*:", "", v).strip() for v in re.split(r",(?![^\[{(]*[\]})])", inside)]
            values = [v for v in values if v]
            if not values or sum(bool(re.match(r"^(['\"`].*['\"`]|-?\d[\d._]*|true|false|null)$", v, re.S)) for v in values) / len(values) >= 0.8:
                rows.update(range(text.count("\n", 0, m.start()) + 1, text.count("\n", 0, i) + 2))
    return len(rows) / full if full else 0.0


def leaves(text: str, lang: str) -> list[tuple[str, bool]]:
    """(text, is a literal) of each named leaf: names and literals."""
    if lang == "python":
        try:
            toks = [(k.string, k.type in (tokenize.NUMBER, tokenize.STRING) or k.string in ("True", "False", "None")) for k in tokenize.generate_tokens(io.StringIO(text).readline) if k.type in (tokenize.NAME, tokenize.NUMBER, tokenize.STRING)]
        except (tokenize.TokenError, IndentationError, SyntaxError):
            toks = [(w, w[0].isdigit()) for w in re.findall(r"\w+", text)]
        import keyword

        return [(s, lit) for s, lit in toks if lit or not keyword.iskeyword(s)]
    out = []
    for m in _TS_TOKEN.finditer(text):
        s = m.group()
        if s[:2] in ("//", "/*"):
            continue
        if s[0] in "\"'`" or s[0].isdigit() or s in ("true", "false", "null", "undefined"):
            out.append((s, True))
        elif (s[0].isalpha() or s[0] in "_$") and s not in _TS_GRAMMAR:
            out.append((s, False))
    return out


_CONTROL = re.compile(r"\b(if|for|while|switch|case|try|catch|except|with|elif|return|raise|throw|yield|await)\b")


def typicality(text: str, lang: str) -> tuple[float, float, float, float, int]:
    """(literal share of leaves, control words per 100 lines, entropy of leaf texts in bits, distinct share, leaves)."""
    ls = leaves(text, lang)
    n = len(ls)
    if not n:
        return (0.0, 0.0, 0.0, 0.0, 0)
    count = Counter(s for s, _ in ls)
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    rows = max(1, text.count("\n") + 1)
    return (sum(lit for _, lit in ls) / n, 100.0 * len(_CONTROL.findall(text)) / rows, entropy, len(count) / n, n)


def fragment(text: str, lang: str) -> bool:
    """Whether a text does not parse on its own (Python) or has brackets that don't close (TypeScript)."""
    if lang == "python":
        return tree(text) is None
    depth = 0
    for ch in _blank(text):
        depth += (ch in "([{") - (ch in ")]}")
        if depth < 0:
            return True
    return depth != 0


def shape(text: str, lang: str) -> tuple[int, int, int, int, int]:
    """(returns, throws, awaits, greatest nesting, distinct identifiers)."""
    names = len(set(re.findall(r"\b[A-Za-z_]\w*\b", text)))
    if lang == "python":
        t = tree(text)
        if t is None:
            return (0, 0, 0, 0, names)
        deep = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.If, ast.For, ast.While, ast.With, ast.Try)

        def nesting(n: ast.AST) -> int:
            return max((nesting(c) for c in ast.iter_child_nodes(n)), default=0) + isinstance(n, deep)

        kinds = Counter(type(n).__name__ for n in ast.walk(t))
        return (kinds["Return"], kinds["Raise"], kinds["Await"], nesting(t), names)
    plain = _blank(text)
    depth = most = 0
    for ch in plain:
        depth += (ch == "{") - (ch == "}")
        most = max(most, depth)
    word = lambda w: len(re.findall(rf"\b{w}\b", plain))
    return (word("return"), word("throw"), word("await"), most, names)


def node_types(text: str) -> dict[str, int]:
    """The twenty commonest node types of a Python text."""
    t = tree(text)
    return dict(Counter(type(n).__name__ for n in ast.walk(t)).most_common(20)) if t else {}


def handler_counts(text: str, lang: str) -> tuple[int, int]:
    """(returns, raises) inside handlers; a nested handler counts for each that holds it."""
    if lang == "python":
        t = tree(text)
        hs = [n for n in ast.walk(t) if isinstance(n, ast.ExceptHandler)] if t else []
        inside = [x for h in hs for x in ast.walk(h)]
        return (sum(isinstance(x, ast.Return) for x in inside), sum(isinstance(x, ast.Raise) for x in inside))
    plain, ret, thr = _blank(text), 0, 0
    for m in re.finditer(r"\bcatch\s*(?:\([^)]*\))?\s*\{", plain):
        depth, i = 0, m.end() - 1
        while i < len(plain):
            depth += (plain[i] == "{") - (plain[i] == "}")
            if not depth:
                break
            i += 1
        ret, thr = ret + len(re.findall(r"\breturn\b", plain[m.end() : i])), thr + len(re.findall(r"\bthrow\b", plain[m.end() : i]))
    return (ret, thr)


def handler_ratio(text: str, lang: str) -> float | None:
    """Returns among the returns and raises inside handlers; null without either."""
    r, t = handler_counts(text, lang)
    return r / (r + t) if r + t else None


def guards(text: str, lang: str) -> float | None:
    """Mean number of ifs before the first return of a function, 0 for one without a return; null without functions."""
    if lang == "python":
        t = tree(text)
        fs = [n for n in ast.walk(t) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if t else []
        counts = []
        for f in fs:
            nodes = sorted((n for n in ast.walk(f) if isinstance(n, (ast.If, ast.Return))), key=lambda n: (n.lineno, n.col_offset))
            first = next((i for i, n in enumerate(nodes) if isinstance(n, ast.Return)), 0)
            counts.append(sum(isinstance(n, ast.If) for n in nodes[:first]))
    else:
        parts = re.split(r"\bfunction\b", _blank(text))[1:]
        counts = [len(re.findall(r"\bif\b", re.split(r"\breturn\b", p)[0])) if re.search(r"\breturn\b", p) else 0 for p in parts]
    return sum(counts) / len(counts) if counts else None


def module_scope_share(text: str, lang: str) -> float | None:
    """Share of calls outside functions, a class body being outside; null without calls."""
    if lang == "python":
        t = tree(text)
        if t is None:
            return None
        total = sum(isinstance(n, ast.Call) for n in ast.walk(t))
        inner = {id(c) for n in ast.walk(t) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for c in ast.walk(n) if isinstance(c, ast.Call)}
        return (total - len(inner)) / total if total else None
    found = typescript_callees(text)
    return 1.0 if found else None  # function bodies are not told apart in this grammar


def column(f: Callable, returns: str) -> Callable:
    """A column function (text, lang) -> f(text, lang), batched by Arrow; a null text gives null."""

    @F.pandas_udf(returns)
    def run(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t, g) for t, g in zip(text, lang)], dtype=object)

    return run


def struct_column(f: Callable, names: tuple[str, ...], returns: str) -> Callable:
    """As column, for functions that give a tuple: a struct of the names."""

    @F.pandas_udf(returns)
    def run(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(t or "", g) for t, g in zip(text, lang)], columns=list(names))

    return run
