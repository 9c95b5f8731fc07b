"""Small sources for operators that the stored tables give nothing to: each query over them has the rows that were worked out by hand."""

from __future__ import annotations

PYTHON = '''"""Doc of the module
in two lines."""
from __future__ import annotations
import os, json as j
import alpha.beta
from gamma.delta import x  # a note
from . import near
from .. import far

LIMIT = 3

@wrap
def first(a):
    # a comment
    if a is None:
        return None
    if a > LIMIT:
        raise ValueError(a)
    s = """two
lines"""
    return os.path.join(s, str(a))

class Thing:
    KEY = os.getenv("KEY")
    async def go(self):
        try:
            await self.run()
        except KeyError:
            return j.dumps({})
        except OSError:
            raise
        if self.x:
            pass
        print("done")

print(first(1))
'''
TYPESCRIPT = """// Copyright note
import React, { useState } from 'react';
import './local.css';
import "side-effect";
import type { A } from "@scope/pkg/types";
const fs = require('fs');
const near = require('./near');
/* block
   comment */
export function first(a: number) {
  if (a < 1) { return null; }
  try { go(a); } catch (e) { throw e; }
  return helper.run(a);
}
export const second = (b) => {
  return fetch(`/x/${b}`); // tail
};
interface Shape { a: number; }
class Box { open() { return 1; } }
type Id = string;
"""
BROKEN = """import os
from lib.sub import y
def f(:
    from inner import z
"""
SOURCES = (
    (1, "python", PYTHON), (2, "typescript", TYPESCRIPT), (3, "python", BROKEN), (4, "python", "x = 1\ny = x + 2\n"), (5, "typescript", "if (a) {\n"),
    (6, "python", "A = [1, 2, 3]\nB = {'x': 1}\nprint(A)\n\n"), (7, "python", "A = [1, f(2)]\nx = 1\n"), (8, "typescript", "export const C = ['a', 'b'] as const;\n"),
    (9, "typescript", "export const A = [1, 2, 3];\nconst B = { a: 1, b: 'x' };\ngo();\n"), (10, "python", ""), (11, "typescript", "const a = 1;\nconst b = 'x';\n"),
)

# fixtures: (id, text, first and last line, host or None, line of the host)
FIXTURES = (
    (1, "// Break: it throws\nconst a = 1;\nconst b = 2;\n", 1, 3, "one\ntwo\nthree", 2),
    (2, "x = 1\n  # Break : odd\ny = 2\n# plain note", 2, 3, "one\ntwo", 9),
    (3, "# Break: all of it", 1, 1, "one\n", 1),
    (4, "a\nb", 1, 5, "one\ntwo", 1),
    (5, "a\nb", 0, 1, "one", 1),
    (6, "a\n# Break: x\nb\n# Break: y", 2, 4, "", 1),
)

# fragments of a text of 130 lines, L1 to L130: (id, first line from 0, line behind the last)
BOUNDS = ((1, 0, 10), (2, 60, 70), (3, 124, 130), (4, 128, 140), (5, -1, 4), (6, 50, 50), (7, 0, 130))

# files of a check: (id, path, source of the text)
PATHS = ((1, "src/a.py", 1), (2, "src/data.py", 6), (3, "tests/a.py", 1), (4, "src/b.ts", 2), (5, "src/data.ts", 9), (6, "src/notes.md", 1), (7, "src/b.test.ts", 2), (8, "lib/test_a.py", 1), (9, "src/mixed.py", 7))

# a history with a merge: (sha, parent)
EDGES = (("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("f", "e"), ("g", "d"), ("z", "gone"))
RANGES = (("b..f", "b", "f"), ("d..f", "d", "f"), ("f", None, "f"), ("e", None, "e"), ("g..c", "g", "c"), ("z", None, "z"))


def literal(x: object) -> str:
    """A value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return repr(x) + ("::DOUBLE" if isinstance(x, float) else "")


def values(rows: tuple | list, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({columns})"


def by_hand(rows: list, columns: str) -> str:
    """The SQL of rows that were worked out by hand."""
    return f"SELECT * FROM {values(rows, columns)}"
