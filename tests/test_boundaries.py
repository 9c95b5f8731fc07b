"""Nothing outside the subpackage for training data imports it."""

import ast
import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_imports_it():
    for p in (ROOT / "vocalith").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for n in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in n.names] + [n.module or ""] if isinstance(n, ast.ImportFrom) else [a.name for a in n.names] if isinstance(n, ast.Import) else []
            assert not any("llm" in x.split(".") for x in names), p


def test_rdds_and_local_checkpoints_are_not_used():
    for p in (ROOT / "vocalith").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text() and ".rdd" not in p.read_text(), p
