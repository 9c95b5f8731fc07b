"""The queries of this package by name, with their SQL."""

from __future__ import annotations

from . import queries_language, queries_overlaps, queries_tables, queries_text, queries_vectors

_MODULES = (queries_tables, queries_overlaps, queries_text, queries_language, queries_vectors)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
