"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

for _name in ("q_sources", "q_samples", "q_text", "q_filters", "q_joins", "q_aggregates", "q_vectors", "q_shapes", "q_order", "q_evidence", "q_pipelines", "q_streaming"):
    importlib.import_module(f".{_name}", __package__)

__all__ = ["QUERIES", "SQL"]
