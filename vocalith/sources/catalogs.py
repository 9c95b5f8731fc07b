"""Catalogs of labelled fragments and benchmark targets, as YAML or JSON files on the driver's side."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FIXTURE = "corpus string, language string, id string, file string, category string, hunk_start_line int, hunk_end_line int, rationale string, difficulty string, host_file string, host_inject_at_line int"
TARGET = "name string, url string, language string, prs array<struct<pr: int, sha: string>>"


def load(path: str) -> dict | list:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def fixtures(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The fixtures of catalogs; host fields come both or not at all, and the line of injection is at least 1."""
    rows = []
    for p in paths:
        c = load(p)
        for f in c["fixtures"]:
            host, at = f.get("host_file"), f.get("host_inject_at_line")
            if (host is None) != (at is None) or (at is not None and at < 1):
                raise ValueError(f"{p}: {f['id']}: host_file and host_inject_at_line >= 1 come together")
            rows.append((c["corpus"], f.get("language", c.get("language")), f["id"], f["file"], f["category"], f["hunk_start_line"], f["hunk_end_line"], f.get("rationale"), f.get("difficulty"), host, at))
    return spark.createDataFrame(rows, FIXTURE)


def targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(t["name"], t["url"], t.get("language"), [(x["pr"], x["sha"]) for x in t["prs"]]) for t in load(path)["targets"]], TARGET)
