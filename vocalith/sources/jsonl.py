"""Fragments as JSON lines: the writer's committer makes a write visible at once or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENS = "array<struct<text: string, node_type: string, start_line: int, end_line: int>>"
SCHEMA = f"commit_sha string, file_path string, language string, hunk_start_line int, hunk_end_line int, context_before {TOKENS}, hunk_tokens {TOKENS}, context_after {TOKENS}, parent_sha string, author_date_iso string"


class NothingWritten(ValueError):
    """A write had no rows."""


def write(df: DataFrame, path: str) -> str:
    """Writes df, or raises where it has no rows."""
    if df.isEmpty():
        raise NothingWritten(path)
    df.write.mode("error").json(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The fragments of a file or folder; blank and malformed lines are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
