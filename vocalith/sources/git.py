"""A data source for the fragments of a git repository.

spark.dataSource.register(GitHunks); spark.read.format("git_hunks").option("mode", "commits").load(path)

Modes: commits (every commit with one parent, a partition for each block of commits), range (option range, "A..B" or a single
commit), workdir (changed against the index), staged (index against HEAD), untracked (each new file as one fragment).
Rows: (source, path, hunk_start, hunk_end, content), lines 0-indexed and half-open, content the file after the change.
Only supported extensions are read; deleted files and root and merge commits are left out.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx")
SCHEMA = "source string, path string, hunk_start int, hunk_end int, content binary"
BLOCK = 200  # commits of a partition
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", re.M)


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, check=True).stdout


def hunks_of(diff: str) -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of each fragment of a diff without context; pure deletions have no lines and are left out."""
    for part in re.split(r"^diff --git ", diff, flags=re.M)[1:]:
        m = re.search(r"^\+\+\+ b/(.*?)\t?$", part, re.M)
        if m is None or not m.group(1).lower().endswith(EXTENSIONS):
            continue
        for h in _HUNK.finditer(part):
            start, n = int(h.group(1)), int(h.group(2) if h.group(2) is not None else 1)
            if n:
                yield m.group(1), start - 1, start - 1 + n


class _Block(InputPartition):
    def __init__(self, shas: list[str]) -> None:
        self.shas = shas


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo = options["path"]
        self.mode = options.get("mode", "commits")
        self.range = options.get("range", "")

    def partitions(self) -> list[InputPartition]:
        if self.mode not in ("commits", "range"):
            return [_Block([])]
        what = ["HEAD"]
        if self.mode == "range":
            what = [self.range] if ".." in self.range else [f"{self.range}^..{self.range}"]
        shas = git(self.repo, "rev-list", "--topo-order", "--min-parents=1", "--max-parents=1", *what).decode().split()
        return [_Block(shas[i : i + BLOCK]) for i in range(0, len(shas), BLOCK)] or [_Block([])]

    def read(self, partition: _Block) -> Iterator[tuple]:
        flags = ("--no-color", "--unified=0", "--find-renames", "--diff-filter=d")
        if self.mode in ("commits", "range"):
            for sha in partition.shas:
                for path, lo, hi in hunks_of(git(self.repo, "diff", *flags, f"{sha}^", sha).decode(errors="replace")):
                    yield sha, path, lo, hi, git(self.repo, "show", f"{sha}:{path}")
        elif self.mode == "workdir":
            for path, lo, hi in hunks_of(git(self.repo, "diff", *flags).decode(errors="replace")):
                with open(os.path.join(self.repo, path), "rb") as f:
                    yield "workdir", path, lo, hi, f.read()
        elif self.mode == "staged":
            for path, lo, hi in hunks_of(git(self.repo, "diff", "--cached", *flags).decode(errors="replace")):
                yield "staged", path, lo, hi, git(self.repo, "show", f":{path}")
        elif self.mode == "untracked":
            for path in git(self.repo, "ls-files", "--others", "--exclude-standard", "-z").decode().split("\0"):
                if path.lower().endswith(EXTENSIONS):
                    with open(os.path.join(self.repo, path), "rb") as f:
                        body = f.read()
                    if body:
                        yield "untracked", path, 0, body.count(b"\n") + (not body.endswith(b"\n")), body
        else:
            raise ValueError(f"mode {self.mode} is none of commits, range, workdir, staged, untracked")


class GitHunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_hunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)
