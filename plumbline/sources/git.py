"""Git history and changes as rows, from the plain git command on the driver."""

from __future__ import annotations

import re
import subprocess
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

DELTAS = "oid string, ord long, author string, ts timestamp, kind string, old_path string, path string"
LINES = "path string, old_path string, status string, side string, b long, e long, binary boolean"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True).stdout.decode("utf-8", "replace")


def parsed_log(text: str) -> list[tuple]:
    """Rows of DELTAS from `git log --name-status -z` with commits set off by \\x01oid\\x02author\\x02seconds\\x03."""
    out = []
    for k, block in enumerate(text.split("\x01")[1:]):
        head, _, body = block.partition("\x03")
        oid, author, seconds = head.split("\x02")
        ts, fields, i = datetime.fromtimestamp(int(seconds), timezone.utc), [x for x in body.strip("\n").split("\0") if x.strip("\n")], 0
        while i < len(fields):
            kind = fields[i].strip("\n")[:1]
            two = kind in ("R", "C")
            out.append((oid, k, author, ts, kind, fields[i + 1] if two else None, fields[i + 1 + two]))
            i += 2 + two
    return out


def commit_deltas(spark: SparkSession, root: str, max_commits: int = 5_000) -> DataFrame:
    """One row for each path that a commit touches, newest first; merges are left out."""
    text = _git(root, "log", "--no-merges", f"-n{max_commits}", "-M", "--name-status", "-z", "--format=%x01%H%x02%ae%x02%ct%x03")
    return spark.createDataFrame(parsed_log(text), DELTAS)


def parsed_diff(text: str) -> list[tuple]:
    """Rows of LINES from a unified diff without context; a file without line changes has one row with null lines."""
    out: list[tuple] = []
    old = new = status = None
    binary, any_ = False, True

    def close() -> None:
        if not any_:
            out.append((new or old, old if old != new else None, status, "new", None, None, binary))

    for line in text.splitlines():
        if line.startswith("diff --git "):
            close()
            m = re.match(r"diff --git a/(.*) b/(.*)", line)
            old, new, status, binary, any_ = m[1], m[2], "modified", False, False
        elif line.startswith("new file"):
            status = "added"
        elif line.startswith("deleted file"):
            status = "deleted"
        elif line.startswith("rename from"):
            status = "renamed"
        elif line.startswith("Binary files"):
            binary = True
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            for side, start, n in (("old", int(m[1]), int(m[2] or 1)), ("new", int(m[3]), int(m[4] or 1))):
                if n:
                    out.append((new if side == "new" else old, old if old != new else None, status, side, start, start + n - 1, False))
                    any_ = True
    close()
    return out


def changed_lines(spark: SparkSession, root: str, since: str = "HEAD") -> DataFrame:
    """Changed line ranges of the working tree against a commit."""
    return spark.createDataFrame(parsed_diff(_git(root, "diff", "-M", "-U0", since)), LINES)


def changed_files(spark: SparkSession, root: str, since: str = "HEAD") -> DataFrame:
    """Paths that differ from a commit, and untracked ones."""
    names = {x for x in (_git(root, "diff", "--name-only", "-z", since) + _git(root, "ls-files", "--others", "--exclude-standard", "-z")).split("\0") if x}
    return spark.createDataFrame([(x,) for x in sorted(names)], "path string")


def snapshot(spark: SparkSession, root: str, commit: str = "HEAD") -> DataFrame:
    """path and content of the files of a commit that are text."""
    out = []
    for entry in filter(None, _git(root, "ls-tree", "-r", "-z", commit).split("\0")):
        meta, path = entry.split("\t", 1)
        data = subprocess.run(["git", "-C", root, "cat-file", "blob", meta.split()[2]], check=True, capture_output=True).stdout
        try:
            out.append((path, data.decode("utf-8")))
        except UnicodeDecodeError:
            continue
    return spark.createDataFrame(out, "path string, content string")
