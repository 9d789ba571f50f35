"""A source tree as files(path, language, content), read by the executors.

The driver lists paths only; names that Spark's own readers hide (_x, .x) are kept. Contents are read where the tasks
run, so on a cluster the tree must be on storage that all of them mount; each task reads its share and no more.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..config import ScanConfig
from ..lang import detect

#: Lock files, which aren't read, and directories never entered.
LOCKFILES = ("Cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock", "npm-shrinkwrap.json", "poetry.lock", "Pipfile.lock", "uv.lock", "pdm.lock", "composer.lock", "Gemfile.lock", "go.sum", "flake.lock", "mix.lock", "pubspec.lock", "Podfile.lock", "deno.lock", "gradle.lockfile", "packages.lock.json")
SKIPPED_DIRS = (".git", ".hg", ".svn")


def ignored(path: str, rules: list[str]) -> bool:
    """Whether the last rule that matches a relative path excludes it; a rule with ! in front takes a path back in."""
    out = False
    for rule in rules:
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        anchored, folder = "/" in rule.rstrip("/"), rule.endswith("/")
        rule = rule.strip("/")
        parts = path.split("/")
        heads = ["/".join(parts[: k + 1]) for k in range(len(parts) - folder)]
        if any(fnmatch.fnmatchcase(h if anchored else h.rsplit("/", 1)[-1], rule) for h in heads):
            out = not back
    return out


def rules_of(folder: str, *names: str) -> list[str]:
    out = []
    for name in names:
        if os.path.isfile(at := os.path.join(folder, name)):
            with open(at, encoding="utf-8", errors="replace") as f:
                out += [x for line in f if (x := line.rstrip()) and not x.startswith("#")]
    return out


def listed(root: str, config: ScanConfig | None = None) -> tuple[list[tuple[str, str, str, int]], dict[str, int]]:
    """(path, file, language, bytes) of the files to read, by path, and counts of those left out, by reason."""
    config, rows = config or ScanConfig(), []
    left = {"ignored": 0, "unrecognised": 0, "oversized": 0, "over_total": 0, "over_files": 0}
    rules = rules_of(root, ".gitignore", ".ignore")
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS)
        for name in sorted(names):
            at = os.path.join(folder, name)
            path = os.path.relpath(at, root).replace(os.sep, "/")
            language = detect(path)
            if name in LOCKFILES or ignored(path, rules) or any(fnmatch.fnmatchcase(path, g) for g in config.exclude) or config.include and not any(fnmatch.fnmatchcase(path, g) for g in config.include):
                left["ignored"] += 1
            elif language is None or os.path.islink(at):
                left["unrecognised"] += 1
            elif (size := os.path.getsize(at)) > config.max_file_bytes:
                left["oversized"] += 1
            else:
                rows.append((path, at, language, size))
    rows.sort()
    kept, total = [], 0
    for row in rows:
        if len(kept) >= config.max_files:
            left["over_files"] += 1
        elif total + row[3] > config.max_total_bytes:
            left["over_total"] += 1
        else:
            total += row[3]
            kept.append(row)
    return kept, left


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for at in batch["at"]:
            try:
                with open(at, "rb") as f:
                    contents.append(f.read().decode("utf-8"))
            except (OSError, UnicodeDecodeError):
                contents.append(None)
        yield batch[["path", "language", "bytes"]].assign(content=contents)


def files(spark: SparkSession, root: str, config: ScanConfig | None = None, partitions: int | None = None) -> DataFrame:
    """path, language, bytes and content of a tree; content is null where a file can't be read as UTF-8."""
    rows, _ = listed(root, config)
    table = spark.createDataFrame(rows, "path string, at string, language string, bytes long")
    table = table.repartition(partitions or max(1, min(len(rows) // 64 + 1, 4096)), "path")
    return table.mapInPandas(_read, "path string, language string, bytes long, content string")
