"""The dependency graph of a source tree: imports of each file, resolved to files of the tree.

Each import names candidate paths in order of preference; candidates are joined with the tree's paths, and the best that
exists wins. What matches nothing stays as an unresolved import. Python is parsed; other languages are read by patterns.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packages

SCHEMA = "source string, specifier string, candidate string, rank long, resolver string"
SCRIPT = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")
JS = re.compile(r"""(?:\bimport\s+(?:[\w*{}\s,$]+\s+from\s+)?|\bexport\s+[\w*{}\s,$]+\s+from\s+|\brequire\(\s*|\bimport\(\s*)['"]([^'"\n]+)['"]""")
RUST = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:mod\s+(\w+)\s*;|use\s+((?:crate|self|super)\b[^;]*);)", re.M)
GO = re.compile(r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"', re.M)
PHP_USE = re.compile(r"^\s*use\s+(?:function\s+|const\s+)?\\?([\w\\]+)", re.M)
PHP_INCLUDE = re.compile(r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"]([^'\"\n]+)['\"]")


def join(folder: str, path: str) -> str | None:
    """A path inside the tree, or None if it leads out of it."""
    out = posixpath.normpath(posixpath.join(folder, path))
    return None if out.startswith("../") or out in ("..", ".") else out


def python(path: str, content: str) -> Iterator[tuple[str, list[str], str]]:
    folder = posixpath.dirname(path)
    roots = ["", *(r for r in ("src", folder) if r)]
    for node in ast.walk(ast.parse(content)):
        names: list[tuple[str, str | None]] = []
        if isinstance(node, ast.Import):
            names = [(a.name, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.level:
                base = posixpath.normpath(posixpath.join(folder, *[".."] * (node.level - 1))) if folder or node.level == 1 else ""
                stem = posixpath.normpath(posixpath.join(base, *(node.module or "").split(".")))
                for a in node.names:
                    yield "." * node.level + (node.module or "") + "." + a.name, [f"{stem}/{a.name}.py", f"{stem}/{a.name}/__init__.py", f"{stem}.py", f"{stem}/__init__.py"], "python-relative"
            else:
                names = [(node.module or "", a.name) for a in node.names]
        for module, member in names:
            stem = module.replace(".", "/")
            tails = ([f"{stem}/{member}.py", f"{stem}/{member}/__init__.py"] if member else []) + [f"{stem}.py", f"{stem}/__init__.py"]
            yield module + (f".{member}" if member else ""), [posixpath.join(r, t) for r in roots for t in tails], "python-module"


def script(path: str, content: str) -> Iterator[tuple[str, list[str], str]]:
    for m in JS.finditer(content):
        if m[1].startswith("."):
            stem = join(posixpath.dirname(path), m[1])
            if stem:
                bare = re.sub(r"\.(?:js|jsx|mjs|cjs)$", "", stem)
                yield m[1], [stem, *(bare + e for e in SCRIPT), *(f"{stem}/index{e}" for e in SCRIPT)], "relative"
        else:
            yield m[1], [], "package"


def use_paths(tree: str) -> list[str]:
    """The paths that a use tree names: groups in braces are expanded, new names and asterisks are left off."""
    tree = tree.strip()
    at = tree.find("{")
    if at < 0:
        path = re.sub(r"\s+as\s+\w+$|::\s*\*$|::\s*self$", "", tree)
        return [re.sub(r"\s+", "", path)] if path and path != "self" else [""]
    depth, parts, start = 0, [], at + 1
    for k in range(at, len(tree)):
        depth += (tree[k] == "{") - (tree[k] == "}")
        if depth == 1 and tree[k] == "," or depth == 0:
            parts.append(tree[start:k])
            start = k + 1
        if depth == 0:
            break
    head = re.sub(r"\s+", "", tree[:at]).removesuffix("::")
    return ["::".join(filter(None, (head, p))) for part in parts if part.strip() for p in use_paths(part)]


def rust(path: str, content: str) -> Iterator[tuple[str, list[str], str]]:
    folder, name = posixpath.split(path)
    own = folder if name in ("mod.rs", "lib.rs", "main.rs") else posixpath.join(folder, name.removesuffix(".rs"))
    crate = path[: path.rfind("src/") + 4].rstrip("/") if "src/" in path else folder
    for m in RUST.finditer(content):
        if m[1]:
            yield f"mod {m[1]}", [posixpath.join(own, f"{m[1]}.rs"), posixpath.join(own, m[1], "mod.rs")], "rust-mod"
            continue
        for name in dict.fromkeys(use_paths(m[2])):
            parts = name.split("::")
            at = crate if parts[0] == "crate" else own
            while parts and parts[0] in ("crate", "self", "super"):
                at = posixpath.dirname(at) if parts[0] == "super" else at
                parts = parts[1:]
            tails = [posixpath.join(at, *parts[:k]) for k in range(len(parts), 0, -1)]
            yield name, [x for t in tails for x in (f"{t}.rs", f"{t}/mod.rs")], "rust-use"


def php(path: str, content: str) -> Iterator[tuple[str, list[str], str]]:
    for m in PHP_USE.finditer(content):
        parts = m[1].split("\\")
        yield m[1], [x for k in range(len(parts)) for x in (f"src/{'/'.join(parts[k:])}.php", f"{'/'.join(parts[k:])}.php", f"app/{'/'.join(parts[k:])}.php")], "php-namespace"
    for m in PHP_INCLUDE.finditer(content):
        if at := join(posixpath.dirname(path), m[1].lstrip("/")):
            yield m[1], [at], "php-include"


def go(path: str, content: str) -> Iterator[tuple[str, list[str], str]]:
    """Packages are told by their folder; a package's first file stands for it."""
    for m in GO.finditer(content):
        parts = m[1].split("/")
        yield m[1], ["/".join(parts[k:]) + "/" for k in range(len(parts))], "go-package"


#: Resolvers of imports through configuration files.
CONFIGURED = ("tsconfig-paths", "tsconfig-base-url", "package-imports", "package-exports", "package-subpath", "package-entrypoint", "package-index", "heuristic-alias", "package")
READERS = {"Python": python, "JavaScript": script, "TypeScript": script, "TSX": script, "Rust": rust, "PHP": php, "Go": go}


def candidates(files: DataFrame) -> DataFrame:
    """A row for each import and candidate path; an import without candidates has one row with a null path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                try:
                    found = dict.fromkeys((s, tuple(c), r) for s, c, r in READERS[language](path, content))
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((path, None, None, 0, "parse-error"))
                    continue
                for specifier, paths, resolver in found:
                    rows += [(path, specifier, c, k, resolver) for k, c in enumerate(paths or (None,))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    some = files.where(F.col("language").isin(*READERS) & F.col("content").isNotNull())
    return some.select("path", "language", "content").mapInPandas(run, SCHEMA)


def resolved(files: DataFrame) -> DataFrame:
    """source, specifier, target and resolver of each import; target is null where nothing in the tree matches."""
    paths = files.select(F.col("path").alias("target"), F.col("path").alias("key"))
    folders = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).groupBy(F.regexp_replace("path", "[^/]*$", "").alias("key")).agg(F.min("path").alias("target"))
    known = paths.unionByName(folders.select("target", "key"))
    rows = candidates(files).where("resolver <> 'parse-error'")
    configured = rows.where("resolver = 'package'").select("source", "specifier")
    rows = rows.where("resolver <> 'package'").unionByName(packages.candidates(configured, files))
    rows = rows.join(known, F.col("candidate") == F.col("key"), "left")
    # The resolvers of one import through configuration are one list of preference; other imports have one resolver each.
    best = Window.partitionBy("source", "specifier", F.when(~F.col("resolver").isin(*CONFIGURED), F.col("resolver"))).orderBy(F.col("target").isNull(), "rank", "target")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("source", "specifier", "target", "resolver")


def unparsed(files: DataFrame) -> DataFrame:
    """source: the files whose imports couldn't be read, as their language's parser fails."""
    return candidates(files).where("resolver = 'parse-error'").select("source")


def edges(files: DataFrame) -> DataFrame:
    """Distinct (source, target, resolver) between files of the tree, the best resolver by name for a pair; no loops."""
    rows = resolved(files).where("target is not null and source <> target")
    return rows.groupBy("source", "target").agg(F.min("resolver").alias("resolver"))
