"""Imports of scripts that go through configuration: path mappings, base folders, package names, exports and imports.

Configuration files are rows like all others. For an import the configurations in its own folder and those above it meet in
one row, as many as the path is deep; a package is found by a join on its name. What an import may mean comes out as
candidates in order of preference, which imports.resolved() joins with the paths of the tree.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of configuration files, endings that a module may have, conditions in the order of preference.
TS_CONFIGS, PACKAGE = ("tsconfig.json", "jsconfig.json"), "package.json"
ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
CONDITIONS = ("types", "import", "require", "node", "browser", "default")
ENTRIES = ("types", "typings", "source", "module", "browser", "main")


def plain_json(text: str) -> str:
    """JSON with comments and commas before a closing bracket as JSON without them; strings stay as they are."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)
    return token.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)


def loaded(text: str | None) -> dict:
    """The object in a configuration file; empty if it can't be read."""
    try:
        found = json.loads(plain_json(text or ""))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def inside(folder: str, path: str) -> str | None:
    out = posixpath.normpath(posixpath.join(folder, path))
    return None if out == ".." or out.startswith(("../", "/")) else "" if out == "." else out


def modules(stem: str | None) -> list[str]:
    """The files that a module path may mean."""
    if stem is None:
        return []
    bare = re.sub(r"\.(?:js|jsx|mjs|cjs)$", "", stem)
    return [stem, *(bare + e for e in ENDINGS), *(posixpath.join(stem, f"index{e}") for e in ENDINGS)]


def matched(patterns, requested: str) -> tuple[str, str | None] | None:
    """The most specific pattern that fits, with what its asterisk stands for: whole names first, then the longest prefix."""
    if requested in patterns:
        return requested, None
    fits = []
    for p in patterns:
        head, star, tail = p.partition("*")
        if star and requested.startswith(head) and requested.endswith(tail) and len(requested) >= len(head) + len(tail):
            fits.append((-len(head), -len(tail), p, requested[len(head) : len(requested) - len(tail)]))
    return min(fits)[2:] if fits else None


def targets(value) -> list[str]:
    """The paths of a mapping's value, which may be a path, a list, or conditions; null has none."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in targets(v)]
    if isinstance(value, dict):
        return [t for c in CONDITIONS if c in value for t in targets(value[c])]
    return []


def by_config(configs: list[tuple[str, str]], specifier: str) -> tuple[list[tuple[str, str]], bool]:
    """(candidate, resolver) from (folder, content) of the configurations above a file, nearest first, and whether that settles it."""
    out: list[tuple[str, str]] = []
    for folder, content in configs:
        options = loaded(content).get("compilerOptions") or {}
        base = options.get("baseUrl")
        root = inside(folder, base) if isinstance(base, str) else folder
        paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
        if root is not None and (hit := matched(paths, specifier)):
            found = [t.replace("*", hit[1] or "", 1) for t in targets(paths[hit[0]])]
            return out + [(c, "tsconfig-paths") for t in found for c in modules(inside(root, t))], True
        if isinstance(base, str) and root is not None:
            out += [(c, "tsconfig-base-url") for c in modules(inside(root, specifier))]
    return out, False


def by_mapping(folder: str, mappings, requested: str, resolver: str) -> list[tuple[str, str]]:
    """Candidates of a package's exports or imports: one key decides, and a target outside of the package ends the search."""
    out: list[tuple[str, str]] = []
    if hit := matched(mappings, requested):
        for t in targets(mappings[hit[0]]):
            if not t.startswith("./"):
                break
            out += [(c, resolver) for c in modules(inside(folder, t.replace("*", hit[1] or "")))]
    return out


def exported(package: dict) -> dict | None:
    """A package's exports by subpath, or None if it has none."""
    found = package.get("exports")
    if found is None:
        return None
    keyed = isinstance(found, dict) and all(k.startswith(".") for k in found)
    return found if keyed else {".": found}


def by_package(folder: str, package: dict, subpath: str | None) -> list[tuple[str, str]]:
    """Candidates of a package of the tree: its exports alone if there are any, else a path in it, or where it begins."""
    exports = exported(package)
    if exports is not None:
        return by_mapping(folder, exports, f"./{subpath}" if subpath else ".", "package-exports")
    if subpath:
        return [(c, "package-subpath") for c in modules(inside(folder, subpath))]
    begins = [package[k] for k in ENTRIES if isinstance(package.get(k), str)]
    out = [(c, "package-entrypoint") for b in begins for c in modules(inside(folder, b))]
    return out + [(c, "package-index") for b in ("src/index", "index") for c in modules(inside(folder, b))]


def split_name(specifier: str) -> tuple[str, str | None]:
    """A package's name, with its scope, and the path within it."""
    parts = specifier.split("/", 2 if specifier.startswith("@") else 1)
    n = 2 if specifier.startswith("@") else 1
    return "/".join(parts[:n]), (parts[n] if len(parts) > n and parts[n] else None)


def meanings(specifier: str, configs: list, packages: list, named: list) -> list[tuple[str, str]]:
    """Candidates of an import that isn't relative. configs, packages: (folder, content) above the file, nearest first; named: those
    of the package's name, which decide if there is one, and leave it open if there are more."""
    if specifier.startswith("#"):
        folder, content = packages[0] if packages else ("", None)
        return by_mapping(folder, loaded(content).get("imports") or {}, specifier, "package-imports")
    out, settled = by_config(configs, specifier)
    if settled:
        return out
    if len(named) > 1:
        return out
    if named:
        return out + by_package(named[0][0], loaded(named[0][1]), split_name(specifier)[1])
    if specifier.startswith("@/"):
        return out + [(c, "heuristic-alias") for root in ("src", "app", "") for c in modules(inside(root, specifier[2:]))]
    return out


def candidates(imported: DataFrame, files: DataFrame) -> DataFrame:
    """source, specifier, candidate, rank and resolver of imports (source, specifier) of scripts that aren't relative.

    files: path, content; the configurations among them are read. An import without candidates has one row with a null.
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    configs = files.where(name.isin(*TS_CONFIGS, PACKAGE)).select(folder.alias("folder"), (name == PACKAGE).alias("package"), F.col("path").alias("config"), "content")
    parts = F.split("source", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    pair = ["source", "specifier"]
    own = imported.select(*pair).distinct()
    found = F.struct((-F.length("folder")).alias("depth"), "config", "folder", "content")
    lists = [F.sort_array(F.collect_list(F.when(F.col("package") == p, found))).alias(n) for p, n in ((False, "configs"), (True, "packages"))]
    near = own.withColumn("folder", F.explode(above)).join(configs, "folder").groupBy(*pair).agg(*lists)
    packages = configs.where("package").withColumn("name", F.get_json_object("content", "$.name")).where("name is not null")
    packages = packages.groupBy("name").agg(F.slice(F.sort_array(F.collect_set(F.struct("folder", "content"))), 1, 2).alias("named"))
    called = F.when(F.startswith("specifier", F.lit("@")), F.regexp_extract("specifier", "^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract("specifier", "^([^/#]+)", 1))
    rows = own.join(near, pair, "left").withColumn("name", called).join(packages, "name", "left").select(*pair, "configs", "packages", "named")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = lambda x: [(r["folder"], r["content"]) for r in x] if x is not None else []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                some = list(dict.fromkeys(meanings(r.specifier, pairs(r.configs), pairs(r.packages), pairs(r.named))))
                out += [(r.source, r.specifier, c, k, how) for k, (c, how) in enumerate(some or [(None, "package")])]
            yield pd.DataFrame(out, columns=["source", "specifier", "candidate", "rank", "resolver"])

    return rows.mapInPandas(run, "source string, specifier string, candidate string, rank long, resolver string")
