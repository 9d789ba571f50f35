"""Predicates and keys of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(normalised(path), "/"), -1)


def dir_bucket(path: Column, depth: int) -> Column:
    """The first `depth` parent directories, "." for a file at the root."""
    parts = F.split(normalised(path), "/")
    parents = F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1))
    return F.when(F.size(parts) < 2, F.lit(".")).otherwise(F.array_join(parents, "/"))


def is_test_file(path: Column) -> Column:
    """By a directory tests, test, __tests__, spec or specs, or a name such as test_x, x_test, x.test.y, x.spec.y, XTest.php."""
    name = file_name(path)
    lower = F.lower(name)
    stem = F.regexp_replace(lower, r"\.[^.]*$", "")
    return (
        F.exists(F.split(F.lower(normalised(path)), "/"), lambda x: x.isin("tests", "test", "__tests__", "spec", "specs"))
        | (lower == "tests.rs")
        | stem.rlike(r"^test_|_test$")
        | lower.rlike(r"\.test\.|\.spec\.|_spec\.rb$")
        | name.rlike(r"^.*Test\.(?i:php)$")
    )


#: File names that start programs, packages or builds.
ENTRYPOINTS = ("__init__.py", "__main__.py", "setup.py", "conftest.py", "bootstrap.php", "artisan", "lib.rs", "build.rs")


def is_entrypoint(path: Column) -> Column:
    """By name, or index.*, main.*, app.*, *.d.ts, or a config of a build tool."""
    return F.lower(file_name(path)).isin(*ENTRYPOINTS) | F.lower(file_name(path)).rlike(r"\.d\.ts$|\.config\.(?:js|ts|mjs|cjs)$|^(?:index|main|app)\.")


def stem_key(path: Column, test: bool = False) -> Column:
    """The path without its extension and one layout directory, in lower case: the key that a test shares with its source."""
    bare = F.lower(F.regexp_replace(normalised(path), r"\.[^./]*$", ""))
    layout = r"(^|/)(?:src|lib|app|tests|test|__tests__|spec|specs)/" if test else r"(^|/)(?:src|lib|app)/"
    return F.regexp_replace(bare, layout, "$1")


def test_stem_keys(path: Column) -> Column:
    """The keys of the sources that a test file may cover."""
    raw = stem_key(path, True)
    kinds = [raw, *(F.regexp_replace(raw, p, r) for p, r in ((r"(^|/)test_([^/]*)$", "$1$2"), (r"_test$", ""), (r"\.test$", ""), (r"\.spec$", ""), (r"_spec$", "")))]
    return F.array_distinct(F.array(*kinds))


def within(path: Column, focus: Column) -> Column:
    """Whether a path is the focus or lies under it."""
    return (path == focus) | F.startswith(path, F.concat(focus, F.lit("/")))


#: Names of files that support a repository's reading, with their scores, and of its configuration.
SUPPORT = {
    "repository instructions": (("agents.md", "claude.md", "gemini.md", "codex.md"), 700.0),
    "repository handoff": (("handoff.md",), 400.0),
    "project manifest or build configuration": (("cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "makefile", "justfile"), 325.0),
}
OVERVIEW = ("project overview", 350.0)
CONFIGURATION = ("cargo.toml", "package.json", "composer.json", "go.mod", "makefile", "dockerfile", "compose.yml", "compose.yaml", "docker-compose.yml", "docker-compose.yaml", "tsconfig.json", "jsconfig.json")
PRECISE = ("relative", "python-relative", "tsconfig-paths", "tsconfig-base-url", "package-imports", "package-exports", "package-entrypoint", "composer-psr-4", "composer-psr-0", "php-include")


def _file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def support_role(path: Column) -> Column:
    """(role, score) of files that explain or configure a repository, else null."""
    name, out = _file_name(path), F.lit(None)
    role = lambda r, score: F.struct(F.lit(r).alias("role"), F.lit(score).alias("score"))
    manifest = "project manifest or build configuration"
    out = F.when(F.startswith(name, F.lit("tsconfig")), role(manifest, SUPPORT[manifest][1]))
    for r, (names, score) in SUPPORT.items():
        out = F.when(name.isin(*names), role(r, score)).otherwise(out)
    return F.when(name.rlike("^(?:readme|contributing)"), role(*OVERVIEW)).otherwise(out)


def is_project_configuration(path: Column) -> Column:
    name = _file_name(path)
    return name.isin(*CONFIGURATION) | name.rlike(r"\.config\.(?:js|ts)$")


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folders_above(path: Column) -> Column:
    """All folders that hold a path, the top one as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def config_governs(config: Column, path: Column) -> Column:
    """Whether the folder of a configuration file is, or holds, a path."""
    folder = parent(config)
    return (folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def resolver_is_precise(resolver: Column) -> Column:
    return resolver.isin(*PRECISE)
