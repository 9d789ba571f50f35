import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators import clone_groups, context, imports, packages


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1, // x\n "b": "//no", /* y */ "c": [1, 2,],}', {"a": 1, "b": "//no", "c": [1, 2]}), ("nonsense", {}), (None, {}), ('{"u": "a\\"/*b*/"}', {"u": 'a"/*b*/'}), ("[1]", {})],
)
def test_configurations_are_read(text, want):
    assert packages.loaded(text) == want


def test_patterns_prefer_the_most_specific():
    assert packages.matched({"@a/*": 1, "@a/b/*": 2, "*": 3}, "@a/b/c") == ("@a/b/*", "c")
    assert packages.matched({"@a/*": 1, "@a/x": 2}, "@a/x") == ("@a/x", None) and packages.matched({"b": 1}, "a") is None
    assert packages.targets({"import": None, "default": ["./x", "./y"]}) == ["./x", "./y"]
    assert packages.split_name("@s/p/q/r") == ("@s/p", "q/r") and packages.split_name("p/q") == ("p", "q") and packages.split_name("p") == ("p", None)


SCRIPTS = {
    "tsconfig.json": json.dumps({"compilerOptions": {"baseUrl": "lib", "paths": {"~/*": ["../web/*"], "blocked/*": ["none/*"]}}}),
    "web/tsconfig.json": '{"compilerOptions": {"paths": {"#own/*": ["./own/*"],}}} // the nearer one',
    "web/package.json": json.dumps({"name": "web", "imports": {"#in": "./own/in.js", "#out": "react"}}),
    "kit/package.json": json.dumps({"name": "@org/kit", "exports": {".": {"import": "./src/main.js"}, "./deep/*": "./src/deep/*.js", "./hidden": None}}),
    "old/package.json": json.dumps({"name": "old", "main": "begin.js"}),
    "twin/a/package.json": json.dumps({"name": "twin"}),
    "twin/b/package.json": json.dumps({"name": "twin"}),
    "web/app.ts": "\n".join(f"import x from '{s}'" for s in ("~/own/in", "base", "#own/in", "#in", "#out", "@org/kit", "@org/kit/deep/x", "@org/kit/hidden", "old", "old/other", "twin", "react", "@/page", "blocked/base", "./own/in")),
    "web/own/in.ts": "", "lib/base.ts": "", "kit/src/main.ts": "", "kit/src/deep/x.ts": "", "kit/hidden.ts": "", "old/begin.js": "", "old/other/index.ts": "", "twin/a/index.ts": "", "src/page.tsx": "",
}


def test_script_imports_through_configuration(spark):
    language = lambda p: "JSON" if p.endswith(".json") else "TypeScript"
    files = spark.createDataFrame([(p, language(p), c) for p, c in SCRIPTS.items()] + [("bad.py", "Python", "def (")], "path string, language string, content string")
    got = {r.specifier: (r.target, r.resolver) for r in imports.resolved(files).collect()}
    targets = {k: v for k, v in got.items() if v[0]}
    assert targets == {
        "~/own/in": ("web/own/in.ts", "tsconfig-paths"), "base": ("lib/base.ts", "tsconfig-base-url"), "#in": ("web/own/in.ts", "package-imports"),
        "@org/kit": ("kit/src/main.ts", "package-exports"), "@org/kit/deep/x": ("kit/src/deep/x.ts", "package-exports"), "old": ("old/begin.js", "package-entrypoint"),
        "old/other": ("old/other/index.ts", "package-subpath"), "@/page": ("src/page.tsx", "heuristic-alias"), "./own/in": ("web/own/in.ts", "relative"),
    }
    assert set(got) - set(targets) == {"#own/in", "#out", "@org/kit/hidden", "twin", "react", "blocked/base"}
    assert [r.source for r in imports.unparsed(files).collect()] == ["bad.py"]


def test_use_trees():
    assert imports.use_paths("crate::a::{b, c::{self, d as e}, f::*}") == ["crate::a::b", "crate::a::c", "crate::a::c::d", "crate::a::f"]
    assert imports.use_paths("super::x as y") == ["super::x"] and imports.use_paths("crate::{a,\n  b}") == ["crate::a", "crate::b"]


INSTANCES = [("wide", "p", 0, 90, 1, 9), ("wide", "q", 10, 100, 2, 10), ("in", "p", 5, 40, 1, 4), ("in", "q", 15, 50, 2, 5), ("more", "p", 5, 40, 1, 4), ("more", "q", 15, 50, 2, 5), ("more", "r", 0, 35, 1, 2), ("over", "p", 0, 30, 1, 2), ("over", "p", 20, 50, 2, 3), ("over", "s", 0, 30, 1, 2), ("self", "p", 0, 30, 1, 1), ("self", "p", 10, 40, 1, 1), ("twice", "q", 10, 100, 2, 10), ("twice", "p", 0, 90, 1, 9)]


def test_clone_groups(spark):
    rows = spark.createDataFrame(INSTANCES, "family string, path string, b long, e long, start_line long, end_line long")
    kept = sorted(map(tuple, clone_groups.pruned(rows).collect()))
    assert kept == sorted(r for r in INSTANCES if r[0] != "self" and r[:3] != ("over", "p", 20))
    names = lambda df: {r.family for r in df.select("family").distinct().collect()}
    assert names(clone_groups.distinct_groups(rows)) == {"twice", "in", "more", "over", "self"}  # "wide" has the regions of "twice" and comes later
    assert names(clone_groups.without_contained(rows)) == {"wide", "more", "over", "self", "twice"}
    assert names(clone_groups.long_enough(rows, 4)) == {"wide", "twice", "in", "more"} and clone_groups.long_enough(rows, 1).count() == len(INSTANCES)
    assert clone_groups.pruned(rows.limit(0)).count() == 0 and clone_groups.without_contained(rows.limit(0)).count() == 0
    ends = spark.createDataFrame([(1, 3, 1, 0, 9), (1, 3, 2, 0, 9), (3, 3, 1, 0, 9), (1, 3, 1, 9, 9)], "s int, e int, c int, b int, f int")
    assert [r[0] for r in ends.select(clone_groups.last_line(*(F.col(c) for c in "secbf"))).collect()] == [2, 3, 3, 3]


def test_pairs_and_matches(spark):
    place = "struct<path: string, b: long, e: long>"
    near = spark.createDataFrame([("near", "en", ("p", 0, 9), ("q", 0, 9), 0.95), ("near", "en", ("q", 5, 9), ("p", 0, 4), 0.86)], f"kind string, language string, a {place}, b {place}, similarity double")
    exact = spark.createDataFrame([(("q", 0, 9), ("p", 0, 9))], f"a {place}, b {place}")
    assert [r.similarity for r in clone_groups.beyond_exact(near, exact).collect()] == [0.86]
    found = clone_groups.findings(near).collect()
    assert [r.confidence for r in found] == ["high", "medium"]
    assert found[0].id == clone_groups.findings(near.select("kind", "language", F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).first().id
    matches = spark.createDataFrame([("x", "y", 0, 0, 50, 5, 0.9), ("x", "y", 10, 10, 40, 5, 1.0), ("x", "y", 10, 200, 40, 5, 1.0), ("x", "z", 0, 0, 40, 5, 1.0)], "file_a string, file_b string, a long, b long, tokens long, lines long, similarity double")
    assert sorted((r.file_b, r.a, r.b, r.checked) for r in clone_groups.apart(matches, 100).collect()) == [("y", 0, 0, True), ("y", 10, 200, True), ("z", 0, 0, True)]
    assert sum(not r.checked for r in clone_groups.apart(matches, 0).collect()) == 2


def test_roles_and_configurations(spark):
    rows = spark.createDataFrame([("a/AGENTS.md",), ("README.rst",), ("x/tsconfig.base.json",), ("Cargo.toml",), ("a/b.py",), ("web/vite.config.ts",)], "path string")
    got = {r.path: (r.r and tuple(r.r), r.c) for r in rows.select("path", paths.support_role(F.col("path")).alias("r"), paths.is_project_configuration(F.col("path")).alias("c")).collect()}
    assert got == {"a/AGENTS.md": (("repository instructions", 700.0), False), "README.rst": (("project overview", 350.0), False), "x/tsconfig.base.json": (("project manifest or build configuration", 325.0), False), "Cargo.toml": (("project manifest or build configuration", 325.0), True), "a/b.py": (None, False), "web/vite.config.ts": (None, True)}
    pairs = spark.createDataFrame([("a/x.json", "a/b/c.py", True), ("a/x.json", "ab/c.py", False), ("x.json", "q", True), ("a/x.json", "a", True)], "c string, p string, want boolean")
    assert all(r.want == r.got for r in pairs.select("want", paths.config_governs(F.col("c"), F.col("p")).alias("got")).collect())


def test_relations_and_confidence(spark):
    files = spark.createDataFrame([("src/a.py", 0.1), ("src/b.py", 0.5), ("src/c.py", 0.0), ("tests/test_a.py", 0.0), ("lib/d.py", 0.0)], "path string, risk double")
    edges = spark.createDataFrame([("src/a.py", "lib/d.py")], "source string, target string")
    score = lambda seeds: {r.path: r.score for r in context.relations(files, seeds, edges).collect()}
    assert score(context.planning_seeds(files, ["src/a.py"])) == {"src/a.py": 1200.0, "src/b.py": 250.0, "src/c.py": 250.0, "tests/test_a.py": 500.0, "lib/d.py": 600.0}
    changed = context.planning_seeds(files, [], files.where("path = 'src/a.py'"))
    assert score(changed) == {"src/a.py": 0.0, "src/b.py": 250.0, "src/c.py": 75.0, "tests/test_a.py": 500.0, "lib/d.py": 600.0}
    assert {r.path for r in context.planning_seeds(files, ["src"]).collect()} == {"src/a.py", "src/b.py", "src/c.py"}
    facts = spark.createDataFrame([("high", "high", "partial", 2, 2, 0, 0, False), ("high", "none", "none", 2, 1, 1, 1, True), ("high", "high", "high", 0, 0, 0, 0, False)], "observed string, discovery string, test_mapping string, graph_eligible int, graph_covered int, relevant_gaps int, outside_gaps int, truncated boolean")
    got = [(r.confidence, r.reasons) for r in context.confidence(facts).collect()]
    assert got == [("high", ["test-mapping-heuristic"]), ("partial", ["changed-graph-coverage-incomplete", "relevant-graph-gaps", "repository-graph-gaps", "scan-truncated", "no-matching-tests"]), ("none", ["no-graph-eligible-changes"])]
    entries = spark.createDataFrame([(1, "a", "changed"), (2, "b", "dependent"), (3, "a", "focus")], "ord long, path string, role string")
    read = {r.path: (r.ord, r.roles) for r in context.merged_reading(entries, spark.createDataFrame([("b",), ("t",)], "path string")).collect()}
    assert read == {"a": (1, ["changed", "focus"]), "b": (2, ["dependent", "matching-test"]), "t": (None, ["matching-test"])}
