import pytest
from pyspark.sql import functions as F

from plumbline.functions import classify, complexity, lines, paths
from plumbline.lang import LANGUAGES, detect, is_code, is_source, language_of
from plumbline.operators import gates, locate
from plumbline.config import ScanConfig, layered


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_halstead_equations(spark):
    h = F.struct(*(F.lit(v).alias(k) for k, v in (("distinct_operators", 25), ("distinct_operands", 12), ("total_operators", 46), ("total_operands", 26))))
    x = one(spark, complexity.halstead(h), a=1)
    assert (x.vocabulary, x.length) == (37, 72)
    assert (x.volume, x.difficulty, x.effort) == pytest.approx((375.08064232528443, 27.083333333333332, 10158.434062976452))


def test_maintainability_and_risk(spark):
    assert one(spark, complexity.maintainability_index(F.lit(100.0), F.lit(10), F.lit(50)), a=1) == pytest.approx(47.589673885921606)
    assert one(spark, complexity.risk_score(F.lit(1000), F.lit(100), F.lit(20)), a=1) == pytest.approx(0.5)
    assert one(spark, complexity.risk_reasons(F.lit(660), F.lit(65), F.lit(20)), a=1) == ["size", "churn"]


def test_lines(spark):
    x = one(spark, lines.line_stats(F.col("c")), c='{\n\n  "value": 1\n}\n')
    assert (x.loc, x.sloc, x.blank_lines, x.comment_lines) == (4, 3, 1, 0)
    x = one(spark, lines.line_stats(F.col("c"), True), c="# a\r\n\t\r\nx # b\n")
    assert (x.loc, x.sloc, x.blank_lines, x.comment_lines) == (3, 1, 1, 1)
    assert one(spark, lines.line_stats(F.col("c")), c="").loc == 0
    assert one(spark, lines.max_brace_depth(F.col("c")), c="}}{a{b}{c{}}}") == 3
    assert one(spark, lines.marker_count(F.col("c"), "TODO"), c="TODO TODOS xTODO TODO: (TODO)") == 3


def test_heuristics(spark):
    assert one(spark, complexity.heuristic_cyclomatic(F.col("c")), c="if (a && b || c) { x ? y : z } else iffy; while (1) for (;;) {}") == 7
    h = one(spark, complexity.halstead_counts(F.col("c")), c="a += b->c::d && e")
    assert (h.distinct_operators, h.total_operators, h.total_operands) == (4, 4, 5)


@pytest.mark.parametrize(("path", "content", "hint"), [("a.min.js", "x", "minified"), ("a.js", "x" * 2001, "minified"), ("dist/a.js", "x", "bundled"), ("s/chunk-1a2b3c.js", "x", "bundled"), ("a.pb.go", "x", "generated"), ("a.py", "\n# Code generated by x", "generated"), ("vendor/a.py", "x", "vendored"), ("a.py", "docs about code generated by x", None)])
def test_skip_hints(spark, path, content, hint):
    assert one(spark, classify.skip_hint(F.col("p"), F.col("c")), p=path, c=content) == hint


def test_paths(spark):
    assert [one(spark, paths.dir_bucket(F.lit(p), n), a=1) for p, n in (("src/metrics/x.rs", 1), ("src/metrics/x.rs", 2), ("README.md", 1))] == ["src", "src/metrics", "."]
    tests = {"tests/a.rs": True, "src/test_a.py": True, "a.spec.ts": True, "src/FooTest.php": True, "src/latest.py": False, "a_test.go": True}
    assert {p: one(spark, paths.is_test_file(F.lit(p)), a=1) for p in tests} == tests
    starts = {"src/main.go": True, "x/__init__.py": True, "a.d.ts": True, "src/domain.go": False}
    assert {p: one(spark, paths.is_entrypoint(F.lit(p)), a=1) for p in starts} == starts


def test_languages(spark):
    some = {"a/b.RS": "Rust", "Dockerfile": "Dockerfile", "x/Dockerfile.dev": "Dockerfile", "Makefile": "Makefile", "a.tsx": "TSX", "a.unknown": None, "README": None, ".hidden": None}
    assert {p: detect(p) for p in some} == some
    assert {p: one(spark, language_of(F.lit(p)), a=1) for p in some} == some
    assert len(LANGUAGES) == 31 and one(spark, is_source(F.lit("Dockerfile")) & ~is_code(F.lit("Dockerfile")), a=1)


def test_match_rank(spark):
    names = ["foo", "FOO", "a.foo", "a::FOO", "foobar", "xfoo", "bar"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.x for r in rows.select(locate.match_rank(F.col("name"), "foo").alias("x")).collect()] == [0, 1, 2, 3, 4, 5, None]
    assert [r.x for r in rows.select(locate.match_rank(F.col("name"), "foo", True).alias("x")).collect()] == [0, None, 2, None, None, None, None]


def test_gates():
    assert gates.parsed("sloc > 10, min-mi<=2.5") == [("sloc", ">", 10.0), ("min-mi", "<=", 2.5)]
    for bad in ("sloc", "what > 1", "sloc > x", "sloc > inf"):
        with pytest.raises(ValueError):
            gates.parsed(bad)


def test_config():
    assert layered({"top": 3}, {"top": None, "markers": ["A"]}, {"max_files": 10**9}) == ScanConfig(top=3, markers=("A",), max_files=500_000)
    assert ScanConfig().safe().max_files == 20_000
