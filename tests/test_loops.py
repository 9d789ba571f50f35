import random

from pyspark.sql import functions as F

from plumbline.functions import complexity, lines
from plumbline.operators import graph, intervals, inventory
from plumbline.plans import catalogue


def jobs_of(spark, run):
    """How many stages read the table `counted`, by an accumulator in a Python function."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    run(count)
    return seen.value


def test_edges_are_made_once(spark):
    rows = spark.createDataFrame([(k, k + 1) for k in range(12)], "source long, target long").coalesce(1)
    for f in (lambda e: graph.reached(e, spark.range(1).toDF("node")), graph.components):
        assert jobs_of(spark, lambda count: f(rows.mapInArrow(count, rows.schema)).collect()) == 12  # noqa: B023


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(37)] + [(300 - k, 299 - k) for k in range(20)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "source long, target long"))
    assert {r.node: r.component for r in got.collect()} == {x: top(x) for x in list(up)}


def test_without_joins_no_intervals(spark):
    r = random.Random(3)
    some = lambda n: [(r.choice("abc"), b, b + r.randint(-1, 9)) for b in (r.randrange(60) for _ in range(n))]
    rows, holes = some(25), [*some(20), ("d", 1, 5)]
    cover = lambda x, k: {i for key, b, e in x if key == k for i in range(b, e)}
    frames = [spark.createDataFrame(x, "k string, b long, e long") for x in (rows, holes)]
    out = intervals.without(*frames, ["k"])
    assert {x.k: x.n for x in out.collect()} == {k: len(cover(rows, k) - cover(holes, k)) for k in "abc"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_measures_agree_with_their_definitions(spark):
    r = random.Random(4)
    parts = ["\n", "\r\n", " ", "\t", "if", "for x", "a&&&b", "|||", "?", "_if", "If", "é", "×", "==", "x1", "-", "\x0b", "\x1c", "😀", "and"]
    texts = ["", "\n", "\n\n", None, "a", "a\n", *("".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(500))]
    files = spark.createDataFrame([(t,) for t in texts], "content string").selectExpr("'p' as path", "content")
    c = F.col("content")
    own, all_ = inventory.measured(files), lines.lines(c)
    want = {"loc": F.size(all_).cast("long"), "blank_lines": lines.count_where(all_, lines.is_blank), "tokens": lines.token_estimate(c), "cyclomatic": complexity.heuristic_cyclomatic(c)}
    bad = own.select("*", *(v.alias(f"w_{k}") for k, v in want.items())).where(" or ".join(f"not ({k} <=> w_{k})" for k in want))
    assert bad.count() == 0


def test_summary_runs_once(spark):
    """What a gate or a comparison reads is one written row, not the measures and windows again for each of its branches."""
    for name in ("fail_gate_eval", "baseline_delta"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "content" not in plan
