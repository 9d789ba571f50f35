import random

from pyspark.sql import functions as F

from plumbline.operators import churn, clones, context, findings, graph, intervals


def test_intervals(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 8, 9), ("a", 20, 21), ("b", 4, 4)], "k string, b long, e long")
    assert sorted(map(tuple, intervals.union(rows, ["k"]).collect())) == [("a", 0, 9), ("a", 20, 21)]
    assert [r.n for r in intervals.length(rows, ["k"]).collect()] == [10]
    assert sorted(map(tuple, intervals.union(rows, ["k"], closed=True).collect())) == [("a", 0, 9), ("a", 20, 21), ("b", 4, 4)]
    holes = spark.createDataFrame([("a", 1, 3), ("a", 2, 6), ("a", 30, 40)], "k string, b long, e long")
    assert [r.n for r in intervals.without(rows, holes, ["k"]).collect()] == [5]


def test_regions_against_brute_force(spark):
    r, width = random.Random(2), 4
    texts = {f"p{k:02}": r.choices("abc", k=r.randint(0, 40)) for k in range(12)}
    files = spark.createDataFrame([(p, "x", " ".join(t)) for p, t in texts.items()], "path string, language string, content string")
    first, covered = {}, {}
    for p, t in sorted(texts.items()):
        for i in range(len(t) - width + 1):
            first.setdefault(tuple(t[i : i + width]), []).append((p, i))
    for places in first.values():
        if len(places) > 1:
            for p, i in places:
                covered.setdefault(p, set()).update(range(i, i + width))
    rows = clones.repeated(clones.windows(files, width))
    assert {r.path: r.n for r in clones.coverage(rows, width).collect()} == {p: len(s) for p, s in covered.items()}
    got = {(x.path, x.start, x.end, x.first_path, x.first_start) for x in clones.regions(rows, width).collect()}
    links = {(p, i): places[0] for places in first.values() for p, i in places[1:]}
    want = set()
    for (p, i), (q, j) in links.items():
        if links.get((p, i - 1)) != (q, j - 1):
            k = i
            while links.get((p, k + 1)) == (q, j + k + 1 - i):
                k += 1
            want.add((p, i, k + width, q, j))
    assert got == want


def test_renamed_clones(spark):
    files = spark.createDataFrame([("a", "x", "def f ( x ) : return x + 1"), ("b", "x", "def g ( y ) : return y + 2"), ("c", "x", "def g ( y ) : return z + 2")], "path string, language string, content string")
    found = clones.renamed_families(clones.shape_windows(files, 10)).collect()
    assert [(r.copies, r.variants, r.first_path, r.first_start) for r in found] == [(2, 2, "a", 0)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f"), ("g", "h")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.distance for r in graph.reached(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node: r.distance for r in graph.reached(edges, seeds, None, "both").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    changed = spark.createDataFrame([("e",)], "node string")
    assert {r.node: r.kind for r in graph.impact(edges, changed).collect()} == {"d": "direct", "c": "transitive", "b": "transitive", "a": "transitive"}
    assert {(r.component, r.size, r.members) for r in graph.cycles(edges).collect()} == {("a", 3, "a,b,c"), ("f", 1, "f")}
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "f": "f", "g": "g", "h": "g"}


def test_selection_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("a", 50, 9.0), ("b", 60, 8.0), ("c", 40, 7.0), ("d", 200, 7.0), ("e", 1, 1.0), ("f", 1, 0.5)], "path string, tokens long, score double")
    got = {r.path: r.reason for r in context.selected(rows, 100, 3).collect()}
    assert got == {"a": None, "b": "does not fit", "c": None, "d": "over the budget", "e": None, "f": "file limit"}


def test_renames_follow_chains(spark):
    deltas = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c"), (4, "x", "z")], "oid long, author string, path string").withColumn("ts", F.timestamp_seconds("oid"))
    renames = spark.createDataFrame([("a", "b"), ("b", "c")], "old_path string, path string")
    got = {r.path: (r.commits, r.authors) for r in churn.churn(churn.renamed(deltas, renames)).collect()}
    assert got == {"c": (3, 2), "z": (1, 1)}


def test_compare_states(spark):
    kind = "path string, score double"
    make = lambda rows: findings.catalog(risks=spark.createDataFrame(rows, kind), risk_threshold=0.0)
    got = findings.compare(make([("a", 0.5), ("b", 0.5), ("c", 0.5), ("d", 0.5)]), make([("a", 0.505), ("b", 0.7), ("c", 0.2), ("e", 0.9)]))
    assert {r.path: r.state for r in got.collect()} == {"b": "worsened", "c": "improved", "d": "resolved", "e": "new"}


def test_greedy_blocks(spark):
    assert [clones.longest_free(0, 10, x) for x in ([], [(2, 4)], [(0, 3), (2, 10)], [(20, 30)], [(-5, 1), (9, 12)])] == [10, 6, 0, 10, 8]
    kind = "path string, language string, first_path string, start long, end long, first_start long"
    rows = [("b", "x", "a", 0, 100, 0), ("c", "x", "a", 0, 100, 0), ("b", "x", "a", 10, 90, 10), ("d", "x", "a", 0, 60, 90)]
    got = clones.top_blocks(spark.createDataFrame(rows, kind), 5, 20)
    assert [(r.family, r.copies, r.impact) for r in got.collect()] == [("a:0:100", 3, 200), ("a:90:60", 2, 60)]
