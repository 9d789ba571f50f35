import json
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.config import ScanConfig
from plumbline.operators import findings
from plumbline.plans import scan
from plumbline.sinks import formats
from plumbline.sources import git, repo
from plumbline.streaming import refresh


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@x.org", *a], check=True, capture_output=True)
    body = "def f(x):\n    if x and x > 1:\n        return [y for y in range(x)]\n    # TODO check\n    return None\n\n\n"
    files = {"src/a.py": body * 4, "src/b.py": body * 4 + "z = 1\n", "__init__.py": "", ".gitignore": "build/\n*.log\n!keep.log\n", "build/x.py": "x", "web/x.min.js": "var a=1", "notes.md": "# x\n", "data.bin": "?", "tests/test_a.py": "import a\n", "yarn.lock": "x"}
    for path, text in files.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("mv", "src/b.py", "src/c.py")
    run("commit", "-qm", "two")
    (root / "src/a.py").write_text(body * 3 + "new = 2\n")
    (root / "more.py").write_text("x = 1\n")
    return str(root)


def test_listing(tree):
    rows, left = repo.listed(tree)
    assert [r[0] for r in rows] == ["__init__.py", "more.py", "notes.md", "src/a.py", "src/c.py", "tests/test_a.py", "web/x.min.js"]
    assert left["ignored"] == 2 and left["unrecognised"] == 2
    rows, left = repo.listed(tree, ScanConfig(max_files=2))
    assert len(rows) == 2 and left["over_files"] == 5


def test_scan_and_sinks(spark, tree, tmp_path):
    files, deltas = repo.files(spark, tree), git.commit_deltas(spark, tree)
    assert {r.kind for r in deltas.collect()} == {"A", "R"} and deltas.where("kind = 'R'").first().old_path == "src/b.py"
    report = scan.scan(files, deltas.select("oid", "author", "ts", "path"), ScanConfig(min_dup_tokens=20, max_complexity=5))
    assert report["summary"].first().files == 7 and {r.path for r in report["skip_candidates"].collect()} == {"web/x.min.js"}
    assert report["clones"].count() > 0 and {r.kind for r in report["findings"].collect()} == {"complexity", "duplication", "marker"}
    assert report["context"].where("reason is null").count() == 7
    assert scan.gated(report, "files > 6") and not scan.gated(report, "files > 7, sloc < 1")
    log = json.loads(formats.sarif(report["findings"]))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == report["findings"].count()
    before = report["findings"].where("kind <> 'marker'")
    states = findings.compare(before, report["findings"])
    assert {r["baselineState"] for r in json.loads(formats.sarif(report["findings"], states))["runs"][0]["results"]} == {"new", "unchanged"}
    formats.ndjson({"file": report["files"].select("path"), "risk": report["risks"].select("path", "score")}, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert {x["kind"] for x in lines} == {"file", "risk"}
    assert "| path |" in formats.markdown({"x": report["risks"].select("path")})
    assert json.loads(formats.document({"s": report["summary"]}))["s"][0]["files"] == 7
    formats.write_atomic("text", str(tmp_path / "file"))
    assert (tmp_path / "file").read_text() == "text"
    report["files"].unpersist()


def test_changes(spark, tree):
    assert {r.path for r in git.changed_files(spark, tree).collect()} == {"src/a.py", "more.py"}
    rows = {(r.path, r.side): (r.b, r.e) for r in git.changed_lines(spark, tree).collect()}
    assert rows[("src/a.py", "new")] == (22, 22) and rows[("src/a.py", "old")] == (22, 28)
    assert {r.path for r in git.snapshot(spark, tree).collect()} >= {"src/c.py", "notes.md"}


def test_graph_formats(spark):
    edges = spark.createDataFrame([("a", 'b"')], "source string, target string")
    assert formats.dot(edges) == 'digraph dependencies {\n  "a" -> "b\\"";\n}'
    assert formats.mermaid(edges) == 'flowchart LR\n  n0["a"]\n  n1["b#quot;"]\n  n0 --> n1'


def test_stream(spark, tmp_path):
    kind = "oid long, author string, ts timestamp, path string"
    rows = spark.createDataFrame([(1, "x", "a"), (2, "y", "a"), (3, "x", "b")], "oid long, author string, path string").withColumn("ts", F.timestamp_seconds(F.col("oid") * 86_400))
    rows.select("oid", "author", "ts", "path").write.parquet(str(tmp_path / "in"))
    schema = spark.createDataFrame([], kind).schema
    seen = []
    refresh.revised(refresh.watched(spark, str(tmp_path / "in"), schema), lambda batch, revision: seen.append((revision, batch.count())), str(tmp_path / "check")).awaitTermination(60)
    assert sum(n for _, n in seen) == 3
    query = refresh.churn_by_window(refresh.watched(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("touches").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("touches").agg(F.sum("touches").alias("n")).first().n == 3
