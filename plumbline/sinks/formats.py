"""Reports as JSON, NDJSON, SARIF, Markdown, DOT and Mermaid.

Rows go through Spark's writers where they may be many (ndjson); documents of one object (JSON, SARIF, Markdown, graphs)
are made on the driver, from tables that the report has cut to a bounded number of rows.
"""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = {"error": "error", "warning": "warning", "note": "note"}


def ndjson(tables: dict[str, DataFrame], path: str) -> None:
    """One line for each row of each table, tagged by kind, written by the executors."""
    out = None
    for kind, table in tables.items():
        rows = table.select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*table.columns).alias("record"))).alias("value"))
        out = rows if out is None else out.union(rows)
    out.write.mode("overwrite").text(path)


def _plain(value):
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, dict, type(None))) else str(value)


def document(tables: dict[str, DataFrame], pretty: bool = False) -> str:
    """A JSON object with a list of records for each table."""
    return json.dumps({k: [_plain(r) for r in t.collect()] for k, t in tables.items()}, ensure_ascii=False, indent=2 if pretty else None)


def sarif(findings: DataFrame, states: DataFrame | None = None) -> str:
    """SARIF 2.1.0 of a catalogue of findings; states (fingerprint, state) give each a baseline state."""
    if states is not None:
        findings = findings.join(states.select("fingerprint", "state"), "fingerprint", "left")
    baseline = {"new": "new", "worsened": "updated", "improved": "updated", "resolved": "absent"}
    results, rules = [], set()
    for r in findings.orderBy("kind", "path", "start_line", "fingerprint").collect():
        rules.add(r.kind)
        place = {"artifactLocation": {"uri": r.path}, "region": {"startLine": int(r.start_line), "endLine": int(r.end_line)}}
        result = {"ruleId": r.kind, "level": LEVELS.get(r.severity, "none"), "message": {"text": r.message}, "locations": [{"physicalLocation": place}], "partialFingerprints": {"primary": r.fingerprint}}
        if states is not None:
            result["baselineState"] = baseline.get(r.state, "unchanged")
        results.append(result)
    driver = {"name": "plumbline", "rules": [{"id": k} for k in sorted(rules)]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]})


def markdown(tables: dict[str, DataFrame]) -> str:
    out = []
    for name, table in tables.items():
        columns = table.columns
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        out += [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
        out += ["| " + " | ".join(cell(v) for v in row) + " |" for row in table.collect()] + [""]
    return "\n".join(out)


def dot(edges: DataFrame) -> str:
    quote = lambda x: json.dumps(str(x), ensure_ascii=False)
    lines = [f"  {quote(r.source)} -> {quote(r.target)};" for r in edges.orderBy("source", "target").collect()]
    return "\n".join(["digraph dependencies {", *lines, "}"])


def mermaid(edges: DataFrame) -> str:
    rows = edges.orderBy("source", "target").collect()
    names = {n: f"n{k}" for k, n in enumerate(sorted({str(x) for r in rows for x in (r.source, r.target)}))}
    label = lambda n: n.replace('"', "#quot;")
    nodes = [f'  {v}["{label(n)}"]' for n, v in names.items()]
    return "\n".join(["flowchart LR", *nodes, *(f"  {names[str(r.source)]} --> {names[str(r.target)]}" for r in rows)])


def write_atomic(text: str, path: str) -> None:
    """text at path, in one step: readers see the old file or the new one. A link at path isn't followed."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)
