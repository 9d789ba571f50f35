"""Catalogues of findings, their comparison, renames, and the part that changed lines touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals

CATALOG = "fingerprint string, kind string, path string, identity string, severity string, message string, start_line long, end_line long, score double"


def fingerprint(kind: Column, path: Column, identity: Column) -> Column:
    return F.concat(kind, F.lit(":v1:"), F.md5(F.concat_ws("|", kind, path, identity)))


def record(kind: str, identity: Column, severity: Column, message: Column, start: Column, end: Column, score: Column) -> list[Column]:
    return [fingerprint(F.lit(kind), F.col("path"), identity).alias("fingerprint"), F.lit(kind).alias("kind"), F.col("path"), identity.alias("identity"), severity.alias("severity"), message.alias("message"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), score.cast("double").alias("score")]


def catalog(files: DataFrame | None = None, markers: DataFrame | None = None, risks: DataFrame | None = None, clones: DataFrame | None = None, max_complexity: int = 20, risk_threshold: float = 0.7) -> DataFrame:
    """The union of the kinds of findings for which rows are given.

    files: path, cyclomatic, loc. markers: path, marker, line, context_hash, ordinal. risks: path, score. clones: path, start, end
    (token positions, which stand in start_line and end_line), each range once.
    """
    warning, parts = F.lit("warning"), []
    if files is not None:
        over = files.where(F.col("cyclomatic") > max_complexity)
        parts.append(over.select(*record("complexity", F.lit("file"), warning, F.format_string("cyclomatic complexity %d exceeds %d", F.col("cyclomatic"), F.lit(max_complexity)), F.lit(1), F.greatest(F.col("loc"), F.lit(1)), F.col("cyclomatic"))))
    if markers is not None:
        identity = F.concat_ws("|", "marker", "context_hash", F.col("ordinal").cast("string"))
        severity = F.when(F.col("marker").isin("FIXME", "BUG", "HACK", "XXX"), warning).otherwise(F.lit("note"))
        parts.append(markers.select(*record("marker", identity, severity, F.concat(F.col("marker"), F.lit(" marker")), F.col("line"), F.col("line"), F.lit(None))))
    if risks is not None:
        parts.append(risks.where(F.col("score") >= risk_threshold).select(*record("risk", F.lit("file"), warning, F.format_string("risk %.2f", F.col("score")), F.lit(1), F.lit(1), F.col("score"))))
    if clones is not None:
        identity = F.concat_ws("|", F.col("start").cast("string"), F.col("end").cast("string"))
        parts.append(clones.select(*record("duplication", identity, warning, F.format_string("%d tokens repeated", F.col("end") - F.col("start")), F.col("start"), F.col("end"), F.col("end") - F.col("start"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare(before: DataFrame, after: DataFrame, band: float = 0.01) -> DataFrame:
    """fingerprint, kind, path and state (new, worsened, improved, resolved) of what differs; risk within `band` is equal."""
    b = before.select("fingerprint", F.struct("kind", "path", "score").alias("b"))
    a = after.select("fingerprint", F.struct("kind", "path", "score").alias("a"))
    rows = a.join(b, "fingerprint", "full_outer")
    change = F.coalesce("a.score", F.lit(0.0)) - F.coalesce("b.score", F.lit(0.0))
    still = F.when(F.coalesce("a.kind", "b.kind") == "risk", F.abs(change) < band).otherwise(change == 0)
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "resolved").when(still, None).when(change > 0, "worsened").otherwise("improved")
    rows = rows.select("fingerprint", F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))
    return rows.where("state is not null")


def state_rank(state: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ("new", "worsened", "improved", "resolved"))), state), F.lit(5)) - 1


def remapped(findings: DataFrame, renames: DataFrame) -> DataFrame:
    """findings under the new paths of renamed files, with new fingerprints. renames: old_path, new_path."""
    rows = findings.join(renames.select(F.col("old_path").alias("path"), "new_path"), "path", "left").withColumn("path", F.coalesce("new_path", "path"))
    return rows.withColumn("fingerprint", fingerprint(F.col("kind"), F.col("path"), F.col("identity"))).drop("new_path")


def touched(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """findings whose lines meet a changed range of their file. changed: path, b, e (both ends included)."""
    rows = findings.withColumnsRenamed({"start_line": "b", "end_line": "e"})
    return intervals.overlapping(rows, changed, "path").withColumnsRenamed({"b": "start_line", "e": "end_line"})


def baseline_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after and regressed for two one-row summaries: duplication and complexity may not grow, maintainability not fall."""
    rules = {"duplicated_pct": ("after - before > 0.01"), "avg_maintainability": "before - after > 0.01", "min_maintainability": "before - after > 0.01", "max_cyclomatic": "after > before"}
    tall = lambda df, name: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*(F.col(c).cast("double") for c in rules)))).alias("metric", name))
    rows = tall(before, "before").join(tall(after, "after"), "metric")
    test = F.lit(False)
    for name, rule in rules.items():
        test = F.when(F.col("metric") == name, F.expr(rule)).otherwise(test)
    return rows.withColumn("regressed", test)
