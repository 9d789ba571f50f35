"""Whole reports: from files and history to the tables of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import paths
from ..operators import churn, clones, context, findings, gates, inventory


def scan(files: DataFrame, deltas: DataFrame | None = None, config: ScanConfig | None = None) -> dict[str, DataFrame]:
    """The tables of a report: summary, languages, directories, rankings, risks, clones, findings and a reading plan.

    files: path, language, content; rows without content are left out and counted. The measured files are persisted
    once, as all tables but those on clones are small aggregates of them; unpersist them with the key "files".
    """
    config = config or ScanConfig()
    measured = inventory.hinted(inventory.measured(files.where("content is not null"), comments=True)).drop("content")
    history = churn.churn(deltas) if deltas is not None else None
    if history is None:
        measured = measured.withColumns({"commits": F.lit(0).cast("long"), "authors": F.lit(0).cast("long")})
    else:
        measured = churn.with_churn(measured, history)
    measured = measured.persist()
    risk = churn.risks(measured.where(~paths.is_test_file(F.col("path"))))
    corpus = files.where("content is not null").join(measured.where("skip_hint in ('minified', 'bundled')").select("path"), "path", "left_anti")
    repeated = clones.repeated(clones.windows(corpus, config.min_dup_tokens))
    regions = clones.regions(repeated, config.min_dup_tokens)
    marks = inventory.marker_occurrences(files.where("content is not null"), list(config.markers))
    scores = context.scored(measured.join(risk.select("path", F.col("score").alias("risk")), "path", "left"))
    return {
        "files": measured,
        "summary": inventory.summary(measured, config.max_complexity),
        "languages": inventory.by_language(measured),
        "directories": inventory.by_directory(measured, 1),
        "top_tokens": inventory.top(measured, "tokens", config.top, "language"),
        "skip_candidates": inventory.top(measured.where("skip_hint is not null"), "tokens", config.top, "skip_hint"),
        "hotspots": churn.hotspots(measured, config.top),
        "risks": churn.top_risks(risk, config.top),
        "clones": regions,
        "duplicated_tokens": clones.coverage(repeated, config.min_dup_tokens),
        "findings": findings.catalog(measured, marks, risk, regions, config.max_complexity, config.risk_threshold),
        "context": context.selected(scores, config.context_tokens, config.context_files),
    }


def gated(report: dict[str, DataFrame], text: str) -> bool:
    """Whether a gate on the summary fails; metrics that weren't measured can't be asked for."""
    return bool(gates.failed(report["summary"], text).first().failed)
