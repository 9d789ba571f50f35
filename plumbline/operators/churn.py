"""Churn of files from commit deltas, and risk and hotspots with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexity
from ..session import cut


def churn(deltas: DataFrame) -> DataFrame:
    """commits, authors and first and last time of each path; a path counts once for each commit."""
    return deltas.groupBy("path").agg(F.count_distinct("oid").alias("commits"), F.count_distinct("author").alias("authors"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"))


def recent(deltas: DataFrame, commits: int) -> DataFrame:
    """The deltas of the latest commits, by time and then id: the budget that churn reads."""
    latest = deltas.select("oid", "ts").distinct().orderBy(F.desc("ts"), F.desc("oid")).limit(commits).select("oid")
    return deltas.join(latest, "oid", "left_semi")


def within_budget(deltas: DataFrame, per_commit: int, total: int) -> DataFrame:
    """Deltas of commits under the cap for one commit, newest commits first, until `total` are read."""
    sizes = deltas.groupBy("oid", "ts").agg(F.count("*").alias("n")).where(F.col("n") <= per_commit)
    running = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("ts"), F.desc("oid")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return deltas.join(running.where(F.col("before") + F.col("n") <= total).select("oid"), "oid", "left_semi")


def renamed(deltas: DataFrame, renames: DataFrame, rounds: int = 50) -> DataFrame:
    """Deltas under the last name of each path. renames: (old_path, path) chains without branches.

    Chains are shortened by pointer doubling, so the rounds grow with the logarithm of the longest.
    """
    chain = renames.select(F.col("old_path").alias("name"), F.col("path").alias("last")).distinct()
    for _ in range(rounds):
        ahead = chain.select(F.col("name").alias("last"), F.col("last").alias("further"))
        longer = chain.join(ahead, "last", "left").select("name", F.coalesce("further", "last").alias("last"), F.col("further").isNotNull().alias("moved"))
        longer = cut(longer)
        chain = longer.select("name", "last")
        if longer.where("moved").isEmpty():
            break
    return deltas.join(chain, deltas["path"] == chain["name"], "left").withColumn("path", F.coalesce("last", "path")).drop("name", "last")


def with_churn(files: DataFrame, history: DataFrame) -> DataFrame:
    return files.join(history, "path", "left").withColumns({"commits": F.coalesce("commits", F.lit(0)), "authors": F.coalesce("authors", F.lit(0))})


def hotspots(files: DataFrame, n: int) -> DataFrame:
    """Files with commits by commits * (cyclomatic + 1)."""
    rows = files.where("commits > 0").withColumn("score", F.col("commits") * (F.col("cyclomatic") + 1))
    return rows.orderBy(F.desc("score"), "path").limit(n).select("path", "commits", "cyclomatic", "score")


def risks(files: DataFrame) -> DataFrame:
    """path, score and reasons of files whose score isn't zero."""
    columns = (F.col("sloc"), F.col("cyclomatic"), F.col("commits"))
    rows = files.withColumns({"score": complexity.risk_score(*columns), "reasons": F.array_join(complexity.risk_reasons(*columns), ",")})
    return rows.where("score > 0").select("path", "score", "sloc", "cyclomatic", "commits", "reasons")


def top_risks(risk: DataFrame, n: int) -> DataFrame:
    return risk.orderBy(F.desc("score"), F.desc("sloc"), F.desc("cyclomatic"), F.desc("commits"), "path").limit(n)
