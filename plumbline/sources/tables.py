"""The relations of the engine over the tables of a folder.

| relation | made from |
|---|---|
| files(path, language, content) | documents, pages |
| commit_deltas(oid, ord, author, ts, path) | events |
| edges(source, target) | lineitem: parts on neighbouring lines of an order; events: event types that follow each other |
| changed_lines(path, start, end) | lineitem: line numbers of an order |
| findings(fingerprint, kind, path, severity, score) | risk and complexity of documents |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    return table(spark, folder, "documents").select(path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), "doc_id")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("HTML").alias("language"), F.col("html").alias("content"), F.col("page_id").alias("doc_id"))


def commit_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """An event is a commit by its user; the file that it touches is the document whose doc_id is the user's id."""
    events = table(spark, folder, "events").select(F.col("event_id").alias("oid"), F.col("event_type").alias("author"), "ts", F.col("user_id"))
    paths = document_files(spark, folder).select("path", "doc_id")
    return events.join(paths, events["user_id"] == paths["doc_id"]).select("oid", "author", "ts", "path")


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct pairs of parts on neighbouring lines of an order."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(line).alias("target"))
    return rows.where("source <> target").distinct()


def event_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct pairs of event types that follow each other for a user."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(line).alias("target"))
    return rows.where("source <> target").distinct()
