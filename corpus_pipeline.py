"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language_id, line_dedup, mixing, near_copies
from plumbline.llm.shared import written

#: SQL can't express the stages.
ORACLE_SQL = None
#: Rows of an Arrow batch where the session leaves Spark's number of 10,000: with whole texts these are 20 MB and more, in
#: the JVM and in Python, for each running task.
BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told: those without a letter, or without a clear best language, go."""
    small_batches(spark)
    found = language_id.identified(docs, language_id.learned(docs))
    return found.where(language_id.accepted()).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; n_chars, if there is such a column, is that of the text left."""
    small_batches(spark)
    found = line_dedup.cleaned(docs, docs.columns)
    sizes = F.when(F.col("n_dropped") > 0, F.length("text").cast("long"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(sizes, F.col("row.n_chars"))
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by similarities of 0.8 or more over five-word shingles, that of the smallest doc_id."""
    small_batches(spark)
    return near_copies.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of an item of `benchmark`, however short a part of the document it is."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with size, source_size, target and taken.

    A column of docs that has one of these names, in any case, keeps it; the new one then takes the prefix mix_.
    """
    small_batches(spark)
    found = mixing.mixed(docs).where("taken > 0")
    names, new = {c.lower() for c in docs.columns}, []
    for c in ("size", "source_size", "target", "taken"):
        name = c
        while name in names:
            name = f"mix_{name}"
        new.append(F.col(c).alias(name))
    return found.select("row.*", *new)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("simhash_near_dedup", near_dedup), ("decontamination", clean), ("source_mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives for `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
