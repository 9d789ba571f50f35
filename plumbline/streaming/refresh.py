"""Incremental refresh by Structured Streaming: new files of a stream update tables and a revision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watched(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def revised(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls refresh(batch, revision) for each batch with rows. A batch that is run again after a failure has the same
    revision, so a refresh that overwrites its revision's output happens once in effect."""

    def one(batch: DataFrame, revision: int) -> None:
        if not batch.isEmpty():
            refresh(batch, revision)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def churn_by_window(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Touches of each path by event-time window; state is dropped once the watermark has passed."""
    by = [F.window("ts", window).alias("window"), "path"]
    out = events.withWatermark("ts", late).groupBy(*by).agg(F.count("*").alias("touches"), F.approx_count_distinct("author").alias("authors"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "path", "touches", "authors")
