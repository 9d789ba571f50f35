"""Places that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of our own only where that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; it survives lost executors and goes with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df after checkpoint() into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of one key from which on a join spreads them, and how many such keys there may be at most.
HOT, HOT_KEYS = 100_000, 100_000


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], n: str, how: str = "inner", hot: int = HOT, counts: DataFrame | None = None) -> DataFrame:
    """rows joined with other on keys, where other has one row for each key and, in column n, how many rows that key has.

    Keys of more than `hot` rows are split: their row of other is repeated, and their rows are dealt by a hash. There are at
    most sum(n) / hot such keys, so their list is broadcast; hot grows with the table to keep it at HOT_KEYS. counts: keys
    and n alone, where they are cheaper to read than other.
    """
    counts = other if counts is None else counts
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = max(hot, total // HOT_KEYS)
    parts = F.greatest(F.ceil(F.col(n) / hot), F.lit(1)).cast("int")
    large = counts.where(F.col(n) > hot).select(*keys, parts.alias("_parts"))
    if total <= hot or large.isEmpty():
        return rows.join(other.drop(n), keys, how)
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), "_parts").cast("int"), F.lit(0))).drop("_parts")
    many = other.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.join(many, [*keys, "_part"], how).drop("_part")


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A map of `bits` bits, a power of two, of the longs in a column; 64 of them a row, so no more than bits / 64 rows reach the driver."""
    at = F.pmod(column, F.lit(bits))
    words = rows.select(F.floor(at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(-(-bits // 64), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned values may be in the map."""
    at = values & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
