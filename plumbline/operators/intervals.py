"""Sets of intervals as rows, by gaps and islands; one sort for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(rows: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """The union of [b, e) for each key; closed: of [b, e], where neighbours one apart merge."""
    reach = 1 if closed else 0
    before = Window.partitionBy(*keys).orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("b", "e").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("b <= e" if closed else "b < e").withColumn("_far", F.max("e").over(before))
    rows = rows.withColumn("_island", F.sum((F.col("_far").isNull() | (F.col("b") > F.col("_far") + reach)).cast("long")).over(upto))
    return rows.groupBy(*keys, "_island").agg(F.min("b").alias("b"), F.max("e").alias("e")).drop("_island")


def _fresh(far: Column) -> Column:
    """What [b, e) adds to the union of the intervals before it, which reach up to `far`."""
    return F.greatest(F.col("e") - F.greatest("b", far), F.lit(0))


def length(rows: DataFrame, keys: list[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    return rows.where("b < e").withColumn("_n", _fresh(F.max("e").over(before))).groupBy(*keys).agg(F.sum("_n").alias("n"))


def without(rows: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the union of rows outside of the union of holes, for each key of rows: that of both less that of holes, in one
    sort for each key and without a join."""
    both = rows.select(*keys, "b", "e", F.lit(False).alias("_hole")).union(holes.select(*keys, "b", "e", F.lit(True))).where("b < e")
    before = Window.partitionBy(*keys).orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    hole = F.when(F.col("_hole"), F.col("e"))
    both = both.withColumns({"_all": _fresh(F.max("e").over(before)), "_cut": F.when(F.col("_hole"), _fresh(F.max(hole).over(before))).otherwise(F.lit(0))})
    return both.groupBy(*keys).agg((F.sum("_all") - F.sum("_cut")).alias("n"), F.count_if(~F.col("_hole")).alias("_own")).where("_own > 0").drop("_own")


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left that touch a row of right with the same key: [b, e] against [b, e], both ends included."""
    other = right.select(key, F.col("b").alias("_b"), F.col("e").alias("_e"))
    near = (left[key] == other[key]) & (left["b"] <= other["_e"]) & (other["_b"] <= left["e"])
    return left.join(other, near, "left_semi")
