"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) from all edges (u, v) in one task."""
    parent, kind = {}, None

    def root(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "component"])


def components(edges: DataFrame, rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, component) of the nodes that have an edge to another node; component: the least node reachable.

    edges: columns u and v of one ordered type. Loops, repeated and reversed edges and an empty table are fine;
    rows with a null end are no edges. Each round is two aggregations and two joins on node, so that no group is
    gathered; a round ends in a checkpoint. The number of rounds grows with the logarithm of the longest path.
    Up to `small` distinct edges are joined in one task instead, which spares the shuffles of all rounds.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    if small and edges.limit(small + 1).count() <= small:
        kind = edges.schema["u"].dataType.simpleString()
        return checkpointed(edges.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
