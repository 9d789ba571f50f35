"""Directed graphs as (source, target) rows: degrees, bounded and unbounded reach, components and cycles.

Loops over the graph run a join for each step, with its result in the shared folder to cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, kept


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select(F.col("target").alias("node"))).distinct()


def fans(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, fan_in and fan_out; one aggregation over both ends of each edge."""
    ends = edges.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if nodes is not None:
        ends = ends.union(nodes.select("node", F.lit(0), F.lit(0)))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def top_nodes(fan: DataFrame, by: str, n: int) -> DataFrame:
    return fan.where(F.col(by) > 0).orderBy(F.desc(by), "node").limit(n).select("node", by)


def orphans(fan: DataFrame) -> DataFrame:
    return fan.where("fan_in = 0").select("node")


def reached(edges: DataFrame, seeds: DataFrame, depth: int | None = None, direction: str = "dependencies") -> DataFrame:
    """node and distance of all nodes within `depth` steps of the seeds (column node), themselves at 0.

    direction: along edges (dependencies), against them (dependents), or both.
    """
    step = edges.select("source", "target")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    step = {"dependencies": step, "dependents": back, "both": step.union(back)}[direction]
    # As files their sizes are known: edges are made once, and a small frontier meets them by a broadcast.
    step = kept(step, "edges") if depth is None or depth > 1 else step
    seen = frontier = kept(seeds.select("node").distinct().withColumn("distance", F.lit(0).cast("long")), "reached")
    k = 0
    while (depth is None or k < depth) and not frontier.isEmpty():
        k += 1
        ahead = frontier.join(step, frontier["node"] == step["source"]).select(F.col("target").alias("node")).distinct()
        frontier = kept(ahead.join(seen, "node", "left_anti").withColumn("distance", F.lit(k).cast("long")), "frontier")
        seen = kept(seen.union(frontier), "reached")
    return seen


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """What depends on the changed nodes: node, distance, and direct or transitive; the changed ones themselves left out."""
    found = reached(edges, changed, None, "dependents").where("distance > 0")
    return found.withColumn("kind", F.when(F.col("distance") == 1, F.lit("direct")).otherwise(F.lit("transitive")))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and component, the least node that is connected to it in either direction.

    Each round gives every node its least neighbour if that is less, follows those links to their ends, and puts the ends in the
    place of the nodes of the edges; an edge within one end goes. Of the nodes that have an edge left no two neighbours are both
    ends, so at most half of them stay; edges are read a few times in all, not once for each step of the longest path.
    """
    left = kept(edges.select("source", "target"), "edges")
    label = None
    for _ in range(rounds):
        ends = left.union(left.select(F.col("target"), F.col("source")))
        link = kept(ends.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("end")).select("node", F.least("node", "end").alias("end")), "links")
        for _ in range(rounds):
            ahead = link.select(F.col("node").alias("end"), F.col("end").alias("further"))
            new = kept(link.join(ahead, "end").select("node", F.col("further").alias("end"), (F.col("further") != F.col("end")).alias("moved")), "links")
            link = new.select("node", "end")
            if new.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        if label is None:
            label = link.withColumnRenamed("end", "component")
        else:
            known = link.select(F.col("node").alias("component"), "end")
            label = kept(label.join(known, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels")
        a, b = (link.select(F.col("node").alias(side), F.col("end").alias(f"{side}_end")) for side in ("source", "target"))
        left = left.join(a, "source").join(b, "target").where("source_end <> target_end")
        left = kept(left.select(F.col("source_end").alias("source"), F.col("target_end").alias("target")).distinct(), "edges")
        if left.isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node and component of nodes on a cycle: each round gives every node the least node that reaches it, and those that
    reach that root back along edges of the same colour form a component, which then leaves the graph."""
    left = cut(edges.select("source", "target").where("source <> target").distinct())
    found = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        colour = cut(nodes_of(left).withColumn("colour", F.col("node")))
        while True:
            offers = left.join(colour, left["source"] == colour["node"]).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("offer"))
            new = cut(colour.join(offers, "node", "left").select("node", F.col("colour").alias("was"), F.least("colour", F.coalesce("offer", "colour")).alias("colour")))
            colour = new.select("node", "colour")
            if new.where("was <> colour").isEmpty():
                break
        a, b = colour.select(F.col("node").alias("source"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("target"), F.col("colour").alias("cb"))
        same = cut(left.join(a, "source").join(b, "target").where("ca = cb").select("source", "target"))
        roots = colour.where("node = colour").select("node")
        members = reached(same, roots, None, "dependents").select("node").join(colour, "node").select("node", F.col("colour").alias("component"))
        members = cut(members)
        found = members if found is None else found.union(members)
        gone = members.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target"))
    if found is None:
        return nodes_of(edges).withColumn("component", F.col("node")).limit(0)
    return cut(found)


def cycles(edges: DataFrame) -> DataFrame:
    """component, its size and members: strong components of two nodes or more, and nodes with an edge to themselves."""
    strong = strong_components(edges).groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members")).where("size > 1")
    loops = edges.where("source = target").select(F.col("source").alias("component"), F.lit(1).cast("long").alias("size"), F.col("source").cast("string").alias("members")).distinct()
    return strong.select("component", "size", F.col("members")).union(loops)


def resolved(references: DataFrame) -> DataFrame:
    """(source, target, relation) once, with the resolver of the best rank. references: those columns, resolver and rank."""
    return references.groupBy("source", "target", "relation").agg(F.min_by("resolver", F.struct("rank", "resolver")).alias("resolver"), F.count("*").alias("references"))


def projected(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges between selected nodes (column node)."""
    keep = selected.select("node")
    return edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi")
