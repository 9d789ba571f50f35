"""Near copies at a Jaccard similarity of 0.8 or more, by deletion-variant signatures over min-hashes.

Texts meet in two ways. Those whose SimHash fingerprints over five-word shingles `simhash.links` joins, by its index of
one-bit-less variants, meet as one bucket. But at a similarity of 0.8 some 10 of 64 bits differ, which no such index bridges.
So min-hashes of the distinct shingles are indexed in the same way, in SEGMENTS of LENGTH: texts that differ in at most one
value of some segment meet under that segment's variant with this value left out. The similarity of those that meet is
computed from their whole sets of shingles (64-bit hashes), so neither way joins what isn't near. Two texts of similarity s
meet by min-hashes with probability 1 - (1 - s^6 - 6 (1 - s) s^5)^6: 0.998 at 0.8, 0.9999 at 0.85. Equal texts are one node
from the start.

Members of a bucket aren't all paired. Each is compared with the bucket's least member, the pivot. Let R be any set, d(A) the
shingles in which a set A differs from R, and excess e(A) = 9 |d(A)| - |A|. A and B have a similarity of 0.8 or more if, and only
if, e(A) + e(B) <= 18 |d(A) & d(B)|. So pairs of which e(A) + e(B) <= 0 link for sure, and all of them through the member of
least excess; any other link shares at least (e(A) + e(B)) / 18 shingles of its differences. R is what most members of a
pivot have, so that differences are few, and texts that were edited apart from each other share next to none. Members meet by
the rarest of their shared differences (as many as the bound leaves, for each level of the other's excess). There each is
compared with one member first; then pairs that are still in different components are, where enough differences are left to
share. Nothing is capped. Texts that share many differences and yet aren't near still cost their number of pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from . import text as T
from .components import components
from .shared import bitmap, marked, spread_join, written
from .simhash import normal, one_of_each, shingle_hashes

#: Words of a shingle, and the similarity from which on two texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Two sets are that similar if, and only if, this times the shingles in which they differ are no more than both have: (1 + s) / (1 - s).
RATIO = 9
#: Segments of a signature, and min-hashes in each.
SEGMENTS, LENGTH = 6, 6

#: Bits of the map of texts whose sets are needed: 16 for each of them, up to this many. Texts that share a bit cost time only.
BITS = 1 << 27

#: Edges up to which components are found in one task.
SMALL = 100_000

#: Levels of excess for which the members of a pivot are indexed.
LEVELS = 8

SEEDS = T.mix(np.arange(1, SEGMENTS * LENGTH + 1, dtype=np.uint64))


def keys_batch(n_shingles: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The variant keys (a row of SEGMENTS x LENGTH for each text that has shingles) of the texts' shingle hashes."""
    full = n_shingles[n_shingles > 0]
    first = np.cumsum(full) - full
    with np.errstate(over="ignore"):
        least = [np.minimum.reduceat(T.mix(h ^ seed), first) for seed in SEEDS]
        parts = np.stack([T.mix(v + seed) for v, seed in zip(least, SEEDS, strict=True)], axis=1).reshape(-1, SEGMENTS, LENGTH)
        rest = parts.sum(axis=2, keepdims=True) - parts
        return T.mix(rest.reshape(-1, SEGMENTS * LENGTH) ^ SEEDS)


def _node(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, spare, node, fp, keys) for each row of docs. node: a 128-bit hash of its words; fp: its SimHash; keys: empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in T.slices(batch.column("text")):
                texts = normal(texts)
                n, h = shingle_hashes(texts, SHINGLE)
                keys = keys_batch(n, h).ravel().view(np.int64) if len(h) else np.zeros(0, np.int64)
                ends = np.append(0, np.cumsum((n > 0) * SEGMENTS * LENGTH)).astype(np.int32)
                columns = [batch.column("doc_id").slice(a, b - a), batch.column("spare").slice(a, b - a), pa.array([_node(t) for t in texts], pa.binary()), pa.array(simhash.fingerprints_of(n, h).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spare", "node", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("spare"))
    return rows.mapInArrow(run, "doc_id long, spare long, node binary, fp long, keys array<long>")


def mark(node: Column) -> Column:
    """A long of 60 bits of a node, for the map."""
    return F.conv(F.substring(F.hex(node), 1, 15), 16, 10).cast("long")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, shingles), once for each of `nodes` that a row of docs has; shingles: the n distinct hashes of its shingles.

    Only texts that a map of the nodes, of bounded size, doesn't rule out are cut into shingles and shuffled.
    """
    bits = min(BITS, 1 << max(20, (16 * nodes.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(nodes.select(mark(F.col("node")).alias("mark")), "mark", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in T.slices(batch.column("text")):
                texts = normal(texts)
                own = [_node(t) for t in texts]
                rows = np.flatnonzero(marked(shared.value, np.array([int.from_bytes(x[:8], "big") >> 4 for x in own], np.uint64)))
                if not len(rows):
                    continue
                n, h = shingle_hashes([texts[k] for k in rows], SHINGLE)
                sets = [np.unique(x) for x in np.split(h.view(np.int64), np.cumsum(n)[:-1])]
                ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in rows], pa.binary()), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "n", "shingles"])

    sets = docs.select("text").mapInArrow(run, "node binary, n int, shingles array<long>").dropDuplicates(["node"])
    return sets.join(nodes, "node", "left_semi")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with j, the Jaccard similarity of their sets."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("a_set") + F.size("b_set") - both)).alias("j"))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes (node, fp, keys) that join the same nodes as all links of the pairs that meet in a bucket."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node").unionByName(fingerprint_groups(nodes))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = written(keyed.join(buckets.drop("n"), "key").where("node <> pivot").select("node", "pivot").distinct(), "near-members")
    needed = written(members.select("node").union(members.select("pivot")).distinct(), "near-nodes")
    sets = written(shingle_sets(docs, needed), "near-sets")
    stars = written(similarities(members.select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets), "near-stars")
    near = stars.where(F.col("j") >= SIMILARITY).select("a", "b")
    return _rest(stars.select(F.col("a").alias("node"), F.col("b").alias("pivot")), near, sets).select(F.col("a").alias("u"), F.col("b").alias("v"))


def fingerprint_groups(nodes: DataFrame) -> DataFrame:
    """(key, node) for each of the nodes (node, fp, keys) that has words: key is one for all whose SimHash fingerprints `simhash.links` joins."""
    own = nodes.where(F.size("keys") > 0).select("node", "fp")
    found = components(simhash.links(own.select("fp").distinct()), small=SMALL).withColumnsRenamed({"node": "fp"})
    return own.join(found, "fp", "left").select(F.coalesce("component", "fp").alias("key"), "node")


def _grouped(rows: DataFrame, near: DataFrame) -> DataFrame:
    """rows with c, the component of node among the pairs `near`."""
    group = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")), small=SMALL)
    return rows.join(group, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _xor(a: str, b: str) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members (node, pivot, c) with an id, n, the size of the node's set, and d, what it differs in from the pivot's reference.

    The reference is the pivot's set, changed in each shingle in which more than half of the members differ from it.
    """
    own, pivots = sets.select("node", F.col("shingles").alias("own")), sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("other"))
    members = members.join(members.groupBy("pivot").agg(F.count("*").alias("m")), "pivot")
    rows = members.join(own, "node").join(pivots, "pivot")
    rows = written(rows.select(F.xxhash64("pivot").alias("group"), "node", "c", "m", F.size("own").alias("n"), _xor("own", "other").alias("d")), "near-differences")
    most = rows.select("group", "m", F.explode("d").alias("x")).groupBy("group", "x").agg(F.count("*").alias("f"), F.max("m").alias("m")).where("2 * f > m")
    most = most.groupBy("group").agg(F.collect_list("x").alias("most"))
    rows = rows.join(most, "group", "left").withColumn("d", F.when(F.col("most").isNull(), F.col("d")).otherwise(_xor("d", "most")))
    return written(rows.select(F.monotonically_increasing_id().alias("id"), "group", "node", "c", "n", "d"), "near-references")


def _overlap(a: Column, b: Column) -> Column:
    """How many shingles the differences of two members of these excesses must share at least, if the two aren't sure to link."""
    return F.greatest(F.ceil((a + b) / (2 * RATIO)), F.lit(1)).cast("int")


def _shared(rows: DataFrame) -> DataFrame:
    """rows (id, group, c, excess, least, d) with shared: those of d that another row of the group has too, rare ones first.

    Without rows that have too few of them for any link. A shingle of a group is a 64-bit hash of both; two of one hash
    would bring more pairs together, not fewer.
    """
    each = rows.select("id", "group", F.explode("d").alias("x")).select("id", F.xxhash64("group", "x").alias("x"))
    each = each.withColumn("f", F.count("*").over(Window.partitionBy("x"))).where("f > 1")
    found = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("shared"))
    found = rows.drop("d").join(found.select("id", F.col("shared.x").alias("shared")), "id")
    return written(found.where(F.size("shared") >= _overlap(F.col("excess"), F.col("least"))), "near-shared")


def _keys(rows: DataFrame) -> DataFrame:
    """`_shared` rows under the shingles by which they meet: (x, side, id, c, excess, left); those of opposite sides meet.

    A member is there once for each level of excesses that it may link to, with the first of its shared shingles that are
    enough for it; x: a hash of one of these and of the two levels; left: how many of them there are from it on.
    """
    span = rows.groupBy("group").agg(F.min("excess").alias("low"), F.max("excess").alias("high"))
    rows = rows.join(span, "group").withColumn("own", F.expr(f"cast((excess - low) * {LEVELS} div (high - low + 1) as int)")).drop("low", "high")
    levels = rows.groupBy("group", F.col("own").alias("other")).agg(F.min("excess").alias("low"))
    levels = levels.groupBy("group").agg(F.collect_list(F.struct("other", "low")).alias("levels"))
    rows = rows.join(levels, "group").withColumn("size", F.size("shared"))
    rows = rows.select("*", F.inline("levels")).withColumn("need", _overlap(F.col("excess"), F.col("low"))).where("need <= size")
    rows = rows.select("id", "c", "excess", "own", "other", "size", F.posexplode(F.expr("slice(shared, 1, size - need + 1)")).alias("at", "x"))
    key = F.xxhash64("x", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(key.alias("x"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "id", "c", "excess", (F.col("size") - F.col("at")).alias("left"))


def _may_link(x: str, y: str) -> Column:
    """Whether two rows of `_keys` that meet may link, as far as that isn't known."""
    enough = 2 * RATIO * F.least(f"{x}.left", f"{y}.left") >= F.col(f"{x}.excess") + F.col(f"{y}.excess")
    return (F.col(f"{x}.c") != F.col(f"{y}.c")) & enough


def _rest(members: DataFrame, near: DataFrame, sets: DataFrame) -> DataFrame:
    """`near`, the known links of members (node, pivot) to pivots, and further ones (a, b), which join all members of a pivot that link."""
    rows = _grouped(members, near)
    several = rows.groupBy("pivot").agg((F.min("c") != F.max("c")).alias("several")).where("several").select("pivot")
    rows = differences(rows.join(several, "pivot", "left_semi"), sets).withColumn("excess", RATIO * F.size("d") - F.col("n")).drop("n")
    first = rows.groupBy("group").agg(F.min(F.struct("excess", "node", "c")).alias("first"))
    rows = rows.join(first, "group").withColumn("least", F.col("first.excess"))
    sure = F.col("excess") <= -F.col("least")
    near = near.union(rows.where(sure & (F.col("node") != F.col("first.node"))).select("node", "first.node"))
    nodes = rows.select("id", "node")
    rows = rows.withColumn("c", F.xxhash64(F.when(sure, F.col("first.c")).otherwise(F.col("c")))).drop("node", "first")
    met = written(_keys(_shared(rows)), "near-keys")
    row = F.struct("id", "c", "excess", "left")
    heads = met.groupBy("x").agg(F.min(row).alias("y"), (F.min("c") != F.max("c")).alias("several")).where("several").drop("several")
    met = written(met.select("x", "side", row.alias("z")).join(heads, "x"), "near-met")
    near = written(near.union(_near(_named(met.where(_may_link("y", "z")).select("y.id", "z.id").toDF("a", "b"), nodes), sets)), "near-heads")
    now = _grouped(nodes, near).select("id", F.xxhash64("c").alias("c"))
    met = written(met.select("x", "side", "z.id", "z.excess", "z.left").join(now, "id"), "near-open")
    y, z = met.alias("y"), met.alias("z")
    pairs = y.join(z, (F.col("y.x") == F.col("z.x")) & (F.col("y.side") == -F.col("z.side")) & (F.col("y.id") < F.col("z.id")) & _may_link("y", "z"))
    return near.union(_near(_named(pairs.select(F.col("y.id").alias("a"), F.col("z.id").alias("b")), nodes), sets))


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of ids as pairs of nodes, the lesser first."""
    for c in ("a", "b"):
        pairs = (pairs.distinct() if c == "a" else pairs).join(nodes.select(F.col("id").alias(c), F.col("node").alias(f"{c}_node")), c)
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are near copies; sets of sizes too unlike for that aren't fetched."""
    pairs = pairs.distinct()
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")), c)
    pairs = pairs.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * SIMILARITY - 1e-6).select("a", "b")
    return written(similarities(pairs, sets).where(F.col("j") >= SIMILARITY).select("a", "b"), "near-pairs")


def with_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, spare, component) for each row of docs; component is the same for texts joined by links.

    Texts are compared by their words, lower-cased in A-Z. Fewer than five words are one shingle; texts without words,
    null ones included, are equal to each other and near no other. Repeated rows give repeated rows; columns other than
    doc_id and text aren't read; an empty table gives none. Which of several equal similarities comes first has no effect.
    """
    own = written(signatures(docs), "near-signatures")
    edges = written(links(docs, own.dropDuplicates(["node"]).select("node", "fp", "keys")), "near-links")
    counts = own.groupBy("node").agg(F.count("*").alias("n"))
    label = counts.join(components(edges, small=SMALL), "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    return spread_join(own.select("doc_id", "spare", "node"), label, ["node"], "n", counts=counts).select("doc_id", "spare", "component")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row for each class of near copies, as `simhash.one_of_each` tells which."""
    return one_of_each(docs, with_classes(docs))
