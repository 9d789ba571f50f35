"""Near-duplicate groups by SimHash and deletion-variant signatures.

Fingerprints are XXH64 votes over three-word shingles. Two fingerprints that differ in at most three of 64 bits
differ in at most one bit of one of their two 32-bit segments. So each distinct fingerprint is indexed under its
segments with one bit taken out (2 x 32 variants); those that meet under an equal variant are candidates, and the
distance of each is computed. A bucket of more than BUCKET fingerprints isn't compared pair by pair: its members are
indexed once more by one-bit-less variants of the two 16-bit halves of the other segment, which leaves at most 18 free
bits, and so at most 2^18 members, among which the neighbours of each are looked up. Nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .shared import spread_join, written

#: Bits of difference at which two fingerprints still link. The variants below hold for this number only.
DISTANCE = 3
#: Fingerprints of a bucket up to which all pairs in it are compared.
BUCKET = 512


def normal(texts: list[bytes]) -> list[bytes]:
    """The words of each text, lower-cased in A-Z and joined by one space."""
    return [b" ".join(t.lower().split()) for t in texts]


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each normal text, XXH64 of all shingles in order). Fewer words than a shingle has: one of all of them."""
    w = T.Words(texts)
    n_shingles = np.where(w.count > 0, np.maximum(w.count - shingle + 1, 1), 0)
    stop = np.cumsum(n_shingles)
    if not len(stop) or not stop[-1]:
        return n_shingles, np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), n_shingles)
    head = w.first[:-1][owner] + np.arange(stop[-1]) - (stop - n_shingles)[owner]
    tail = np.minimum(head + shingle - 1, w.first[1:][owner] - 1)
    return n_shingles, T.xxh64(w.buf, w.start[head], w.end[tail] - w.start[head], 42)


def fingerprint_batch(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash fingerprints (uint64) of texts; no word: zero."""
    return fingerprints_of(*shingle_hashes(normal(texts), shingle))


def fingerprints_of(n_shingles: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The fingerprints of texts from what `shingle_hashes` gives."""
    out = np.zeros(len(n_shingles), np.uint64)
    full = np.flatnonzero(n_shingles)
    if not len(full):
        return out
    stop = np.cumsum(n_shingles)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, (stop - n_shingles)[full], axis=0, dtype=np.int32)
    over = (2 * votes > n_shingles[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, spare, fp) for each row of docs; fp: the fingerprint's bits as a signed long. A null text counts as empty.

    spare: a hash of the text, to tell apart rows that have no doc_id, or the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint_batch(texts, shingle) for _, _, texts in T.slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("spare"), pa.array(np.concatenate([np.zeros(0, np.uint64), *fps]).view(np.int64))], ["doc_id", "spare", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("spare"))
    return rows.mapInArrow(run, "doc_id long, spare long, fp long")


def variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the 64 one-bit-less variants of its two halves."""
    i, half = F.col("i"), F.when(F.col("i") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    bit = F.expr("shiftleft(1L, i % 32)")
    return nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select((F.shiftleft(i.cast("long"), 32) + half.bitwiseAND(F.bitwise_not(bit))).alias("key"), "fp")


def _finer(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second keys of a large bucket's members: one-bit-less variants of both quarters of the half that isn't in key."""
    other = fps & np.uint64(0xFFFFFFFF) if key >> 32 < 32 else fps >> np.uint64(32)
    keys = []
    for k in range(32):
        quarter = (other >> np.uint64(16 * (k // 16))) & np.uint64(0xFFFF)
        keys.append(T.mix(np.full(len(fps), key, np.uint64)) ^ T.mix((np.uint64(k) << np.uint64(16)) | (quarter & ~np.uint64(1 << k % 16))))
    return np.concatenate(keys), np.tile(fps, 32)


class Forest:
    """Links among fingerprints; gives one edge to the root for each node, so edges are as many as nodes."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = [x for x, y in self.parent.items() if x != y]
        return np.array(nodes, np.uint64), np.array([self.root(x) for x in nodes], np.uint64)


def _paired(key: np.ndarray, fp: np.ndarray, forest: Forest, once: bool = True) -> None:
    """Links within runs of equal keys, pair by pair; once: a pair counts only under the first variant that it shares."""
    cut = np.flatnonzero(np.append(np.diff(key) != 0, True))
    left = np.repeat(cut, np.diff(np.append(-1, cut))) - np.arange(len(key))
    rows, lag = np.flatnonzero(left), 1
    while len(rows):
        a, b = fp[rows], fp[rows + lag]
        diff = a ^ b
        near = np.bitwise_count(diff) <= DISTANCE
        if once:
            i = key[rows] >> np.uint64(32)
            upper, lower = diff >> np.uint64(32), diff & np.uint64(0xFFFFFFFF)
            bit = np.uint64(1) << (i & np.uint64(31))
            first = np.where(i < 32, np.where(upper == 0, i == 0, upper == bit), (np.bitwise_count(upper) > 1) & np.where(lower == 0, i == 32, lower == bit))
            near &= first & (diff != 0)
        forest.link(a[near], b[near])
        lag += 1
        rows = rows[left[rows] >= lag]


def _looked_up(fp: np.ndarray, forest: Forest) -> None:
    """Links within one bucket whose members share all but a few bits: each one's neighbours are looked up."""
    fp = np.unique(fp)
    free = np.bitwise_or.reduce(fp ^ fp[0])
    bits = [1 << k for k in range(64) if int(free) >> k & 1]
    for n in range(1, DISTANCE + 1):
        for some in combinations(bits, n):
            other = fp ^ np.uint64(sum(some))
            at = np.searchsorted(fp, other)
            hit = np.flatnonzero((other > fp) & (fp[np.minimum(at, len(fp) - 1)] == other))
            forest.link(fp[hit], other[hit])


def _buckets(batches: Iterator[pa.RecordBatch], level: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Edges (finer false) from rows that come sorted by key; at the first level also the rows of large buckets under finer keys."""
    forest = Forest()
    key, fp, large = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None

    def out(a: np.ndarray, b: np.ndarray, finer: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), finer))], ["u", "v", "finer"])

    def done(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, but for a large one that is on its way out."""
        cut = np.flatnonzero(np.append(np.diff(key) != 0, True)) if len(key) else np.zeros(0, int)
        size = np.diff(np.append(-1, cut))
        for k in np.flatnonzero(size > bucket):
            members = fp[cut[k] - size[k] + 1 : cut[k] + 1]
            if level == 1:
                yield out(*_finer(int(key[cut[k]]), members), True)
            else:
                _looked_up(members, forest)
        small = np.repeat((size > 1) & (size <= bucket), size)
        _paired(key[small], fp[small], forest, level == 1)

    for batch in batches:
        key = np.append(key, batch.column(0).to_numpy().view(np.uint64))
        fp = np.append(fp, batch.column(1).to_numpy().view(np.uint64))
        if large is not None:  # goes on with the bucket that was too large to hold
            n = int(np.argmin(np.append(key, np.uint64(large) + np.uint64(1)) == large))
            yield out(*_finer(large, fp[:n]), True)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            large = None
        n = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1])) if len(key) else 0
        yield from done(key[:n], fp[:n])
        key, fp = key[n:], fp[n:]
        if level == 1 and len(key) > max(bucket, 20_000):
            large = int(key[0])
            yield out(*_finer(large, fp), True)
            key, fp = key[:0], fp[:0]
        if len(forest.parent) > 1_000_000:
            yield out(*forest.edges(), False)
            forest = Forest()
    if large is None:
        yield from done(key, fp)
    yield out(*forest.edges(), False)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that join exactly the distinct fingerprints (column fp) within DISTANCE bits, directly or through others.

    For each task the edges are a spanning forest of the links found in it, not all pairs of a group.
    """

    def level(n: int):
        return lambda batches: _buckets(batches, n, bucket)

    kind = "u long, v long, finer boolean"
    first = written(variants(nodes).repartition("key").sortWithinPartitions("key").mapInArrow(level(1), kind), "simhash-links")
    finer = first.where("finer").select(F.col("u").alias("key"), F.col("v").alias("fp"))
    second = finer.repartition("key").sortWithinPartitions("key").mapInArrow(level(2), kind)
    return first.where("not finer").select("u", "v").union(second.select("u", "v"))


def with_components(docs: DataFrame, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, spare, fp, component, component_id) for each row of docs.

    component: a fingerprint that is the same for the whole component.
    component_id: the smallest doc_id whose fingerprint is reachable by links of at most DISTANCE bits, the row's own
    included; null if all of them are null. Rows with null or without words have fingerprint zero, and link like any
    other. Repeated rows give repeated rows. Columns other than doc_id and text are not read. An empty table gives none.
    """
    fps = written(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), bucket)).withColumnsRenamed({"node": "fp"})
    group = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    group = group.select("fp", "component", "least", "n")
    label = group.groupBy("component").agg(F.min("least").alias("component_id"))
    label = group.select("fp", "n", "component").join(label, "component").select("fp", "n", "component", "component_id")
    return spread_join(fps, label, ["fp"], "n", counts=nodes.select("fp", "n")).select("doc_id", "spare", "fp", "component", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row for each component of `with_components`."""
    return one_of_each(docs, with_components(docs))


def one_of_each(docs: DataFrame, own: DataFrame) -> DataFrame:
    """docs with one row for each component: that of the smallest doc_id. Columns of docs stay as they are.

    own: doc_id, spare (a hash of the text) and component of each row of docs.
    Rows are told apart by doc_id and text: of a component's rows with its smallest doc_id the one of the least text hash
    stays, once if it is repeated. A doc_id whose texts lie in several components stays in each that it is the smallest of.
    Rows with a null doc_id come after all others, and so stay only in components without any doc_id.
    """
    kept = own.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "spare")).alias("least")).select("least.*")
    # What stays is decided on ids and hashes; the texts are shuffled once, and the rank follows the join's partitioning.
    given = F.struct(F.col("row.doc_id").cast("long").isNull().alias("none"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("row.text").alias("spare"))
    rows = docs.select(F.struct("*").alias("row")).select("row", given.alias("k")).select("row", "k.*")
    kept = kept.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "spare").distinct()
    rows = rows.join(kept, ["none", "id", "spare"]).withColumn("rank", F.row_number().over(Window.partitionBy("none", "id", "spare").orderBy("spare")))
    return rows.where("rank = 1").select("row.*")
