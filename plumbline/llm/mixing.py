"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The tokens here are words. Targets are shares of a total by weight, none above a multiple of its source's size. The
total, in blocks, is dealt to sources by highest quotients target / (2 * seats + 1), and each source's blocks to its
shards likewise by their sizes. A shard lays its documents out in a seeded order and takes whole rounds of it, and
then one seeded run of blocks, so that each block is taken equally often or once more than another.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WEIGHTS = (3, 1, 2)
#: Words to a block, words to a shard, and shards of a source at most; beyond that its shards grow.
BLOCK, SHARD, SHARDS = 16, 1 << 20, 4096
#: Sources up to which their table is broadcast; beyond that it is joined by a shuffle.
SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """What each source is to give: share * sum(sizes) by weight, at most `most` times its size; what is above goes to the others by weight."""
    caps = [most * s for s in sizes]
    out, total, open_ = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        above = [i for i in open_ if total * weights[i] / weight > caps[i]]
        if not above:
            for i in open_:
                out[i] = total * weights[i] / weight
            break
        for i in above:
            out[i] = caps[i]
            total -= caps[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def apportion(claims: np.ndarray, seats: int) -> np.ndarray:
    """Integer seats by Sainte-Laguë: each goes to the highest quotient claim / (2 * seats + 1), the first one on ties."""
    claims = np.asarray(claims, float)
    out = np.zeros(len(claims), np.int64)
    if seats <= 0 or not claims.sum() > 0:
        return out
    # The divisor total/seats is at most len(claims) seats away; the highest or lowest quotients give those.
    out = np.floor(claims * (seats / claims.sum()) + 0.5).astype(np.int64)
    if (lack := seats - int(out.sum())) > 0:
        heap = [(-c / (2 * s + 1), i) for i, (c, s) in enumerate(zip(claims.tolist(), out.tolist(), strict=True)) if c > 0]
        heapq.heapify(heap)
        for _ in range(lack):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-claims[i] / (2 * out[i] + 1), i))
    elif lack < 0:
        heap = [(c / (2 * s - 1), -i) for i, (c, s) in enumerate(zip(claims.tolist(), out.tolist(), strict=True)) if s > 0]
        heapq.heapify(heap)
        for _ in range(-lack):
            _, i = heap[0]
            out[-i] -= 1
            heapq.heapreplace(heap, (claims[-i] / (2 * out[-i] - 1) if out[-i] else np.inf, i))
    return out


def _shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard")
    return pd.DataFrame({"place": group["place"], "shard": group["shard"], "shard_size": group["shard_size"], "quota": apportion(group["shard_size"].to_numpy(), int(group["blocks"].iloc[0]))})


def mixed(docs: DataFrame, keep: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 7) -> DataFrame:
    """The columns `keep` of docs (all of them if None) in a struct `row`, with size, source_size, target and taken, for each row.

    size: words of the text, 0 if it is null. target: that of the row's source; sources weigh `weights` in turn, by
    code point, null last. taken: words that the mix takes from the row, repeats counted, at most `most` times its size.
    The taken words of a source differ from its target by less than two blocks, or half a block for each of its shards
    where targets are at their most. Repeated rows are rows of their own; rows with one doc_id and size are laid out by a
    hash of their texts. Equal inputs give equal results however they
    are partitioned. An empty table gives none.

    One row for each source reaches the driver; a source's shards, SHARDS at most, meet in one group.
    """
    spark = docs.sparkSession
    sized = docs.select(F.struct(*(docs[c] for c in (docs.columns if keep is None else keep))).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("spare"))
    light = written(sized.select("doc_id", "source", "size", "spare"), "mixing-sizes")
    if keep is not None and set(keep) <= {"doc_id", "source"}:
        sized = light.select(F.struct(*keep).alias("row"), "doc_id", "source", "size", "spare")
    found = sorted(((r.source, r.size) for r in light.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in found]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    blocks = apportion(np.array(aims), round(sum(aims) / block))
    plan = spark.createDataFrame([(s, i, n, aims[i], int(blocks[i]), int(min(SHARDS, -(-n // shard) or 1))) for i, (s, n) in enumerate(found)], "source string, place int, source_size long, target double, blocks long, shards int")
    order = F.xxhash64("doc_id", "size", F.lit(seed))

    def dealt(rows: DataFrame) -> DataFrame:
        own = plan.withColumnRenamed("source", "of")
        own = F.broadcast(own) if len(found) <= SOURCES else own
        return rows.join(own, rows["source"].eqNullSafe(own["of"])).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "shards").cast("int")).drop("of")

    sums = dealt(light).groupBy("place", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    quotas = sums.groupBy("place").applyInPandas(_shard_quotas, "place int, shard int, shard_size long, quota long")
    rows = dealt(sized).join(quotas, ["place", "shard"])
    line = Window.partitionBy("place", "shard").orderBy(order, "doc_id", "size", "spare").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length, take = F.col("shard_size"), F.least(F.col("quota") * block, (F.col("shard_size") * F.lit(most)).cast("long"))
    rows = rows.withColumn("end", F.sum("size").over(line)).withColumn("take", take)
    rounds = F.expr("if(shard_size = 0, 0L, take div shard_size)")
    rest = F.expr("if(shard_size = 0, 0L, take % shard_size)")
    begin = F.pmod(F.xxhash64("place", "shard", F.lit(seed)), F.ceil(F.greatest(length, F.lit(1)) / block)) * block
    rows = rows.withColumns({"rounds": rounds, "rest": rest, "begin": begin, "start": F.col("end") - F.col("size")})
    within = lambda shift: F.greatest(F.lit(0), F.least(F.col("end"), F.col("begin") + F.col("rest") - shift) - F.greatest(F.col("start"), F.col("begin") - shift))
    taken = (F.col("rounds") * F.col("size") + within(F.lit(0)) + within(length)).cast("long")
    return rows.select("row", "size", "source_size", "target", taken.alias("taken"))
