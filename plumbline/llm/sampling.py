"""Folds by crc32 of the doc_id, and bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null doc_id reads as ""."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Text bytes of a key's sample after which no further text is taken; the last one may go beyond.
KEY_BYTES = 16 << 20


def drawn(rows: DataFrame, per_key: int) -> DataFrame:
    """About 4 * per_key rows for each key, by a hash of their doc_id, from rows (key, doc_id, ...); all rows of smaller keys."""
    rows = rows.where(F.col("key").isNotNull())
    counts = rows.groupBy("key").count().collect()  # a row for each key
    if not counts:
        return rows
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["key"], min(1.0, 4 * per_key / r["count"]))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / (1 << 30)
    return rows.where(draw < F.element_at(share, F.col("key")))


def picked(rows: list[tuple], per_key: int, key_bytes: int) -> list[tuple]:
    """Of (key, place, size, ...) rows the first per_key of each key by place, until those before have key_bytes."""
    out, count, size = [], {}, {}
    for r in sorted(rows):
        if count.get(r[0], 0) < per_key and size.get(r[0], 0) < key_bytes:
            count[r[0]], size[r[0]] = count.get(r[0], 0) + 1, size.get(r[0], 0) + r[2]
            out.append(r)
    return out


def sample(rows: DataFrame, per_key: int, key_bytes: int = KEY_BYTES) -> list[tuple]:
    """(key, text) of `per_key` rows for each key at most, from rows (key, doc_id, text) whose text isn't null or empty.

    Texts are whole, however long; where they are long, fewer are taken (key_bytes). Rows are taken by a hash of their
    doc_id and text, so the same table gives the same sample, and repeated rows count once. First about 4 * per_key
    places for each key come to the driver, without texts, and then the texts of those that are chosen.
    """
    some = drawn(rows.where(F.col("text").isNotNull() & (F.col("text") != "")), per_key)
    some = some.select("key", F.xxhash64("doc_id", F.lit(17)).alias("place"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"), "text")
    chosen = picked([tuple(r) for r in some.select("key", "place", "size", "hash").distinct().collect()], per_key, key_bytes)
    if not chosen:
        return []
    kind = some.select("key", "place", "hash").schema
    names = rows.sparkSession.createDataFrame([(r[0], r[1], r[3]) for r in chosen], kind)
    found = some.join(F.broadcast(names), ["key", "place", "hash"]).select("key", "place", "hash", "text").dropDuplicates(["key", "place", "hash"])
    return [(r.key, r.text) for r in sorted(found.collect(), key=lambda r: (r.key, r.place, r.hash))]
