"""Repeated token windows: exact (type 1) and consistently renamed (type 2) clones.

A window that stands more than once is a family; its occurrences are counted and linked to the first one, by path and
position, never to each other, so the rows stay as many as the windows however large a family is. Runs of neighbouring
occurrences that link to neighbouring firsts are one maximal region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, rolling

#: Words and punctuation marks as tokens.
TOKEN = r"[A-Za-z0-9_À-ÿ]+|[^\sA-Za-z0-9_À-ÿ]"


def tokens(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(TOKEN), F.lit(0))


def token_count(content: Column) -> Column:
    return F.regexp_count(content, F.lit(TOKEN)).cast("long")


def windows(files: DataFrame, width: int) -> DataFrame:
    """Records of neighbouring windows of `width` tokens that may stand more than once, with 96 bits of rolling hash each; a
    window whose anchor stands once is left out. See rolling.runs()."""
    return rolling.runs(files, lambda data, starts: rolling.Hashed(data, starts, width))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for now, _ in rolling.met(batches, rolling.EXACT):
        first = now.first[now.family]
        shown = now.copies[now.family] > 1
        # What earlier batches have left was shown then, unless it stood once.
        shown[: now.old] &= now.count[: now.old] == 1
        at = np.flatnonzero(shown)
        if not len(at):
            continue
        codes = now.table.column("path").dictionary_encode().indices.to_numpy()
        record, other = now.record[at], first[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(record) != 0) | (np.diff(codes[now.record[other]]) != 0) | (np.diff(now.place[other]) != 1)
        head = np.flatnonzero(new)
        rows = pa.array(record[head])
        columns = [now.table.column("path").take(rows), now.table.column("language").take(rows), pa.array(now.place[at[head]]), pa.array(np.diff(np.append(head, len(at)))), now.paths(other[head]), pa.array(now.place[other[head]])]
        yield pa.RecordBatch.from_arrays(columns, ["path", "language", "start", "n", "first_path", "first_start"])


def repeated(rows: DataFrame) -> DataFrame:
    """Windows that stand more than once: path, language, start and n of neighbouring ones, whose first occurrences, by path and
    start, are neighbours too from first_path and first_start on. A first occurrence has itself. rows: of windows().

    Records meet by key in one sorted pass; a key's distinct windows are what a task holds.
    """
    kind = "path string, language string, start long, n long, first_path string, first_start long"
    return rolling.by_key(rows).mapInArrow(_links, kind)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for now, end in rolling.met(batches, rolling.EXACT):
        sizes, n = np.unique(now.copies[(end | ~now.last) & (now.copies > 1)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(n)], ["copies", "windows"])


def family_sizes(rows: DataFrame) -> DataFrame:
    """How many windows stand how often. rows: of windows()."""
    return rolling.by_key(rolling.unplaced(rows)).mapInArrow(_sizes, "copies long, windows long").groupBy("copies").agg(F.sum("windows").alias("windows"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for now, end in rolling.met(batches, rolling.DIGEST):
        shown = (end | ~now.last) & (now.copies > 1)
        text = now.items[now.first[shown]].tobytes().hex()
        yield pa.RecordBatch.from_arrays([pa.array([text[k : k + 32] for k in range(0, len(text), 32)], pa.string()), pa.array(now.copies[shown])], ["hash", "copies"])


def digested(files: DataFrame, width: int) -> DataFrame:
    """hash and copies of windows that stand more than once, by the md5 of their tokens, for results that show or order by it."""
    rows = rolling.runs(files, lambda data, starts: rolling.Digested(data, starts, width))
    return rolling.by_key(rolling.unplaced(rows)).mapInArrow(_digests, "hash string, copies long")


def regions(rows: DataFrame, width: int) -> DataFrame:
    """Maximal runs of repeated windows against their first occurrences: path, start and end (tokens), first_path, first_start."""
    later = rows.where("path <> first_path or start <> first_start").withColumn("diagonal", F.col("start") - F.col("first_start"))
    line = Window.partitionBy("path", "first_path", "diagonal").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumn("island", F.col("start") - F.coalesce(F.sum("n").over(line), F.lit(0)))
    grouped = later.groupBy("path", "language", "first_path", "diagonal", "island")
    return grouped.agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) + (width - 1)).alias("end"), F.min("first_start").alias("first_start")).drop("island", "diagonal")


def spans(rows: DataFrame, width: int) -> DataFrame:
    """b and e of the tokens that runs of repeated windows cover."""
    return rows.select("path", "language", F.col("start").alias("b"), (F.col("start") + F.col("n") + (width - 1)).alias("e"))


def coverage(rows: DataFrame, width: int) -> DataFrame:
    """Tokens of each path that a repeated window covers."""
    return intervals.length(spans(rows, width), ["path", "language"])


def predecessors(buckets: DataFrame, early: int = 8, late: int = 56) -> DataFrame:
    """Pairs that a bounded mode looks at: each member of a bucket against its `early` first and `late` latest predecessors.

    buckets: (hash, path, start). Each row names the ranks of its partners, early + late at most, and meets them by an equi-join.
    """
    line = Window.partitionBy("hash").orderBy("path", "start")
    ranked = buckets.withColumn("r", F.row_number().over(line))
    none = F.array().cast("array<int>")
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(none)
    first, last = upto(F.lit(1), F.least(F.lit(early), F.col("r") - 1)), upto(F.greatest(F.lit(1), F.col("r") - late), F.col("r") - 1)
    right = ranked.select("hash", F.col("path").alias("right_path"), F.col("start").alias("right_start"), F.explode(F.array_union(first, last)).alias("r"))
    left = ranked.select("hash", F.col("path").alias("left_path"), F.col("start").alias("left_start"), "r")
    return left.join(right, ["hash", "r"]).select("hash", "left_path", "left_start", "right_path", "right_start")


def pair_count(copies: Column, early: int = 8, late: int = 56) -> Column:
    """Pairs of a bucket under predecessors()."""
    cap = early + late
    return F.when(copies <= cap + 1, copies * (copies - 1) / 2).otherwise(F.lit(cap) * (cap + 1) / 2 + (copies - cap - 1) * cap).cast("long")


def admitted(sizes: DataFrame, budget: int) -> DataFrame:
    """Rare buckets first, by hash on ties, until the budget of pairs is used; the last one may be admitted in part.

    sizes: (hash, copies) of buckets of two members at least. Each has a pair, so `budget` of them are all that one task ranks.
    """
    first = sizes.withColumn("pairs", pair_count(F.col("copies"))).orderBy("copies", "hash").limit(budget)
    line = Window.orderBy("copies", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = first.withColumn("before", F.coalesce(F.sum("pairs").over(line), F.lit(0)))
    return rows.where(F.col("before") < budget).select("hash", "copies", F.least(F.col("pairs"), F.lit(budget) - F.col("before")).cast("long").alias("pairs"))


def shape_windows(files: DataFrame, width: int) -> DataFrame:
    """Records of windows under consistent renaming: each word is coded by the distance to its last use within the window, 0 at
    its first, and numbers as one token. Equal codes mean that a one-to-one renaming of words turns one window into the other."""
    return rolling.runs(files, lambda data, starts: rolling.Shaped(data, starts, width))


def _renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for now, end in rolling.met(batches, rolling.SHAPE):
        variants = now.variants()
        shown = (end | ~now.last) & (variants > 1)
        first = now.first[shown]
        yield pa.RecordBatch.from_arrays([pa.array(now.copies[shown]), pa.array(variants[shown]), now.paths(first), pa.array(now.place[first])], ["copies", "variants", "first_path", "first_start"])


def renamed_families(rows: DataFrame) -> DataFrame:
    """Families of windows that are equal under renaming but not as they stand: copies, variants and the first place. rows: of
    shape_windows()."""
    return rolling.by_key(rows).mapInArrow(_renamed, "copies long, variants long, first_path string, first_start long")


def instances(found: DataFrame) -> DataFrame:
    """(family, tokens, path, start): the occurrences of each region's first place, itself included. found: rows of regions()."""
    own = found.withColumn("tokens", F.col("end") - F.col("start"))
    family = F.concat_ws(":", "first_path", F.col("first_start").cast("string"), F.col("tokens").cast("string"))
    own = own.withColumn("family", family)
    first = own.select("family", "tokens", F.col("first_path").alias("path"), F.col("first_start").alias("start"))
    return own.select("family", "tokens", "path", "start").union(first).distinct()


def longest_free(b: int, e: int, taken: list[tuple[int, int]]) -> int:
    """The longest run of [b, e) outside of the taken intervals."""
    out, at = 0, b
    for x, y in sorted(taken):
        if y > at and x < e:
            out, at = max(out, x - at), max(at, y)
    return max(out, e - at)


def top_blocks(found: DataFrame, n: int, least: int) -> DataFrame:
    """The first n families by tokens * (copies - 1) that each add `least` tokens in a row, in two places at least, that
    families taken before don't cover.

    Sequential by nature: families come to the driver in order, one after another, and the walk stops at the n-th.
    """
    kind = "family string, tokens long, copies long, impact long"
    grouped = instances(found).groupBy("family", "tokens").agg(F.sort_array(F.collect_list(F.struct("path", "start"))).alias("places"))
    ranked = grouped.withColumn("impact", F.col("tokens") * (F.size("places") - 1)).orderBy(F.desc("impact"), F.desc("tokens"), "family")
    taken: dict[str, list[tuple[int, int]]] = {}
    out = []
    for r in ranked.toLocalIterator():
        if len(out) == n:
            break
        spans = [(p.path, p.start, p.start + r.tokens) for p in r.places]
        if sum(longest_free(b, e, taken.get(path, [])) >= least for path, b, e in spans) >= 2:
            out.append((r.family, r.tokens, len(spans), r.impact))
            for path, b, e in spans:
                taken.setdefault(path, []).append((b, e))
    return found.sparkSession.createDataFrame(out, kind)
