"""Removal of word sequences that stand in an earlier document, by seeds and their extension.

Each window of WINDOW words selects one of its ANCHOR-word sequences, the one of least hash, so equal windows select
equal anchors, and neighbours mostly share them. An anchor that stands in one document only can't seed a repeat. For each
other anchor the smallest document that holds it is its reference, and each further place of the anchor is a seed against
that. Seeds of one pair of documents on one diagonal share a stretch of the reference, which is brought to the later
document; there they are extended both ways, word by word, and maximal repeats of WINDOW words and more go.

That settles all windows that equal the reference's. A window that differs from it may still equal one of another earlier
document, whose window then differs from the reference's too. So these windows, and no others, are seeds of a second round:
as whole windows, by 96 bits of their hash, each against the smallest document that holds it, extended and compared in the
same way. Both rounds together find every repeat of WINDOW words with a smaller doc_id, and compare words, not hashes.

Documents with one and the same sequence of words (by SHA-256) count as one in the search, that of the smallest doc_id;
the others go as a whole. No step pairs up the documents of a group: each place has one reference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import spread_join, written

WINDOW, ANCHOR = 50, 16
#: Words of a reference that come as one row.
BLOCK = 128
#: A null doc_id counts as larger than any other.
LAST = (1 << 63) - 1
NOTHING = hashlib.sha256(b"").hexdigest()
BLANK = " \t\n\x0b\f\r"
#: A document in the search: its id, and a hash of its text, as ids may repeat. Ends on its reference.
DOC, REF = ["id", "tag"], ["ref", "ref_tag"]


def _least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each `width` consecutive values, and its place, the first one on ties."""
    out, at, span = x, np.arange(len(x)), 1

    def joined(out: np.ndarray, at: np.ndarray, by: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        later = out[by : by + n] < out[:n]
        return np.where(later, out[by : by + n], out[:n]), np.where(later, at[by : by + n], at[:n])

    while 2 * span <= width:
        out, at = joined(out, at, span, len(out) - span)
        span *= 2
    return joined(out, at, width - span, len(x) - width + 1) if span < width else (out, at)


class Windowed:
    """Windows of some texts of words joined by one space. rows: first words; owner: the text; at: first word in the text;
    anchor and place: the hash that a window selects, and where in the text that begins."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        self.words = w = T.Words(texts)
        self.hash = w.hashes()
        owner = np.repeat(np.arange(len(texts)), w.count)
        n = max(0, len(self.hash) - window + 1)
        self.rows = np.flatnonzero(owner[:n] == owner[window - 1 :][:n])
        self.owner = owner[self.rows]
        begin = w.first[:-1][self.owner]
        self.at = self.rows - begin
        if n:
            least, place = _least(T.window_hashes(self.hash, anchor), window - anchor + 1)
            self.anchor, self.place = least[self.rows], place[self.rows] - begin
        else:
            self.anchor, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)


    def sides(self, owner: np.ndarray, place: np.ndarray, window: int, anchor: int) -> Iterator[np.ndarray]:
        """Hashes of the words on either side of anchors, of which each window around one covers the left or the right ones.

        Both are cut at the borders of the text.
        """
        first, end = self.words.first[:-1][owner], self.words.first[1:][owner]
        at, half = first + place, (window - anchor) // 2
        yield T.run_hashes(self.hash, np.maximum(first, at - half), at).view(np.int64)
        yield T.run_hashes(self.hash, at + anchor, np.minimum(end, at + anchor + half)).view(np.int64)


def _described(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in T.slices(batch.column("text")):
            norm = [b" ".join(t.split()) for t in texts]
            w = Windowed(norm, window, anchor)
            new = np.ones(len(w.owner), bool)  # windows follow each other, and so do the places that they select
            new[1:] = (w.owner[1:] != w.owner[:-1]) | (w.place[1:] != w.place[:-1])
            offsets = pa.array(np.searchsorted(w.owner[new], np.arange(len(texts) + 1)), pa.int32())
            columns = [w.anchor[new].view(np.int64), w.place[new].astype(np.int32), *w.sides(w.owner[new], w.place[new], window, anchor)]
            seeds = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["anchor", "at", "left", "right"])
            digests = pa.array([hashlib.sha256(t).digest() for t in norm], pa.binary())
            columns = [batch.column("doc_id")[a:b], batch.column("tag")[a:b], digests, pa.array(w.words.count, pa.int64()), pa.ListArray.from_arrays(offsets, seeds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "sequence", "n_words", "seeds"])


def equal_runs(words: list[bytes], other: list[bytes], begin: int, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs (from, to) of `least` words and more that equal other's, of which the first stands at `begin`."""
    start = None
    for k, (x, y) in enumerate(zip(words[begin : begin + len(other)], other, strict=False), begin):
        if x == y:
            start = k if start is None else start
        elif start is not None:
            if k - start >= least:
                yield start, k
            start = None
    end = min(len(words), begin + len(other))
    if start is not None and end - start >= least:
        yield start, end


def repeats(words: list[bytes], stretches: list[dict], window: int) -> dict[tuple, list[tuple[int, int]]]:
    """For each reference and shift the maximal repeats. Stretches that follow on each other are one."""
    out: dict[tuple, list[tuple[int, int]]] = {}
    key, begin, other = None, 0, []
    for s in [*sorted(stretches, key=lambda s: (s["ref"], s["ref_tag"], s["shift"], s["b"])), None]:
        new = s and (s["ref"], s["ref_tag"], s["shift"])
        if s and new == key and s["b"] == begin + len(other):
            other += s["stretch"].encode().split()
            continue
        if key:
            out.setdefault(key, []).extend(equal_runs(words, other, begin + key[2], window))
        if s:
            key, begin, other = new, s["b"], s["stretch"].encode().split()
    return out


def _compared(batches: Iterator[pa.RecordBatch], window: int, anchor: int | None) -> Iterator[pa.RecordBatch]:
    """The repeats (b, e) of each document with the stretches of its references (h null).

    With an anchor also the windows, from b on, of the document's seeds that no repeat with the seed's reference covers (h, g).
    """
    for batch in batches:
        for first, last, texts in T.slices(batch.column("text")):
            part = batch.slice(first, last - first)
            found_rows, found_b, found_e = [], [], []
            found: list[dict] = []
            for k, stretches in enumerate(part.column("stretches").to_pylist()):
                own = repeats(texts[k].split(), stretches or [], window)
                found.append(own)
                for b, e in sorted({x for xs in own.values() for x in xs}):
                    found_rows.append(k)
                    found_b.append(b)
                    found_e.append(e)
            rows, b, e = np.array(found_rows, np.int64), np.array(found_b, np.int32), np.array(found_e, np.int32)
            ids = [part.column(c) for c in DOC]
            none = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in ids), pa.array(b), pa.array(e), *none], [*DOC, "b", "e", "h", "g"])
            if anchor is None:
                continue
            w = Windowed(texts, window, anchor)
            bounds = np.searchsorted(w.owner, np.arange(len(texts) + 1))
            left = np.zeros(len(w.owner), bool)
            for k, seeds in enumerate(part.column("places").to_pylist()):
                lo, hi = bounds[k], bounds[k + 1]
                begins, ends = (lo + np.searchsorted(w.place[lo:hi], [s["at"] + d for s in seeds]) for d in (0, 1))
                for s, x, y in zip(seeds, begins.tolist(), ends.tolist(), strict=True):
                    left[x:y] = True
                    for b, e in found[k].get((s["ref"], s["ref_tag"], s["shift"]), ()) if s["shift"] is not None else ():
                        left[x:y] &= (w.at[x:y] < b) | (w.at[x:y] + window > e)
            rows = np.flatnonzero(left)
            h, g = T.window_hashes(w.hash, window)[w.rows[rows]], T.window_hashes(w.hash, window, 0xD6E8FEB86659FD93)[w.rows[rows]]
            begin = w.at[rows].astype(np.int32)
            columns = [pa.array(begin), pa.array(begin + window, pa.int32()), pa.array(h.view(np.int64)), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(w.owner[rows])) for c in ids), *columns], [*DOC, "b", "e", "h", "g"])


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, numbers, parts = [], [], []
        for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words = text.split()
            for i in range(0, len(words), block):
                rows.append(k)
                numbers.append(i // block)
                parts.append(b" ".join(words[i : i + block]))
        ids = [batch.column(c).take(pa.array(rows, pa.int64())) for c in REF]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(numbers, pa.int32()), pa.array(parts, pa.binary()).cast(pa.string())], [*REF, "block", "words"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, texts = [], []
        for text, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                edge[r["b"]] += 1
                edge[r["e"]] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            removed.append(int(gone.sum()))
            texts.append(b" ".join(x for x, g in zip(words, gone.tolist(), strict=True) if not g))
        columns = [pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOC), *columns], [*DOC, "n_removed", "kept_sha256", "kept"])


def _seeds(places: DataFrame, key: list[str], name: str) -> DataFrame:
    """Places (id, tag, at, left, right, and a key that equal ones share) against the reference of the key, the smallest place:
    ref, ref_tag, shift.

    Keys of one id only are left out, and so is the reference itself. shift is null in documents that have the reference's
    id, and where the words on both sides differ from the reference's, so that no window can equal one of it.
    """
    refs = places.groupBy(*key).agg(F.min(F.struct("id", "tag", "at", "left", "right")).alias("r"), F.max("id").alias("last"), F.count("*").alias("n")).where("r.id < last")
    refs = written(refs.select(*key, "r", "n"), f"substrings-{name}-references")
    rows = spread_join(places, refs, key, "n", counts=refs.select(*key, "n"))
    rows = rows.select(*DOC, "at", F.col("r.id").alias("ref"), F.col("r.tag").alias("ref_tag"), F.col("r.at").alias("ref_at"), ((F.col("left") == F.col("r.left")) | (F.col("right") == F.col("r.right"))).alias("near"))
    rows = rows.where("not (id = ref and tag = ref_tag and at = ref_at)")
    return written(rows.select(*DOC, "at", *REF, F.when((F.col("id") > F.col("ref")) & F.col("near"), F.col("at") - F.col("ref_at")).alias("shift")), f"substrings-{name}-seeds")


def _stretches(seeds: DataFrame, near: DataFrame, before: int, after: int) -> DataFrame:
    """For each document the stretches of its references: (ref, ref_tag, shift, b, stretch), from `before` words before a seed to
    `after` words after its beginning; those that touch are one."""
    run = Window.partitionBy(*DOC, *REF, "shift").orderBy("at")
    rows = seeds.where("shift is not null").withColumn("new", (F.col("at") - F.lag("at", 1, -(1 << 30)).over(run) > before + after).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*DOC, *REF, "shift", "run").agg(F.min("at").alias("x"), F.max("at").alias("y"))
    rows = rows.select(*DOC, *REF, "shift", F.greatest(F.lit(0), -F.col("shift"), F.col("x") - F.col("shift") - before).alias("b"), (F.col("y") - F.col("shift") + after).alias("e"))
    # References come in blocks, so that a long one is neither one row nor cut up again for each of its seeds.
    span = F.sequence(F.floor(F.col("b") / BLOCK).cast("int"), F.floor(F.greatest(F.col("b"), F.col("e") - 1) / BLOCK).cast("int"))
    rows = written(rows.withColumn("block", F.explode(span)), "substrings-stretches")
    key = [*REF, "block"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    refs = near.withColumnsRenamed(dict(zip(DOC, REF, strict=True))).join(rows.select(*REF).distinct(), REF)
    blocks = refs.mapInArrow(lambda x, block=BLOCK: _blocks(x, block), "ref long, ref_tag long, block int, words string").join(counts, key)
    rows = spread_join(rows, blocks, key, "n", counts=counts)
    at = F.greatest(F.col("b"), F.col("block") * BLOCK)
    words = F.slice(F.split("words", " "), at - F.col("block") * BLOCK + 1, F.least(F.col("e"), (F.col("block") + 1) * BLOCK) - at)
    return rows.select(*DOC, F.struct(*REF, "shift", at.alias("b"), F.array_join(words, " ").alias("stretch")).alias("s")).groupBy(*DOC).agg(F.collect_list("s").alias("stretches"))


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs; with_text: also kept, the words left, joined by one space,
    which is null where no word goes.

    A word goes if a window of `window` consecutive words that covers it also starts in a row with a smaller doc_id; the
    windows are those of the input. A null text has no words. A null doc_id counts as larger than any other. Rows with
    the same doc_id don't count against each other, and repeated rows are rows of their own with equal results. Very long
    texts are whole, a task holds one of them at a time. Other columns, whatever their names, aren't read. An empty table
    gives none.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    kind = "doc_id long, tag long, sequence binary, n_words long, seeds array<struct<anchor: long, at: int, left: long, right: long>>"
    described = written(texts.mapInArrow(lambda b: _described(b, window, anchor), kind), "substrings-documents").withColumn("id", ident)
    # Rows of one sequence have equal seeds, so any of them will do.
    classes = described.where(F.col("n_words") >= window).groupBy("sequence").agg(F.min(F.struct(*DOC)).alias("first"), F.any_value("seeds").alias("seeds"), F.count("*").alias("n"))
    classes = written(classes.select("sequence", "first.*", "seeds", "n"), "substrings-classes")
    places = classes.select(*DOC, F.inline("seeds")).select("anchor", *DOC, "at", "left", "right")
    seeds = _seeds(places, ["anchor"], "anchor")
    own = seeds.select(*DOC).union(seeds.where("shift is not null").select(*REF)).distinct()
    words = F.regexp_replace(F.btrim("text", F.lit(BLANK)), r"[\x20\x09-\x0D]+", " ")
    near = written(texts.select(ident.alias("id"), "tag", words.alias("text")).join(own, DOC).dropDuplicates(DOC), "substrings-near")
    grouped = seeds.groupBy(*DOC).agg(F.collect_list(F.struct("at", *REF, "shift")).alias("places"))
    kind = "id long, tag long, b int, e int, h long, g int"
    rows = near.join(grouped, DOC).join(_stretches(seeds, near, window - anchor, window), DOC, "left")
    first = written(rows.mapInArrow(lambda b: _compared(b, window, anchor), kind), "substrings-first")
    wholes = first.where("h is not null").select("h", "g", *DOC, F.col("b").alias("at"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    seeds = _seeds(wholes, ["h", "g"], "whole").where("shift is not null")
    rows = near.join(_stretches(seeds, near, 0, window), DOC)
    runs = first.where("h is null").union(rows.mapInArrow(lambda b: _compared(b, window, None), kind))
    runs = runs.groupBy(*DOC).agg(F.collect_list(F.struct("b", "e")).alias("runs"))
    partly = near.join(runs, DOC).mapInArrow(_kept, "id long, tag long, n_removed long, kept_sha256 string, kept string")
    partly = partly if with_text else partly.drop("kept")
    results = classes.select("sequence", *DOC, "n").join(partly, DOC, "left").drop("tag").withColumnRenamed("id", "first_id")
    out = spread_join(described.drop("seeds", "tag"), results, ["sequence"], "n", "left", counts=classes.select("sequence", "n"))
    whole = F.col("id") > F.col("first_id")
    columns = {
        "n_removed": F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long"),
        "kept_sha256": F.when(whole, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sequence")))),
    }
    if with_text:
        columns["kept"] = F.when(whole, F.lit("")).otherwise(F.col("kept"))
    return out.select("doc_id", "n_words", *(c.alias(k) for k, c in columns.items()))
