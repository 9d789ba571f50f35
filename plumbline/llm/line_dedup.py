"""Removal of lines whose template recurs across documents, by a fixed-depth log-template tree.

A line's path in the tree is its number of words and its first DEPTH words; words with a digit or one of @ / = in them are
variable fields from the start and read as a wildcard. In a leaf, lines of one length that begin alike, a word is constant
at its position if it stands there CONTEXTS times or more, over distinct lines and documents; other words are variable, and
become wildcards as well. What is left is the line's template. Counts don't depend on the order of rows.

A template recurs when CONTEXTS distinct documents hold it. A document's context is the hash of the set of its lines, with
fields by form as wildcards, so that copies, and those that differ in such fields only, count once, while a footer, notice
or menu line counts in each document, whatever stands beside it and however many copies there are. Near copies that differ
in other words are documents of their own. The lines of recurring templates go from all documents. Lines of fewer than WORDS
words, or whose template has fewer than WORDS constant words, or more variable words than constant ones, never go.

A leaf that fewer than CONTEXTS documents share can't have such a template. So the leaves are counted first, and those that
recur are marked in a bitmap of fixed size; only lines whose leaf is marked are shuffled with their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import text as T
from .shared import bitmap, marked, written

CONTEXTS, WORDS, DEPTH = 10, 3, 2
#: Lines to go up to which they are broadcast; beyond that they are joined.
BLOCK = 2_000_000
#: Bits of the map of leaves; leaves that share a bit cost time only.
BITS = 1 << 25
WILDCARD = np.uint64(0x2A)
FIELD = np.zeros(256, bool)
FIELD[[*b"0123456789@/="]] = True


class Lines:
    """Lines with words, of some texts. owner: the text; number: the line's place among all lines of it; line: the hash of
    its words; leaf: the hash of its path; words: hashes of all words, of which a line's stand from first to last."""

    def __init__(self, texts: list[bytes], depth: int = DEPTH):
        w = T.Words(texts)
        newline = np.concatenate([[0], np.cumsum(w.buf == 0x0A)])
        line = newline[w.start]
        self.first = first = np.flatnonzero(np.diff(line, prepend=-1))
        self.last = last = np.append(first[1:], len(line))[: len(first)]
        fields = np.concatenate([[0], np.cumsum(FIELD[w.buf])])
        self.words = np.where(fields[w.end] > fields[w.start], WILDCARD, w.hashes())
        self.owner = np.searchsorted(w.first[1:], first, "right")
        self.number = line[first] - newline[w.text_start][self.owner]
        self.line = T.run_hashes(self.words, first, last)
        with np.errstate(over="ignore"):
            self.leaf = T.mix(T.run_hashes(self.words, first, np.minimum(first + depth, last)) + (last - first).astype(np.uint64) * T.P1)
            total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(np.where(self._once(), self.line, 0)))])
        bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        #: Of each text, a hash of the set of its lines.
        self.context = total[bounds[1:]] - total[bounds[:-1]]
        self.fit = last - first >= WORDS

    def _once(self) -> np.ndarray:
        """Whether a line is the first of its kind in its text."""
        order = np.lexsort((self.line, self.owner))
        new = np.ones(len(order), bool)
        new[1:] = (self.owner[order][1:] != self.owner[order][:-1]) | (self.line[order][1:] != self.line[order][:-1])
        out = np.zeros(len(order), bool)
        out[order[new]] = True
        return out


def _leaves(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in T.slices(batch.column("text")):
            x = Lines(texts, depth)
            pair = np.unique(np.stack([x.leaf[x.fit], x.context[x.owner[x.fit]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, k]).view(np.int64)) for k in (0, 1)], ["leaf", "context"])


def _candidates(batches: Iterator[pa.RecordBatch], shared, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, texts in T.slices(batch.column("text")):
            x = Lines(texts, depth)
            rows = np.flatnonzero(x.fit & x._once() & marked(shared.value, x.leaf))
            size = (x.last - x.first)[rows]
            offsets = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(x.first[rows] - offsets[:-1], size) + np.arange(offsets[-1])
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.words[at].view(np.int64)))
            columns = [x.leaf[rows], x.line[rows], x.context[x.owner[rows]]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), words], ["leaf", "line", "context", "words"])


def recurring(docs: DataFrame, contexts: int = CONTEXTS, depth: int = DEPTH, bits: int = BITS) -> DataFrame:
    """(line, template) of the distinct lines whose template recurs; both are hashes."""
    texts = docs.select("text")
    leaves = texts.mapInArrow(lambda b: _leaves(b, depth), "leaf long, context long").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= contexts)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(leaves, "leaf", bits))
    rows = written(texts.mapInArrow(lambda b: _candidates(b, shared, depth), "leaf long, line long, context long, words array<long>"), "line-candidates")
    held = rows.select("line", "context").distinct()
    kinds = rows.groupBy("line").agg(F.any_value("leaf").alias("leaf"), F.any_value("words").alias("words"))
    kinds = written(kinds.join(held.groupBy("line").agg(F.count("*").alias("n")), "line"), "line-kinds")
    pieces = kinds.select("leaf", "line", "n", F.posexplode("words").alias("at", "word")).where((F.col("at") >= depth) & (F.col("word") != int(WILDCARD)))
    constant = pieces.groupBy("leaf", "at", "word").agg(F.sum("n").alias("s")).where(F.col("s") >= contexts).select("leaf", "at", "word")
    stay = pieces.join(constant, ["leaf", "at", "word"]).groupBy("line").agg(F.collect_set("at").alias("ats"))
    kinds = kinds.join(stay, "line", "left")
    own = lambda w, i: (i < depth) | F.array_contains(F.coalesce("ats", F.array().cast("array<int>")), i)
    masked = F.transform("words", lambda w, i: F.when(own(w, i), w).otherwise(F.lit(int(WILDCARD))))
    known = F.size(F.filter("masked", lambda w: w != int(WILDCARD)))
    kinds = kinds.withColumn("masked", masked).withColumn("known", known).where((F.col("known") >= WORDS) & (2 * F.col("known") >= F.size("words")))
    kinds = kinds.select("line", F.xxhash64("leaf", "masked").alias("template"))
    found = held.join(kinds, "line").select("template", "context").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= contexts)
    return kinds.join(found.select("template"), "template").select("line", "template")


def _cleaned(batches: Iterator[pa.RecordBatch], known, with_text: bool) -> Iterator[pa.RecordBatch]:
    """known: the lines to go of all rows, or None where each row has its own in column gone."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        own = None if known is not None else batch.column("gone").to_pylist()
        for first, _, part in T.slices(batch.column("text")):
            x = Lines(part)
            lines = known.value if known is not None else np.unique(np.array([h for k in range(len(part)) for h in own[first + k] or ()], np.int64).view(np.uint64))
            if len(lines):
                at = np.minimum(np.searchsorted(lines, x.line), len(lines) - 1)
                gone = np.flatnonzero(x.fit & (lines[at] == x.line))
            else:
                gone = np.zeros(0, np.int64)
            n_lines.append(np.bincount(x.owner, minlength=len(part)))
            n_dropped.append(np.bincount(x.owner[gone], minlength=len(part)))
            numbers: dict[int, set[int]] = {}
            for owner, number in zip(x.owner[gone].tolist(), x.number[gone].tolist(), strict=True):
                numbers.setdefault(owner, set()).add(number)
            for owner, some in numbers.items():
                part[owner] = b"\n".join(t for k, t in enumerate(part[owner].split(b"\n")) if k not in some)
            texts += part
        if with_text:
            out = pa.array([t if v else None for t, v in zip(texts, batch.column("text").is_valid().to_pylist(), strict=True)], pa.binary()).cast(pa.string())
        else:
            out = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        counts = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (n_lines, n_dropped)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), out, *counts], ["row", "text" if with_text else "kept_sha256", "n_lines", "n_dropped"])


def _own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, line): the distinct lines of each text, under two hashes that tell texts apart."""
    for batch in batches:
        for first, last, texts in T.slices(batch.column("text")):
            x = Lines(texts)
            rows = np.flatnonzero(x.fit & x._once())
            ids = [batch.column(c)[first:last].take(pa.array(x.owner[rows])) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(x.line[rows].view(np.int64))], ["a", "b", "line"])


def cleaned(docs: DataFrame, keep: list[str], with_text: bool = True, contexts: int = CONTEXTS, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """The columns `keep` of docs, without text, in a struct `row`, with n_lines (lines with a word), n_dropped, and the text left.

    with_text false: kept_sha256 in place of the text. A null text stays null, has no lines, and its sha256 is that of
    an empty one. The lines left are joined as they were, by line feeds. Repeated rows are rows of their own, and count as
    one document; a task holds one very long text at a time. An empty table gives none. Lines are matched by hashes of 64
    bits. Up to `block` distinct lines that go are broadcast; more are joined with the texts' own lines, with equal results.
    """
    found = written(recurring(docs, contexts, depth).select("line"), "line-templates")
    rows = docs.select(F.struct(*(docs[c] for c in keep if c != "text")).alias("row"), "text")
    kind = StructType([rows.schema["row"], StructField("text" if with_text else "kept_sha256", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if found.count() <= block:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(found.toPandas()["line"].to_numpy(np.int64).view(np.uint64)))
        return rows.mapInArrow(lambda b: _cleaned(b, known, with_text), kind)
    keys = [F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")]
    own = docs.select("text", *keys).mapInArrow(_own_lines, "a long, b long, line long").distinct()
    gone = own.join(found, "line").groupBy("a", "b").agg(F.collect_list("line").alias("gone"))
    return rows.select("*", *keys).join(gone, ["a", "b"], "left").select("row", "text", "gone").mapInArrow(lambda b: _cleaned(b, None, with_text), kind)
