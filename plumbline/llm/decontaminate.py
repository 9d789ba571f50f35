"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows. A window's shingles are ordered by how rare they are over all documents; as a
document must contain the whole window, one shingle, the rarest, is the necessary prefix. Document shingles that equal a
prefix give the places where a window can begin; those that would begin or end outside of the document fall to the
bounds on position and length, and the words of the rest are compared exactly.

The index of the benchmark goes to all tasks in blocks of bounded size, one after another if it is larger than one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as T

WINDOW, SHINGLE = 13, 5
#: Text bytes of the benchmark that are broadcast at once; as an index they take about a hundred times that.
BLOCK_BYTES = 1 << 20
#: Bytes of words to themselves in lower case, of others to a space: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Index:
    """Windows of some items. starts: first words of the shingles looked for, with the shingles' lengths."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        self.windows: dict[bytes, set[str]] = {}
        self.shingle = shingle
        for item, text in items:
            w = words((text or "").encode())
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                self.windows.setdefault(b" ".join(w[i : i + n]), set()).add("" if item is None else str(item))
        self.all = {s for key in self.windows for s, _ in self.shingles(key)}

    def shingles(self, key: bytes) -> Iterator[tuple[bytes, int]]:
        w = key.split()
        n = min(self.shingle, len(w))
        for i in range(len(w) - n + 1):
            yield b" ".join(w[i : i + n]), i

    @staticmethod
    def heads(shingles) -> dict[bytes, tuple[int, ...]]:
        out: dict[bytes, set[int]] = {}
        for s in shingles:
            w = s.split()
            out.setdefault(w[0], set()).add(len(w))
        return {w: tuple(sorted(n)) for w, n in out.items()}

    def prefixes(self, count: dict[bytes, int]) -> dict[bytes, set[tuple[int, int]]]:
        """The rarest shingle of each window, to (its place in the window, the window's length)."""
        out: dict[bytes, set[tuple[int, int]]] = {}
        for key in self.windows:
            s, at = min(self.shingles(key), key=lambda x: (count.get(x[0], 0), x[0], x[1]))
            out.setdefault(s, set()).add((at, key.count(b" ") + 1))
        return out


def _counted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    heads, wanted = shared.value
    count: Counter[bytes] = Counter()
    for batch in batches:
        for _, _, texts in T.slices(batch.column("text")):
            for t in texts:
                w = words(t)
                count.update(s for i, x in enumerate(w) if x in heads for n in heads[x] if (s := b" ".join(w[i : i + n])) in wanted)
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["shingle", "n"])


def hits(w: list[bytes], heads: dict, prefixes: dict, windows: dict) -> tuple[bytearray, set[str]]:
    """A mark for each word within a window, and the items of the windows found."""
    hit, items, seen = bytearray(len(w)), set(), set()
    for i in [i for i, x in enumerate(w) if x in heads]:
        for n in heads[w[i]]:
            for at, length in prefixes.get(b" ".join(w[i : i + n]), ()):
                start = i - at
                if start >= 0 and start + length <= len(w) and (start, length) not in seen and (found := windows.get(b" ".join(w[start : start + length]))):
                    seen.add((start, length))
                    hit[start : start + length] = b"\x01" * length
                    items |= found
    return hit, items


def _scanned(batches: Iterator[pa.RecordBatch], shared, last: bool) -> Iterator[pa.RecordBatch]:
    heads, prefixes, windows = shared.value
    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        text = named["text"] if "text" in named else named["row"].field("text")
        before = zip(named["hit"].to_pylist(), named["items"].to_pylist(), strict=True)
        n_words, n_hit, marks, found = [], [], [], []
        for _, _, texts in T.slices(text):
            for t, (hit_before, items_before) in zip(texts, before, strict=False):
                w = words(t)
                hit, items = hits(w, heads, prefixes, windows)
                if hit_before:
                    hit = bytearray(map(max, hit, hit_before))
                n_words.append(len(w))
                n_hit.append(sum(hit))
                marks.append(bytes(hit) if n_hit[-1] and not last else b"")
                found.append(sorted(items.union(items_before)))
        named |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit": pa.array(marks, pa.binary()), "items": pa.array(found, pa.list_(pa.string()))}
        if last:
            named.pop("text", None)
        yield pa.RecordBatch.from_arrays(list(named.values()), list(named))


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about block_bytes of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()], k == n - 1


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of docs (all of them if None) in a struct `row`, with n_words, n_hit (words within a window) and
    items (sorted ids, as strings, of the items of which a window occurs), for each row.

    Words are runs of letters and digits of ASCII, in lower case, and of all other characters. A null or empty text has
    no words, and an item without words no windows. A null item_id reads as "". Repeated rows are rows of their own, and
    repeated items count once. An empty benchmark hits nothing; an empty table gives none.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    out = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), *([] if "text" in keep else ["text"]), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(b"").alias("hit"), F.array().cast("array<string>").alias("items"))
    for items, last in blocks(benchmark, block_bytes):
        index = Index(items, window, shingle)
        look = spark.sparkContext.broadcast((Index.heads(index.all), index.all))
        counts = docs.select("text").mapInArrow(lambda b, look=look: _counted(b, look), "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        count = {bytes(r.shingle): r.n for r in counts.collect()} if index.all else {}  # no more rows than the block has shingles
        prefixes = index.prefixes(count)
        look = spark.sparkContext.broadcast((Index.heads(prefixes), prefixes, index.windows))
        kind = StructType([f for f in out.schema.fields if f.name != "text" or not last])
        out = out.mapInArrow(lambda b, look=look, last=last: _scanned(b, look, last), kind)
    return out.select("row", "n_words", "n_hit", "items")


#: A document counts as contaminated when some word is hit, and one in so many words at least.
ONE_IN = 20


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item of benchmark."""
    return scanned(docs, benchmark).where("n_hit = 0").select("row.*")
