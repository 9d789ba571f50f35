"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of order ORDER holds how often each byte followed each context in its training
texts. The statistics stay frozen: a byte costs -log2 of its share in the longest known context, with an escape cost
(method C) for each context in which it never came, down to a uniform byte. A text's code length is the sum over its
bytes, and the language of the shortest code wins. A tree holds only the contexts that occur, as sorted codes; a batch of
text is scored by its distinct four-byte codes, once for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import text as T
from .sampling import KEY_BYTES, fold, sample

ORDER = 3
#: Training texts of a language at most; they are whole, and fewer where they are very long (sampling.KEY_BYTES).
PER_LANGUAGE = 400
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1


@dataclass
class Tree:
    """The contexts of one language that occur, by their length. Codes are bytes read as one number, the last one lowest."""

    #: Bits of each byte without a context.
    zero: np.ndarray
    #: For lengths 1 to ORDER: codes of a context with the byte after it, and their bits.
    codes: list[np.ndarray]
    bits: list[np.ndarray]
    #: For lengths 1 to ORDER: codes of the contexts, and the bits of their escapes.
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code after the bytes before it."""
        out, left = np.zeros(len(code), np.float64), np.arange(len(code))
        for k in range(ORDER, 0, -1):
            own = code[left] & ((1 << 8 * (k + 1)) - 1)
            at, known = _found(self.codes[k - 1], own)
            out[left[known]] += self.bits[k - 1][at[known]]
            left, own = left[~known], own[~known]
            at, known = _found(self.contexts[k - 1], own >> 8)
            out[left[known]] += self.escapes[k - 1][at[known]]
        out[left] += self.zero[code[left] & 0xFF]
        return out


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]


def _found(known: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each of some in known, which is sorted, and whether it is there."""
    if not len(known):
        return np.zeros(len(some), np.int64), np.zeros(len(some), bool)
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    return at, known[at] == some


def _codes(data: np.ndarray) -> np.ndarray:
    """Each byte from the fourth on, with the three before it."""
    d = data.astype(np.int64)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


def grown(texts: list[str]) -> Tree:
    code = np.concatenate([_codes(np.frombuffer(b"\n\n\n" + t.encode().lower(), np.uint8)) for t in texts])
    n = np.bincount(code & 0xFF, minlength=256)
    total, distinct = n.sum(), (n > 0).sum()
    with np.errstate(divide="ignore"):
        zero = np.where(n > 0, -np.log2(n / (total + distinct)), 8 - np.log2(distinct / (total + distinct)))
    tree = Tree(zero, [], [], [], [])
    for k in range(1, ORDER + 1):
        codes, times = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        contexts, first, size = np.unique(codes >> 8, return_index=True, return_counts=True)
        total = np.add.reduceat(times, first) + size
        tree.codes.append(codes)
        tree.bits.append(-np.log2(times / np.repeat(total, size)))
        tree.contexts.append(contexts)
        tree.escapes.append(-np.log2(size / total))
    return tree


def trained(texts: list[tuple[str, str]]) -> Model | None:
    """The model of (language, text) pairs; None if there are none."""
    languages = sorted({language for language, _ in texts})
    return Model(languages, [grown([t for language, t in texts if language == k]) for k in languages]) if languages else None


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(model.languages)))
    pieces = [(i, t[max(0, a - 3) : a + T.SLICE_BYTES], a == 0) for i, t in enumerate(texts) for a in range(0, len(t), T.SLICE_BYTES)]
    k = 0
    while k < len(pieces):
        first, size = k, 0
        while k < len(pieces) and (k == first or size + len(pieces[k][1]) <= T.SLICE_BYTES):
            size += len(pieces[k][1])
            k += 1
        data = b"".join((b"\n\n\n" if head else b"") + t for _, t, head in pieces[first:k]).lower()
        codes, own = np.unique(_codes(np.frombuffer(data, np.uint8)).astype(np.uint32), return_inverse=True)
        codes = codes.astype(np.int64)
        lengths = np.array([len(t) + 3 * head for _, t, head in pieces[first:k]])
        stop = np.cumsum(lengths)
        context = (stop[:-1, None] + np.arange(3)).ravel()  # bytes that are context only
        owners = [i for i, _, _ in pieces[first:k]]
        for column, tree in enumerate(model.trees):
            bits = np.concatenate([np.zeros(3), tree.costs(codes)[own]])
            bits[context] = 0
            np.add.at(out[:, column], owners, np.add.reduceat(bits, stop - lengths))
    return out


def _identified(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model | None = shared.value
    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        letters = named.pop("letters").to_pylist()
        text = named.pop("text") if "text" in named else named["row"].field("text")
        best, score, bits = [], [], []
        for a, b, texts in T.slices(text):
            if model is None:
                lengths = np.zeros((b - a, 1))
            else:
                lengths = code_lengths(model, texts)
            top = lengths.argmin(1)
            least = lengths[np.arange(b - a), top]
            share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
            for k in range(b - a):
                known = letters[a + k] and model is not None
                best.append(model.languages[top[k]] if known else UNKNOWN)
                score.append(float(share[k]) if known else 0.0)
                bits.append(float(least[k]) / max(1, len(texts[k])))
        named |= {"lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64()), "bits": pa.array(bits, pa.float64())}
        yield pa.RecordBatch.from_arrays(list(named.values()), list(named))


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE, key_bytes: int = KEY_BYTES) -> Model | None:
    """The model of a bounded sample of the rows with a lang outside of the held-out fold."""
    rows = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).select(F.col("lang").alias("key"), "doc_id", "text")
    return trained(sample(rows, per_language, key_bytes))


def identified(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all of them if None) in a struct `row`, with lang_pred, score and bits, for each row.

    lang_pred: the language of the shortest code, the first by name on ties; "und" if the text is null, has no letter,
    or nothing was learned. score: the share of that language's probability in the sum over all, 0 for "und". bits: of
    the shortest code, for each byte. Whole texts are scored, very long ones in pieces. An empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*(docs[c] for c in keep)).alias("row"), *([] if "text" in keep else ["text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])
    return rows.mapInArrow(lambda batches: _identified(batches, shared), kind)


#: A document whose best language has less than this share is rejected, like one without a language.
SURE = 0.5


def accepted() -> Column:
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)
