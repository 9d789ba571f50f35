"""Quality scores from supervised subword embeddings.

A text is a bag of hashed features: its words, the character 3-grams and 4-grams of each word with its borders, and pairs
of neighbouring words. Each bucket has a learned vector; a text's
vector is the mean over its features, and a softmax layer gives the probability of label 1. Vectors and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample of labelled texts. As the layer is linear,
each bucket's vector times the layer is one number when texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .sampling import KEY_BYTES, drawn, fold, sample

BUCKETS, DIMENSIONS = 1 << 17, 8
#: Training texts of a label at most; they are whole, and fewer where they are very long (sampling.KEY_BYTES).
PER_LABEL = 1500
EPOCHS, RATE = 6, 0.5
FOLDS, HELD_OUT = 5, 0
CUTOFF = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature of some texts, in no order."""
    w = T.Words([b" " + b" ".join(t.split()) + b" " for t in texts])
    owner = np.repeat(np.arange(len(texts)), w.count)
    word = w.hashes()
    owners, hashes = [owner], [word]
    if len(word) > 1:
        same = owner[1:] == owner[:-1]
        with np.errstate(over="ignore"):
            pair = T.mix(word[1:] * T.P1 + word[:-1])
        owners.append(owner[1:][same])
        hashes.append(pair[same])
    n = len(w.data) - 8
    first = np.flatnonzero((w.buf[:n] & 0xC0) != 0x80)  # where characters begin
    space, byte = T.SPACE[w.buf[first]], np.append(first, n)
    of = np.repeat(np.arange(len(texts)), w.text_end - w.text_start + 1)[:n][first]
    for size in (3, 4):
        at = np.arange(max(0, len(first) - size + 1))
        inner = np.zeros(len(at), bool)
        for k in range(1, size - 1):
            inner |= space[k : k + len(at)]
        at = at[~inner & (of[: len(at)] == of[size - 1 :][: len(at)])]
        owners.append(of[at])
        hashes.append(T.mix(T.hashes(w.buf, first[at], byte[at + size] - first[at]) ^ np.uint64(size << 56)))
    return np.concatenate(owners), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def trained(texts: list[tuple[int, str]], seed: int = 1) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias) from (label, text) pairs; a text's logit is the mean of its buckets' numbers, and the bias."""
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, bias = r.uniform(-0.1, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    rows = []
    for a in range(0, len(texts), 64):
        part = texts[a : a + 64]
        owner, bucket = features([t.encode() for _, t in part])
        for k, (label, _) in enumerate(part):
            ids, times = np.unique(bucket[owner == k], return_counts=True)
            if len(ids):
                rows.append((ids.astype(np.int32), (times / times.sum()).astype(np.float32), int(label)))
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in r.permutation(len(rows)):
            ids, share, label = rows[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            vectors[ids] -= rate * share[:, None] * back * min(len(ids), 50)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scores(model: tuple[np.ndarray, float], texts: list[bytes]) -> np.ndarray:
    weight, bias = model
    owner, bucket = features(texts)
    total, n = np.bincount(owner, weight[bucket], len(texts)), np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -40, 40)))


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [scores(shared.value, texts) for _, _, texts in T.slices(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *found]))], ["doc_id", "score"])


def learned(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, key_bytes: int = KEY_BYTES) -> tuple[np.ndarray, float]:
    """The model of a bounded sample of labelled rows outside of the held-out fold; all scores are 0.5 if there are none.

    A doc_id that is labelled more than once counts as 1 if one of its labels is; labels other than 0 and 1 are left out, and
    so are rows of docs without a label. Rows that share a doc_id are learned from each; repeated rows count once.
    """
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("key"))
    marks = marks.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    # Ids are drawn first, so that only their texts are joined, by a broadcast of about 8 * per_label ids a label.
    ids = drawn(marks, 2 * per_label).select("key", "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("key", "doc_id", "text")
    return trained(sample(rows, per_label, key_bytes))


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score, the probability of label 1, for each row of docs; a text without features, or null, has the bias alone.

    Whole texts are scored, in batches. Repeated rows are rows of their own, with equal scores; other columns, whatever their
    names, aren't read; an empty table gives no rows. A logit is cut to -40 to 40.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _scored(batches, shared), "doc_id long, score double")
