"""Token counts by section, from one encoding of the whole document.

A document is encoded once with a byte-level BPE vocabulary. The byte lengths of its tokens, added up, give each token's
span; sections are spans too, and each token is joined to the section that holds its first byte. That is the rule for
tokens that cross a border: all of the token goes to the section in which it begins, so the sections' counts add up to
the document's. Sections are lines here, each with the line feed that ends it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary file: a line for each token, base64 bytes and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a text that are encoded in one call; a longer text is cut before a word, where the pattern cuts it too.
PIECE = 1 << 20


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """The encoding, and the byte length of each token."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("plumbline", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces that are encoded alike alone and together: cut where a letter is followed by one space and a letter."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def sections(text: bytes) -> np.ndarray:
    """Byte positions where lines begin; none in an empty text. A line feed belongs to the line that it ends."""
    if not text:
        return np.zeros(0, np.int64)
    after = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x0A) + 1
    return np.concatenate([np.zeros(1, np.int64), after[after < len(text)]])


def attributed(spans_end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Tokens of each section: by the section that holds the token's first byte."""
    begin = np.concatenate([np.zeros(1, np.int64), spans_end])[:-1]
    return np.bincount(np.searchsorted(starts, begin, "right") - 1, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    encoding, lengths = encoder(shared.value)
    for batch in batches:
        n_tokens, n_crossing, counts = [], [], []
        for text in batch.column("text").to_pylist():
            ids = [encoding.encode_ordinary(piece) for piece in pieces(text)] if text else []
            end = np.cumsum(lengths[np.concatenate([np.array(x, np.int64) for x in ids])]) if ids else np.zeros(0, np.int64)
            starts = sections((text or "").encode())
            n_tokens.append(len(end))
            counts.append(attributed(end, starts))
            n_crossing.append(len(starts) - 1 - int(np.isin(starts[1:], end).sum()) if len(starts) else 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()), lists], ["doc_id", "n_tokens", "n_crossing", "section_tokens"])


def counted(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_crossing (section borders within a token) and section_tokens (an array) for each row of docs.

    A null or empty text has no tokens and no sections. The strings of special tokens are ordinary text. The sum of
    section_tokens is n_tokens. Repeated rows are rows of their own; an empty table gives none; other columns aren't
    read. The driver reads the vocabulary file, of a fixed size, and broadcasts it.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _counted(batches, shared), "doc_id long, n_tokens long, n_crossing long, section_tokens array<long>")
