"""Vectorised work on batches of UTF-8 texts, for functions that run under mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; arrays of eight bytes for each of them stay small.
SLICE_BYTES = 1 << 20
#: [\x20\x09-\x0D] as a table over bytes; bytes.split() splits at the same ones.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTERS = np.zeros(256, bool)
LETTERS[ord("A") : ord("Z") + 1] = LETTERS[ord("a") : ord("z") + 1] = LETTERS[0x80:] = True

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, texts) of runs of rows with about `most` text bytes; null is b""."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts), texts[first:]


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit changes about half of the output."""
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of several texts. start, end: byte positions in data; first: for each text its first word, and the end."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.data = b"\n".join(texts) + bytes(8)
        self.buf = np.frombuffer(self.data, np.uint8)
        n = len(self.data) - 8
        word = np.zeros(n + 2, np.int8)
        word[1:-1] = ~space[self.buf[:n]]
        edge = np.diff(word)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start))
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hashes(self.buf, self.start, self.end - self.start)


def at64(buf: np.ndarray) -> np.ndarray:
    """A view that reads eight bytes from any byte position."""
    return np.ndarray(len(buf) - 7, "<u8", buf, strides=(1,))


#: Masks of the first 0 to 8 bytes of a little-endian number.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hashes(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a round; the same for equal bytes anywhere. buf ends in eight spare bytes."""
    eight = at64(buf)
    with np.errstate(over="ignore"):
        h = mix((eight[start] & HEAD[np.minimum(length, 8)]) + length.astype(np.uint64) * P1)
        on, done = np.flatnonzero(length > 8), 8
        while len(on):
            h[on] = mix((h[on] * P4) ^ (eight[start[on] + done] & HEAD[np.minimum(length[on] - done, 8)]))
            done += 8
            on = on[length[on] > done]
    return h


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte range. buf ends in eight spare bytes."""
    eight = at64(buf)
    seed64 = np.uint64(seed)
    pos, rest = start.astype(np.int64), length.astype(np.int64)
    acc = np.full(len(pos), seed64 + P5, np.uint64)
    with np.errstate(over="ignore"):
        if len(big := np.flatnonzero(rest >= 32)):
            lanes = [np.full(len(big), s, np.uint64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            at, left, on = pos[big], rest[big], np.arange(len(big))
            while len(on):
                for k in range(4):
                    lanes[k][on] = rotl(lanes[k][on] + eight[at[on] + 8 * k] * P2, 31) * P1
                at[on] += 32
                left[on] -= 32
                on = on[left[on] >= 32]
            a = rotl(lanes[0], 1) + rotl(lanes[1], 7) + rotl(lanes[2], 12) + rotl(lanes[3], 18)
            for k in range(4):
                a = (a ^ (rotl(lanes[k] * P2, 31) * P1)) * P1 + P4
            acc[big], pos[big], rest[big] = a, at, left
        acc += length.astype(np.uint64)
        for _ in range(3):
            on = np.flatnonzero(rest >= 8)
            if not len(on):
                break
            acc[on] = rotl(acc[on] ^ (rotl(eight[pos[on]] * P2, 31) * P1), 27) * P1 + P4
            pos[on] += 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        acc[on] = rotl(acc[on] ^ ((eight[pos[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        pos[on] += 4
        rest[on] -= 4
        for k in range(3):
            on = np.flatnonzero(rest > k)
            if not len(on):
                break
            acc[on] = rotl(acc[on] ^ (buf[pos[on] + k].astype(np.uint64) * P5), 11) * P1
        acc = (acc ^ (acc >> np.uint64(33))) * P2
        acc = (acc ^ (acc >> np.uint64(29))) * P3
        return acc ^ (acc >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(b)))]).astype(np.uint64) for b in (base, inverse))


def window_hashes(word_hash: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of `width` consecutive word hashes."""
    n = max(0, len(word_hash) - width + 1)
    return run_hashes(word_hash, np.arange(n), np.arange(n) + width, base)


def run_hashes(word_hash: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of word hashes from start to end: a polynomial in an odd base, mixed. Runs of other lengths differ too."""
    power, inverse = _powers(1 << max(16, int(len(word_hash) + 1).bit_length()), base)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(word_hash * power[: len(word_hash)])])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * P5)
