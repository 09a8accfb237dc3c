"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

White space is ASCII only (blank and U+0009 to U+000D), so words can be cut on
bytes. A word is known by a 64-bit hash of its bytes: the sum of a fixed random
number per byte value times a power that depends on the place in the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int, known=[np.cumprod(np.full(4096, _BYTE[7]), dtype=np.uint64)]) -> np.ndarray:
    if len(known[0]) < n:
        known[0] = np.cumprod(np.full(2 * n, _BYTE[7]), dtype=np.uint64)
    return known[0]


@dataclass
class Words:
    """Words of a run of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray   # bytes of all texts
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def text(self, word: int) -> bytes:
        return self.data[self.start[word]:self.end[word]].tobytes()

    def of_word(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, nulls as empty, and where each text starts and the last one ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[at[0]:at[-1]] if buffer is not None and len(buffer) \
        else np.zeros(0, np.uint8)
    return data, at - at[0]


def words_of(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Words:
    data, at = utf8(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[:-1][at[:-1] < len(data)]
    begins[cut] = inside[cut]  # a text's first byte starts a word of its own
    start = np.flatnonzero(begins)
    over = np.append(~inside, True)
    over[cut] = True
    stop = np.flatnonzero(over)
    end = stop[np.searchsorted(stop, start, "right")] if len(start) else start
    first = np.searchsorted(start, at)
    return Words(data, start, end, first, hashes(data, start, end) if hashed else np.zeros(0, np.uint64))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    letters = data[place + np.repeat(start, length)]
    terms = _BYTE[letters] * _powers(int(length.max()))[place]
    return mixed(np.add.reduceat(terms, at) + length.astype(np.uint64))


def windows(of: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbours, over the ends of texts too."""
    n = len(of) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out += of[j:j + n] * _PLACE[j]
    return mixed(out)


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word at which each whole window of ``k`` words starts, and its text."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n), text


def slices(batches: Iterator[pa.RecordBatch], column: str,
           most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``most`` bytes, whole texts only."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(length)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def int64(values: np.ndarray) -> pa.Array:
    """Hashes as Spark's signed longs."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
