"""Vectorised text kernels that run inside Spark's Arrow batches.

A batch of texts is one byte buffer with offsets, so words, shingles and lines are found and hashed with a few
numpy passes over the bytes rather than with a Python loop over words.  A word is a run of bytes other than
0x20 and 0x09-0x0D; a null text has no words.  Hashes are 64 bits wide: two different words of a corpus of
10^9 distinct words share one with a probability below 3 in 100.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTES_PER_CHUNK = 1 << 20

_RATIO = np.uint64(0x9E3779B97F4A7C15)
_RATIO_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[WHITE] = 0
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        factors = np.full(max(n, BYTES_PER_CHUNK), base, np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if n <= 4 * BYTES_PER_CHUNK:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Texts:
    """Consecutive texts of one buffer; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, size: int = BYTES_PER_CHUNK, most: int = 65_536) -> Iterator[Texts]:
    """Whole texts in runs of about `size` bytes and at most `most` texts; a longer text is a run of its own."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1), i + most)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


@dataclass
class Words:
    """hashes: of each word; starts, ends: its bytes; offsets: words of text i are offsets[i]:offsets[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def spans(data: np.ndarray, solid: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `solid` bytes, which `borders` cut."""
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = solid[0], False
    np.greater(solid[1:], solid[:-1], out=edge[1:-1])
    inner = borders[(borders > 0) & (borders < len(data))]
    edge[inner] |= solid[inner]
    starts = np.flatnonzero(edge[:-1])
    edge[0], edge[-1] = False, solid[-1]
    np.greater(solid[:-1], solid[1:], out=edge[1:-1])
    edge[inner] |= solid[inner - 1]
    return starts, np.flatnonzero(edge)


def hash_spans(data: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends]; spans don't overlap, and bytes between them have code 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    weighed = codes[data]
    weighed *= _power(_RATIO, len(data))
    sums = np.add.reduceat(weighed, starts)
    return mix(sums * _power(_RATIO_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: Texts, lower: bool = False) -> Words:
    if not len(texts.data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64))
    starts, ends = spans(texts.data, ~WHITE[texts.data], texts.offsets)
    hashes = hash_spans(texts.data, _LOWER_CODES if lower else _CODES, starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, texts.offsets))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows that lie in one text, and the index of each one's first word."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = w.hashes[: n - k + 1].copy()
    for j in range(1, k):
        total *= np.uint64(0xC2B2AE3D27D4EB4F)
        total += w.hashes[j : n - k + 1 + j]
    last = np.repeat(w.offsets[1:], np.diff(w.offsets))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mix(total[at]), at


def release() -> None:
    """Gives back to the system what this process holds of freed arrays, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() at the end: Spark keeps a task's Python worker, idle too, and with it what arrays once took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def count_words(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.diff(words_offsets(t)) for t in chunks(column))])


def words_offsets(texts: Texts) -> np.ndarray:
    if not len(texts.data):
        return np.zeros(len(texts) + 1, np.int64)
    starts, _ = spans(texts.data, ~WHITE[texts.data], texts.offsets)
    return np.searchsorted(starts, texts.offsets)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 of all i, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)
