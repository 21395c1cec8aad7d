"""Whole-column text work in numpy: words, hashes and counts straight from Arrow buffers.

A column of texts is one byte array plus offsets, so words, their hashes and
their places come out of a handful of vector passes, whatever the number of
documents.  Words are runs of bytes other than 0x20 and 0x09-0x0D; those bytes
never occur inside a UTF-8 sequence, so this equals the code-point definition.

Hashes are 64-bit: a polynomial over the bytes modulo 2**64, taken from prefix
sums, then finished with the length by a bijective mixer.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; arrays of this length stay near the CPU's caches.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for n positions at least."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, CHUNK + 4096)
        out = []
        for b in (_BASE, _INVERSE):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * CHUNK:  # one giant word or line: don't keep tables of its length
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving what it has freed back to the system at its end: workers outlive their tasks, and would keep it."""

    def thrift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return thrift


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        stop = int(ends[last - 1])
        power, inverse = _tables(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * power[: stop - base], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


class Words:
    """The words of a batch of texts: hash, place in data, and each text's range of words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, self.offsets = buffers(texts)
        self.data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)  # a text begins or ends here
        edge[self.offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~solid[:-1]
            starts = solid & (before | edge[:-1])
            after = np.empty(n, bool)
            after[-1] = True
            after[:-1] = ~solid[1:]
            ends = solid & (after | edge[1:])
            self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)  # the text's words: first[k] up to first[k + 1]
        self.hash = spans_hash(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of so many words in a text, with each text's range; a shorter text with words gives one run of them all."""
        counts = np.diff(self.first)
        runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(runs)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], runs)
        length = np.repeat(np.minimum(counts, size), runs)
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            more = length > k
            if more.all():
                out = mix(out ^ self.hash[at + k], k + 1) if k else mix(self.hash[at], 1)
            else:
                out[more] = mix(out[more] ^ self.hash[at[more] + k], k + 1)
        return out, first


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, a row at least."""
    texts = batch.column(column)
    if len(texts) == 0:
        return
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(first, last - first)
        first = last


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte (one entry more than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
