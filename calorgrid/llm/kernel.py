"""Numpy helpers for the text columns of Arrow batches: slices, words, hashes, ragged gathers.

All work on whole batches at once. A slice holds about `SLICE` bytes of text, or one longer text, so that
the memory of a Python worker follows the slice and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_libc = ctypes.CDLL(None)
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.arange(256) >= 0x80  # of words of letters and digits, lower-cased
_LETTER[0x30:0x3A] = _LETTER[0x61:0x7B] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 2 * len(_powers["up"]))
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a sequence of 64-bit values; equal spans have equal hashes."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and their offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):  # glibc alone has it
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has about `size` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch, offsets
        release()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [start, end) of words `[^\\x20\\x09-\\x0D]+`, and the first word of each text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_values(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return _BYTE[_LOWER[data]] if lower else _BYTE[data]


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the first of each text; a text of fewer words gives its whole
    sequence as one, a text without words none."""
    starts, ends, first = words(data, offsets)
    h = span_hash(byte_values(data, lower), starts, ends)
    n = first[1:] - first[:-1]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    at = ragged(first[:-1], count)
    return span_hash(h, at, at + np.repeat(np.minimum(n, k), count)), begin


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + count) in a row."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1], dtype=np.int64) + np.repeat(starts - (total - counts), counts)


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts with A-Z in lower case: the number of each word, the
    distinct words, and the first word of each text. Words are told apart by their bytes."""
    low = _LOWER[data]
    inside = _LETTER[low]
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True  # a text begins a word anew
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | new[:-1]))
    total = np.concatenate([[0], np.cumsum(inside)])
    bounds = np.append(total[starts], total[-1])
    got = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low[inside]))
    coded = got.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary, np.searchsorted(starts, offsets)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row and their offsets."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), total[offsets]


class Table:
    """A map from 64-bit hashes to 0, 1, 2, ... in the order of insertion; linear probing, all in numpy."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is not in the table."""
        mask, shift = (1 << self.bits) - 1, U(64 - self.bits)
        slot = (h >> shift).astype(np.int64)
        got = np.where(self.keys[slot] == h, self.rows[slot], -1)
        left = np.flatnonzero((got < 0) & (self.rows[slot] >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            row, same = self.rows[slot], self.keys[slot] == h[left]
            got[left[same & (row >= 0)]] = row[same & (row >= 0)]
            go = (row >= 0) & ~same
            left, slot = left[go], slot[go]
        return got

    def add(self, h: np.ndarray) -> None:
        """Append distinct hashes that are not in the table."""
        while self.n + len(h) > (1 << self.bits) // 2:
            old = np.flatnonzero(self.rows >= 0)
            keys, rows = self.keys[old], self.rows[old]
            self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int32)
            self._put(keys, rows)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rows[free]  # of several for one slot the last stays
            won = free & (self.rows[slot] == rows)
            self.keys[slot[won]] = h[won]
            slot, h, rows = (slot[~won] + 1) & mask, h[~won], rows[~won]
