"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Everything here works on the UTF-8 bytes of a whole slice of
documents at once: one pass finds every word of every document, and a prefix polynomial gives each
word (and each run of words) a 64-bit hash without visiting words one by one in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = (1 << 19) - 64
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT2 = np.uint64(0xD6E8FEB86659FD93)
_GOLD = 0xBF58476D1CE4E5B9


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _PowerTable:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        return self.up, self.down


_BYTES, _WORDS = _PowerTable(0x5851F42D4C957F2D), _PowerTable(0x2545F4914F6CDD1D)
_VALUE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h *= _MULT
    h ^= h >> np.uint64(29)
    h *= _MULT2
    h ^= h >> np.uint64(32)
    return h


def release() -> None:
    """Give freed memory back to the system: a Python worker lives through many tasks and would keep the most that any has used."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that a slice holds at most `limit` bytes of text (or one longer document).

    Yields the slice, its bytes and its row offsets.  Null texts are empty.  Memory that earlier tasks have freed
    is given back at first, this one's at the end."""
    release()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, "")
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            kind = np.int32
        else:
            kind = np.int64
        n = len(col)
        if not n:
            continue
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        a = 0
        while a < n:
            b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
            b = min(n, max(b, a + 1))
            yield batch.slice(a, b - a), raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b
    release()


def space_table() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return t


def alnum_table() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, after lower-casing."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word.

    A word never spans two documents."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    up, down = _BYTES.get(len(data) + 1)
    acc = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts])


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h (max(0, n-k+1) of them)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.get(n + 1)
    acc = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((h | np.uint64(1)) * up[:n] + (h >> np.uint64(7)) * up[:n], out=acc[1:])
    return mix((acc[k:] - acc[: n - k + 1]) * down[: n - k + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + l)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty ranges give 0."""
    acc = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind in "fi" else np.int64), np.cumsum(values)])
    return acc[bounds[1:]] - acc[bounds[:-1]]


def ragged(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column over a flat numpy array."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, type=kind))
