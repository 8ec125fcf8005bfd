"""Packed integers where they lie: load, store, resize, sort and search at bit offsets, without unpacking to arrays.

A vector is a BINARY column of ``width``-bit values, value i at bits i * width from the lowest bit of the first byte on.
The functions work on the bytes of a whole Arrow batch at once: a value that crosses a 64-bit word is merged from two words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType

MOST_WIDTH = 57


def words_of(data: bytes | memoryview | pa.Buffer, n_bytes: int | None = None) -> np.ndarray:
    """The bytes as 64-bit words of their own, with a word of slack so that two words can be loaded anywhere."""
    raw = np.frombuffer(data, np.uint8)[:n_bytes]
    words = np.zeros((len(raw) + 7) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(raw)] = raw
    return words


def load(words: np.ndarray, bit: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """The values of ``width`` (1 to 64) bits at the bit offsets ``bit``."""
    word, shift, width = bit >> 6, (bit & 63).astype(np.uint64), np.asarray(width).astype(np.uint64)
    low = words[word] >> shift
    # a shift by 64 is none in numpy, so the upper part moves by 1 and then by the rest
    high = (words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    return (low | high) & (np.uint64(2**64 - 1) >> (np.uint64(64) - width))


def store(words: np.ndarray, bit: np.ndarray, width: np.ndarray | int, values: np.ndarray) -> None:
    """Put ``values`` at bit offsets that don't overlap; other bits stay."""
    word, shift, width = bit >> 6, (bit & 63).astype(np.uint64), np.asarray(width).astype(np.uint64)
    mask = np.uint64(2**64 - 1) >> (np.uint64(64) - width)
    values = values.astype(np.uint64) & mask
    up = np.uint64(63) - shift
    np.bitwise_and.at(words, word, ~(mask << shift))
    np.bitwise_or.at(words, word, values << shift)
    np.bitwise_and.at(words, word + 1, ~((mask >> np.uint64(1)) >> up))
    np.bitwise_or.at(words, word + 1, (values >> np.uint64(1)) >> up)


class PackedInts:
    """One packed vector: ``n`` values of ``width`` bits."""

    def __init__(self, words: np.ndarray, width: int, n: int):
        self.words, self.width, self.n = words, width, n

    @classmethod
    def of(cls, values: np.ndarray, width: int | None = None) -> PackedInts:
        values = np.asarray(values).astype(np.uint64)
        width = width or max(1, int(values.max(initial=0)).bit_length())
        words = np.zeros((len(values) * width + 63) // 64 + 1, "<u8")
        if len(values):
            store(words, np.arange(len(values)) * width, width, values)
        return cls(words, width, len(values))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return load(self.words, np.asarray(at, np.int64) * self.width, self.width)

    def __setitem__(self, at: np.ndarray, values: np.ndarray) -> None:
        store(self.words, np.asarray(at, np.int64) * self.width, self.width, np.asarray(values))

    def lower_bound(self, targets: np.ndarray) -> np.ndarray:
        """For each target the number of values below it; the values ascend.

        All targets halve their ranges in step, without branches: any number of values, not only powers of two.
        """
        targets = np.asarray(targets, np.uint64)
        base, size = np.zeros(len(targets), np.int64), self.n
        while size > 1:
            half = size >> 1
            base += half * (self[base + half - 1] < targets)
            size -= half
        return base + (self[base] < targets) if size else base


def _vectors(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all vectors of a binary array, and where in bits each begins and how many bytes it has."""
    data = data.cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = data.buffers()[2] if data.buffers()[2] is not None else b""
    words = words_of(memoryview(raw)[offsets[0] : offsets[-1]] if len(data) else b"")
    return words, 8 * (offsets[:-1] - offsets[0]), np.diff(offsets)


def _binaries(raw: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def _numbers(*columns: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows have a null, and the columns as longs with 0 for it."""
    null = np.logical_or.reduce([np.asarray(c.is_null()) for c in columns])
    return null, [np.asarray(c.fill_null(0).cast(pa.int64()), np.int64) for c in columns]


def _udf(kind: DataType) -> Callable:
    return F.arrow_udf(returnType=kind)


@_udf(LongType())
def _element(data: pa.Array, width: pa.Array, at: pa.Array) -> pa.Array:
    null, (w, i) = _numbers(width, at)
    words, begin, size = _vectors(data)
    null |= np.asarray(data.is_null()) | (i < 0) | (w < 1) | (w > 64) | ((i + 1) * w > 8 * size)
    ok = np.flatnonzero(~null)
    out = np.zeros(len(w), np.int64)
    out[ok] = load(words, begin[ok] + i[ok] * w[ok], w[ok]).view(np.int64)
    return pa.array(out, mask=null)


def element(data: Column, width: Column, at: Column) -> Column:
    """The value at place ``at`` (from 0) of a packed vector; null outside of its bytes."""
    return _element(data, width, at)


@_udf(BinaryType())
def _with_element(data: pa.Array, width: pa.Array, at: pa.Array, value: pa.Array) -> pa.Array:
    null, (w, i, v) = _numbers(width, at, value)
    words, begin, size = _vectors(data)
    none = np.asarray(data.is_null())
    ok = np.flatnonzero(~(null | none | (i < 0) | (w < 1) | (w > 64) | ((i + 1) * w > 8 * size)))
    store(words, begin[ok] + i[ok] * w[ok], w[ok], v[ok].view(np.uint64))
    return _binaries(words.view(np.uint8)[: int(size.sum())], size, none)


def with_element(data: Column, width: Column, at: Column, value: Column) -> Column:
    """The packed vector with ``value`` (its lowest ``width`` bits) at place ``at``; unchanged outside of its bytes."""
    return _with_element(data, width, at, value)


@_udf(BinaryType())
def _resized(data: pa.Array, width: pa.Array, n: pa.Array) -> pa.Array:
    null, (w, m) = _numbers(width, n)
    null |= np.asarray(data.is_null())
    words, begin, size = _vectors(data)
    bits = np.where(null, 0, np.maximum(m, 0) * w)
    new = (bits + 7) // 8
    kept = np.minimum(size, new)
    ends = np.cumsum(new)
    out = np.zeros(int(new.sum()), np.uint8)
    step = np.arange(int(kept.sum())) - np.repeat(np.cumsum(kept) - kept, kept)
    out[np.repeat(ends - new, kept) + step] = words.view(np.uint8)[np.repeat(begin // 8, kept) + step]
    cut = np.flatnonzero((bits & 7 > 0) & (kept == new))
    out[ends[cut] - 1] &= (np.uint8(0xFF) >> (8 - (bits[cut] & 7)).astype(np.uint8))
    return _binaries(out, new, null)


def resize(data: Column, width: Column, n: Column) -> Column:
    """The first ``n`` values of a packed vector, still packed; zeros follow where it has fewer."""
    return _resized(data, width, n)


@_udf(BinaryType())
def _sorted(data: pa.Array, width: pa.Array, n: pa.Array) -> pa.Array:
    null, (w, m) = _numbers(width, n)
    words, begin, size = _vectors(data)
    none = np.asarray(data.is_null())
    m = np.where(null | none | (w < 1), 0, np.minimum(m, 8 * size // np.maximum(w, 1)))
    row = np.repeat(np.arange(len(m)), m)
    bit = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)) * w[row]
    values = load(words, bit, w[row])
    store(words, bit, w[row], values[np.lexsort([values, row])])
    return _binaries(words.view(np.uint8)[: int(size.sum())], size, none)


def sort_packed(data: Column, width: Column, n: Column) -> Column:
    """The packed vector with its first ``n`` values in ascending order (unsigned)."""
    return _sorted(data, width, n)


@_udf(LongType())
def _lower_bound(data: pa.Array, width: pa.Array, n: pa.Array, target: pa.Array) -> pa.Array:
    null, (w, m, t) = _numbers(width, n, target)
    words, begin, _ = _vectors(data)
    null |= np.asarray(data.is_null())
    size, base, t = np.where(null, 0, m), np.zeros(len(m), np.int64), t.view(np.uint64)
    while (live := np.flatnonzero(size > 1)).size:
        half = size[live] >> 1
        at = base[live] + half
        base[live] = np.where(load(words, begin[live] + (at - 1) * w[live], w[live]) < t[live], at, base[live])
        size[live] -= half
    live = np.flatnonzero(size == 1)
    base[live] += load(words, begin[live] + base[live] * w[live], w[live]) < t[live]
    return pa.array(base, mask=null)


def lower_bound(data: Column, width: Column, n: Column, target: Column) -> Column:
    """The number of values below ``target`` in a packed ascending vector; all rows of a batch halve in step."""
    return _lower_bound(data, width, n, target)

