"""Arrow UDFs for what SQL can't say in wrapping arithmetic or in bytes: hashes and packed integer vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

# Multipliers of the 32-bit and 64-bit mixes, and their inverses modulo 2^32 and 2^64.
MIX_32 = (0x2C1B3C6D, 0x297A2D39)
UNMIX_32 = (0x0CF0B109, 0x64EA2D65)
MIX_64 = (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93)
UNMIX_64 = (0xCFEE444D8B59A89B, 0xCFEE444D8B59A89B)


def _mix(x: np.ndarray, half: int, factors: tuple[int, int]) -> np.ndarray:
    kind = x.dtype.type
    for f in factors:
        x = ((x >> kind(half)) ^ x) * kind(f)
    return (x >> kind(half)) ^ x


def _mixer(bits: int, factors: tuple[int, int]):
    wide, signed = (np.uint32, np.int32) if bits == 32 else (np.uint64, np.int64)

    @F.pandas_udf(LongType())
    def mix(x: pd.Series) -> pd.Series:
        low = x.to_numpy(dtype=np.int64).view(np.uint64).astype(wide)
        return pd.Series(_mix(low, bits // 2, factors).view(signed).astype(np.int64))

    return mix


def hash32(x: Column) -> Column:
    """A reversible hash of the low 32 bits, as a signed 32-bit number."""
    return _mixer(32, MIX_32)(x)


def unhash32(x: Column) -> Column:
    return _mixer(32, UNMIX_32)(x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def hash64(x: Column) -> Column:
    """A reversible hash of a long, as a signed 64-bit number."""
    return _mixer(64, MIX_64)(x)


def unhash64(x: Column) -> Column:
    return _mixer(64, UNMIX_64)(x)


def pack_ints(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits one after the other, lowest bits first."""
    if not len(values):
        return b""
    v = values.astype(np.uint64)
    v &= np.uint64((1 << width) - 1)
    at = np.arange(len(v), dtype=np.int64) * width
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    words = np.zeros((len(v) * width >> 6) + 2, np.uint64)
    np.bitwise_or.at(words, word, v << bit)
    over = bit + np.uint64(width) > 64
    np.bitwise_or.at(words, word[over] + 1, v[over] >> (np.uint64(64) - bit[over]))
    return words.astype("<u8").tobytes()[: (len(v) * width + 7) // 8]


def unpack_ints(data: bytes, width: int, n: int) -> np.ndarray:
    words = np.frombuffer(bytes(data).ljust((len(data) + 7) // 8 * 8 + 8, b"\0"), "<u8")
    at = np.arange(n, dtype=np.int64) * width
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    out = words[word] >> bit
    over = bit + np.uint64(width) > 64
    out[over] |= words[word[over] + 1] << (np.uint64(64) - bit[over])
    return (out & np.uint64((1 << width) - 1)).astype(np.int64)


@F.pandas_udf(BinaryType())
def pack(values: pd.Series, width: pd.Series) -> pd.Series:
    """Arrays of non-negative longs to packed bytes."""
    return pd.Series([None if v is None else pack_ints(np.asarray(v), int(w)) for v, w in zip(values, width, strict=True)])


@F.pandas_udf(ArrayType(LongType()))
def unpack(data: pd.Series, width: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else unpack_ints(d, int(w), int(m)) for d, w, m in zip(data, width, n, strict=True)])


@F.pandas_udf(LongType())
def lower_bound(ordered: pd.Series, target: pd.Series) -> pd.Series:
    """The first place in a sorted array whose value isn't below the target."""
    return pd.Series([None if a is None else int(np.searchsorted(np.asarray(a), t)) for a, t in zip(ordered, target, strict=True)])


def words_required(n: Column, width: Column, word_bits: int = 64) -> Column:
    """Words for n packed integers, with slack so that a whole word can be loaded at any of them."""
    return F.when(n > 0, F.floor(((n - 1) * width + (2 * word_bits - 8)) / word_bits)).otherwise(0).cast("long")


def resized(values: Column, n: Column) -> Column:
    """The first n values; zeros follow where there are fewer."""
    n = n.cast("int")
    return F.concat(F.slice(values, F.lit(1), n), F.array_repeat(F.lit(0).cast("long"), F.greatest(n - F.size(values), F.lit(0))))


@F.pandas_udf(BinaryType())
def pack_with_header(values: pd.Series, width: pd.Series) -> pd.Series:
    """Packed values after a 64-bit header (size << 8 | width), in whole words with the slack of ``words_required``."""
    out = []
    for v, w in zip(values, width, strict=True):
        if v is None:
            out.append(None)
            continue
        n, w = len(v), int(w)
        words = ((n - 1) * w + 120) // 64 if n else 0
        out.append((n << 8 | w).to_bytes(8, "little") + pack_ints(np.asarray(v), w).ljust(8 * words, b"\0"))
    return pd.Series(out)


@F.pandas_udf(ArrayType(LongType()))
def unpack_with_header(data: pd.Series) -> pd.Series:
    def one(d: bytes | None) -> np.ndarray | None:
        head = int.from_bytes(d[:8], "little") if d is not None else 0
        return None if d is None else unpack_ints(d[8:], head & 255, head >> 8)

    return pd.Series([one(d) for d in data])
