"""Sequences in two bits a base, with what doesn't fit beside them, and k-mers from the packed words themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.packed import PackedInts, load, words_of
from strandlake.operators.kmers import SLICE, _batches, _check

_KIND = "n long, data binary, places array<long>, lengths array<int>, letters string"
_CODE = np.full(128, 255, np.uint8)
_CODE[[ord(c) for c in "ACTG"]] = range(4)
_LETTER = np.array([ord(c) for c in "ACTG"], np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Characters whose packed rows or texts a worker holds at a time, about.
CHARS = 1 << 20


def _packed(text: str) -> tuple[int, bytes, np.ndarray, np.ndarray, str]:
    c = _points(text)
    code = np.where(c < 128, _CODE[np.minimum(c, 127)], 255).astype(np.uint8)
    odd = np.append(code == 255, False)
    edges = np.flatnonzero(np.diff(odd, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    code[odd[:-1]] = 0
    fours = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    data = (fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6).astype(np.uint8).tobytes()
    return len(c), data, starts, (ends - starts).astype(np.int32), c[odd[:-1]].tobytes().decode("utf-32-le", "surrogatepass")


def pack_text(text: str) -> tuple[int, bytes, list[int], list[int], str]:
    """Length, 2-bit bases (base i at bits 2i), and the stretches of other letters: where, how long, and which."""
    n, data, starts, lengths, letters = _packed(text)
    return n, data, starts.tolist(), lengths.tolist(), letters


def _lists(arrays: tuple[np.ndarray, ...]) -> pa.Array:
    """Arrays as a column of lists, without an object per number."""
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays)))


def _parts(b: pa.RecordBatch, id_col: str) -> Iterator[tuple]:
    """The packed rows of a batch one after the other: id, n, data, starts, lengths, letters."""
    for i, n, data, starts, lengths, letters in zip(*(b.column(c) for c in (id_col, "n", "data", "places", "lengths", "letters")), strict=True):
        yield i.as_py(), n.as_py(), data.as_py(), starts.values.to_numpy(), lengths.values.to_numpy(), letters.as_py()


def _places(starts: list[int] | np.ndarray, lengths: list[int] | np.ndarray) -> np.ndarray:
    n = np.array(lengths, np.int64)
    return np.repeat(np.array(starts, np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def unpack_text(n: int, data: bytes, starts: list[int], lengths: list[int], letters: str) -> str:
    """The text that ``pack_text`` packed."""
    b = np.frombuffer(data, np.uint8)
    c = _LETTER[np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).ravel()[:n]]
    c[_places(starts, lengths)] = _points(letters)
    return c.tobytes().decode("utf-32-le", "surrogatepass")


def pack_sequences(seqs: DataFrame, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """(id, n, data, places, lengths, letters): A, C, T and G in two bits each, all other letters (lower case too) as
    stretches beside them, so nothing is lost. A null sequence is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, chars, done = [], 0, 0
            for r, text in enumerate(b.column(1), 1):
                rows.append(_packed(text.as_py()))
                chars += rows[-1][0]
                if chars >= CHARS or r == b.num_rows:
                    n, data, starts, lengths, letters = zip(*rows, strict=True)
                    columns = [pa.array(n, pa.int64()), pa.array(data, pa.binary()), _lists(starts), _lists(lengths), pa.array(letters, pa.string())]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, r - done), *columns], [id_col, "n", "data", "places", "lengths", "letters"])
                    rows, chars, done = [], 0, r

    return seqs.filter(F.col(seq_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), seq_col).mapInArrow(run, f"`{id_col}` long, {_KIND}")


def unpack_sequences(packed: DataFrame, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """(id, sequence) as they were before ``pack_sequences``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, chars, done = [], 0, 0
            for r, (_, *row) in enumerate(_parts(b, id_col), 1):
                texts.append(unpack_text(*row))
                chars += row[0]
                if chars >= CHARS or r == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, r - done), pa.array(texts, pa.string())], [id_col, seq_col])
                    texts, chars, done = [], 0, r

    return packed.select(id_col, "n", "data", "places", "lengths", "letters").mapInArrow(run, f"`{id_col}` long, `{seq_col}` string")


def _first_base_highest(x: np.ndarray, k: int) -> np.ndarray:
    """Codes with the first base in the highest bits, of k bases that are loaded with the first one in the lowest."""
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> np.uint64(shift)) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(shift)
    return (x.byteswap() >> np.uint64(64 - 2 * k)).view(np.int64)


def packed_kmers(packed: DataFrame, k: int, id_col: str = "seq_id") -> DataFrame:
    """(id, pos, code) of the k-mers of valid bases (either case), loaded from the packed words; k is 31 at most."""
    _check(k)

    def scan(n: int, data: bytes, starts: list[int], lengths: list[int], letters: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, at, odd = words_of(data), _places(starts, lengths), _points(letters)
        code = np.full(128, 255, np.uint8)
        code[[ord(c) for c in "actg"]] = range(4)
        own = np.where(odd < 128, code[np.minimum(odd, 127)], 255).astype(np.uint8)
        PackedInts(words, 2, n)[at[own < 255]] = own[own < 255]  # lower-case bases are bases
        bad = at[own == 255]
        for s in range(0, n - k + 1, SLICE):
            e = min(s + SLICE, n - k + 1)
            wrong = np.zeros(e - s + k, np.int32)
            wrong[bad[(bad >= s) & (bad < e + k - 1)] - s + 1] = 1
            wrong = np.cumsum(wrong)
            pos = s + np.flatnonzero(wrong[k:] == wrong[: e - s])
            yield pos, _first_base_highest(load(words, 2 * pos, 2 * k), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(["pos", "code"], ((i, found) for b in batches for i, *row in _parts(b, id_col) for found in scan(*row)), id_col)

    return packed.select(id_col, "n", "data", "places", "lengths", "letters").mapInArrow(run, f"`{id_col}` long, pos long, code long")
