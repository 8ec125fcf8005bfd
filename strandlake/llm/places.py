"""Row keys and packed places: what the operators on repeated strings share.

A row's key is (a, h): its doc_id (a hash of its text where there is none) and the hash of its text. Rows that share a
doc_id and differ in text are rows apart, and rows of one key are equal, so they get equal results. Places are packed as
numbers in a small table of the keys that a worker saw.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import mix64, pack, small_batches, unpack


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), names: tuple[str, ...] = ("doc_id", "a", "h", "text")) -> DataFrame:
    """doc_id, a, h and text (binary; null: empty) of every row, the same whenever they are read, and the columns ``keep``."""
    small_batches(df.sparkSession)
    doc, a, h, text = names
    binary = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    doc_id = F.col(id_col).cast("long")
    key = F.coalesce(doc_id, F.xxhash64(F.lit("no id"), binary))
    return df.select(doc_id.alias(doc), key.alias(a), F.xxhash64(binary).alias(h), binary.alias(text), *[F.col(f"`{c}`") for c in keep])


class Keys:
    """Numbers for the row keys that a worker sees."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, int], int] = {}

    def number(self, a: int, h: int) -> int:
        return self.numbers.setdefault((a, h), len(self.numbers))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(list(self.numbers), np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def numbered(a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each key among the distinct ones, and those."""
    order = np.lexsort([h, a])
    x, y = a[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return at, x[new], y[new]


def key_part(a: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The part of ``n`` that collects what concerns a row."""
    return (mix64(a.view(np.uint64) ^ mix64(h.view(np.uint64))) % np.uint64(n)).astype(np.int64)


def hash_bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted hashes are sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def joined(*parts: bytes) -> bytes:
    """Byte strings as one zstd string that ``parted`` takes apart."""
    raw = b"".join(parts)
    head = np.array([len(parts), len(raw), *map(len, parts)], np.int64).tobytes()
    return head + pa.Codec("zstd", 1).compress(raw).to_pybytes()


def parted(blob: bytes) -> list[bytes]:
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    sizes = np.frombuffer(blob, np.int64, n, 16).tolist()
    raw = pa.Codec("zstd").decompress(memoryview(blob)[16 + 8 * n :], decompressed_size=size).to_pybytes()
    ends = np.cumsum(sizes).tolist()
    return [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def pack_places(number: np.ndarray, a: np.ndarray, h: np.ndarray, *more: np.ndarray) -> bytes:
    """Places (numbers of keys in the tables ``a`` and ``h``, and arrays of their own) with the keys that they use."""
    used, at = np.unique(number, return_inverse=True)
    at = at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
    table = pack(a[used], h[used])
    return np.array([len(table), at.itemsize], np.int64).tobytes() + table + pack(at, *more)


def unpack_places(blob: bytes, *kinds) -> list[np.ndarray]:
    """a, h and the arrays of packed places."""
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    a, h = unpack(memoryview(blob)[16 : 16 + n], np.int64, np.int64)
    at, *rest = unpack(memoryview(blob)[16 + n :], np.uint16 if size == 2 else np.uint32, *kinds)
    return [a[at], h[at], *rest]


def runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal values."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return list(zip(cut, [*cut[1:], len(x)], strict=True))


def by_part(number: np.ndarray, a: np.ndarray, h: np.ndarray, parts: int, *more: np.ndarray) -> list[tuple[int, bytes]]:
    """Places packed by the part of their rows."""
    if not len(number):
        return []
    part = key_part(a, h, parts)[number]
    order = np.argsort(part, kind="stable")
    part = part[order]
    return [(int(part[x]), pack_places(number[order[x:y]], a, h, *(m[order[x:y]] for m in more))) for x, y in runs_of(part)]


def collected(rows: DataFrame, kinds: tuple, name: str) -> DataFrame:
    """Packed places (part, data) to one row per key (a, h, ``name``): its distinct places, sorted."""

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [unpack_places(d, *kinds) for d in table.column("data").to_pylist()]
        cols = [np.concatenate(x) for x in zip(*got, strict=True)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)  # equal rows have equal places
        a, h, *more = (c[new] for c in cols)
        cut = runs_of(np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (h[1:] != h[:-1])])))
        first = [x for x, _ in cut]
        return pa.table({"a": pa.array(a[first]), "h": pa.array(h[first]), name: pa.array([pack(*(m[x:y] for m in more)) for x, y in cut], pa.binary())})

    return rows.groupBy("part").applyInArrow(join, f"a long, h long, {name} binary")
