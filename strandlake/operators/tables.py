"""Lookup tables addressed by the code of a k-mer, for k beyond what a broadcast holds.

A table of 4^k entries is cut into blocks of ``BLOCK`` codes. A block is a bitmap of the codes that have an entry, the
ones before each of its words, and the entries themselves, packed. Codes and blocks meet by range: neither is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.packed import PackedInts, words_of

#: log2 of the codes of a block.
BLOCK_BITS = 16
#: Rows of one block that a task looks up, about: blocks that more rows ask for are sent to several tasks.
TASK_ROWS = 2_000_000

_KIND = "block long, bitmap binary, width int, n int, data binary"


def direct_table(entries: DataFrame, code: str = "code", value: str = "rank") -> DataFrame:
    """Packed blocks of the entries (code, a non-negative value); the largest of several values of a code counts."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, v = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("at", "v"))
        order = np.lexsort([v, at])
        at, v = at[order], v[order]
        last = np.append(at[1:] != at[:-1], True)
        bits = np.zeros(1 << BLOCK_BITS, bool)
        bits[at] = True
        p = PackedInts.of(v[last])
        row = [key[0].as_py(), np.packbits(bits, bitorder="little").tobytes(), p.width, p.n, p.words.tobytes()]
        return pa.table({name: pa.array([x], k) for name, x, k in zip(("block", "bitmap", "width", "n", "data"), row, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)})

    rows = entries.filter(F.col(code).isNotNull() & F.col(value).isNotNull()).select(F.shiftright(F.col(code).cast("long"), BLOCK_BITS).alias("block"), F.col(code).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).alias("at"), F.col(value).cast("long").alias("v"))
    return rows.groupBy("block").applyInArrow(pack, _KIND)


def looked_up(rows: DataFrame, table: DataFrame, code: str = "code", name: str = "rank", task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` with the entry of their code in ``table`` (see ``direct_table``), null where there is none.

    Rows and blocks are dealt by block; a block that many rows ask for, such as that of a very frequent k-mer, goes to
    several tasks, each with a share of its rows. A task holds one block at a time.
    """
    columns = rows.columns
    asked = rows.withColumns({"__block": F.coalesce(F.shiftright(F.col(code).cast("long"), BLOCK_BITS), F.lit(-1)), "__row": F.monotonically_increasing_id()})
    tasks = asked.groupBy("__block").agg(F.ceil(F.count("*") / F.lit(task_rows)).cast("int").alias("__tasks"))  # one row per block
    null = lambda c: F.lit(None).cast(dict(rows.dtypes)[c]).alias(c)
    parts = ("bitmap", "width", "n", "data")
    blocks = table.join(tasks, F.col("block") == F.col("__block")).select("__block", F.explode(F.sequence(F.lit(0), F.col("__tasks") - 1)).alias("__task"), F.lit(0).alias("__kind"), *[F.col(c).alias(f"__{c}") for c in parts], *[null(c) for c in columns])
    none = dict(zip(parts, ("binary", "int", "int", "binary"), strict=True))
    mine = asked.join(tasks, "__block").select("__block", (F.col("__row") % F.col("__tasks")).cast("int").alias("__task"), F.lit(1).alias("__kind"), *[F.lit(None).cast(k).alias(f"__{c}") for c, k in none.items()], *[F.col(f"`{c}`") for c in columns])
    met = blocks.unionByName(mine).repartition("__block", "__task").sortWithinPartitions("__block", "__task", "__kind")
    schema = rows.withColumn(name, F.lit(None).cast("long")).schema

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            kind, block = np.asarray(b.column("__kind")), np.asarray(b.column("__block"))
            cuts = np.flatnonzero(np.append(True, (kind[1:] == 0) | (kind[:-1] == 0) | (block[1:] != block[:-1]))).tolist()
            for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if kind[s] == 0:
                    bits = np.frombuffer(b.column("__bitmap")[s].as_buffer(), "<u8")
                    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
                    packed = PackedInts(words_of(b.column("__data")[s].as_buffer()), b.column("__width")[s].as_py(), b.column("__n")[s].as_py())
                    at = block[s]
                    continue
                part = b.slice(s, e - s)
                found, there = np.zeros(e - s, np.int64), np.zeros(e - s, bool)
                if at == block[s]:
                    c = np.asarray(part.column(code).cast(pa.int64()), np.int64) & ((1 << BLOCK_BITS) - 1)
                    word, bit = c >> 6, (c & 63).astype(np.uint64)
                    there = (bits[word] >> bit & np.uint64(1)) > 0
                    place = before[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
                    found[there] = packed[place[there]].view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(found, mask=~there)], [*columns, name])

    return met.mapInArrow(look, schema)
