"""Vectors in blocks, and parts of queries that travel to them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block and queries of a part at 64 dimensions (fewer at more), and parts that one block is built for.
BLOCK_ROWS, PARTS = 16_384, 32


def sound_vector(embedding: str = "embedding") -> tuple:
    """The vector as doubles, and whether it is one: not null, without null or non-finite components."""
    v = F.col(embedding).cast("array<double>")
    return v, F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def shares(df: DataFrame, rows: int, v: str = "v") -> int:
    """How many blocks of ``rows`` vectors of 64 dimensions ``df`` makes; longer vectors count for more."""
    total = df.agg(F.coalesce(F.sum(F.greatest(F.size(v), F.lit(64))), F.lit(0)).alias("n")).first()["n"] / 64
    return max(1, math.ceil(total / rows))


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def in_blocks(rows: DataFrame, n: int, by: str) -> DataFrame:
    """``rows`` in ``n`` blocks, dealt by a hash of the column ``by``: block and the block's rows as bytes."""

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([_blob(table.drop_columns(["block"]))], pa.binary())})

    keyed = rows.withColumn("block", F.pmod(F.xxhash64(by), F.lit(n)).cast("long"))
    return keyed.groupBy("block").applyInArrow(one, "block long, data binary")


def vectors_by_size(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions the places of its rows, and their vectors."""
    v = table.column("v").combine_chunks()
    sizes, flat = np.asarray(v.value_lengths(), np.int64), np.asarray(v.flatten(), np.float64)
    starts, out = np.cumsum(sizes) - sizes, {}
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        out[dim] = at, flat[starts[at][:, None] + np.arange(dim)]
    return out


def meet(blocks: DataFrame, n_blocks: int, parts: DataFrame, n_parts: int, build: Callable[[pa.Table], object], ask: Callable[[object, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``ask`` makes of each part of queries and what ``build`` made of a block, for all blocks and all parts.

    A partition is one block and a lane of parts, the block first: it is built once for up to ``PARTS`` parts. There are
    more lanes only where blocks alone would leave cores idle.
    """
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    lanes = min(n_parts, max(math.ceil(n_parts / PARTS), math.ceil(cores / n_blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.select("block", each(lanes).alias("lane"), F.lit(-1).cast("long").alias("part"), "data")
    right = parts.select(each(n_blocks).alias("to"), (F.col("block") % lanes).alias("lane"), F.col("block").alias("part"), "data").withColumnRenamed("to", "block")
    met = left.unionByName(right).repartitionById(n_blocks * lanes, (F.col("block") * lanes + F.col("lane")).cast("int")).sortWithinPartitions("block", "lane", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, built = None, None
        for b in batches:
            for block, part, data in zip(b.column("block").to_pylist(), b.column("part").to_pylist(), b.column("data"), strict=True):
                table = pa.ipc.open_stream(data.as_buffer()).read_all()
                if part < 0:
                    at, built = block, build(table)
                elif at == block:  # a hash may leave a block without vectors
                    yield from ask(built, table)

    return met.mapInArrow(run, schema)
