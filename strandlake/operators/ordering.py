"""Global order at scale: row numbers over a whole table, and sorted search over a whole column.

Neither has a task that sees all rows. Rows are dealt by ranges of their order and sorted there; what crosses ranges
is one row per range. A search packs the sorted values into blocks of bits; targets are routed to the block that can hold
their place, and all targets of a batch take each halving step of a block together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.packed import PackedInts, words_of
from strandlake.scratch import stored

#: Values of a packed block.
BLOCK_VALUES = 1 << 14
#: Ranges that targets are dealt over, at most: the driver holds one bound for each.
MOST_RANGES = 4_096
#: monotonically_increasing_id has the partition above this many bits, and the row in it below.
_ROW_BITS = 33


def _ranges(df: DataFrame, ranges: int | None) -> int:
    return ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: Column | str, name: str = "place", ranges: int | None = None) -> DataFrame:
    """``df`` with the row number (from 1) in the order of the columns ``order``, in two phases.

    Rows are dealt by ranges and sorted in them; ranges are counted, and the counts of the ranges before (one row each)
    are added to the place in the range. Ties are numbered in any order, so name columns that leave none: then also a
    key that most rows share is split over ranges. Nulls come where the order puts them.
    """
    dealt = df.repartitionByRange(_ranges(df, ranges), *order).sortWithinPartitions(*order)
    at = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", _ROW_BITS)
    counts = at.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return at.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + inside + 1).drop("__at", "__part", "__before")


def running_totals(df: DataFrame, value: str, *order: Column | str, name: str = "before", ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each one in the order of ``order``, in the same two phases.

    Name order columns that leave no ties; a null value counts as 0.
    """
    n = F.coalesce(F.col(value).cast("long"), F.lit(0))
    dealt = df.repartitionByRange(_ranges(df, ranges), *order).sortWithinPartitions(*order)
    at = stored(dealt.withColumn("__part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = at.groupBy("__part").agg(F.sum(n).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def sorted_blocks(values: DataFrame, col: str, ranges: int | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """The longs of a column in ascending order, packed: start (values before the block), after, n, low, width, data.

    ``after`` is the last value before the block (null for the first one), ``low`` the block's first value, from which its
    values are counted in ``width`` bits. Null values are left out. The table is written: build it once, search it often.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, done, last, held = TaskContext.get().partitionId(), 0, 0, None, np.zeros(0, np.int64)

        def block(v: np.ndarray) -> pa.RecordBatch:
            nonlocal seq, done, last
            p = PackedInts.of(v.view(np.uint64) - v[:1].view(np.uint64))
            row = [part, seq, done, last, len(v), int(v[0]), int(v[-1]), p.width, p.words.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            seq, done, last = seq + 1, done + len(v), int(v[-1])
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "seq", "inside", "after", "n", "low", "high", "width", "data"])

        for b in batches:
            held = np.concatenate([held, np.asarray(b.column(0), np.int64)])
            while len(held) >= block_values:
                yield block(held[:block_values])
                held = held[block_values:]
        if len(held):
            yield block(held)

    rows = values.select(F.col(col).cast("long").alias("v")).filter("v IS NOT NULL")
    dealt = rows.repartitionByRange(_ranges(values, ranges), "v").sortWithinPartitions("v")
    blocks = stored(dealt.mapInArrow(pack, "part int, seq int, inside long, after long, n long, low long, high long, width int, data binary"), "sorted-blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"), F.max("high").alias("high"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.max("high").over(before).alias("passed"))
    return blocks.join(F.broadcast(parts), "part").select((F.col("first") + F.col("inside")).alias("start"), F.coalesce("after", "passed").alias("after"), "n", "low", "width", "data")


def lower_bounds(blocks: DataFrame, targets: DataFrame, target: str, name: str = "place") -> DataFrame:
    """``targets`` with the number of values in ``blocks`` (see ``sorted_blocks``) below the column ``target``.

    Each distinct target travels once to the one block that can hold its place; blocks and targets are dealt by ranges
    of at most ``MOST_RANGES`` bounds, and a range is one ordered stream, of which a worker holds one block and one
    batch. A null target has no place. Targets that repeat are searched for once and joined back.
    """
    spark = targets.sparkSession
    asked = targets.select(F.col(target).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
    n = blocks.count()
    if not n:
        return targets.withColumn(name, F.when(F.col(target).isNotNull(), F.lit(0).cast("long")))
    parts = min(n, MOST_RANGES, 4 * _ranges(targets, None))
    bounds = sorted(set(blocks.filter("after IS NOT NULL").agg(F.percentile_approx("after", [k / parts for k in range(1, parts)], 100 * parts).alias("b")).first()["b"] or [])) if parts > 1 else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series, kind: pd.Series) -> pd.Series:
        # targets equal to a bound belong before it, the block after that bound behind it; the first block has no key
        k = key.fillna(-(2**63)).to_numpy(np.int64) if not key.hasnans else np.array([-(2**63) if pd.isna(x) else x for x in key], np.int64)
        return pd.Series(np.where(kind == 1, np.searchsorted(edges, k, side="right"), np.searchsorted(edges, k, side="left")).astype(np.int32))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, low, packed = 0, 0, PackedInts.of(np.zeros(0, np.uint64))
        for b in batches:
            kind = np.asarray(b.column("kind"))
            at = [*np.flatnonzero(kind == 1).tolist(), b.num_rows]
            for s, e in zip([-1, *at], at, strict=False):
                if s >= 0:
                    start, low, n, width = (b.column(c)[s].as_py() for c in ("start", "low", "n", "width"))
                    packed = PackedInts(words_of(b.column("data")[s].as_buffer()), width, n)
                if e > s + 1:
                    keys = np.asarray(b.column("key").slice(s + 1, e - s - 1), np.int64)
                    # keys up to the block's first value stand at its start
                    inside = np.where(keys > low, keys.view(np.uint64) - np.array([low], np.int64).view(np.uint64), np.uint64(0))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(start + packed.lower_bound(inside))], ["key", "found"])

    null = lambda kind: F.lit(None).cast(kind)
    left = blocks.select(F.col("after").alias("key"), F.lit(1).alias("kind"), "start", "low", "n", "width", "data")
    right = asked.select("key", F.lit(0).alias("kind"), null("long").alias("start"), null("long").alias("low"), null("long").alias("n"), null("int").alias("width"), null("binary").alias("data"))
    rows = left.unionByName(right)
    ordered = rows.withColumn("part", part_of("key", "kind")).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "kind", "start")
    found = ordered.mapInArrow(search, "key long, found long").withColumnRenamed("found", name)
    return targets.withColumn("__t", F.col(target).cast("long")).join(found.withColumnRenamed("key", "__t"), "__t", "left").drop("__t")
