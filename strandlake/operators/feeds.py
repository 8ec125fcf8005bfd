"""Sequences that arrive in chunks: k-mers continue across chunk edges, without joining a sequence anywhere.

A chunk needs only the last k - 1 characters before it and their place. They come from a slim table with one row per
chunk (length and tail), so the chunks themselves are never brought together: a chromosome is as many tasks as chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.kmers import _check, _scan
from strandlake.operators.ordering import running_totals
from strandlake.scratch import stored
from strandlake.sources import fastx

#: Splits (one slim row each) that are broadcast to the pieces; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def _tail(c: str, k: int):
    return F.right(F.col(c), F.lit(max(k - 1, 0)))


def _carry(tail: str, k: int, w, held):
    """The last k - 1 characters of the chunks before, of which there are ``held``; each chunk has one character at least."""
    before = [F.coalesce(F.lag(tail, j).over(w), F.lit("")) for j in range(k - 1, 0, -1)]
    return F.right(F.concat(*before), F.least(F.lit(k - 1).cast("long"), held).cast("int")) if before else F.lit("")


def carried(chunks: DataFrame, k: int, id_col: str = "seq_id", part_col: str = "part", seq_col: str = "sequence") -> DataFrame:
    """``chunks`` with start (characters of the sequence before the chunk) and carry (the last k - 1 of them).

    ``part_col`` orders the chunks of a sequence and is unique in it. Null and empty chunks go.
    """
    full = chunks.filter(F.length(seq_col) > 0)
    w = Window.partitionBy("__i").orderBy("__p")
    slim = full.select(F.col(id_col).alias("__i"), F.col(part_col).alias("__p"), F.length(seq_col).cast("long").alias("__n"), _tail(seq_col, k).alias("__t"))
    start = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = slim.withColumn("start", start).withColumn("carry", _carry("__t", k, w, F.col("start"))).drop("__n", "__t")
    return full.join(edges, (F.col(id_col) == F.col("__i")) & (F.col(part_col) == F.col("__p"))).drop("__i", "__p")


def fed_kmers(chunks: DataFrame, k: int, keys: list[str], seq_col: str = "sequence") -> DataFrame:
    """One row per k-mer of valid bases that ends in a chunk with start and carry: ``keys``, pos (from 0 in its sequence), code."""
    _check(k)
    schema = chunks.select(*keys, F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("code")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, (start, carry, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("start", "carry", seq_col)), strict=True)):
                for _, at, code in _scan((carry or "") + text, k):
                    if len(at):
                        mine = pa.array(np.full(len(at), r))
                        pos = pa.array(at + (start - len(carry or "")))
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(mine) for c in keys), pos, pa.array(code)], [*keys, "pos", "code"])

    return chunks.select(*keys, "start", "carry", seq_col).mapInArrow(run, schema)


def fed_totals(chunks: DataFrame, k: int, keep: list[str], seq_col: str = "sequence") -> DataFrame:
    """What the k-mers of ``fed_kmers`` add up to: the columns ``keep`` of a chunk, n, first, last, total (of pos), codes (their sum).

    A row for each chunk, also without a k-mer (n is 0, first and last are null), and more of a very long one: rows of
    k-mers don't leave the worker. k is 21 at most, so that a slice's codes add up in a long.
    """
    if not 1 <= k <= 21:
        raise ValueError("k must be 1 to 21")
    names = ["n", "first", "last", "total", "codes"]
    schema = chunks.select(*keep, *[F.lit(None).cast("long").alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows = [], []
            for r, (start, carry, text) in enumerate(zip(*(b.column(c) for c in ("start", "carry", seq_col)), strict=True)):
                carry = carry.as_py() or ""
                before = start.as_py() - len(carry)
                found = [(len(at), int(at[0]) + before, int(at[-1]) + before, int(at.sum()) + before * len(at), int(code.sum())) for _, at, code in _scan(carry + (text.as_py() or ""), k) if len(at)]
                found = found or [(0, None, None, 0, 0)]
                of += [r] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            mine = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(mine) for c in keep), *(pa.array(c, pa.int64()) for c in columns)], [*keep, *names])

    return chunks.select(*dict.fromkeys([*keep, "start", "carry", seq_col])).mapInArrow(run, schema)


def chunked_kmers(chunks: DataFrame, k: int, id_col: str = "seq_id", part_col: str = "part", seq_col: str = "sequence") -> DataFrame:
    """(id, pos, code) of the k-mers of sequences that come in chunks, also of those across chunks."""
    return fed_kmers(carried(chunks, k, id_col, part_col, seq_col), k, [id_col], seq_col)


def stitched(spark: SparkSession, path: str, k: int, split_bytes: int = fastx.SPLIT_BYTES) -> DataFrame:
    """The pieces of FASTA files in byte ranges of any size, ready for ``fed_kmers``.

    Columns: path, record (the byte place of the record's header; null before the first one of a file), header (null on
    pieces after a record's first), split, row (its place in the split), start, carry, sequence, and file_start (bases
    of all files and splits before this piece, whatever record they are of; files in the order of their paths). A record
    may lie in any number of splits. The files are read twice: first for one row per split, then for the bases.
    """
    fastx.register(spark)
    pieces = spark.read.format("fastx").option("format", "fasta").option("layout", "pieces").option("split_bytes", str(split_bytes)).load(path)
    slim = pieces.select("path", "split", "last", "record", "header_open", "rest_ended", *[F.length(c).cast("long").alias(f"n_{c}") for c in ("rest", "sequence")], *[_tail(c, k).alias(f"t_{c}") for c in ("rest", "sequence")])
    # a split is one row: its last piece (which the next split goes on with), its rest, and its bases
    headless = lambda c: F.max(F.when(F.col("record").isNull(), F.col(c)))
    last = lambda c: F.max(F.when(F.col("last"), F.col(c)))
    splits = slim.groupBy("path", "split").agg(headless("n_rest").alias("n_rest"), headless("t_rest").alias("t_rest"), last("record").alias("record"), last("header_open").alias("header_open"), last("n_sequence").alias("n"), last("t_sequence").alias("t"), F.sum("n_sequence").alias("bases"))
    splits = stored(splits, "fasta-splits")
    w = Window.partitionBy("path").orderBy("split")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # the rest of a line that began in an earlier split belongs to a header, which its own split has read on to its end
    in_header = F.coalesce(F.last("header_open", ignorenulls=True).over(before), F.lit(False))
    rows = splits.withColumn("in_header", in_header)
    kept = F.when(F.col("in_header"), 0).otherwise(F.coalesce("n_rest", F.lit(0)))
    own = F.when(F.col("record").isNull(), kept).otherwise(0) + F.coalesce("n", F.lit(0))
    tail = F.right(F.concat(F.when(F.col("record").isNull() & ~F.col("in_header"), F.coalesce("t_rest", F.lit(""))).otherwise(""), F.coalesce("t", F.lit(""))), F.lit(max(k - 1, 0)))
    rows = rows.withColumns({"kept": kept, "own": own, "tail": tail, "all": kept + F.col("bases")})
    total = F.coalesce(F.sum("own").over(before), F.lit(0))
    rows = rows.withColumn("total", total)
    since = F.coalesce(F.last(F.when(F.col("record").isNotNull(), F.col("total")), ignorenulls=True).over(before), F.lit(0))
    rows = rows.withColumns({"of": F.last("record", ignorenulls=True).over(before), "from": F.col("total") - since})
    # splits without bases would be steps of a lag that carry nothing: tails add up over the others
    some = Window.partitionBy("path").orderBy("split")
    steps = [F.coalesce(F.lag("tail", j).over(some), F.lit("")) for j in range(k - 2, 0, -1)]
    upto = rows.filter("own > 0 OR record IS NOT NULL").select("path", "split", F.right(F.concat(*steps, F.col("tail")), F.lit(max(k - 1, 0))).alias("upto"))
    rows = rows.join(upto, ["path", "split"], "left").withColumn("carry", F.coalesce(F.last("upto", ignorenulls=True).over(before), F.lit("")))
    rows = running_totals(rows, "all", "path", "split", name="file_start")
    edges = rows.select("path", "split", "of", "from", "in_header", "kept", F.right("carry", F.least(F.lit(k - 1).cast("long"), F.col("from")).cast("int")).alias("carry"), F.col("file_start").alias("__at"))
    edges = stored(edges, "fasta-edges")
    met = pieces.join(F.broadcast(edges) if edges.count() <= MOST_BROADCAST else edges, ["path", "split"])
    first = F.col("record").isNull()
    text = F.concat(F.when(F.col("in_header"), "").otherwise(F.coalesce("rest", F.lit(""))), F.col("sequence"))
    return met.select("path", F.coalesce("record", F.when(first, F.col("of"))).alias("record"), "header", "split", "row", F.when(first, F.col("from")).otherwise(0).alias("start"), F.when(first, F.col("carry")).otherwise("").alias("carry"), F.when(first, text).otherwise(F.col("sequence")).alias("sequence"), (F.col("__at") + F.when(first, 0).otherwise(F.col("kept")) + F.col("before")).alias("file_start"))
