"""Helpers that the operators share: the shared folder, written tables, packed arrays, bounded slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at a time; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows that Spark hands to a Python worker at a time, where the session has its default of 10,000: texts are wide rows.
BATCH_ROWS = 1_500

#: Bits of a key map for each key (of other rows one in about as many passes it by chance), and in all: 32 MB.
KEY_BITS, MOST_KEY_BITS = 16, 1 << 28

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests on one machine), a folder of our own is set once."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.strandlake.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
            spark.conf.set("spark.strandlake.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and lost executors lose nothing of it.

    ``batch_rows`` bounds the rows that a Python worker gets at a time while this table is made, for wide rows.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    usual = conf.get(_BATCH)
    try:
        if batch_rows:
            conf.set(_BATCH, str(batch_rows))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_BATCH, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made."""
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, top)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store; one that isn't there is fine."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs before the next large shuffle."""
    import gc
    import time

    for _ in range(2):  # Python lets go of its handles first, and the JVM hears of it a little later
        gc.collect()
        time.sleep(0.2)
        spark._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand fewer rows at a time to Python workers, unless the session says how many."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``: only sizes partitions, never changes a result.

    Where Catalyst knows nothing (rows of an RDD count as endless), the session's number of partitions decides.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) << 23


def maybe_among(df: DataFrame, keys: DataFrame, cols: list[str], flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false where ``cols`` are surely not among the rows of ``keys``, a written table.

    Only flagged rows need an exact join, so wide rows that match nothing are not shuffled. The keys' hashes set bits of a
    map that is broadcast, about two bytes a key and 32 MB at most; of more keys, more rows are flagged by chance.
    """
    at = F.pmod(F.xxhash64(*cols), F.lit(min(MOST_KEY_BITS, max(1, KEY_BITS * keys.count())))) + 1
    piece, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    pieces = keys.select(piece.alias("__piece"), bit.alias("__bit")).groupBy("__piece").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("__piece", piece).join(F.broadcast(pieces), "__piece", "left")
    return found.select(*df.columns, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias(flag))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_binary: bool = True) -> DataFrame:
    """The two columns that the operators read, whatever else ``df`` has; a null text is an empty one."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (text.cast("binary") if as_binary else text).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``size`` bytes of their column ``text``, so that memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()


def tidy() -> None:
    """Give memory that a task no longer needs back to the system; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def encode_array(a: np.ndarray) -> bytes:
    """Bytes of an integer array by planes, so that a codec finds the empty high ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def decode_array(b: memoryview, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(b, np.uint8, n * size).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as zstd bytes: the length, then the planes of each."""
    raw = b"".join([np.int64(len(arrays[0])).tobytes(), *(encode_array(np.ascontiguousarray(a)) for a in arrays)])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw).to_pybytes()


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = memoryview(pa.Codec("zstd").decompress(memoryview(blob)[8:], decompressed_size=size))
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for t in dtypes:
        out.append(decode_array(raw[at:], n, t))
        at += n * np.dtype(t).itemsize
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
