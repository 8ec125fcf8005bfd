"""Streams (an extension): FASTA files that arrive in a folder, and sequences whose chunks arrive one after the other."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandlake.operators.kmers import _scan, kmers


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """header and sequence of the records of new files."""
    rows = spark.readStream.option("lineSep", "\n>").text(folder).select(F.regexp_replace("value", "^>", "").alias("r"))
    return rows.select(F.regexp_extract("r", "^([^\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace("r", "^[^\n]*\n?", ""), "[\r\n]", "").alias("sequence"))


def stream_counts(seqs: DataFrame, k: int) -> DataFrame:
    """Running counts by code; the state holds every k-mer seen (4^k at most), and no watermark applies."""
    return kmers(seqs.withColumn("seq_id", F.xxhash64("header")), k).groupBy("code").agg(F.count("*").alias("count"))


class _Feed(StatefulProcessor):
    """The state of a sequence that arrives in chunks: its last k - 1 characters, its place, and chunks before their turn.

    A chunk whose turn it is never enters the state, and waiting chunks are counted, so nothing is looked up in vain.
    """

    def __init__(self, k: int, first_part: int = 0):
        self.k, self.first_part = k, first_part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.feed = handle.getValueState("feed", "carry string, pos long, part long, held long")
        self.waiting = handle.getMapState("waiting", "part long", "sequence string")

    def fed(self, batches: Iterable[Iterable[tuple[int, str | None]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and codes of the k-mers that end in chunks (part, text) which are complete up to their turn."""
        carry, pos, part, held = self.feed.get() or ("", 0, self.first_part, 0)

        def turn(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal carry, pos, part
            whole = carry + text
            for _, at, code in _scan(whole, self.k):
                if len(at):
                    yield at + (pos - len(carry)), code
            pos, part = pos + len(text), part + 1
            carry = whole[len(whole) - min(len(whole), self.k - 1) :]

        for batch in batches:
            for n, text in sorted(batch, key=lambda c: c[0]):
                if n > part:
                    held += not self.waiting.containsKey((n,))
                    self.waiting.updateValue((n,), (text or "",))
                elif n == part:
                    yield from turn(text or "")
                while held and self.waiting.containsKey((part,)):
                    text = self.waiting.getValue((part,))[0]
                    self.waiting.removeKey((part,))
                    held -= 1
                    yield from turn(text)
        self.feed.update((carry, pos, part, held))

    def close(self) -> None:
        pass


class ChunkFeed(_Feed):
    """A row per k-mer."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pos, code in self.fed(zip(b["part"].tolist(), b["sequence"].tolist(), strict=True) for b in rows):
            yield pd.DataFrame({"seq_id": np.full(len(pos), key[0]), "pos": pos, "code": code})


class ChunkTotals(_Feed):
    """A row per sequence and micro-batch that has k-mers: how many, and where the last one is."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, last = 0, -1
        # rows come one by one, a batch of few at a time
        while batch := [(r["part"], r["sequence"]) for r in islice(rows, 64)]:
            for pos, _ in self.fed([batch]):
                n, last = n + len(pos), int(pos[-1])
        if n:
            yield Row(seq_id=key[0], n=n, last=last)


def _keyed(chunks: DataFrame) -> GroupedData:
    """Chunks by their sequence, with a state store that the processors can use."""
    spark = chunks.sparkSession
    conf = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(conf):
        spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return chunks.select("seq_id", "part", "sequence").groupBy("seq_id")


def stream_chunk_totals(chunks: DataFrame, k: int, first_part: int = 0) -> DataFrame:
    """seq_id, n and last of the k-mers of ``stream_chunked_kmers``, added up for each sequence and micro-batch."""
    return _keyed(chunks).transformWithState(ChunkTotals(k, first_part), "seq_id long, n long, last long", "Append", "None")


def stream_chunked_kmers(chunks: DataFrame, k: int, first_part: int = 0) -> DataFrame:
    """seq_id, pos and code of the k-mers of a stream of chunks (seq_id, part, sequence), also of those across chunks.

    Parts count on from ``first_part``; a chunk that arrives before its turn waits in the state, so the order of arrival
    doesn't matter. A sequence's state is its last k - 1 characters, its place and what waits. Needs the RocksDB state
    store, which this sets for the session unless it has another provider than Spark's default.
    """
    return _keyed(chunks).transformWithStateInPandas(ChunkFeed(k, first_part), "seq_id long, pos long, code long", "Append", "None")
