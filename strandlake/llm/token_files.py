"""Token ids as binary files of directly addressable codes (Brisaboa, Ladra and Navarro, 2009).

An id is split into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of
those ids that need one, and so on; a continuation bitmap beside each level says which ids go on, and its rank
directory (ones before each 512-bit block) says where in the next level they stand. So id i is read with a few lookups,
without decoding its neighbours.

Layout of a segment (little-endian): magic ``DAC1``, uint32 version (2), uint64 ids, uint64 documents, uint32 levels,
uint32 chunk bits, uint64 documents without a doc_id (the first ones; their doc_id is stored as 0; version 1 lacks this);
then int64 doc_id and uint64 end offset of each document; then per level a uint64 count, its chunks
(one or two bytes each) and, but for the last level, its bitmap in 64-bit words and its rank directory in uint32.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import id_text, new_path, plan_bytes, slices

#: Bits of a chunk: 8 or 16.
CHUNK = 8
BLOCK_BITS = 512
MAGIC = b"DAC1"
#: Ids of a segment, about; a longer document makes a longer segment.
SEGMENT_IDS = 1 << 20
#: Ranges of doc_id at most, each written by one task (a doc_id that many rows share is more ranges than one).
MOST_PARTS = 65_536
#: log2 of the ids by which positions and segments are brought together.
BUCKET_BITS = 20


class Dac:
    """A sequence of unsigned 32-bit ids in directly addressable codes."""

    def __init__(self, n: int, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray], chunk: int = CHUNK):
        self.n, self.levels, self.bitmaps, self.ranks, self.chunk = n, levels, bitmaps, ranks, chunk
        self.nulls = 0

    @classmethod
    def encode(cls, ids: np.ndarray, chunk: int = CHUNK) -> Dac:
        kind, mask = (np.uint8, 0xFF) if chunk == 8 else (np.uint16, 0xFFFF)
        rest, levels, bitmaps, ranks = np.asarray(ids, np.uint32), [], [], []
        while True:
            levels.append((rest & np.uint32(mask)).astype(kind))
            more = rest >> np.uint32(chunk)
            on = more > 0
            if not on.any():
                break
            bits = np.packbits(on, bitorder="little")
            words = np.zeros(-(-len(on) // BLOCK_BITS) * BLOCK_BITS // 64, np.uint64)
            words.view(np.uint8)[: len(bits)] = bits
            ones = np.bitwise_count(words).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint32)
            bitmaps.append(words)
            ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32))
            rest = more[on]
        return cls(len(ids), levels, bitmaps, ranks, chunk)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions ``at``, each by its own path through the levels."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[live] |= level[at].astype(np.uint32) << np.uint32(k * self.chunk)
            if k == len(self.bitmaps) or not len(live):
                break
            words, word, bit = self.bitmaps[k], at >> 6, (at & 63).astype(np.uint64)
            on = (words[word] >> bit) & np.uint64(1) > 0
            live, at, word, bit = live[on], at[on], word[on], bit[on]
            rank = self.ranks[k][at // BLOCK_BITS].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            first = at // BLOCK_BITS * (BLOCK_BITS // 64)
            for j in range(BLOCK_BITS // 64 - 1):
                before = first + j < word
                rank[before] += np.bitwise_count(words[(first + j)[before]])
            at = rank
        return out

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not -self.n <= i < self.n:
            raise IndexError(i)
        return int(self.access(np.array([i % self.n]))[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start..end: one rank per level, then the level's run of that range."""
        out = np.zeros(end - start, np.uint32)
        live: np.ndarray | None = None
        for k, level in enumerate(self.levels):
            if end <= start:
                break
            part = level[start:end].astype(np.uint32) << np.uint32(k * self.chunk)
            if live is None:
                out |= part
            else:
                out[live] |= part
            if k == len(self.bitmaps):
                break
            first = start >> 3
            bits = np.unpackbits(self.bitmaps[k].view(np.uint8)[first : (end + 7) >> 3], bitorder="little")[start - 8 * first : end - 8 * first].view(bool)
            live = np.flatnonzero(bits) if live is None else live[bits]
            start = self._rank(k, start)
            end = start + int(np.count_nonzero(bits))
        return out

    def _rank(self, k: int, at: int) -> int:
        """Ones of bitmap ``k`` before position ``at``."""
        block = min(at // BLOCK_BITS, len(self.ranks[k]) - 1)
        words = self.bitmaps[k][block * (BLOCK_BITS // 64) : at >> 6]
        ones = int(self.ranks[k][block]) + int(np.bitwise_count(words).sum())
        if at & 63:
            ones += int(self.bitmaps[k][at >> 6] & np.uint64((1 << (at & 63)) - 1)).bit_count()
        return ones

    def to_bytes(self, doc_ids: np.ndarray, ends: np.ndarray, nulls: int = 0) -> bytes:
        """The segment of these ids and documents, of which the first ``nulls`` have no doc_id."""
        parts = [MAGIC, np.uint32(2).tobytes(), np.array([self.n, len(doc_ids)], np.uint64).tobytes(), np.array([len(self.levels), self.chunk], np.uint32).tobytes(), np.uint64(nulls).tobytes()]
        parts += [np.asarray(doc_ids, np.int64).tobytes(), np.asarray(ends, np.uint64).tobytes()]
        for k, level in enumerate(self.levels):
            parts += [np.uint64(len(level)).tobytes(), level.tobytes()]
            if k < len(self.bitmaps):
                parts += [self.bitmaps[k].tobytes(), self.ranks[k].tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[Dac, np.ndarray, np.ndarray]:
        """The codes (with ``nulls``, the number of documents without a doc_id), the doc_ids and the end offset of each document."""
        version = int(np.frombuffer(data, np.uint32, 1, 4)[0]) if data[:4] == MAGIC else 0
        if version not in (1, 2):
            raise ValueError("not a token segment of version 1 or 2")
        n, docs = (int(x) for x in np.frombuffer(data, np.uint64, 2, 8))
        count, chunk = (int(x) for x in np.frombuffer(data, np.uint32, 2, 24))
        nulls = int(np.frombuffer(data, np.uint64, 1, 32)[0]) if version == 2 else 0
        at = 32 + 8 * (version == 2)
        doc_ids = np.frombuffer(data, np.int64, docs, at)
        ends = np.frombuffer(data, np.uint64, docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        levels, bitmaps, ranks = [], [], []
        for k in range(count):
            size = int(np.frombuffer(data, np.uint64, 1, at)[0])
            level = np.frombuffer(data, np.uint8 if chunk == 8 else np.uint16, size, at + 8)
            levels.append(level)
            at += 8 + level.nbytes
            if k + 1 < count:
                blocks = -(-size // BLOCK_BITS)
                bitmaps.append(np.frombuffer(data, np.uint64, blocks * BLOCK_BITS // 64, at))
                at += blocks * BLOCK_BITS // 8
                ranks.append(np.frombuffer(data, np.uint32, blocks, at))
                at += blocks * 4
        dac = cls(n, levels, bitmaps, ranks, chunk)
        dac.nulls = nulls
        return dac, doc_ids, ends


#: White space that may join what stands beside it: two in a row, or any but space and line feed.
ODD = ("  ", " \n", "\n ", "\n\n", *(chr(c) for c in range(1, 0x3001) if chr(c).isspace() and chr(c) not in " \n"))

LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").match


class WordEncoder:
    """The tokenizers library's ids of whole texts, with each word encoded once.

    A byte-level BPE never merges across its pre-tokens, and a single space between two characters that are not white
    space always begins a pre-token. So a text whose white space next to a space is only ever that one space is its
    words, each with its space, encoded alone. Words are kept (at most ``KEEP``); any other text is encoded whole.
    """

    KEEP = 1_500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True  # a space in byte-level pieces
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _learn(self, keep: dict[str, bytes], missing: set[str], space: str) -> None:
        """Learn words; letters that end before an ASCII character of another kind are a pre-token, so what follows is apart."""
        split = {w: k for w in missing if not w.isalpha() and (m := LETTERS(w)) and (k := m.end()) < len(w) and w[k] < "\x80"} if space else {}
        if split:
            stems, tails = {w[:k] for w, k in split.items()}, {w[k:] for w, k in split.items()}
            self._ask(keep, (missing - split.keys()) | {w for w in stems if w not in keep}, space)
            self._ask(self.first, {w for w in tails if w not in self.first}, "")
            keep.update({w: keep[w[:k]] + self.first[w[k:]] for w, k in split.items()})
        else:
            self._ask(keep, missing, space)

    def _ask(self, keep: dict[str, bytes], missing: set[str], space: str) -> None:
        todo = list(missing)
        for at in range(0, len(todo), 2000):
            part = todo[at : at + 2000]
            if space:
                # words joined by single spaces keep apart, and every id whose bytes begin with a space begins one
                ids = np.asarray(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cut = (4 * np.flatnonzero(self.begins[ids])).tolist()
                if len(cut) == len(part):
                    raw = ids.tobytes()
                    keep.update(zip(part, map(raw.__getitem__, map(slice, cut, [*cut[1:], len(raw)])), strict=True))
                    continue
            for w, e in zip(part, self.tokenizer.encode_batch_fast([space + w for w in part], add_special_tokens=False), strict=True):
                keep[w] = np.asarray(e.ids, np.uint32).tobytes()

    def _codes(self, keep: dict[str, bytes], words: list[str], space: str) -> list[bytes]:
        """The ids of each word; those of words not known yet are learnt."""
        if len(self.first) + len(self.inner) > self.KEEP:
            self.first.clear()
            self.inner.clear()
        out, at, holes = list(map(keep.get, words)), -1, []
        try:
            while True:
                at = out.index(None, at + 1)
                holes.append(at)
        except ValueError:
            pass
        self._learn(keep, {words[i] for i in holes}, space)
        for i in holes:
            out[i] = keep[words[i]]
        return out

    def _odd(self, text: str) -> bool:
        """Whether ``text`` has white space beside a space or line end, or of another kind, or a special token."""
        return any(x in text for x in (*ODD, *self.special))

    def _plain(self, text: str) -> bool:
        return bool(text) and not text[0].isspace() and not text[-1].isspace() and not self._odd(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        joined = " ".join(["|", *texts, "|"])
        plain, whole = range(len(texts)), []
        if self._odd(joined):
            flags = [self._plain(t) for t in texts]
            plain, whole = [i for i, f in enumerate(flags) if f], [i for i, f in enumerate(flags) if not f]
            joined = " ".join(["|", *[texts[i] for i in plain], "|"])
        words = joined.split(" ")[1:-1]
        codes = self._codes(self.inner, words, " ")
        starts = np.cumsum([0, *[texts[i].count(" ") + 1 for i in plain]]).tolist()
        heads = self._codes(self.first, [words[s] for s in starts[:-1]], "")
        for i, head, s, e in zip(plain, heads, starts, starts[1:], strict=False):
            out[i] = head + b"".join(codes[s + 1 : e])
        for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.asarray(e.ids, np.uint32).tobytes()
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, so that words stay known from task to task."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _range_of(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``x``, in two steps, so that a row meets about twice their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    # one literal each instead of one per bound
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < x))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    coarse = below(longs([b[-1] for b in blocks]))  # whole blocks below
    inside = F.split(F.get(F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";"), coarse), ",").cast("array<bigint>")
    return coarse * step + F.coalesce(F.when(coarse < len(blocks), below(inside)), F.lit(len(bounds) - len(blocks) * step))


def _parts(ids: DataFrame, parts: int) -> tuple[Column, int]:
    """The part of a row with doc_id and ``order`` (a hash whose signed order counts), and the number of parts.

    Bounds come from the ids alone: a range exchange would read the texts once more to sample them. An id that is
    several bounds has a range of its own, cut into as many parts by the hash; so have rows without an id.
    """
    found = ids.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 4 * parts)).alias("b")).first()
    raw = (found["b"] or []) if parts > 1 else []
    shares = {b: n for b in set(raw) if (n := raw.count(b)) > 1}
    bounds = sorted(set(raw) | {b - 1 for b in shares if b > -(2**63)})
    nulls = min(parts, math.ceil(parts * found["nulls"] / found["n"])) if found["nulls"] else 0
    cuts = [shares.get(b, 1) for b in bounds] + [1]  # of the ranges up to each bound, and of what is beyond
    starts = [nulls]
    for c in cuts:
        starts.append(starts[-1] + c)
    at = _range_of(F.col("doc_id"), bounds)
    get = lambda xs: F.get(F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>"), at)
    # the upper 31 bits of the hash, shifted to be unsigned
    share = lambda n: F.floor(F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(2**63)).cast("long")), 33) * n / F.lit(2.0**31))
    of_ids = get(starts[:-1]) + (F.when(get(cuts) > 1, share(get(cuts))).otherwise(0) if shares else F.lit(0))
    return (F.when(F.col("doc_id").isNull(), share(F.lit(nulls))).otherwise(of_ids) if nulls else of_ids), starts[-1]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every document and write segments, in ascending doc_id order, to the folder ``path``.

    The folder is a Parquet table with one row per segment: part and segment number (their order is the order of the
    documents), the counts of ids and documents, and the segment's bytes, so any store that Spark can write to will do.
    A null or empty text has the end id only. Documents without a doc_id come first; those of one doc_id (or of none)
    stand in the order of a hash of their text, then of the text, so the files depend on the rows alone and not on where
    they lay. Parts are ranges of doc_id; a doc_id, or the lack of one, that many rows share is cut by the hash, so only
    rows that are equal altogether have to share a part.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col, as_binary=False)
    parts = max(1, min(MOST_PARTS, -(-plan_bytes(rows) // (8 << 20))), int(spark.conf.get("spark.sql.shuffle.partitions")) if plan_bytes(rows) > (8 << 20) else 1)
    part, n_parts = _parts(docs.select(F.col(id_col).cast("long").alias("doc_id")), parts)
    order = F.xxhash64("text").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    rows = rows.withColumn("order", order).withColumn("part", part.cast("int"))
    rows = rows.repartitionById(n_parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "order", "text").select("doc_id", "text", "part")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, e = -1, 0, encoder(tokenizer)
        end = np.uint32(end_id).tobytes()
        ids: list[int | None] = []
        codes: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal ids, codes, held, number
            ends = np.cumsum([len(c) // 4 for c in codes])
            dac = Dac.encode(np.frombuffer(b"".join(codes), np.uint32))
            nulls = ids.count(None)
            row = [[part], [number], [held], [len(ids)], [dac.to_bytes(np.asarray([0] * nulls + ids[nulls:], np.int64), ends, nulls)]]
            ids, codes, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "n_ids", "n_docs", "data"])

        for b in slices(batches):
            got = e.encode(b.column("text").to_pylist())
            for p, i, c in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), got, strict=True):
                if p != part:
                    if ids:
                        yield segment()
                    part, number = p, 0
                ids.append(i)
                codes.append(c + end)
                held += len(c) // 4 + 1
                if held >= segment_ids:
                    yield segment()
        if ids:
            yield segment()

    rows.mapInArrow(encode, "part int, segment int, n_ids long, n_docs long, data binary").write.option("compression", "none").parquet(path)


def _segment_starts(table: DataFrame) -> DataFrame:
    """part, segment, n and first: the ids of a segment and of all segments before it.

    Windows run inside a part, and over one row per part (``MOST_PARTS`` at most).
    """
    totals = table.groupBy("part", "segment").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    return totals.withColumn("in_part", F.coalesce(F.sum("n").over(before), F.lit(0))).join(parts, "part").select("part", "segment", "n", (F.col("part_start") + F.col("in_part")).alias("first"))


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """position and id for the positions (from 0, over all documents) in column ``position`` of ``wanted``.

    Each id is read by its own path through the levels of its segment; nothing else of the segment is decoded. The
    segments are stored as they are, so only those that hold a position are read on. Null positions and positions
    outside of the files have no row; repeated ones have one each.
    """
    table = spark.read.parquet(path)
    starts = _segment_starts(table)
    bucket = lambda c: F.shiftright(c, BUCKET_BITS)
    held = starts.filter("n > 0").withColumn("bucket", F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("first") + F.col("n") - 1))))
    asked = wanted.select(F.col("position").cast("long").alias("position")).filter("position >= 0").withColumn("bucket", bucket(F.col("position")))
    places = asked.join(held, "bucket").filter("position >= first AND position < first + n").select("part", "segment", F.lit(1).alias("kind"), (F.col("position") - F.col("first")).alias("at"), "position", F.lit(None).cast("binary").alias("data"))
    read = table.select("part", "segment", "data").join(places.select("part", "segment").distinct(), ["part", "segment"], "left_semi")
    rows = read.select("part", "segment", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("position"), "data").unionByName(places)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dac = None
        for b in batches:
            kind = np.asarray(b.column("kind"))
            cuts = np.flatnonzero(kind == 0).tolist()
            for s, e in zip([-1, *cuts], [*cuts, b.num_rows], strict=True):
                if s >= 0:
                    dac = Dac.from_bytes(b.column("data")[s].as_py())[0]
                part = b.slice(s + 1, e - s - 1)
                if part.num_rows and dac is not None:
                    yield pa.RecordBatch.from_arrays([part.column("position"), pa.array(dac.access(np.asarray(part.column("at"))).astype(np.int64))], ["position", "id"])

    # a segment comes first, then the positions in it: a worker holds one segment and one batch
    return rows.repartition("part", "segment").sortWithinPartitions("part", "segment", "kind", "at").mapInArrow(look, "position long, id long")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    table = spark.read.parquet(path)
    starts = _segment_starts(table).select("part", "segment", "first")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(*(b.column(c).to_pylist() for c in ("part", "segment", "data")), strict=True):
                dac, doc_ids, ends = Dac.from_bytes(data)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(dac.slice(s, e).tobytes()) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(doc_ids, mask=np.arange(n) < dac.nulls), pa.array(begins), pa.array(ends - begins), pa.array(crcs, pa.int64())], ["part", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"])

    out = table.select("part", "segment", "data").mapInArrow(documents, "part int, segment int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    out = out.join(starts, ["part", "segment"])
    return out.select("doc_id", (F.col("first") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)
