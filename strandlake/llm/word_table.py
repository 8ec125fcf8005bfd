"""Byte-level BPE by a table of distinct words: each distinct word is encoded once, ids come back by position.

1. Documents are cut into words where they are read. Some ``CHUNK_BYTES`` of text are a chunk: it numbers its own
   distinct words, and a document is the list of its words' numbers. Both go to a table in the shared folder, which is
   bucketed by chunk; a chunk's words are dealt over word buckets by a hash, packed.
2. A word bucket brings the same words of all chunks together. Each distinct one is encoded once by the tokenizers
   library, and decoded by joining its ids with the table of ids and pieces.
3. The encoded words go back to the chunks that asked for them, where positions turn them into documents.

What is shuffled are a chunk's distinct words, packed, not occurrences: no word, source or group of copies makes a hot
key, and the documents themselves stay where they lie. A word is a run of white space with the run of other characters
after it, cut again where a letter or digit precedes ASCII punctuation. The pre-tokenizer always begins a token there, and
looks no further than the first character after white space, so words are encoded as they would be in their text; the
encodings of a text's words make up its encoding.
"""

from __future__ import annotations

import math
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import id_text, new_path, pack, plan_bytes, slices, tidy, unpack, written

#: Text bytes and distinct words of a chunk, about; a longer document is a chunk of its own.
CHUNK_BYTES, CHUNK_WORDS = 16 << 20, 600_000
#: Bytes of input (as Catalyst sizes it) for each word bucket, and buckets at most: more input makes larger buckets.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 16
#: Words that the library gets at a time, and bytes of text that leave a worker at a time, about.
CALL_WORDS, OUT_BYTES = 4_000, 4 << 20
#: Ids of a vocabulary at most, as its table of ids and pieces (some 20 bytes each) is broadcast.
MOST_IDS = 1 << 21

# The characters with Unicode's property White_Space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII punctuation, and letters and digits of Latin-1.
_MARKS, _LETTERS = r"!-/:-@\[-`{-~", "A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A word up to a letter before punctuation or white space, or else up to white space. Added tokens may be cut by it.
WORDS = re.compile(f"[{WHITE_SPACE}]*+(?:(?!\\Z)[^{WHITE_SPACE}{_LETTERS}]*+[^{WHITE_SPACE}{_MARKS}]*+(?<=[{_LETTERS}])|[^{WHITE_SPACE}]+)|[{WHITE_SPACE}]+")
#: A word up to white space, for texts with added tokens.
WHOLE_WORDS = re.compile(f"[{WHITE_SPACE}]*+[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The library's tokenizer without truncation and padding, one per process; an error if words can't stand alone in it."""
    if path not in _TOKENIZERS:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        spec = json.loads(t.to_str())
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and re.fullmatch(f"[^{WHITE_SPACE}]+", a["content"]) for a in added)
        if spec["normalizer"] or not byte_level or not plain or (spec["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("words stand alone only in a byte-level tokenizer without normalizer, prefix space and added tokens with white space")
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def split(text: str, added: list[str]) -> list[str]:
    """The words of a text."""
    return (WHOLE_WORDS if any(x in text for x in added) else WORDS).findall(text)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw).to_pybytes()


def _unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(data)[8:], decompressed_size=int.from_bytes(data[:8], "little")).to_pybytes()


#: Rows of a chunk: its documents (bucket -1) as the numbers of their words, or those of its words that are in a bucket.
_CUT = "chunk long, bucket int, doc_ids array<long>, counts array<long>, numbers binary, sizes binary, words binary"
_CUT_KINDS = {"chunk": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "numbers": pa.binary(), "sizes": pa.binary(), "words": pa.binary()}


def cut(docs: DataFrame, path: str, buckets: int, chunk_bytes: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of all chunks (see ``_CUT``). They must be written before use: a chunk's number is that of its task and of the chunk in it."""
    added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, _CUT_KINDS.values(), strict=True)], list(_CUT_KINDS))

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            raw = [w.encode() for w in known]
            deal = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            order = np.argsort(deal, kind="stable")
            edges = np.searchsorted(deal[order], np.arange(buckets + 1))
            for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                mine = sorted(order[edges[k] : edges[k + 1]].tolist(), key=raw.__getitem__)  # words in order squeeze well
                yield row(chunk, k, None, None, pack(np.array(mine, np.int32)), pack(np.array([len(raw[i]) for i in mine], np.int32)), _squeeze(b"".join([raw[i] for i in mine])))
            known.clear()
            chunk, held = chunk + 1, 0

        for b in slices(batches):
            texts = b.column("text").to_pylist()
            numbers = [np.fromiter(map(known.__getitem__, split(t, added)), np.int32) for t in texts]
            yield row(chunk, -1, b.column("doc_id").to_pylist(), list(map(len, numbers)), pack(np.concatenate(numbers)), None, None)
            held += sum(map(len, texts))
            if held >= chunk_bytes or len(known) >= chunk_words:
                yield from close()
        yield from close()

    return id_text(docs, id_col, text_col, as_binary=False).mapInArrow(run, _CUT)


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``df`` written in buckets of the column ``by``, so that no later step shuffles it by that column."""
    spark, name = df.sparkSession, f"strandlake_words_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, "word-numbers")).bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece (its bytes) of the vocabulary."""
    t = tokenizer(path)
    # the byte-level alphabet: printable Latin characters are themselves, the other bytes follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}
    vocabulary = t.get_vocab(with_added_tokens=True)
    if len(vocabulary) > MOST_IDS:
        raise ValueError("this vocabulary is too large to be broadcast")
    rows = [(i, bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()) for piece, i in vocabulary.items()]
    return F.broadcast(spark.createDataFrame(rows, "id int, piece binary"))


def encode_words(words: list[str], path: str) -> Iterator[list[int]]:
    """The ids of each word, by the library."""
    t = tokenizer(path)
    for at in range(0, len(words), CALL_WORDS):
        yield from (e.ids for e in t.encode_batch_fast(words[at : at + CALL_WORDS], add_special_tokens=False))


def word_ids(asked: DataFrame, path: str) -> DataFrame:
    """The table of distinct words, and who asks for them, from rows of word buckets (sorted by bucket in each partition).

    Rows are bucket, w and id, one for each id of the bucket's distinct word w, in order; then chunk, numbers and asks for
    each chunk that has words in the bucket: ``asks`` are the words w, ``numbers`` what the chunk calls them.
    """
    kinds = {"bucket": pa.int32(), "w": pa.int32(), "id": pa.int32(), "chunk": pa.int64(), "numbers": pa.binary(), "asks": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, asks = None, {}, []

        def close() -> Iterator[pa.RecordBatch]:
            words = [w.decode() for w in known]
            for s in range(0, len(words), 25 * CALL_WORDS):
                ids = list(encode_words(words[s : s + 25 * CALL_WORDS], path))
                w = np.repeat(np.arange(s, s + len(ids), dtype=np.int32), [len(x) for x in ids])
                flat = pa.array([i for x in ids for i in x], pa.int32())
                null = [pa.nulls(len(w), k) for k in list(kinds.values())[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), at, np.int32)), pa.array(w), flat, *null], list(kinds))
            for chunk, numbers, mine in asks:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((at, None, None, chunk, numbers, mine), kinds.values(), strict=True)], list(kinds))

        for b in batches:
            for chunk, bucket, numbers, sizes, words in zip(*(b.column(c).to_pylist() for c in ("chunk", "bucket", "numbers", "sizes", "words")), strict=True):
                if bucket != at:
                    if asks:
                        yield from close()
                    at, known, asks = bucket, {}, []
                raw, ends = _unsqueeze(words), np.cumsum(unpack(sizes, np.int32)[0]).tolist()
                mine = [known.setdefault(raw[s:e], len(known)) for s, e in zip([0, *ends], ends, strict=False)]
                asks.append((chunk, numbers, pack(np.array(mine, np.int32))))
        if asks:
            yield from close()
        known, asks = {}, []
        tidy()

    return asked.mapInArrow(run, "bucket int, w int, id int, chunk long, numbers binary, asks binary")


def answers(words: DataFrame) -> DataFrame:
    """For each ask of ``words`` (those of ``word_ids``, each id with its piece): chunk, numbers, sizes, ids and raw, packed.

    Rows come in the order of ``word_ids``: the join with the broadcast pieces streams them. Another order is an error.
    """
    kinds = {"chunk": pa.int64(), "numbers": pa.binary(), "sizes": pa.binary(), "ids": pa.binary(), "raw": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, table = None, [], None
        for b in batches:
            bucket, ask = np.asarray(b.column("bucket")), np.asarray(b.column("w").is_null())
            edges = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (ask[1:] != ask[:-1])))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
                if bucket[s] != at:
                    at, held, table = bucket[s], [], None
                part = b.slice(s, e - s)
                if not ask[s]:
                    if table is not None:
                        raise RuntimeError("words after asks")
                    pieces = part.column("piece").cast(pa.large_binary()).fill_null(b"")
                    held.append((np.asarray(part.column("w")), np.asarray(part.column("id")), np.asarray(pa.compute.binary_length(pieces), np.int64), b"".join(pieces.to_pylist())))
                    continue
                if table is None:
                    table = _table_of(held)
                n_ids, n_raw, id_at, raw_at, ids, raw = table
                for chunk, numbers, asks in zip(*(part.column(c).to_pylist() for c in ("chunk", "numbers", "asks")), strict=True):
                    w, = unpack(asks, np.int32)
                    row = [chunk, numbers, pack(n_ids[w].astype(np.int32), n_raw[w].astype(np.int32)), pack(_gather(ids, id_at[w], n_ids[w])), _squeeze(_gather(raw, raw_at[w], n_raw[w]).tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds.values(), strict=True)], list(kinds))
        held, table = [], None
        tidy()

    return words.mapInArrow(run, "chunk long, numbers binary, sizes binary, ids binary, raw binary")


def _table_of(held: list[tuple]) -> tuple[np.ndarray, ...]:
    """Per word its ids and bytes: how many, from where, and all of them."""
    w, ids, n = (np.concatenate([h[k] for h in held]) for k in range(3))
    if (np.diff(w) < 0).any() or len(w) and (w[0] or (np.diff(w) > 1).any()):
        raise RuntimeError("words out of order")
    n_ids = np.bincount(w)
    n_raw = np.bincount(w, weights=n).astype(np.int64)
    return n_ids, n_raw, np.cumsum(n_ids) - n_ids, np.cumsum(n_raw) - n_raw, ids.astype(np.int32), np.frombuffer(b"".join(h[3] for h in held), np.uint8)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def encode_decode(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, chunk_words: int = CHUNK_WORDS, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row, as the library encodes the text and decodes the ids.

    A null or empty text has no ids and decodes to an empty text. Every row has a result of its own, also those of a
    null or repeated doc_id; other columns are left out; an empty table gives an empty one. Added tokens in a text are
    encoded as such, as the library does, and stay when decoding.
    """
    spark = docs.sparkSession
    size = plan_bytes(docs.select(id_col, text_col))
    buckets = buckets or max(1, min(MOST_BUCKETS, math.ceil(size / BUCKET_BYTES)))
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (4 * CHUNK_BYTES)))
    rows = bucketed(cut(docs, path, buckets, chunk_bytes, chunk_words, id_col, text_col), "chunk", homes)
    asked = rows.filter("bucket >= 0").select("chunk", "bucket", "numbers", "sizes", "words").repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    back = answers(word_ids(asked, path).join(piece_table(spark, path), "id", "left").select("bucket", "w", "id", "piece", "chunk", "numbers", "asks"))
    mine = rows.filter("bucket < 0").select("chunk", "doc_ids", "counts", "numbers")

    def assemble(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(unpack(r["numbers"], np.int32)[0], *unpack(r["sizes"], np.int32, np.int32), unpack(r["ids"], np.int32)[0], _unsqueeze(r["raw"])) for r in right.to_pylist()]
        numbers, n_ids, n_raw, ids = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int32) for k in range(4))
        tidy()  # of the chunk before
        order = np.argsort(numbers, kind="stable")
        ends, raw = np.cumsum(n_raw.astype(np.int64)), b"".join(g[4] for g in got)
        words = [raw[e - n : e] for e, n in zip(ends[order].tolist(), n_raw[order].tolist(), strict=True)]
        starts = (np.cumsum(n_ids.astype(np.int64)) - n_ids)[order]
        del got, raw, ends
        parts = [p for r in range(left.num_rows) for p in _documents(left.column("doc_ids")[r].values, np.array(left.column("counts")[r].as_py(), np.int64), unpack(left.column("numbers")[r].as_py(), np.int32)[0], n_ids[order].astype(np.int64), starts, ids, words)]
        return pa.Table.from_batches(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "raw": pa.array([], pa.binary())})

    out = mine.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids array<int>, raw binary")
    return out.select("doc_id", "ids", F.col("raw").cast("string").alias("decoded"))


def _documents(doc_ids: pa.Array, counts: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The documents of a slice from the numbers of their words, some at a time."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        begin = int(ends[a] - counts[a])
        z = max(a + 1, int(np.searchsorted(ends, begin + OUT_BYTES // 8, side="right")))
        mine = numbers[begin : int(ends[z - 1])]
        n = sizes[mine]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[mine] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = np.concatenate([[0], ends[a:z] - begin])
        words = list(map(raw.__getitem__, mine.tolist()))
        texts = [b"".join(words[s:e]) for s, e in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        lists = pa.ListArray.from_arrays(pa.array(upto[cuts].astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([doc_ids.slice(a, z - a), lists, pa.array(texts, pa.binary())], ["doc_id", "ids", "raw"])
        a = z


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of any rows of ids, as decode(ids, skip_special_tokens=False) gives it.

    Each id is joined with its piece and goes back to its row by position. Null or empty ids give an empty text; ids
    that the vocabulary lacks give nothing; bytes that are no UTF-8 become U+FFFD, as in the library.
    """
    rows = written(encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")), "ids-to-decode")
    each = rows.select("row", F.posexplode("ids").alias("pos", "id")).join(piece_table(rows.sparkSession, path), "id")
    parts = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", F.decode("piece", "ISO-8859-1").alias("piece")))).alias("parts"))
    raw = parts.select("row", F.encode(F.array_join("parts.piece", ""), "ISO-8859-1").alias("raw"))

    def lossy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(x or b"").decode("utf-8", "replace") for x in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    out = rows.select("row", "doc_id").join(raw, "row", "left").select("doc_id", "raw")
    return out.mapInArrow(lossy, out.withColumn("raw", F.lit("")).withColumnRenamed("raw", "decoded").schema)


def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and the digest of its ids, and the digest of the text that they decode to."""
    import public_tokenizers

    rows = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
