"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A piece never holds a space after another character, so a text falls apart at its spaces into segments that merge
alone. Each distinct segment is encoded once: the symbols of many segments lie in one flat array, with the rank of the
pair that begins at each. A round takes the minimum rank of each segment and merges its pairs of that rank from the left
on, in all segments at the same time: those that don't overlap, up to the first one that makes a new pair of that rank
or a lower one, which the library would merge before the rest. Merged symbols leave the array when they are many, and a
segment leaves when no pair of it is in the vocabulary; all segments go this way, however long. Characters that no piece
covers become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import id_text, slices

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class PieceModel:
    """A byte-fallback BPE model of sentencepiece with an identity normaliser, a dummy prefix and kept white space."""

    KEEP = 500_000

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if sp.encode("  a  b") != sp.encode("  a  b ")[:-1] or any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("this model trims white space or has pieces across spaces")
        self.symbols = {names[i]: i for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = sp.eos_id()
        chars = {c for s in self.symbols for c in s} - self.symbols.keys()
        self.symbols |= {c: n + k for k, c in enumerate(sorted(chars))}
        ranks = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        pairs = sorted((self.symbols[p[:k]] << 32 | self.symbols[p[k:]], ranks[sp.get_score(i)], i) for i in plain for p in [names[i]] for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols)
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs] + [NONE], np.int32)
        self.merged = np.array([p[2] for p in pairs] + [0], np.int32)
        self.known: dict[str, bytes] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table; its last place for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment (its spaces written as ``SPACE``) as unsigned 32-bit integers."""
        extra: dict[str, int] = {}
        base = self.size + len(self.symbols)
        flat = [self.symbols.get(c, -1) for s in segments for c in s]
        sym = np.array(flat, np.int64)
        if (unknown := np.flatnonzero(sym < 0)).size:
            text = "".join(segments)
            for i in unknown.tolist():
                sym[i] = extra.setdefault(text[i], base + len(extra))
        names = {v: k for k, v in extra.items()} | {v: k for k, v in self.symbols.items() if v >= self.size}
        seg = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        sym, seg = self._rounds(sym, seg)
        out = sym.astype(np.uint32)
        if (odd := np.flatnonzero(sym >= self.size)).size:
            spelled = [[self.bytes[b] for b in names[x].encode()] for x in sym[odd].tolist()]
            extra_n = np.ones(len(sym), np.int64)
            extra_n[odd] = [len(x) for x in spelled]
            out, seg = np.repeat(out, extra_n), np.repeat(seg, extra_n)
            starts = (np.cumsum(extra_n) - extra_n)[odd]
            for s, x in zip(starts.tolist(), spelled, strict=True):
                out[s : s + len(x)] = x
        cut = (4 * np.searchsorted(seg, np.arange(len(segments) + 1))).tolist()
        raw = out.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _rounds(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that no merge changes any more, and their segments, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)

        def fresh(sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, ...]:
            """What stands before and after each symbol in its segment (-1: nothing), and its pair."""
            n = len(sym)
            following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            ends = np.append(seg[1:] != seg[:-1], True)
            following[ends] = -1
            before[np.append(True, ends[:-1])] = -1
            at = np.full(n, none)
            i = np.flatnonzero(~ends)
            at[i] = self.pairs(sym[i], sym[i + 1])
            return following, before, at

        following, before, at = fresh(sym, seg)
        alive, rank = np.ones(len(sym), bool), self.ranks[at]
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
        dead = 0
        while len(sym):
            sizes = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            stop = low == NONE
            idle = dead + int(sizes[stop].sum())
            if stop.all() or 4 * idle > len(sym):
                gone = np.repeat(stop, sizes)
                done.append((sym[gone & alive], seg[gone & alive]))
                stay = alive & ~gone
                where = np.cumsum(stay) - 1
                following, before = (np.where(x[stay] < 0, -1, where[x[stay]]) for x in (following, before))
                sym, seg, at, rank = sym[stay], seg[stay], at[stay], rank[stay]
                alive, dead = np.ones(len(sym), bool), 0
                first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else first[:0]
                continue
            hit = np.flatnonzero((rank == np.repeat(low, sizes)) & (rank != NONE))
            # of pairs that overlap each other in a row, every second one is merged
            chained = np.append(False, following[hit[:-1]] == hit[1:])
            start = np.flatnonzero(~chained)
            hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))) % 2 == 0]
            second, new, own = following[hit], self.merged[at[hit]].astype(np.int64), rank[hit]
            left, right = before[hit], following[second]
            beside = np.append(False, (left[1:] == second[:-1]) & (left[1:] >= 0))
            left_sym = np.where(beside, np.append(0, new[:-1]), sym[left])
            early = (left >= 0) & (self.ranks[self.pairs(left_sym, new)] <= own)
            early |= (right >= 0) & (self.ranks[self.pairs(new, sym[right])] <= own)
            if early.any():
                held = seg[hit]
                upto = np.cumsum(early) - early
                begin = np.append(True, held[1:] != held[:-1])
                now = upto == np.repeat(upto[begin], np.diff(np.append(np.flatnonzero(begin), len(hit))))
                hit, second, new, right = hit[now], second[now], new[now], right[now]
            sym[hit], following[hit] = new, right
            alive[second], rank[second] = False, NONE
            dead += len(second)
            before[right[right >= 0]] = hit[right >= 0]
            change = np.concatenate([hit, before[hit][before[hit] >= 0]])
            other = following[change]
            at[change] = np.where(other >= 0, self.pairs(sym[change], sym[other]), none)
            rank[change] = self.ranks[at[change]]
        if not done:
            return sym, seg
        sym, seg = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        if len(self.known) > self.KEEP:
            self.known.clear()
        split = []
        for t in texts:
            t = t.replace(SPACE, " ")
            if not t:
                split.append([])
            elif "  " in t or t[0] == " ":
                split.append([s[1:] for s in re.findall(" +[^ ]*", " " + t)])
            else:
                split.append(t.split(" "))
        missing = [w for w in set().union(*split) if w not in self.known]
        for at in range(0, len(missing), 50_000):
            part = missing[at : at + 50_000]
            self.known.update(zip(part, self.merge([(" " + w).replace(" ", SPACE) for w in part]), strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in split]


_MODELS: dict[str, PieceModel] = {}
_PROCESSORS: dict = {}


def model(path: str) -> PieceModel:
    """One per Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def processor(path: str):
    """The library's own, to decode with."""
    import sentencepiece

    if path not in _PROCESSORS:
        _PROCESSORS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PROCESSORS[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int, the end id last). A null or empty text has the end id only.

    Every row is encoded by itself: repeated rows and ties agree, a null doc_id stays, an empty table gives one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches):
            ids = [np.append(a, np.uint32(m.end)) for a in m.encode(b.column("text").to_pylist())]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col, as_binary=False).mapInArrow(run, "doc_id long, ids array<int>")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(doc_ids: pa.Array, ids: list[list[int]], sp, decimal: list[str]) -> pa.RecordBatch:
    shas = [hashlib.sha256(" ".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids]
    texts = [hashlib.sha256(t.encode()).hexdigest() for t in sp.decode(ids, num_threads=1)] if ids else []
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the decimal ids and of the text that the library decodes from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        decimal = [str(i) for i in range(sp.get_piece_size())]
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                yield _digests(b.column("doc_id"), b.column("ids").to_pylist(), sp, decimal)

    return encoded.select("doc_id", "ids").mapInArrow(run, _DIGESTS)


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every document in one worker, so that ids don't travel.

    Rows are handled one by one, so repeats, ties and other columns are free; a null or empty text has the end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        decimal = [str(i) for i in range(m.size)]
        for b in slices(batches):
            ids = [[*a.tolist(), m.end] for a in m.encode(b.column("text").to_pylist())]
            yield _digests(b.column("doc_id"), ids, m.sp, decimal)

    return id_text(docs, id_col, text_col, as_binary=False).mapInArrow(run, _DIGESTS)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
