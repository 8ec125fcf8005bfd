"""Substring dedup against a log-structured index of window fingerprints.

A window is ``width`` consecutive words of a document; its fingerprint is a 64-bit hash. The index is a set of
immutable runs; a run holds, per bucket of the hash range, the sorted distinct fingerprints of one ingested batch with
a row of the smallest doc_id that has each. Runs are bucketed tables, so a batch is dealt to the buckets once and
merge-joined there with every run where it lies: history is read but never shuffled again. A window whose fingerprint
belongs to a row of a smaller doc_id is a candidate. Candidates that follow each other in a document and have one owner
are joined into passages, and each passage is verified against the owner's words. The batch then becomes a run, and
``FAN_IN`` runs of one level are compacted into one of the next, bucket by bucket. Fingerprints that collide go to an
exact path: their windows are grouped by their words.

Of the places of one fingerprint in a worker's chunk only those of the smallest doc_id go to its bucket; for the others
that one is an owner already. So a passage that any number of documents share comes once per chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import drop_path, mix64, new_path, pack, plan_bytes, release, slices, unpack, written
from strandlake.llm.places import Keys, by_part, collected, deltas, hash_bucket, keyed_text, numbered, pack_places, runs_of, unpack_places

WIDTH = 13
FAN_IN = 2
#: Input bytes per bucket of the hash range, and words whose windows a worker holds at a time.
BUCKET_BYTES, CHUNK_WORDS = 4 << 20, 1_000_000
BATCHES = 4
#: Buckets of a table at most; Spark's own limit is 100,000.
MOST_BUCKETS = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What a candidate says besides its row: the window's place, its owner's key.
_HIT = (np.uint32, np.int64, np.int64)
_KINDS = "bucket int, kind int, part int, data binary"


class _WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_HASHES = _WordHashes()


def window_hashes(words: list[bytes], width: int, bits: int = 64) -> np.ndarray:
    """A hash of each run of ``width`` words, of which ``bits`` bits are kept (fewer only in tests)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _STEP
        out += h[k : k + n]
    return mix64(out) >> np.uint64(64 - bits) << np.uint64(64 - bits) if bits < 64 else mix64(out)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows of a run: (bucket, kind, part, data); kind 0 is the index's own, 1 a batch's windows, 2 candidates."""
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "part", "data"])


@dataclass
class FingerprintIndex:
    """Runs of window fingerprints as bucketed tables in the shared folder, and the operations on them.

    ``runs`` are their paths and levels; an index is opened again from them with the same ``buckets``, ``width`` and
    ``bits``.
    """

    spark: SparkSession
    buckets: int
    width: int = WIDTH
    bits: int = 64
    runs: list[tuple[str, int]] = field(default_factory=list)
    hits: list[str] = field(default_factory=list)
    _names: dict[str, str] = field(default_factory=dict)

    def _table(self, path: str, kind: int) -> DataFrame:
        """One kind of a run's rows as a bucketed table; their folder is all that an index keeps of it."""
        path = f"{path}/kind={kind}"
        if path not in self._names:
            name = self._names[path] = f"strandlake_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (bucket INT, part INT, data BINARY) USING parquet CLUSTERED BY (bucket) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(self._names[path])

    def run(self, path: str) -> DataFrame:
        return self._table(path, 0).select("bucket", F.lit(0).alias("kind"), "part", "data")

    def _save(self, rows: DataFrame) -> str:
        """Write rows that are dealt by their bucket; each task has whole buckets, so a bucket is one file of each kind."""
        path, name = new_path(self.spark, "window-run"), f"strandlake_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", path).partitionBy("kind").bucketBy(self.buckets, "bucket").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return path

    def drop(self, path: str, kind: int) -> None:
        """Delete the files of one kind of a run."""
        drop_path(self.spark, f"{path}/kind={kind}")
        name = self._names.pop(f"{path}/kind={kind}", None)
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _windows(self, batch: DataFrame) -> DataFrame:
        """The batch's windows, sorted by fingerprint within a worker's chunk, and candidates that the chunk settles."""
        buckets, width, bits = self.buckets, self.width, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            keys, words = Keys(), 0

            def flush() -> pa.RecordBatch:
                nonlocal keys, words
                h, row, pos = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                key_a, key_h = keys.tables()
                keys, words = Keys(), 0
                place = np.empty(len(key_a), np.int64)  # rows by doc_id, so that the first one of a fingerprint owns it
                place[np.lexsort([key_h, key_a])] = np.arange(len(key_a))
                order = np.lexsort([pos, place[row], h])
                h, row, pos = h[order], row[order], pos[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                owner = np.repeat(row[first], np.diff(np.append(first, len(h))))
                later = key_a[row] > key_a[owner]
                rows = [(part, 2, part, data) for part, data in by_part(row[later], key_a, key_h, buckets, pos[later], key_a[owner[later]], key_h[owner[later]])]
                h, row, pos = h[~later], row[~later], pos[~later]
                bucket = hash_bucket(h, buckets)
                rows += [(int(bucket[x]), 1, 0, pack_places(row[x:y], key_a, key_h, deltas(h[x:y]), pos[x:y])) for x, y in runs_of(bucket)]
                return _rows(rows).to_batches()[0]

            for b in slices(batches):
                for a, k, text in zip(*(b.column(c).to_pylist() for c in ("a", "h", "text")), strict=True):
                    h = window_hashes(text.split(), width, bits)
                    if len(h):
                        held.append((h, np.full(len(h), keys.number(a, k), np.int64), np.arange(len(h), dtype=np.uint32)))
                        words += len(h)
                    if words >= CHUNK_WORDS:
                        yield flush()
            if held:
                yield flush()

        return batch.select("a", "h", "text").mapInArrow(run, _KINDS)

    def ingest(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Merge-join a batch (a, h, text; a the doc_id) with the runs and with itself; its fingerprints become a run.

        Returns packed candidates (part, data): the windows (row, position) whose fingerprint a row of a smaller doc_id
        also has, with the key of such a row. Batches come in ascending order of their ids.
        """
        buckets = self.buckets

        def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            bucket, out, got = key[0].as_py(), [], []
            for kind, part, data in zip(*(table.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True):
                if kind == 2:
                    out.append((bucket, 2, part, data))
                    continue
                a, h, fp, *pos = unpack_places(data, np.uint64, *([np.uint32] if kind else []))
                got.append((np.cumsum(fp, dtype=np.uint64), a, h, pos[0] if kind else np.zeros(len(fp), np.uint32), np.full(len(fp), kind, np.uint8)))
            if got:
                fp, a, h, pos, kind = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(fp, kind="stable")  # merges what is sorted already
                fp, a, h, pos, kind = fp[order], a[order], h[order], pos[order], kind[order]
                first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
                times = np.diff(np.append(first, len(fp)))
                group = np.repeat(np.arange(len(first)), times)
                least = np.flatnonzero(a == np.minimum.reduceat(a, first)[group])
                owner = least[np.concatenate([[True], group[least][1:] != group[least][:-1]])]  # one for each fingerprint
                of = owner[group]
                hit = np.flatnonzero((kind == 1) & (a > a[of]))
                if len(hit):
                    out += [(bucket, 2, part, data) for part, data in by_part(*numbered(a[hit], h[hit]), buckets, pos[hit], a[of[hit]], h[of[hit]])]
                if keep:
                    new = owner[np.minimum.reduceat(kind, first) == 1]  # a run holds what no older run has
                    if len(new):
                        out.append((bucket, 0, 0, pack_places(*numbered(a[new], h[new]), deltas(fp[new]))))
            return _rows(out)

        rows = self._windows(batch).repartition(buckets, "bucket")
        for path, _ in self.runs:
            rows = rows.unionByName(self.run(path))
        path = self._save(rows.groupBy("bucket").applyInArrow(join, _KINDS))
        self.hits.append(path)
        if keep:
            self.runs.append((path, 0))
            while len(alike := [r for r in self.runs if r[1] == self.runs[-1][1]]) >= FAN_IN:
                self.compact(alike)
        return self._table(path, 2).select("part", "data")

    def compact(self, runs: list[tuple[str, int]]) -> None:
        """Replace runs by one of the next level; each bucket is a merge of sorted runs, and nothing is shuffled."""

        def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            got = [unpack_places(data, np.uint64) for data in table.column("data").to_pylist()]
            a, h = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            fp = np.concatenate([np.cumsum(g[2], dtype=np.uint64) for g in got])
            order = np.argsort(fp, kind="stable")
            a, h, fp = a[order], h[order], fp[order]
            return _rows([(key[0].as_py(), 0, 0, pack_places(*numbered(a, h), deltas(fp)))])

        rows = self.run(runs[0][0])
        for path, _ in runs[1:]:
            rows = rows.unionByName(self.run(path))
        merged = self._save(rows.groupBy("bucket").applyInArrow(merge, _KINDS))
        for path, _ in runs:
            self.drop(path, 0)
        self.runs = [r for r in self.runs if r not in runs] + [(merged, runs[0][1] + 1)]


def _stretches(pos: np.ndarray, *owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where candidates of one row begin that follow each other and have one owner, and how many they are."""
    new = np.ones(len(pos), bool)
    new[1:] = pos[1:] != pos[:-1] + 1
    for o in owner:
        new[1:] |= o[1:] != o[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(pos)))


def _remove(docs: DataFrame, hits: DataFrame, width: int, spell: bool) -> DataFrame:
    """Per document the words kept, and with ``spell`` the passages to verify (owner's key, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text, blob in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("hits").to_pylist(), strict=True):
                words = text.split()
                gone, ask = 0, []
                kept = words
                if blob is not None:
                    pos, a, h = unpack(blob, *_HIT)
                    pos = pos.astype(np.int64)
                    at, size = _stretches(pos, a, h)
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, pos[at], 1)
                    np.add.at(mark, pos[at] + size + width - 1, -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    kept = [words[i] for i in np.flatnonzero(stay).tolist()]
                    gone = len(words) - len(kept)
                    if spell:
                        ask = list({(x, y, b" ".join(words[p : p + n + width - 1])) for p, n, x, y in zip(pos[at].tolist(), size.tolist(), a[at].tolist(), h[at].tolist(), strict=True)})
                rows.append((doc, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), [{"a": x, "h": y, "words": w} for x, y, w in ask]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("h", pa.int64()), ("words", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "ask"])

    joined = docs.join(hits, ["a", "h"], "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, ask array<struct<a:bigint,h:bigint,words:binary>>")


def _refuted(docs: DataFrame, asked: DataFrame, width: int, bits: int) -> DataFrame:
    """Fingerprints of windows in the asked passages whose words their owner doesn't have.

    An owner's text comes once, before the passages that are asked of it, however many they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner = None, b""
        for b in batches:
            bad: set[int] = set()
            for a, k, kind, text in zip(*(b.column(c).to_pylist() for c in ("a", "h", "kind", "text")), strict=True):
                if kind == 0:
                    if (a, k) != key:
                        key, owner = (a, k), b" " + b" ".join(text.split()) + b" "
                    continue
                if (a, k) != key:
                    raise ValueError("a passage is asked of a row that isn't there")
                if b" " + text + b" " in owner:
                    continue
                w = text.split(b" ")
                for h, i in zip(window_hashes(w, width, bits).view(np.int64).tolist(), range(len(w)), strict=False):
                    if b" " + b" ".join(w[i : i + width]) + b" " not in owner:
                        bad.add(h)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(bad), pa.int64())], ["fp"])

    # all texts move once: to keep the owners alone would move all texts to the join, and the owners' again
    both = docs.select("a", "h", "text", F.lit(0).alias("kind")).unionByName(asked.select("a", "h", F.col("words").alias("text"), F.lit(1).alias("kind")))
    return both.repartition("a", "h").sortWithinPartitions("a", "h", "kind").mapInArrow(run, "fp long")


def _exact(docs: DataFrame, bad: DataFrame, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """For colliding fingerprints: all their windows (a, h, pos), and those whose words a smaller doc_id also has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 19):
            for a, k, text in zip(*(b.column(c).to_pylist() for c in ("a", "h", "text")), strict=True):
                w = text.split()
                h = window_hashes(w, width, bits)
                if len(h):
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, a, np.int64)), pa.array(np.full(n, k, np.int64)), pa.array(np.arange(n)), pa.array([hashlib.sha256(b" ".join(w[i : i + width])).digest() for i in range(n)], pa.binary())], ["fp", "a", "h", "pos", "words"])

    windows = written(docs.select("a", "h", "text").mapInArrow(run, "fp long, a long, h long, pos long, words binary").join(bad, "fp", "left_semi"), "collisions")
    owners = windows.groupBy("words").agg(F.min(F.struct("a", "h")).alias("owner"))
    return windows.select("a", "h", "pos"), windows.join(owners, "words").filter("a > owner.a").select("a", "h", "pos", "owner")


def _replaced(hits: DataFrame, wrong: DataFrame, right: DataFrame) -> DataFrame:
    """Candidates with the windows ``wrong`` taken out and ``right`` put in."""
    change = wrong.groupBy("a", "h").agg(F.collect_set("pos").alias("drop")).join(right.groupBy("a", "h").agg(F.collect_set(F.struct("pos", "owner")).alias("add")), ["a", "h"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blob, drop, add in zip(*(b.column(c).to_pylist() for c in ("hits", "drop", "add")), strict=True):
                windows: dict[int, tuple[int, int]] = {}
                if blob is not None:
                    windows = {p: (x, y) for p, x, y in zip(*(v.tolist() for v in unpack(blob, *_HIT)), strict=True)}
                for p in drop or ():
                    windows.pop(p, None)
                windows |= {x["pos"]: (x["owner"]["a"], x["owner"]["h"]) for x in add or ()}
                cols = [(p, *windows[p]) for p in sorted(windows)]
                out.append(pack(*(np.array(c, t) for c, t in zip(zip(*cols, strict=True), _HIT, strict=True))) if cols else None)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("h"), pa.array(out, pa.binary())], ["a", "h", "hits"])

    return hits.join(change, ["a", "h"], "full").mapInArrow(run, "a long, h long, hits binary").filter("hits is not null")


def remove_repeats(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 after removing repeated windows.

    A word goes if a window of ``width`` words covers it whose words also start in a document with a smaller doc_id. A
    null or empty text has no words, one shorter than a window keeps all. Rows that share a doc_id are judged one by
    one, each against the rows of smaller ids, so windows that only they share stay and equal rows get equal results.
    Rows of a null doc_id are returned whole and own nothing. An empty table gives one.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col)
    n = buckets or min(MOST_BUCKETS, max(16, -(-plan_bytes(rows) // BUCKET_BYTES)))
    index = FingerprintIndex(spark, n, width, bits)
    known = rows.filter("doc_id is not null")
    bounds = docs.select(F.col(id_col).cast("long").alias("doc_id")).agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("b")).first()["b"] if batches > 1 else None
    edges = [None, *sorted(set(bounds or [])), None]
    found: list[DataFrame] = []
    for low, high in zip(edges, edges[1:], strict=False):
        batch = known.filter(F.col("doc_id") > low) if low is not None else known
        batch = batch.filter(F.col("doc_id") <= high) if high is not None else batch
        found.append(index.ingest(batch, keep=high is not None))
        release(spark)
    for path, _ in index.runs:  # nothing is looked up any more
        index.drop(path, 0)
    candidates = found[0]
    for f in found[1:]:
        candidates = candidates.unionByName(f)
    hits = written(collected(candidates, _HIT, "hits"), "passages")
    release(spark)
    for path in index.hits:
        index.drop(path, 2)
    first = written(_remove(rows, hits, width, spell=True), "kept", 1000)
    release(spark)
    asked = first.select(F.explode("ask").alias("a")).select("a.a", "a.h", "a.words").distinct()
    bad = written(_refuted(known, asked, width, bits).distinct(), "refuted", 500)
    out = first.drop("ask")
    if not bad.isEmpty():
        wrong, right = _exact(known, bad, width, bits)
        out = _remove(rows, written(_replaced(hits, wrong, right), "passages"), width, spell=False).drop("ask")
    return out


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
