"""Near-duplicate texts on word shingles: SimHash tiles inside bands of minimum hashes, verified by Jaccard similarity.

A 64-bit SimHash cannot tell a similarity of 0.8 from chance, so fingerprints here have ``BITS`` bits and the radius
covers that similarity by a wide margin. No block of bits then survives for sure, so the documents that meet in a tile
are those that agree in a band of minimum hashes (``BANDS`` bands of ``ROWS``: a pair at 0.8 misses all with probability
3e-5). Inside, tiles are compared exactly by exclusive-or and bit counts, tile pairs whose population counts differ by
more than the radius are skipped, and what lies within it is verified on the shingles' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import id_text, maybe_among, mix64, pack, slices, unpack, written
from strandlake.llm.components import components
from strandlake.llm.passages import _HASHES

WIDTH, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, and the radius for sets of any size: few shingles decide a bit by few votes, so it is wide.
BITS, RADIUS = 256, 96
BANDS, ROWS = 26, 5
SIDE = 512
_SEEDS = mix64(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MIN = mix64(np.arange(100, 100 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted (ASCII lower case; a shorter text is one shingle)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(out))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits as words of 64: each set if more than half of the shingles' hashes set it."""
    out = np.zeros(len(_SEEDS), np.uint64)
    for k, seed in enumerate(_SEEDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 15):
            ones += np.unpackbits(mix64(shingles[at : at + (1 << 15)] ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]
    return out


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash per band of minimum hashes."""
    least = np.full(len(_MIN), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * _MIN[None, :] ^ (shingles[at : at + 4096, None] >> np.uint64(29))).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = mix64(key ^ least.reshape(BANDS, ROWS)[:, r])
    return mix64(key + np.arange(BANDS, dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def tile_links(prints: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int, side: int = SIDE) -> list[tuple[int, int]]:
    """A forest (later, earlier) over the members that verified links connect; pairs already connected aren't verified."""
    n = len(prints)
    pop = np.bitwise_count(prints).sum(axis=1).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    pop = pop[order]
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    links = []
    for i in range(0, n, side):
        for j in range(i, n, side):
            if pop[j] - pop[min(i + side, n) - 1] > radius:
                break
            a, b = prints[order[i : i + side]], prints[order[j : j + side]]
            far = np.zeros((len(a), len(b)), np.uint16)
            for k in range(prints.shape[1]):
                far += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
            near = far <= radius
            if i == j:
                near = np.triu(near, 1)
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                u = int(order[i + x])
                for y in np.flatnonzero(near[x]).tolist():
                    v = int(order[j + y])
                    p, q = find(u), find(v)
                    if p != q and jaccard(sets[u], sets[v]) >= similarity:
                        top[max(p, q)] = min(p, q)
                        links.append((u, v))
    return links


def text_key(text_col: str) -> Column:
    """A hash that tells the texts of one doc_id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")))


def near_duplicate_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", member_limit: int = 4096) -> DataFrame:
    """doc_id, text_hash (``text_key`` of the text) and group: the smallest doc_id reached by links of at least ``similarity``.

    Texts of one shingle set are one class before any comparison; classes are compared, never copies. A band's bucket of
    more than ``member_limit`` classes is compared in blocks: block pairs meet in tasks of their own. Blank and null texts
    are one class. Rows of a null doc_id take no part; rows that share a doc_id but not their text are grouped each by its own.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets], pa.string()), pa.array([wide_fingerprint(s).tobytes() for s in sets], pa.binary()), pa.array([bands(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "class", "print", "bands"],
            )

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("print"), pa.array([pack(np.diff(shingle_set(t, width), prepend=np.uint64(0))) for t in b.column("text").to_pylist()], pa.binary())], ["rep", "print", "shingles"])

    texts = id_text(docs, id_col, text_col).filter("doc_id is not null").withColumn("text_hash", text_key("text"))
    rows = written(texts.mapInArrow(sketch, "doc_id long, text_hash long, class string, print binary, bands array<long>"), "sketches", 2000)
    classes = rows.groupBy("class").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = written(classes.select("class", F.monotonically_increasing_id().alias("rep"), "first.*"), "class-numbers")
    rep = written(rows.join(classes, ["class", "doc_id", "text_hash"]).select("rep", "doc_id", "text_hash", "print", "bands").dropDuplicates(["rep"]), "classes")
    buckets = rep.select("rep", F.explode("bands").alias("band"))
    # buckets of the same members, as two copies have in most bands, are compared once
    sums = [F.sum(f("rep").cast("decimal(38,0)")).alias(k) for f, k in ((F.xxhash64, "h"), (F.hash, "g"))]
    counts = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"), *sums).filter("n > 1")
    counts = written(counts.groupBy("n", "low", "high", "h", "g").agg(F.min("band").alias("band")).select("band", "n"), "bands")
    met = buckets.join(counts, "band").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / member_limit)).cast("int"))
    met = met.withColumn("p", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(0).cast("int"))
    met = met.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "rep")
    met = written(met, "band-members")
    asked = written(rep.join(met.select("rep").distinct(), "rep").select("rep", "doc_id", "text_hash", "print"), "asked")
    # of the texts only those that meet another one travel
    found = maybe_among(texts, asked, ["doc_id", "text_hash"], "maybe").filter("maybe").drop("maybe")
    sets = written(found.join(asked, ["doc_id", "text_hash"]).mapInArrow(spell, "rep long, print binary, shingles binary"), "shingle-sets", 2000).dropDuplicates(["rep"])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("rep").combine_chunks())
        order = np.argsort(ids, kind="stable")
        prints = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(len(ids), -1)
        blobs = table.column("shingles").to_pylist()
        links = tile_links(prints[order], [np.cumsum(unpack(blobs[i], np.uint64)[0], dtype=np.uint64) for i in order.tolist()], similarity, RADIUS)
        ids = ids[order]
        return pa.table({"u": pa.array([ids[x] for x, _ in links], pa.int64()), "v": pa.array([ids[y] for _, y in links], pa.int64())})

    full = met.join(sets, "rep")
    edges = full.groupBy("band", "a", "b").applyInArrow(compare, "u long, v long")
    linked = written(components(edges).withColumnRenamed("id", "rep").join(classes.select("rep", "doc_id"), "rep"), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("group"))
    named = classes.join(linked.join(least, "root").select("rep", "group"), "rep", "left").select("class", F.coalesce("group", "doc_id").alias("group"))
    return rows.select("doc_id", "text_hash", "class").join(written(named, "groups"), "class").select("doc_id", "text_hash", "group")
