"""SimHash fingerprints and the groups of those within a radius, by tiled exact comparison.

Two fingerprints at most r bits apart agree on one of r + 1 blocks of bits, so every pair that can link meets in a tile
of equal block values. Inside, the fingerprints are sorted by their population count and compared tile against tile by
exclusive-or and bit counts; two tiles whose counts lie further apart than r are skipped. A tile yields a star per
group, never its pairs. Equal fingerprints are one node from the start, and a tile above ``TILE_LIMIT`` fingerprints is
split into blocks that are compared pair by pair in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import id_text, slices, written
from strandlake.llm.components import components

SIDE = 1024
TILE_LIMIT = 1 << 14


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words (ASCII lower case, joined by one space), repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long). A null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(shingle_hashes(t, width, seed)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def tile_groups(fps: np.ndarray, radius: int, side: int = SIDE) -> np.ndarray:
    """For each of the distinct ``fps`` the index of its group's first member, exactly."""
    n = len(fps)
    if n == 2:
        return np.array([0, 0 if (int(fps[0]) ^ int(fps[1])).bit_count() <= radius else 1])
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    f, pop = fps[order], pop[order].astype(np.int64)
    label = np.arange(n)
    while True:
        best = label.copy()
        for i in range(0, n, side):
            for j in range(i, n, side):
                if pop[j] - pop[min(i + side, n) - 1] > radius:
                    break  # counts only grow from here on
                near = np.bitwise_count(f[i : i + side, None] ^ f[None, j : j + side]) <= radius
                if i == j and np.count_nonzero(near) == near.shape[0] or not near.any():
                    continue
                a, b = slice(i, i + side), slice(j, j + side)
                best[a] = np.minimum(best[a], np.where(near, label[None, b], n).min(axis=1))
                best[b] = np.minimum(best[b], np.where(near, label[a, None], n).min(axis=0))
        hook = np.arange(n)
        np.minimum.at(hook, label, best)
        while (hook[hook] != hook).any():
            hook = hook[hook]
        if (hook[label] == label).all():
            break
        label = hook[label]
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def link(nodes: DataFrame, radius: int = 2, tile_limit: int = TILE_LIMIT) -> DataFrame:
    """``nodes`` (fp: distinct longs) to (id, root) for those within ``radius`` bits of another one."""
    edges = [0, *(64 * (k + 1) // (radius + 1) for k in range(radius + 1))]
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col("fp"), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1).cast("long")).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    tiles = nodes.select("fp", F.explode(blocks).alias("t")).select("t.block", "t.value", "fp")
    tiles = written(tiles, "tiles")
    full = written(tiles.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > tile_limit), "hot-tiles")
    keyed = tiles.withColumns({"a": F.lit(0), "b": F.lit(0)})
    if not full.isEmpty():
        # a row of part p goes to the part pairs (p, q) and (q, p): every pair of rows meets in one task of bounded size
        parts = full.select("block", "value", F.ceil(F.col("n") * 2 / tile_limit).cast("int").alias("parts"))
        split = tiles.join(parts, ["block", "value"]).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        split = split.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = keyed.join(full.select("block", "value"), ["block", "value"], "left_anti").unionByName(split.select("block", "value", "fp", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0, np.uint64)

        def stars(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            g = tile_groups(f, radius)
            out = np.flatnonzero(g != np.arange(len(f)))
            return f[out], f[g[out]]

        for b in batches:
            cols = [np.asarray(b.column(c)) for c in ("block", "value", "a", "b")]
            fps = np.asarray(b.column("fp")).view(np.uint64)
            new = np.zeros(len(fps), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cut = np.flatnonzero(new)
            us, vs = [], []
            starts, stops = [0, *cut.tolist()], [*cut.tolist(), len(fps)]
            for s, e in zip(starts, stops, strict=True):
                now = tuple(int(c[s]) for c in cols)
                if now == key:
                    held = np.concatenate([held, fps[s:e]])
                    continue
                if len(held) > 1:
                    u, v = stars(held)
                    us.append(u)
                    vs.append(v)
                key, held = now, fps[s:e]
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], ["u", "v"])
        if len(held) > 1:
            u, v = stars(held)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    by = ["block", "value", "a", "b"]
    return components(keyed.select(*by, "fp").repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", tile_limit: int = TILE_LIMIT) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that it reaches by links).

    Null and blank texts have fingerprint zero and link like any other; repeated rows and ties share their component.
    A null doc_id stays in the result and never names a component unless all of one's ids are null.
    """
    fps = written(simhash(docs, width, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = written(link(nodes.select("fp"), radius, tile_limit), "groups")
    least = groups.join(nodes, groups["id"] == nodes["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    names = nodes.join(groups.join(least, "root").select(F.col("id").alias("fp"), "least"), "fp", "left")
    # written, so that the last join deals both sides anew and Spark can split a hot fingerprint
    names = written(names.select("fp", F.coalesce("least", "first").alias("component_id")), "names")
    return fps.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
