"""Hard negatives by a vector-approximation file (Weber, Schek and Blott, 1998).

Rows lie in blocks, dealt by a hash of their id. In a block each dimension is cut into ``CELLS`` cells at the block's own
quantiles, and a row is approximated by its cells, a byte for each dimension. For an anchor a table gives the least and
the greatest share of a score that each cell allows; so a row's lower and upper bound are sums of looked-up integers.
Only rows whose bounds say that they may enter an anchor's answer are scored exactly: those that may be among its
nearest of the same label, then those that may be among the first of a window of scores. Bounds are exact integers, so
nothing is lost. Anchors travel to the blocks in parts; of each meeting only an anchor's best rows come back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.blocks import BLOCK_ROWS, in_blocks, meet, shares, sound_vector, vectors_by_size
from strandlake.llm.common import written

#: Cells of a dimension.
CELLS = 256
#: Anchors of a part at 64 dimensions (fewer at more).
PART_ROWS = 512
#: Components are below this in the approximation file; rows with others are scored exactly, without bounds.
SMALL = 1 << 24
LONG = (1 << 63) - 1


def components(x: np.ndarray) -> np.ndarray:
    """floor(256 x), exact, as integers of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(256 * x)
    if (np.abs(scaled) < SMALL).all():
        return scaled.astype(np.int64)
    return np.array([math.floor(256 * v) if abs(v) < 2.0**900 else int(v) * 256 for v in x.tolist()], object)


def window(positive_score: int) -> tuple[int, int]:
    """The least and the greatest score of a negative: at least 50 % and at most 95 % of its positive's."""
    return -(-50 * positive_score // 100), 95 * positive_score // 100


def _clipped(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long count as the nearest long."""
    return np.array([max(-LONG - 1, min(LONG, int(s))) for s in scores], np.int64) if scores.dtype == object else scores


class VectorFile:
    """Rows of one dimension: their approximation, and the rows themselves, ordered by label and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]):
        order = np.lexsort([ids, labels])
        self.ids, self.labels = ids[order], labels[order]
        vectors = [vectors[i] for i in order.tolist()]
        self.large = np.array([i for i, v in enumerate(vectors) if v.dtype == object], np.int64)
        self.exact = vectors
        dim = len(vectors[0])
        small = np.array([np.zeros(dim, np.int64) if v.dtype == object else v for v in vectors], np.int64).reshape(len(vectors), dim)
        self.rows, self.most = small, int(np.abs(small).max(initial=0))
        edges = np.quantile(small, np.arange(1, CELLS) / CELLS, axis=0) if small.size else np.zeros((CELLS - 1, dim))
        self.cells = np.zeros((dim, len(small)), np.uint8)
        self.least, self.greatest = (np.zeros((dim, CELLS), np.int64) for _ in range(2))
        for d in range(dim):
            self.cells[d] = c = np.searchsorted(edges[:, d], small[:, d], side="right")
            low, high = np.full(CELLS, SMALL), np.full(CELLS, -SMALL)
            np.minimum.at(low, c, small[:, d])
            np.maximum.at(high, c, small[:, d])
            used = low <= high
            self.least[d, used], self.greatest[d, used] = low[used], high[used]

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())

    def bounds(self, query: np.ndarray, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """For the rows a to z the least and the greatest score that their cells allow."""
        kind = np.int32 if int(np.abs(query).max(initial=0)) * self.most * max(len(query), 1) < 1 << 31 else np.int64
        one, two = query[:, None] * self.least, query[:, None] * self.greatest
        out = []
        for side in (np.minimum(one, two).astype(kind), np.maximum(one, two).astype(kind)):
            total = np.zeros(z - a, kind)
            for table, cells in zip(side, self.cells[:, a:z], strict=True):
                total += table[cells]
            out.append(total.astype(np.int64))
        return out[0], out[1]

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The exact scores of the rows at ``at``."""
        if query.dtype == object or len(self.large) and np.isin(at, self.large).any():
            own = [int(x) for x in query]
            return _clipped(np.array([sum(int(x) * y for x, y in zip(self.exact[i].tolist(), own, strict=True)) for i in at.tolist()] + [None], object)[:-1])
        return self.rows[at] @ query

    def nearest(self, query: np.ndarray, anchor: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows of the label but the anchor's own."""
        a, z = self.of_label(label)
        at = np.arange(a, z)
        other = self.ids[a:z] != anchor
        if query.dtype != object:
            low, high = self.bounds(query, a, z)
            large = np.isin(at, self.large)
            sure = low[other & ~large]
            least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) >= k else -LONG
            other &= (high >= least) | large
        at = at[other]
        scores = self.scores(query, at)
        best = np.lexsort([self.ids[at], -scores.astype(object) if scores.size and scores.min() == -LONG - 1 else -scores])[:k]
        return self.ids[at[best]], scores[best]

    def between(self, query: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores the ids and scores of its ``k`` first rows of other labels."""
        a, z = self.of_label(label)
        n = len(self.ids)
        other = np.append(np.arange(a), np.arange(z, n))
        picked: list[np.ndarray] = []
        if query.dtype == object:
            picked = [other] * len(windows)
        else:
            low, high = (np.concatenate(x) for x in zip(self.bounds(query, 0, a), self.bounds(query, z, n), strict=True))
            large = np.isin(other, self.large)
            # what no window can hold goes first: all windows look at the rest only
            first, last = min(w[0] for w in windows), max(w[1] for w in windows)
            some = np.flatnonzero((high >= first) & (low <= last) | large)
            other, low, high, large = other[some], low[some], high[some], large[some]
            for first, last in windows:
                sure = low[(low >= first) & (high <= last) & ~large]
                least = max(first, int(np.partition(sure, len(sure) - k)[len(sure) - k])) if len(sure) >= k else first
                picked.append(other[(high >= least) & (low <= last) | large])
        out = []
        at = np.unique(np.concatenate(picked))
        scores = self.scores(query, at)
        for mine, (first, last) in zip(picked, windows, strict=True):
            i = np.searchsorted(at, mine)
            i = i[(scores[i] >= first) & (scores[i] <= last)]
            best = i[np.lexsort([self.ids[at[i]], -scores[i]])][:k]
            out.append((self.ids[at[best]], scores[best]))
        return out


def _files(table: pa.Table) -> dict[int, VectorFile]:
    """A file for each number of dimensions among the rows."""
    ids, labels = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("vec_id", "label"))
    return {dim: VectorFile(ids[at], labels[at], [components(x) for x in v]) for dim, (at, v) in vectors_by_size(table).items()}


def _asking(ask: Callable[[VectorFile, np.ndarray, dict], Iterator[tuple]], schema: str) -> Callable[[dict[int, VectorFile], pa.Table], Iterator[pa.RecordBatch]]:
    """The rows of longs that ``ask`` makes of each anchor of a part and the file of its number of dimensions."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(files: dict[int, VectorFile], table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = [row for r in table.to_pylist() if len(r["v"]) in files for row in ask(files[len(r["v"])], components(np.array(r["v"], np.float64)), r)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    return run


def sound(rows: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and v of the rows that take part; every ``relabel_every``-th id has the next label."""
    v, fine = sound_vector()
    i, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(i % relabel_every == 0, (label + 1) % labels).otherwise(label)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(i.alias("vec_id"), moved.alias("label"), v.alias("v")).filter(fine)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and each of its positives.

    Both tables have vec_id, label and v (see ``sound``). Scores are exact inner products of the components
    floor(256 x); rows of different lengths have no score and never meet; scores beyond a long count as the nearest
    long. A repeated row is a positive or negative of its own, and a repeated anchor has rows of its own; rows with the
    anchor's own id are never its positives. Anchors without positives, and positives whose window holds nothing, have
    no rows. Anchors are a stated set against all rows, so the work is their product; bounds only make it cheap.
    """
    spark = rows.sparkSession
    file = written(rows, "vectors")
    asked = written(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v"), "anchors")
    n_blocks, n_parts = shares(file, block_rows), shares(asked, part_rows)
    blocks = written(in_blocks(file, n_blocks, "vec_id"), "vector-files")

    def near(f: VectorFile, query: np.ndarray, r: dict) -> Iterator[tuple]:
        ids, scores = f.nearest(query, r["vec_id"], r["label"], positives)
        yield from ((r["anchor"], i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))

    schema = "anchor long, positive_id long, positive_score long"
    found = meet(blocks, n_blocks, in_blocks(asked, n_parts, "anchor"), n_parts, _files, _asking(near, schema), schema)
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    ranked = found.withColumn("no", F.row_number().over(best)).filter(F.col("no") <= positives)
    lists = ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("no", "positive_id", "positive_score"))).alias("p"))
    with_windows = written(asked.join(lists, "anchor").select(*asked.columns, F.transform("p", lambda x: x["no"].cast("long")).alias("no"), F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score")), "anchors-with-positives")

    def hard(f: VectorFile, query: np.ndarray, r: dict) -> Iterator[tuple]:
        open_ = [(no, i, s, window(s)) for no, i, s in zip(r["no"], r["positive_id"], r["positive_score"], strict=True) if window(s)[0] <= window(s)[1]]
        if open_:
            got = f.between(query, r["label"], [w for *_, w in open_], negatives)
            for (no, i, s, _), (ids, scores) in zip(open_, got, strict=True):
                yield from ((r["anchor"], no, r["vec_id"], i, s, n, t) for n, t in zip(ids.tolist(), scores.tolist(), strict=True))

    schema = "anchor long, no long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    held = meet(blocks, n_blocks, in_blocks(with_windows, n_parts, "anchor"), n_parts, _files, _asking(hard, schema), schema)
    first = Window.partitionBy("anchor", "no").orderBy(F.desc("negative_score"), "negative_id")
    out = held.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sound(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 50 == 0))
