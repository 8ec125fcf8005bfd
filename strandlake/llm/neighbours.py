"""Approximate nearest neighbours by collision counting (Huang et al., 2015), for the largest inner product.

Vectors x of norm at most M become (x, sqrt(M^2 - |x|^2)) / M and a query q becomes (q, 0) / |q|: then the largest
inner product is the smallest distance. A line is one random projection; an index keeps, per line, its projections in
one sorted array. A query stands in the middle of a window on every line. Virtual rehashing widens all windows by a
factor at a time and counts only what each widening adds; a vector whose count reaches the threshold is verified by its
exact inner product, and widening stops by the distance of the k-th best verified vector. Equal vectors are one entry.
A block of vectors has one index for each range of norms (a factor of two), so that a few long vectors don't press the
others together; ranges that can't hold better ones are left out, few vectors are all verified. Queries travel to the
blocks. All sizes are held as powers of two beside scaled vectors, so no finite vector over- or underflows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.blocks import BLOCK_ROWS, in_blocks, meet, shares, sound_vector, vectors_by_size
from strandlake.llm.common import written

#: Lines, share of them in which a vector must collide, and the factor by which windows widen.
LINES, SHARE, WIDER = 64, 0.75, 1.05
#: The first half-width is so much of the usual last one, by so many vectors of the index taken as queries.
FIRST, TRIED = 0.95, 32
#: A query is done with a block once its windows' half-width is so many times the distance of its k-th best verified
#: vector: one at that distance collides in a line with probability erf(REACH / sqrt 2) = 0.82, so that it misses the
#: threshold with 0.06, and nearer ones with less. Measured recall is in the README.
REACH = 1.34
#: Queries of a part at 64 dimensions (fewer at more), and vectors of a range of norms that are verified without an index.
QUERY_ROWS, FEW = 1_024, 64


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors over a power of two that makes their largest component 0.5 to 1, its exponent, and log2 of their norm.

    Powers of two change no digit: inner products of scaled vectors, scaled back, are those of the vectors.
    """
    _, e = np.frexp(np.abs(vectors).max(axis=1))
    out = np.ldexp(vectors, -e[:, None])
    return out, e, e + 0.5 * np.log2(np.einsum("ij,ij->i", out, out))


#: Scores below this have lost digits or all of themselves to underflow.
TINY = 2.0**-1000


class CollisionIndex:
    """The sorted projections of some vectors (none of them zero), and their search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 7, k: int = 20):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, which = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.raw = vectors[first]
        self.vectors, self.exponents, norms = scaled(self.raw)
        self.threshold, self.top = max(1, int(SHARE * lines)), float(norms.max())
        by = np.argsort(which, kind="stable")
        self.ids, self.starts = ids[by], np.searchsorted(which[by], np.arange(len(first) + 1))
        #: vectors of norm 1 at most, the longest of 1
        self.unit = self.vectors * np.exp2(self.exponents - self.top)[:, None]
        if len(first) <= FEW:
            return
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, lines))
        lift = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", self.unit, self.unit)))
        at = np.hstack([self.unit, lift[:, None]]) @ self.lines
        self.order = np.argsort(at, axis=0, kind="stable").T.astype(np.intp, order="C")
        self.sorted = np.take_along_axis(at, self.order.T, axis=0).T.copy()
        self.room = np.empty(self.order.size, np.intp)
        tried = self.unit[:: -(-len(first) // TRIED)]
        near = np.partition(tried @ self.unit.T / np.linalg.norm(tried, axis=1)[:, None], -min(k + 1, len(first)), axis=1)[:, -min(k + 1, len(first))]
        self.width = max(1e-3, FIRST * REACH * float(np.median(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near)))))

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The inner products in double precision; where partial sums leave the doubles, those of scaled vectors, scaled back."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = np.einsum("ij,j->i", self.raw[at], query)
            if (odd := np.flatnonzero(~np.isfinite(out))).size:
                small, e, _ = scaled(query[None])
                out[odd] = np.ldexp(np.einsum("ij,j->i", self.vectors[at[odd]], small[0]), self.exponents[at[odd]] + e[0])
        return out

    def windows(self, centres: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query and line, where the window of half-width ``width`` begins and ends in the sorted array."""
        low = np.stack([np.searchsorted(s, c - width) for s, c in zip(self.sorted, centres.T, strict=True)], axis=1)
        high = np.stack([np.searchsorted(s, c + width, side="right") for s, c in zip(self.sorted, centres.T, strict=True)], axis=1)
        return low, high

    def _within(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The entries at places a to b and c to d of every line."""
        places = zip(self.order, a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)
        size = int((b - a + d - c).sum())
        return np.concatenate([part for o, i, j, k, m in places for part in (o[i:j], o[k:m])], out=self.room[:size])

    def candidates(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the entries that reached the threshold, in that order, and their products with the query, both of norm 1 at most.

        Windows widen by steps, the last one to REACH times the ``k``-th best distance so far, or hold the whole block.
        """
        n = len(self.vectors)
        small, exponents, norms = scaled(queries)
        unit = small * np.exp2(exponents - norms)[:, None]
        if n <= FEW:
            yield from ((np.arange(n), self.unit @ q) for q in unit)
            return
        centres = unit @ self.lines[:-1]
        middle = self.windows(centres, 0.0)[0]
        steps: list[tuple[np.ndarray, np.ndarray]] = []  # windows after each widening, for all queries
        for q, query in enumerate(unit):
            counts, new, found, products = np.zeros(n, np.int64), np.ones(n, bool), [], []
            step, width, goal = 0, self.width, math.inf
            low = high = middle[q]  # empty windows
            while True:
                if goal <= width:
                    width = goal
                    to_low, to_high = (w[0] for w in self.windows(centres[q : q + 1], width))
                else:
                    if step == len(steps):
                        steps.append(self.windows(centres, width))
                    to_low, to_high = steps[step][0][q], steps[step][1][q]
                # count what the widening adds, or afresh what is still outside, whichever is less
                outside = int((n - to_high + to_low).sum())
                if int((to_high - high + low - to_low).sum()) <= outside:
                    counts += np.bincount(self._within(to_low, low, high, to_high), minlength=n)
                else:
                    counts = len(self.order) - np.bincount(self._within(np.zeros_like(to_low), to_low, to_high, np.full_like(to_high, n)), minlength=n)
                low, high = to_low, to_high
                reached = np.flatnonzero(new & (counts >= self.threshold))
                if len(reached):
                    new[reached] = False
                    found.append(reached)
                    products.append(self.unit[reached] @ query)
                    if sum(map(len, found)) >= k:
                        # of the lifted unit vectors: the squared distance is 2 - 2 <x, q> / (norm |q|)
                        goal = REACH * math.sqrt(max(0.0, 2.0 - 2.0 * float(np.partition(np.concatenate(products), -k)[-k])))
                if goal <= width or not low.any() and (high == n).all():
                    yield np.concatenate(found), np.concatenate(products)
                    break
                step, width = step + 1, width * WIDER

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and exact scores of the k best candidates, ties to the smaller id, without its own id."""
        out = []
        # its own entry may hold a query's own id alone, hence k + 1
        for query_id, query, (found, near) in zip(query_ids.tolist(), queries, self.candidates(queries, k + 1), strict=True):
            if len(found) > k + 1:  # those that rounding can't keep out are scored exactly
                found = found[near >= np.partition(near, -(k + 1))[-(k + 1)] - 1e-9]
            scores = self.scores(found, query)
            if not TINY < np.abs(scores).max() < np.inf and len(found) < len(self.raw):
                found = np.arange(len(self.raw))  # distances say nothing about scores that all leave the doubles
                scores = self.scores(found, query)
            best = np.argsort(-scores, kind="stable")
            by_score = scores[best]
            # k + 1 entries and those that tie with the last of them, each with its k + 1 smallest ids
            cut = int(np.searchsorted(-by_score, -by_score[min(len(best), k + 1) - 1], side="right"))
            ids = [self.ids[self.starts[i] : self.starts[i + 1]][: k + 1] for i in found[best[:cut]].tolist()]
            score = np.repeat(by_score[:cut], [len(x) for x in ids])
            flat = np.concatenate(ids)
            flat, score = flat[flat != query_id], score[flat != query_id]
            top = np.lexsort([flat, -score])[:k]
            out.append((flat[top], score[top]))
        return out


class NormRanges:
    """The vectors of a block and one number of dimensions: an index for each factor of two of their norms, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = 20):
        norms = scaled(vectors)[2]
        rank = np.floor(norms.max() - norms).astype(np.int64)
        self.indexes = [CollisionIndex(ids[rank == r], vectors[rank == r], k=k) for r in np.unique(rank).tolist()]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and exact scores of the k best found, ties to the smaller id, without its own id."""
        norms = scaled(queries)[2]
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        kth = np.full(len(query_ids), -np.inf)  # log2 of the k-th best score, where it is positive and finite
        for index in self.indexes:
            todo = np.flatnonzero(kth <= index.top + norms + 1e-9)
            for q, (ids, scores) in zip(todo.tolist(), index.search(query_ids[todo], queries[todo], k), strict=True):
                ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                top = np.lexsort([ids, -scores])[:k]
                best[q] = ids[top], scores[top]
                if len(top) == k and 0 < scores[top[-1]] < np.inf:
                    kth[q] = np.log2(scores[top[-1]])
        return best


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest inner products found for each query.

    Both tables have vec_id and an array column ``embedding``; a candidate of the query's own id doesn't count. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor does a null vec_id; vectors of
    different lengths have no inner product and don't meet. Components may have any finite size: a score that leaves the
    doubles is infinite or zero. Repeated rows are candidates of their own. The queries are a stated set against all
    rows: blocks of both sides meet pair by pair, each in bounded memory, and every pair yields its k best at most.
    """

    def sound(df: DataFrame) -> DataFrame:
        v, fine = sound_vector()
        return df.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(fine & F.exists("v", lambda x: x != 0))

    rows, asked = written(sound(vectors), "vectors"), sound(queries)
    n_blocks, n_parts = shares(rows, block_rows), shares(asked, query_rows)
    blocks = written(in_blocks(rows, n_blocks, "vec_id"), "vector-blocks")
    parts = written(in_blocks(asked, n_parts, "vec_id"), "query-blocks")

    def build(table: pa.Table) -> dict[int, NormRanges]:
        ids = np.asarray(table.column("vec_id").combine_chunks(), np.int64)
        return {dim: NormRanges(ids[at], v, k) for dim, (at, v) in vectors_by_size(table).items()}

    def ask(ranges: dict[int, NormRanges], table: pa.Table) -> Iterator[pa.RecordBatch]:
        all_ids = np.asarray(table.column("vec_id").combine_chunks(), np.int64)
        for dim, (at, v) in vectors_by_size(table).items():
            if dim in ranges:
                ids = all_ids[at]
                found = ranges[dim].search(ids, v, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "vec_id", "score"])

    found = meet(blocks, n_blocks, parts, n_parts, build, ask, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
