"""Document quality from a linear-chain conditional random field over lines.

Every line has one of two labels, good or bad. Its evidence are bins of simple measures of the line and of the lines
before and after it; the chain's transitions carry evidence along the document. Forward-backward gives each line's
marginal, and the marginals, weighted by the lines' lengths, give the document's quality, which a logistic curve
calibrates. Training needs labels of documents only: at first all lines take their document's label, then lines of bad
documents that look good by themselves are relabelled, and the chain is fitted again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import id_text, pack, slices, small_batches, unpack

#: Labelled documents that training reads at most: those of the smallest hashes of their ids.
TRAIN_DOCUMENTS = 4_000
BINS = 8
ROUNDS = 60

_KIND = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 1 if "a" <= _ch <= "z" or _c >= 128 else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9" else 0 if _c in (32, 9, 10, 11, 12, 13) else 4 if _ch in ".,;:'\"!?()-" else 5
MEASURES = 13


def line_measures(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Measures (lines x MEASURES) and lengths in bytes of the lines of a text; an empty text is one empty line."""
    lines = text.split(b"\n")
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    kind = _KIND[np.frombuffer(text, np.uint8)]
    upto = np.zeros((6, len(kind) + 1), np.int64)
    for k in range(1, 6):
        np.cumsum(kind == k, out=upto[k, 1:])
    lower, upper, digit, mark, odd = (upto[k, starts + sizes] - upto[k, starts] for k in range(1, 6))
    seen = Counter(lines)
    out = np.zeros((n, MEASURES), np.float32)
    for i, line in enumerate(lines):
        words = line.split()
        w = len(words)
        if w:
            out[i, 0] = w
            out[i, 1] = len(set(words)) / w
            out[i, 2] = sum(map(eq, words, words[1:])) / w
            # the mean over stretches of 200 words, so that the length of a line doesn't decide
            out[i, 3] = sum(len(set(words[k : k + 200])) for k in range(0, w, 200)) / w
        out[i, 4] = seen[line] > 1 and w > 0
    full = np.maximum(1, sizes - (out[:, 0] - 1).clip(0))
    out[:, 5], out[:, 6], out[:, 7], out[:, 8], out[:, 9] = upper / full, digit / full, mark / full, odd / full, lower / full
    out[:, 10] = (lower + upper) / np.maximum(1, out[:, 0])
    out[:, 11] = odd / np.maximum(1, out[:, 0])
    out[:, 12] = sizes
    return out, sizes


def _padded(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length: their first lines, lengths, and how many have more than t lines, for each t."""
    lengths = np.diff(cut)
    order = np.argsort(-lengths, kind="stable")
    return cut[:-1][order], lengths[order], len(lengths) - np.searchsorted(np.sort(lengths), np.arange(int(lengths.max(initial=0))), side="right")


def forward_backward(score: np.ndarray, trans: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 per line, and of label pairs of a line and the one before it (zero for first lines).

    ``score`` is the log-odds of each line's own evidence, ``trans`` the 2 x 2 log weights, ``cut`` the documents' bounds.
    """
    start, _, live = _padded(cut)
    own = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
    step = np.exp(trans)
    ahead, behind = own.copy(), np.ones_like(own)
    for t, n in enumerate(live.tolist()):
        at = start[:n] + t
        if t:
            ahead[at] *= ahead[at - 1] @ step
        ahead[at] /= ahead[at].sum(axis=1, keepdims=True)
    for t in range(len(live) - 2, -1, -1):
        at = start[: live[t + 1]] + t
        b = (own[at + 1] * behind[at + 1]) @ step.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    pairs = np.zeros((len(score), 2, 2))
    inner = np.ones(len(score), bool)
    inner[cut[:-1][np.diff(cut) > 0]] = False
    i = np.flatnonzero(inner)
    p = ahead[i - 1][:, :, None] * step[None] * (own[i] * behind[i])[:, None, :]
    pairs[i] = p / p.sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class LineChain:
    """A fitted chain: bin edges, weights by (neighbour, measure, bin), transitions, and the calibration."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def bins(self, measures: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, measures[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def evidence(self, bins: np.ndarray, cut: np.ndarray) -> np.ndarray:
        score = np.full(len(bins), self.bias)
        for side, b in enumerate(_sides(bins, cut)):
            for k in range(b.shape[1]):
                score += self.weights[side, k, b[:, k]]
        return score

    def marginals(self, measures: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return forward_backward(self.evidence(self.bins(measures), cut), self.trans, cut)[0]

    def score(self, marginals: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Documents' quality: the length-weighted mean of the marginals, calibrated."""
        mean = _mean(marginals, sizes, cut)
        return 1 / (1 + np.exp(-(self.curve[0] * _logit(mean) + self.curve[1])))


def _sides(bins: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Bins of the line, of the one before and of the one after; beyond a document's ends, the last bin of all."""
    none = np.full((1, bins.shape[1]), BINS)
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    some = np.diff(cut) > 0
    before[cut[:-1][some]] = BINS
    after[cut[1:][some] - 1] = BINS
    return [bins, before, after]


def _mean(marginals: np.ndarray, sizes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    weight = sizes + 1.0
    return np.add.reduceat(marginals * weight, cut[:-1]) / np.add.reduceat(weight, cut[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _ascend(chain: LineChain, bins: np.ndarray, cut: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int) -> None:
    """Maximise the penalised conditional likelihood by Adam on the whole sample."""
    sides = _sides(bins, cut)
    cells = [[(side, k, b[:, k]) for k in range(b.shape[1])] for side, b in enumerate(sides)]
    pair = np.zeros((len(y), 2, 2))
    inner = np.ones(len(y), bool)
    inner[cut[:-1]] = False
    i = np.flatnonzero(inner)
    pair[i, y[i - 1], y[i]] = 1
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (chain.weights, chain.trans, np.zeros(1))]
    for r in range(1, rounds + 1):
        p, pairs = forward_backward(chain.evidence(bins, cut), chain.trans, cut)
        miss = (y - p) * weight
        grads = [np.zeros_like(chain.weights), ((pair - pairs) * weight[:, None, None]).sum(axis=0), np.array([miss.sum()])]
        for side in cells:
            for s, k, b in side:
                grads[0][s, k] = np.bincount(b, miss, BINS + 1)
        scale = weight.sum()
        grads = [grads[0] / scale - 1e-3 * chain.weights, grads[1] / scale - 1e-2 * chain.trans, grads[2] / scale]
        steps = []
        for g, s in zip(grads, state, strict=True):
            s[0][:] = 0.9 * s[0] + 0.1 * g
            s[1][:] = 0.99 * s[1] + 0.01 * g * g
            steps.append(0.15 * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-8))
        chain.weights += steps[0]
        chain.trans += steps[1]
        chain.bias += float(steps[2][0])


def fit(measures: np.ndarray, sizes: np.ndarray, cut: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> LineChain:
    """Fit a chain to documents (lines ``cut[i]`` to ``cut[i + 1]``, label 0 or 1)."""
    edges = np.stack([np.quantile(measures[:, k], np.arange(1, BINS) / BINS) for k in range(measures.shape[1])])
    for k in range(len(edges)):  # evidence is often in the tail: two of the edges stand there
        edges[k, 0], edges[k, -1] = np.quantile(measures[:, k], (0.03, 0.97))
    edges.sort(axis=1)
    chain = LineChain(edges, np.zeros((3, measures.shape[1], BINS + 1)), 0.0, np.zeros((2, 2)))
    lengths = np.diff(cut)
    y = np.repeat(labels, lengths).astype(np.int64)
    weight = np.repeat(1 / np.sqrt(lengths), lengths) * np.where(y == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean())).clip(0, 5)
    bins = chain.bins(measures)
    _ascend(chain, bins, cut, y, weight, rounds)
    alone = 1 / (1 + np.exp(-np.clip(chain.evidence(bins, cut), -30, 30)))
    worst = np.repeat(np.minimum.reduceat(alone, cut[:-1]), lengths)
    y = np.where((y == 0) & (alone > 0.7) & (alone > worst), 1, y)
    _ascend(chain, bins, cut, y, weight, rounds)
    x = _logit(_mean(chain.marginals(measures, cut), sizes, cut))
    a, b = 1.0, 0.0
    for _ in range(25):  # Newton on the two parameters, with a weak prior
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((labels - p) * x).sum() - 0.1 * (a - 1), (labels - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -3, 3))
    chain.curve = (max(a, 1e-3), b)
    return chain


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> LineChain | None:
    """A chain from at most ``limit`` labelled documents that are not held out, None without both labels.

    The chosen ids are at most ``limit``, so broadcasting them is bounded; only their lines' measures reach the driver.
    """
    ids = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [line_measures(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([pack(m.reshape(-1)) for m, _ in rows], pa.binary())], ["doc_id", "quality", "measures"])

    rows = id_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(measure, "doc_id long, quality int, measures binary")
    rows = rows.orderBy(F.xxhash64("doc_id", "measures"), "doc_id", "measures").limit(limit).collect()  # an id may have many rows
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["measures"])))
    y = np.array([r["quality"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    each = [unpack(bytes(r["measures"]), np.float32)[0].reshape(-1, MEASURES) for r in rows]
    measures = np.concatenate(each)
    return fit(measures, measures[:, 12].astype(np.int64), np.cumsum([0, *map(len, each)]), y)


def scored(docs: DataFrame, chain: LineChain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_good (lines likelier good) and score of every document; 0.5 for all without a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [line_measures(t) for t in b.column("text").to_pylist()]
            cut = np.cumsum([0, *(len(m) for m, _ in rows)])
            if chain is None:
                good, score = np.zeros(len(rows), np.int64), np.full(len(rows), 0.5)
            else:
                p = chain.marginals(np.concatenate([m for m, _ in rows]), cut)
                score = chain.score(p, np.concatenate([s for _, s in rows]), cut)
                good = np.add.reduceat((p >= 0.5).astype(np.int64), cut[:-1])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(cut)), pa.array(good), pa.array(score)], ["doc_id", "n_lines", "n_good", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_lines long, n_good long, score double")


def quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted, n_lines, n_good.

    A null text is an empty one: one empty line. Rows of a null id are scored and never train. Labels other than 0 and
    1, and labels without a document, are ignored; a document labelled twice counts as the worse. Equal texts score equally.
    """
    out = scored(docs, train(docs, labels, limit, id_col, text_col), id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def filtered(docs: DataFrame, chain: LineChain | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``; all columns pass through, nothing is shuffled.

    Without a chain all rows stay. A null text is scored as an empty one; null doc_ids, repeated rows and ties are rows
    like any other, and an empty table gives one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            at = 0
            texts = pa.RecordBatch.from_arrays([b.column(text_col).cast(pa.binary()).fill_null(b"")], ["text"])
            for part in slices([texts]):
                rows = [line_measures(t) for t in part.column("text").to_pylist()]
                cut = np.cumsum([0, *(len(m) for m, _ in rows)])
                if chain is not None:
                    p = chain.marginals(np.concatenate([m for m, _ in rows]), cut)
                    keep[at : at + len(rows)] = chain.score(p, np.concatenate([s for _, s in rows]), cut) >= least
                at += len(rows)
            yield b.filter(pa.array(keep))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
