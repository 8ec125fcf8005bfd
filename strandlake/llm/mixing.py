"""Mixing sources to target weights by the cube method of balanced sampling.

A source that must give t words out of s gives every document floor(t / s) times; the fraction t / s - floor(t / s)
that is left is an inclusion probability, and the cube method (Deville and Tille, 2004) turns it into 0 or 1 while it
keeps the source's totals of documents and of tokens. The flight moves the probabilities along the null space of the
two constraints, three documents at a time, until one of them is 0 or 1. It runs block by block: the documents of a
source are dealt over blocks by a hash of their row, each block keeps back a few documents of all sizes and leaves at most
two others fractional, and what is left of all blocks meets in a flight of fewer blocks, until a source is one block. The
landing there draws the last two documents and then exchanges taken documents for others of about the size that the
draw added or lacks, so that the words stay at the target and the number of documents with them. No task ever holds a
whole source, and what is balanced is the whole source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import mix64, slices, written
from strandlake.llm.places import keyed_text

#: Documents of one source that a flight handles at a time, in the first round and in those that follow.
BLOCK = 2_000
#: Documents of a block, of all sizes, that only the last flight decides, so that the landing has what to exchange.
KEPT_BACK = 8
EPS = 1e-9

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text of a binary array."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_binary(texts.type) else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(n, np.int64)
    space = _SPACE[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    start = ~space
    start[1:] &= space[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = ~space[first]
    upto = np.concatenate([[0], np.cumsum(start)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def document_sizes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (the words of the text; null or empty: 0), a and h (the row's key; equal rows share it)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(word_counts(b.column("text"))), b.column("a"), b.column("h")], ["doc_id", "source", "size", "a", "h"])

    source = (F.col(source_col) if source_col in docs.columns else F.lit(None)).cast("string")
    rows = keyed_text(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), source.alias("source")), keep=["source"])
    return rows.mapInArrow(count, "doc_id long, source string, size long, a long, h long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """Per source: source_size, target.

    Sources in code point order (null last) take the weights in turn and share the whole size; a target above cap times
    the source's size stops there and the excess is shared again by weight. The fixed point is min(cap * size, weight *
    level) for one level: sources stop in the order of cap * size / weight, so running sums in that order give it.
    The window runs over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("stop", F.col("source_size") * cap / F.col("weight"))
    by_stop, whole = Window.orderBy("stop", F.col("source").asc_nulls_last()), Window.partitionBy()
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(whole),
            "before": F.coalesce(F.sum(F.col("source_size") * cap).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # the level if this source is the first that doesn't stop; it holds for the first one whose stop is not below it
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    per = per.withColumn("fits", F.col("level") <= F.col("stop"))
    per = per.withColumn("level", F.min(F.when(F.col("fits"), F.struct("stop", "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.coalesce(F.least(F.col("source_size") * cap, F.col("weight") * F.col("level")), F.col("source_size") * cap).alias("target"))


def _fly(q: list[float], x: list[float], units: range, draws: list[float]) -> list[int]:
    """Move the probabilities ``q`` of ``units`` (sizes ``x``), in this order, and return the units that stay fractional.

    Three units have a one-dimensional null space of the constraints (1, size): their cross product. Moving along it
    either way until a probability is 0 or 1 keeps both totals; the way is drawn so that expectations hold.
    """
    live: list[int] = []
    for i in units:
        if q[i] <= EPS or q[i] >= 1 - EPS:
            q[i] = float(round(q[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if (top := max(map(abs, u))) < EPS:
                u, top = (1.0, -1.0, 0.0), 1.0  # equal sizes: any exchange keeps both totals
            up = down = math.inf
            for k, v in zip(live, u, strict=True):
                if v > EPS * top:
                    up, down = min(up, (1 - q[k]) / v), min(down, q[k] / v)
                elif v < -EPS * top:
                    up, down = min(up, q[k] / -v), min(down, (1 - q[k]) / -v)
            step = up if draws[i] * (up + down) < down else -down
            for k, v in zip(live, u, strict=True):
                q[k] = min(1.0, max(0.0, q[k] + step * v))
                if q[k] <= EPS or q[k] >= 1 - EPS:
                    q[k] = float(round(q[k]))
            live = [k for k in live if 0 < q[k] < 1]
    return live


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities after the cube method's flight over units in falling order of size; at most two stay fractional."""
    q, x = p.astype(float).tolist(), (size / max(1.0, float(size.max(initial=1)))).tolist()
    _fly(q, x, range(len(q)), draws.tolist())
    return np.asarray(q)


def landed(p: np.ndarray, q: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The landing: the fractional units of ``q`` are drawn, then exchanges bring the words back to those of ``p``.

    An exchange takes one unit for another and keeps their number; a single unit changes only where no exchange helps
    and it halves what is lacking at least.
    Every step brings the words nearer to the target, and units that were certain stay so.
    """
    q = np.where((q > 0) & (q < 1), (draws < q).astype(float), q)
    free = (p > EPS) & (p < 1 - EPS)
    lack = float(((p - q) * size).sum())
    while abs(lack) >= 1 or free.any() and abs(lack) > 0.5:
        out, in_ = np.flatnonzero(free & (q == 0)), np.flatnonzero(free & (q == 1))
        out, in_ = out[np.argsort(size[out], kind="stable")], in_[np.argsort(size[in_], kind="stable")]
        best, change = abs(lack), None
        if len(out) and len(in_):
            at = np.searchsorted(size[in_], size[out] - lack)
            for near in (at.clip(0, len(in_) - 1), (at - 1).clip(0, len(in_) - 1)):
                left = np.abs(lack - (size[out] - size[in_[near]]))
                k = int(np.argmin(left))
                if left[k] < best:
                    best, change = float(left[k]), [(out[k], 1.0), (in_[near[k]], 0.0)]
        side = out if lack > 0 else in_
        if change is None and len(side):
            left = np.abs(abs(lack) - size[side])
            k = int(np.argmin(left))
            if left[k] < best / 2:
                best, change = float(left[k]), [(side[k], float(lack > 0))]
        if change is None:
            break
        for i, v in change:
            q[i] = v
        lack = float(((p - q) * size).sum())
    return q


def _draws(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(keys.view(np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(float) / 2.0**53


_UNIT = "source string, doc_id long, size long, p double, n long, a long, h long, key long"


def cube_sample(units: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``units`` (source, doc_id, size, p, n: the units of its source, a, h, key: a hash of the row) with take 0 or 1."""

    if block < 3:
        raise ValueError("a flight needs three units at least")
    kept = max(0, min(KEPT_BACK, block // 4 - 2))

    def round_of(last: bool, salt: int):
        def fly(table: pa.Table) -> pa.Table:
            size, p, key = (np.asarray(table.column(c).combine_chunks()) for c in ("size", "p", "key"))
            order = np.lexsort([key, -size])  # large documents first: those that are still fractional at the end are small
            size, p, draws = size[order], p[order], _draws(key[order], seed + salt)
            if last:
                q = landed(p, flight(p, size, draws), size, draws)
            else:
                fly_now = np.ones(len(p), bool)
                fly_now[np.linspace(0, len(p) - 1, kept).astype(int)] = False  # of all sizes
                q = p.copy()
                q[fly_now] = flight(p[fly_now], size[fly_now], draws[fly_now])
            table = table.take(pa.array(order))
            return table.set_column(table.column_names.index("p"), "p", pa.array(q))

        return fly

    done, rest, salt = [], units, 0
    most = units.agg(F.max("n")).first()[0] or 0
    while True:
        last = most <= block
        blocks = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("key", F.lit(salt)), F.ceil(F.col("n") / block))
        flown = written(rest.withColumn("block", blocks).groupBy("source", "block").applyInArrow(round_of(last, salt), _UNIT + ", block long"), "cube")
        done.append(flown if last else flown.filter((F.col("p") == 0) | (F.col("p") == 1)))
        if last:
            break
        # each block leaves two units and those kept back at most, so a source has at most this many in the next round
        left = kept + 2
        rest = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("n", F.least("n", (left * F.ceil(F.col("n") / block)).cast("long"))).drop("block")
        most, salt = left * math.ceil(most / block), salt + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "a", "h", F.round("p").cast("int").alias("take"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, seed: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies (how often the mix takes it), taken (copies * size), source, a, h (its key).

    A null text has size 0, a null source is a source of its own (the last). Rows without a doc_id and rows that repeat
    one are units of their own. A source without words keeps target 0 and takes none. An empty table gives an empty one.
    Equal rows are numbered over the whole table, each a unit of its own, so the draws depend on the rows and ``seed`` only,
    not on files or batches: reruns agree, also over another layout. Of equal rows any may be the one that is taken.
    """
    sizes = written(document_sizes(docs, text_col, id_col, source_col), "sizes")
    targets = source_targets(sizes, weights, cap)
    counts = sizes.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "c_source")
    t = targets.withColumnRenamed("source", "t_source").join(counts, F.col("t_source").eqNullSafe(F.col("c_source"))).drop("c_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    whole = F.floor(F.col("rate") + EPS)
    t = written(t.withColumn("rate", rate).withColumn("base", whole.cast("long")).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0))), "source-rates")
    alike = sizes.groupBy("source", "doc_id", "size", "a", "h").agg(F.count("*").alias("m"))
    units = alike.withColumn("salt", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")
    rows = units.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    flown = cube_sample(rows.select("source", "doc_id", "size", "p", "n", "a", "h", F.xxhash64("a", "h", "salt").alias("key")), seed, block)
    out = flown.join(t.select("t_source", "source_size", "target", "base"), F.col("source").eqNullSafe(F.col("t_source")))
    copies = F.col("base") + F.col("take")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"), "source", "a", "h")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows of one doc_id, text and source share what the mix takes of them, the first ones in turn taking the odd one.
    The source is a key that is never null: the join and the window then have the same keys and texts are shuffled once.
    """

    def never_null(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), c), F.lit(""))

    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    taken = taken.groupBy("a", "h", "source").agg(F.sum("copies").alias("__c"), F.count("*").alias("__m")).select(F.col("a").alias("__x"), F.col("h").alias("__y"), never_null(F.col("source")).alias("__z"), "__c", "__m")
    source = (F.col(source_col) if source_col in docs.columns else F.lit(None)).cast("string")
    # the row travels as one column, so that its own names can't clash with those used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = keyed_text(docs.select(row, F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), never_null(source).alias("__s")), "__id", "__text", keep=["__row", "__s"], names=("__doc", "__a", "__h", "__bytes"))
    one = Window.partitionBy("__a", "__h", "__s").orderBy(*[F.col("__row").getField(c) for c, kind in docs.dtypes if "map" not in kind])
    rows = keyed.drop("__doc", "__bytes").join(written(taken, "copies"), (F.col("__a") == F.col("__x")) & (F.col("__h") == F.col("__y")) & (F.col("__s") == F.col("__z")))
    share = F.floor((F.col("__c") + F.col("__m") - F.row_number().over(one)) / F.col("__m"))
    return rows.withColumn("__n", share.cast("long")).filter("__n > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select("__row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "a", "h")
