"""K-mer operators over DataFrames of sequences: runs, windows, positions, minimizers and super-k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.nucleotides import MAX_LONG_K

_CODE = np.full(256, 255, np.uint8)
for _chars, _value in (("aA", 0), ("cC", 1), ("tT", 2), ("gG", 3)):
    for _c in _chars:
        _CODE[ord(_c)] = _value


def runs(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """Maximal stretches of at least k valid bases: (id, run, bases), without their places."""
    found = F.regexp_extract_all(F.col(seq_col), F.lit(f"[ACGTacgt]{{{k},}}"), F.lit(0))
    return seqs.select(id_col, F.posexplode(found).alias("run", "bases"))


#: K-mers of a sequence that a worker handles at a time, and rows of a batch, about.
SLICE, BATCH = 1 << 19, 500_000


def _scan(text: str, k: int, extra: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs, places and codes of the k-mers of valid bases, by slices; places count characters.

    Neighbouring slices share ``extra`` k-mers, so every window of ``extra`` + 1 k-mers lies in one slice.
    """
    b = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)  # a byte per character; what isn't Latin becomes "?"
    n, before, going = len(b) - k + 1, 0, False
    for s in range(0, max(0, n), SLICE):
        code = _CODE[b[s : s + SLICE + extra + k - 1]]
        wrong = np.concatenate([[0], np.cumsum(code == 255)])
        at = np.flatnonzero(wrong[k:] == wrong[:-k])
        value = np.zeros(len(at), np.int64)
        for j in range(k):
            value = value << 2 | code[at + j]
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        if len(at) and at[0] == 0 and going:
            new[0] = False
        yield before + np.cumsum(new) - 1, at + s, value
        before += int(np.count_nonzero(new[at < SLICE]))
        going = bool(len(at)) and bool((at == SLICE - 1).any())


def _batches(columns: list[str], found: Iterator[tuple[int, tuple[np.ndarray, ...]]], id_col: str) -> Iterator[pa.RecordBatch]:
    """Arrays of many sequences as batches of about ``BATCH`` rows."""
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0
    for i, arrays in found:
        if len(arrays[0]):
            parts.append((np.full(len(arrays[0]), i, np.int64), *arrays))
            held += len(arrays[0])
        if held > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], [id_col, *columns])
            parts, held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], [id_col, *columns])


def _each(seqs: DataFrame, scan: Callable[[str], Iterator[tuple[np.ndarray, ...]]], columns: dict[str, str], id_col: str, seq_col: str) -> DataFrame:
    """The rows that ``scan`` makes of every sequence, with its id; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i.as_py(), arrays) for b in batches for i, text in zip(b.column(0), b.column(1), strict=True) if text.is_valid for arrays in scan(text.as_py()))
        yield from _batches(list(columns), rows, id_col)

    schema = ", ".join(f"`{c}` {t}" for c, t in ({id_col: "long"} | columns).items())
    return seqs.select(F.col(id_col).cast("long").alias(id_col), seq_col).mapInArrow(run, schema)


def _check(k: int) -> None:
    if not 1 <= k <= MAX_LONG_K:
        raise ValueError("k must be 1 to 31")


def kmers(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """One row per k-mer of valid bases: (id, run, pos from 0 in the sequence, code). k is 31 at most.

    The scan is vectorised over slices of a sequence, so memory doesn't grow with its length but for its text.
    """
    _check(k)

    def scan(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        for run, at, value in _scan(text, k):
            yield run.astype(np.int32), at, value

    return _each(seqs, scan, {"run": "int", "pos": "long", "code": "long"}, id_col, seq_col)


def distinct_codes(seqs: DataFrame, k: int, seq_col: str = "sequence") -> DataFrame:
    """The codes (code) of all k-mers of valid bases, each once.

    A worker sends a code once per task, from a bitmap of 4^k codes, and for k beyond 12 once per batch.
    """
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (value for b in batches for text in b.column(0) if text.is_valid for _, _, value in _scan(text.as_py(), k))
        if k <= 12:
            seen = np.zeros(4**k, bool)
            for value in found:
                seen[value] = True
            for s in range(0, len(seen), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen[s : s + BATCH]) + s)], ["code"])
            return
        parts, held = [], 0
        for value in found:
            parts.append(value)
            held += len(value)
            if held > BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)))], ["code"])
                parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(parts)))], ["code"])

    return seqs.select(seq_col).mapInArrow(run, "code long").distinct()


def windows(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """One row per window of k characters, also of invalid ones: (id, pos, code, valid). k is 31 at most.

    A bit per base says whether it is one; it goes with the window. Bases that are none count as code 0 (A).
    """
    _check(k)

    def scan(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        b = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
        for s in range(0, max(0, len(b) - k + 1), SLICE):
            code = _CODE[b[s : s + SLICE + k - 1]]
            wrong = np.concatenate([[0], np.cumsum(code == 255)])
            code = np.where(code == 255, 0, code).astype(np.int64)
            n = len(code) - k + 1
            value = np.zeros(n, np.int64)
            for j in range(k):
                value = value << 2 | code[j : j + n]
            yield np.arange(s, s + n), value, wrong[k:] == wrong[:-k]

    return _each(seqs, scan, {"pos": "long", "code": "long", "valid": "boolean"}, id_col, seq_col)


def validity(seq: Column) -> Column:
    """A bit for each character of a sequence, one if it is a base: the bitmap's bytes, lowest bit first."""

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else np.packbits(_CODE[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)] != 255, bitorder="little").tobytes() for t in texts])

    return bits(seq)


def two_word_kmers(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """One row per k-mer of valid bases for k of 32 to 63: (id, run, pos, hi, lo), the two words of its 2k-bit code.

    ``lo`` has the last 32 bases and all 64 bits, so both words are to be read as unsigned.
    """
    if not 32 <= k <= 63:
        raise ValueError("k must be 32 to 63")

    def wide(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        b = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
        before, going = 0, False
        for s in range(0, max(0, len(b) - k + 1), SLICE):
            code = _CODE[b[s : s + SLICE + k - 1]]
            wrong = np.concatenate([[0], np.cumsum(code == 255)])
            at = np.flatnonzero(wrong[k:] == wrong[:-k])
            hi, lo = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for j in range(k):
                word = hi if j < k - 32 else lo
                word <<= np.uint64(2)
                word |= code[at + j]
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            if len(at) and at[0] == 0 and going:
                new[0] = False
            yield (before + np.cumsum(new) - 1).astype(np.int32), at + s, hi.view(np.int64), lo.view(np.int64)
            before += int(np.count_nonzero(new))
            going = bool(len(at)) and int(at[-1]) == SLICE - 1

    return _each(seqs, wide, {"run": "int", "pos": "long", "hi": "long", "lo": "long"}, id_col, seq_col)


def wide_kmers(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """One row per k-mer of valid bases of any length k: (id, kmer in upper case). Batches are of bounded size."""
    found = runs(seqs, k, id_col, seq_col).select(id_col, F.upper("bases").alias("bases"))
    schema = found.select(id_col, F.col("bases").alias("kmer")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, ids, parts = b.schema.field(0).type, [], []
            for i, bases in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in range(0, len(bases) - k + 1, BATCH):
                    part = [bases[j : j + k] for j in range(s, min(s + BATCH, len(bases) - k + 1))]
                    ids += [i] * len(part)
                    parts += part
                    if len(parts) > BATCH // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(parts, pa.string())], [id_col, "kmer"])
                        ids, parts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(parts, pa.string())], [id_col, "kmer"])

    return found.mapInArrow(cut, schema)


def _strand_words(code: np.ndarray, k: int) -> list[np.ndarray]:
    """The k bases from each place on as words of 32, the first word of what is over; wider parts are made of two narrower ones."""
    n = len(code) - k + 1
    powers = [code.astype(np.uint64)]
    while 2 << len(powers) - 1 <= min(k, 32):
        half = 1 << len(powers) - 1
        powers.append(powers[-1][:-half] << np.uint64(2 * half) | powers[-1][half:])
    words, at = [], 0
    for width in [k % 32] * (k % 32 > 0) + [32] * (k // 32):
        word = np.zeros(n, np.uint64)
        for j in reversed(range(len(powers))):
            if width >> j & 1:
                part = powers[j][at : at + n]
                word = part if 1 << j == 32 else word << np.uint64(2 << j) | part
                at += 1 << j
        words.append(word)
    return words


def _extreme(words: list[np.ndarray], most: bool) -> int:
    """The first place of the least or the greatest row of words."""
    at = np.arange(len(words[0]))
    for w in words:
        x = w[at]
        at = at[x == (x.max() if most else x.min())]
    return int(at[0])


def canonical_extremes(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """The number of k-mers of valid bases and the least and greatest of their canonical forms, for any k: (id, n, least, most).

    A form is a list of words of 32 bases (the first has what is over) whose top bits are flipped, so that Spark's order of
    lists is the unsigned one. There is a row for each slice of a sequence: no k-mer leaves the worker.
    """
    if k < 1:
        raise ValueError("k must be positive")
    flip = np.uint64(1 << 63)

    def scan(text: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        b = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
        for s in range(0, max(0, len(b) - k + 1), SLICE):
            code = _CODE[b[s : s + SLICE + k - 1]]
            wrong = np.concatenate([[0], np.cumsum(code == 255)])
            fine = wrong[k:] == wrong[:-k]
            if not fine.any():
                continue
            code &= 3
            mine, other = _strand_words(code, k), [w[::-1] for w in _strand_words((code ^ 2)[::-1], k)]
            less, same = np.zeros(len(fine), bool), np.ones(len(fine), bool)
            for x, y in zip(mine, other, strict=True):
                less |= same & (x < y)
                same &= x == y
            words = [np.where(less, x, y)[fine] for x, y in zip(mine, other, strict=True)]
            yield len(words[0]), *(np.array([(w[i] ^ flip).view(np.int64) for w in words]) for i in (_extreme(words, False), _extreme(words, True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            rows = [(i.as_py(), *r) for i, text in zip(b.column(0), b.column(1), strict=True) if text.is_valid for r in scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [id_col, "n", "least", "most"])

    return seqs.select(F.col(id_col).cast("long").alias(id_col), seq_col).mapInArrow(run, f"`{id_col}` long, n long, least array<long>, most array<long>")


def reverse_complement_codes(code: np.ndarray, k: int) -> np.ndarray:
    """The codes of the other strand."""
    out = np.zeros_like(code)
    for _ in range(k):
        out, code = out << 2 | (code & 3 ^ 2), code >> 2
    return out


def _minima(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each w consecutive values and its place, the rightmost if several; linear for any w.

    A window over blocks of w values is the end of one and the begin of the next: running minima of the blocks from
    either side, with the places where they last changed.
    """
    n = len(x) - w + 1
    top = np.iinfo(np.int64).max
    rows = np.append(x, np.full(-len(x) % w, top)).reshape(-1, w)
    at = np.arange(rows.size).reshape(rows.shape)
    ahead = np.minimum.accumulate(rows, axis=1)
    ahead_at = np.maximum.accumulate(np.where(rows == ahead, at, -1), axis=1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)
    new = np.ones(back.shape, bool)
    new[:, 1:] = back[:, 1:] < back[:, :-1]
    back_at = np.minimum.accumulate(np.where(new, at[:, ::-1], rows.size), axis=1)[:, ::-1].ravel()[:n]
    back = back[:, ::-1].ravel()[:n]
    ahead, ahead_at = ahead.ravel()[w - 1 : w - 1 + n], ahead_at.ravel()[w - 1 : w - 1 + n]
    right = ahead <= back
    return np.where(right, ahead, back), np.where(right, ahead_at, back_at)


def _window_minima(text: str, k: int, w: int, canonical: bool, allowed: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Run, place of the last k-mer, minimum and its place, for each w consecutive k-mers of a run."""
    for run, at, value in _scan(text, k, w - 1):
        if canonical:
            value = np.minimum(value, reverse_complement_codes(value, k))
        rank = value if allowed is None else np.where(allowed[value >> 3] >> (value & 7).astype(np.uint8) & 1, value, np.int64(4**k))
        n = len(at) - w + 1
        if n <= 0:
            yield run[:0].astype(np.int32), at[:0], value[:0], at[:0]
            continue
        best, which = _minima(rank, w)
        place = at[which]
        whole = at[w - 1 :] - at[:n] == w - 1
        if allowed is not None:
            whole &= best < 4**k
        yield run[w - 1 :][whole].astype(np.int32), at[w - 1 :][whole], best[whole], place[whole]


def _allowed(k: int, codes: set[int] | None) -> np.ndarray | None:
    """A bitmap of the k-mers that may be minimizers, without ``codes``: 4^k bits, 32 MB at most."""
    if codes is None:
        return None
    if k > 14:
        raise ValueError("a bitmap of k-mers needs k of at most 14")
    table = np.full(-(-(4**k) // 8), 255, np.uint8)
    bad = np.fromiter(codes, np.int64, len(codes))
    np.bitwise_and.at(table, bad >> 3, ~(np.uint8(1) << (bad & 7).astype(np.uint8)))
    return table


def minimizers(seqs: DataFrame, k: int, w: int, canonical: bool = False, forbidden: set[int] | None = None, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """For each w consecutive k-mers of a run the least code, the rightmost if several: (id, run, pos, min_value, min_pos).

    Only full windows give a row, which stands at its last k-mer. K-mers in ``forbidden`` are never chosen; a window of
    nothing else has no row. It is one scan: no row per k-mer leaves the worker.
    """
    _check(k)
    allowed = _allowed(k, forbidden)
    return _each(seqs, lambda text: _window_minima(text, k, w, canonical, allowed), {"run": "int", "pos": "long", "min_value": "long", "min_pos": "long"}, id_col, seq_col)


def minimizer_totals(seqs: DataFrame, k: int, w: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """What the rows of ``minimizers`` add up to: (id, n, n_minima, codes, places), a row for each slice of a sequence.

    ``n_minima`` counts the windows of a run whose minimum is another element than the window's before. As places of
    rightmost minima don't fall, these are the distinct places. k is 21 at most, so that a slice's codes add up in a long.
    """
    if not 1 <= k <= 21:
        raise ValueError("k must be 1 to 21")

    def scan(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        last = (-1, -1)
        for run, _, low, place in _window_minima(text, k, w, False, None):
            if len(run):
                new = np.diff(run, prepend=last[0]) != 0
                new |= np.diff(place, prepend=last[1]) != 0
                last = (run[-1], place[-1])
                yield tuple(np.array([x], np.int64) for x in (len(run), np.count_nonzero(new), low.sum(), place.sum()))

    return _each(seqs, scan, {"n": "long", "n_minima": "long", "codes": "long", "places": "long"}, id_col, seq_col)


def ends_of_runs(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """The last k-mer of each run: (id, run, pos, code, n: the k-mers of the run)."""
    _check(k)

    def scan(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        open_ = None
        for run, at, value in _scan(text, k):
            if not len(run):
                continue
            last = np.flatnonzero(np.append(run[1:] != run[:-1], True))
            n = np.diff(np.append(-1, last))
            if open_ is not None:
                if open_[0] == run[0]:
                    n[0] += open_[3]
                else:
                    yield tuple(np.array([x], t) for x, t in zip(open_, (np.int32, np.int64, np.int64, np.int64), strict=True))
            yield run[last[:-1]].astype(np.int32), at[last[:-1]], value[last[:-1]], n[:-1]
            open_ = (run[-1], at[-1], value[-1], n[-1])
        if open_ is not None:
            yield tuple(np.array([x], t) for x, t in zip(open_, (np.int32, np.int64, np.int64, np.int64), strict=True))

    return _each(seqs, scan, {"run": "int", "pos": "long", "code": "long", "n": "long"}, id_col, seq_col)


def placed_kmers(seqs: DataFrame, k: int, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """K-mers with their place (from 1) in the order of (code, pos) in their sequence: (id, pos, code, place).

    A sequence is sorted where it is scanned: 24 bytes per k-mer of one sequence at a time.
    """
    _check(k)

    def scan(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        parts = list(_scan(text, k))
        if parts:
            at, value = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
            order = np.argsort(value, kind="stable")
            for s in range(0, len(order), BATCH):
                i = order[s : s + BATCH]
                yield at[i], value[i], np.arange(s + 1, s + len(i) + 1)

    return _each(seqs, scan, {"pos": "long", "code": "long", "place": "long"}, id_col, seq_col)


def with_entropy(rows: DataFrame, k: int, code: str = "code", name: str = "numerator") -> DataFrame:
    """``rows`` with the fixed-point 2-mer entropy of a k-mer column, vectorised; it is evaluated where it stands.

    A filter on the new column doesn't move below what comes before, such as a distinct.
    """
    from strandlake.functions.nucleotides import entropy_table

    table = np.array([*entropy_table(k), 0], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(code))
            pairs = np.stack([x >> (2 * j) & 15 for j in range(k - 1)]) if k > 1 else np.zeros((0, len(x)), np.int64)
            total = np.zeros(len(x), np.int64)
            for p in range(16):
                total += table[(pairs == p).sum(axis=0)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total)], [*b.schema.names, name])

    schema = rows.select("*", F.lit(0).cast("long").alias(name)).schema
    return rows.mapInArrow(run, schema)


def with_offsets(seqs: DataFrame, order_col: str = "seq_id", seq_col: str = "sequence", name: str = "offset") -> DataFrame:
    """Add the number of bases in all sequences before each one, in the order of ``order_col``.

    Two phases: lengths are summed per range of the order, the sums of the ranges (one row each) are added up, and a
    window inside each range does the rest, so no task sees all sequences.
    """
    spark = seqs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = seqs.withColumn("__n", F.coalesce(F.length(seq_col), F.lit(0)).cast("long"))
    bounds = seqs.agg(F.percentile_approx(order_col, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or [] if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(order_col))) if bounds else F.lit(0)
    sized = sized.withColumn("__part", part)
    totals = sized.groupBy("__part").agg(F.sum("__n").alias("__t"))
    before = totals.select("__part", F.coalesce(F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return sized.join(before, "__part").withColumn(name, F.col("__before") + F.col("__inside")).drop("__n", "__part", "__before", "__inside")


def window_minimum(rows: DataFrame, w: int, value: Column, by: list[str], order: str = "pos") -> DataFrame:
    """For each w consecutive rows of a group the least value, the rightmost if several: adds min_value, min_pos.

    Only full windows remain; each stands at its last row.
    """
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(w - 1), 0)
    least = F.min(F.struct(value.alias("value"), (-F.col(order)).alias("neg"))).over(frame)
    out = rows.withColumns({"__least": least, "__n": F.count("*").over(frame)}).filter(F.col("__n") == w)
    return out.select("*", F.col("__least.value").alias("min_value"), (-F.col("__least.neg")).alias("min_pos")).drop("__least", "__n")


def minimum_changes(windows: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    """Add changed: whether a window's minimum is another element than the window's before it."""
    w = Window.partitionBy(*by).orderBy(order)
    return windows.withColumn("changed", ~F.col("min_pos").eqNullSafe(F.lag("min_pos").over(w)))


def superkmers(seqs: DataFrame, k: int, m: int, forbidden: set[int] | None = None, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """Maximal runs of consecutive k-mers with one canonical m-mer minimizer: (id, run, start, end, minimizer).

    One scan; ``forbidden`` m-mers are never minimizers, and k-mers of nothing else belong to no super-k-mer.
    """
    _check(m)
    allowed = _allowed(m, forbidden)

    def scan(text: str) -> Iterator[tuple[np.ndarray, ...]]:
        open_ = None  # run, first and last place, minimum, its place
        for run, at, low, place in _window_minima(text, m, k - m + 1, True, allowed):
            if not len(run):
                continue
            new = np.ones(len(run), bool)
            new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1]) | (np.diff(at) > 1)
            cut = np.flatnonzero(new)
            ends = np.append(cut[1:], len(run)) - 1
            first, last = at[cut], at[ends]
            if open_ is not None:
                if open_[0] == run[0] and open_[4] == place[0] and open_[2] + 1 == at[0]:
                    first[0] = open_[1]
                else:
                    yield _super(*(np.array([x]) for x in open_[:4]))
            yield _super(run[cut[:-1]], first[:-1], last[:-1], low[cut[:-1]])
            open_ = (run[-1], first[-1], last[-1], low[cut[-1]], place[-1])
        if open_ is not None:
            yield _super(*(np.array([x]) for x in open_[:4]))

    def _super(run: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
        return run.astype(np.int32), first - (k - m), last + m, low

    return _each(seqs, scan, {"run": "int", "start": "long", "end": "long", "minimizer": "long"}, id_col, seq_col)


def count_kmers(seqs: DataFrame, k: int, canonical_form: bool = True, id_col: str = "seq_id", seq_col: str = "sequence") -> DataFrame:
    """code and count of every k-mer; partial sums precede the shuffle, so a frequent k-mer loads no task."""
    from strandlake.functions.nucleotides import canonical

    code = canonical(F.col("code"), k) if canonical_form else F.col("code")
    return kmers(seqs, k, id_col, seq_col).groupBy(code.alias("code")).agg(F.count("*").alias("count"))


def ranked(rows: DataFrame, ranks: DataFrame, on: str = "code") -> DataFrame:
    """Attach ranks from a table of (``on``, rank)."""
    return rows.join(ranks, on, "left")
