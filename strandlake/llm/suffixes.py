"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Sorting every suffix would move the corpus hundreds of times over, so suffixes start at anchors only: the anchor of a
window of ``shared`` bytes is the leftmost of its ``PIECE``-byte pieces with the smallest hash. It depends on the
window's bytes alone, so equal windows have their anchors at the same place, and windows with one anchor are neighbours.
Anchors whose piece occurs once can't repeat and drop out first. For the others, workers sort what stands after each
anchor, and what stands before it read backwards, as two runs of front-coded strings (common prefix with the string
before, and the rest). A reducer of a range of piece hashes merges the runs with a loser tree that knows the common
prefixes: it compares two strings only beyond what both share with the string output last, and yields each string's
common prefix with its predecessor. A window of n bytes that begins o bytes before its anchor repeats exactly if another
anchor shares at least o bytes before it and n - o bytes after it; both kinds of classes follow from the merged
prefixes, for windows of ``length`` bytes (which are removed) and of ``shared`` bytes (which tell passages that
documents share).

Groups of copies are taken together before anything is exchanged: of the places of one piece, and of one surrounding of
an anchor, in a worker's chunk only representatives go to the reducer, the others are settled at once. So a reducer gets
a copied passage once per chunk, however many rows hold it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import drop_written, mix64, pack, plan_bytes, release, slices, unpack, written
from strandlake.llm.places import Keys, by_part, collected, deltas, hash_bucket, joined, keyed_text, numbered, pack_places, parted, runs_of, unpack_places

LENGTH, SHARED, PIECE = 400, 200, 100
BUCKET_BYTES, CHUNK_ANCHORS, CHUNK_BYTES = 4 << 20, 300_000, 6 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(2048), np.uint64)
_LOW = np.uint64((1 << 24) - 1)
#: Bytes scanned at a time; places within a scan have 24 bits.
SCAN = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[0] = _powers(_P, max(n, SCAN + 4096)), _powers(_P_INVERSE, max(n, SCAN + 4096))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def anchors(text: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of ``text``: their places, first and last window starts, and the hashes of their pieces."""
    n, span = len(text), length - piece + 1
    windows = n - length + 1
    if windows <= 0:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64))
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[text] * up[:n], out=sums[1:])
    h = mix64((sums[piece:] - sums[:-piece]) * down[: n - piece + 1])
    # the hash's high bits, then the place: the smallest of a window is its leftmost smallest
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], windows) - 1
    # small hashes are what anchors have in common, so they are mixed once more before they deal anything out
    return at[first], first, last, mix64(h[at[first]] ^ _P)


def document_anchors(text: bytes, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a text of any size, scanned in overlapping parts (a part's end may split an anchor's windows)."""
    a = np.frombuffer(text, np.uint8)
    if len(a) <= SCAN:
        return anchors(a, length, piece)
    out = []
    for s in range(0, len(a) - length + 1, SCAN - length + 1):
        at, first, last, h = anchors(a[s : s + SCAN], length, piece)
        out.append((at + s, first + s, last + s, h))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def common(a: bytes, b: bytes, k: int) -> int:
    """The length of the common prefix of two strings that agree on their first ``k`` bytes."""
    n = min(len(a), len(b))
    while k < n:
        x, y = a[k : k + 64], b[k : k + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return k + m if not d else k + m - (d.bit_length() + 7) // 8
        k += 64
    return n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs (strings, each one's common prefix with the one before) with a loser tree.

    Returns the order as (run, place) and each string's common prefix with the one output before it. A string in the
    tree is kept with its common prefix with the string that beat it last, or that was output last; of two strings that
    are not smaller than that one, the longer prefix is the smaller string, and equal prefixes are compared beyond them.
    """
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - k)
    places, prefix = [0] * size, [0] * size
    loser = [0] * size

    def beats(i: int, j: int) -> bool:
        """Whether run i's head comes before run j's; the one that loses learns its prefix with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if prefix[i] != prefix[j]:
            return prefix[i] > prefix[j]
        c = common(a, b, prefix[i])
        first = c == len(a) or (c < len(b) and a[c] < b[c])
        if c == len(a) == len(b):
            first = i < j
        prefix[j if first else i] = c
        return first

    winners = list(range(size))
    level, base = winners, size
    while len(level) > 1:
        base //= 2
        following = []
        for x in range(0, len(level), 2):
            i, j = level[x], level[x + 1]
            if beats(i, j):
                loser[base + x // 2] = j
                following.append(i)
            else:
                loser[base + x // 2] = i
                following.append(j)
        level = following
    top = level[0]
    order: list[tuple[int, int]] = []
    prefixes: list[int] = []
    while heads[top] is not None:
        order.append((top, places[top]))
        prefixes.append(prefix[top])
        places[top] += 1
        strings, shared = runs[top]
        if places[top] < len(strings):
            heads[top], prefix[top] = strings[places[top]], shared[places[top]]
        else:
            heads[top] = None
        node = (top + size) // 2
        while node:
            other = loser[node]
            if beats(other, top):
                loser[node], top = top, other
            node //= 2
    return order, prefixes


def repeated_offsets(right: list[int], right_prefix: list[int], left: list[int], left_prefix: list[int], least: np.ndarray, most: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int]]:
    """(member, first offset, last offset) of the windows of ``length`` bytes that repeat, for anchors of one piece.

    ``right`` and ``left`` are the members in the order of what stands after and before them, with the common prefixes
    of neighbours; a member has windows that begin ``least`` to ``most`` bytes before it, and stands for places marked
    from ``low`` to ``high``: windows repeat if they occur under two marks.
    """
    out = []
    n = len(right)
    if n == 2:
        a, b = length - right_prefix[1], left_prefix[1]
        if low[0] == high[0] == low[1] == high[1]:
            return []
        if low[0] == high[0] and low[1] == high[1]:
            return [(i, max(a, int(least[i])), min(b, int(most[i]))) for i in (0, 1) if max(a, least[i]) <= min(b, most[i])]
    start, high_end = int(least.min()), int(most.max())
    steps = sorted({start, *(p + 1 for p in left_prefix[1:]), *(length - p for p in right_prefix[1:])})
    steps = [s for s in steps if start <= s <= high_end]
    if not steps:
        return out
    rp, lp, ro, lo = np.array(right_prefix), np.array(left_prefix), np.array(right), np.array(left)
    rp[0] = lp[0] = -1
    r, l = np.empty(n, np.int64), np.empty(n, np.int64)
    for s, e in zip(steps, [*(x - 1 for x in steps[1:]), high_end], strict=True):
        a, b = np.maximum(least, s), np.minimum(most, e)
        some = a <= b
        if not some.any():
            continue
        r[ro] = np.cumsum(rp < length - s)
        l[lo] = np.cumsum(lp < s)
        key = r * (n + 1) + l
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        apart = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
        again = np.empty(n, bool)
        again[order] = np.repeat(apart, np.diff(np.append(first, n)))
        for i in np.flatnonzero(again & some).tolist():
            out.append((i, int(a[i]), int(b[i])))
    return out


def _front(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Common prefixes of sorted strings with the one before, and the rests."""
    prefix, rests, before = [], [], b""
    for s in strings:
        k = common(before, s, 0)
        prefix.append(k)
        rests.append(s[k:])
        before = s
    return np.array(prefix, np.uint32), b"".join(rests)


def _unfront(prefix: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for k, n in zip(prefix.tolist(), sizes.tolist(), strict=True):
        before = before[:k] + rests[at : at + n - k]
        at += n - k
        out.append(before)
    return out


_ANCHOR = (np.uint32, np.uint16, np.uint16, np.uint64)
_TOLD = (*_ANCHOR, np.uint8)
#: Spans of repeated windows: first start, how many, and whether they are of the shorter length.
_SPAN = (np.uint32, np.uint32, np.uint8)


def _table(rows: list[tuple[int, bytes]], first: str) -> pa.Table:
    return pa.table({first: pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _batch(settled: list[tuple[int, bytes]], open_: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows for the reducers: kind 1 are settled and only pass through to their part, kind 0 are to be merged."""
    rows = [(*r, 1) for r in settled] + [(*r, 0) for r in open_]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "kind", "data"])


def _passed(table: pa.Table) -> tuple[list[tuple[int, bytes]], list[bytes]]:
    """What only passes through a reducer, and what it is to merge."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True))
    return [(b, d) for b, k, d in rows if k == 1], [d for _, k, d in rows if k == 0]


def repeated_anchors(docs: DataFrame, window: int, piece: int, buckets: int) -> DataFrame:
    """Per row (a, h, anchors): the anchors whose piece's hash occurs at another place too.

    Of several places in a chunk the first goes to the reducer, marked as settled, for the places of other chunks.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, keys = [], 0, Keys()

        def flush() -> pa.RecordBatch:
            nonlocal keys, count
            number, at, most, least, h = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            number, at, most, least, h = number[order], at[order], most[order], least[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(first, len(h)))
            several = np.repeat(times > 1, times)
            tables = keys.tables()
            settled = by_part(number[several], *tables, buckets, at[several], most[several], least[several], h[several])
            told = (times > 1).astype(np.uint8)
            open_ = [(int(b), pack_places(number[i], *tables, at[i], most[i], least[i], deltas(h[i]), told[x:y])) for (x, y), b in _cut(hash_bucket(h[first], buckets)) for i in [first[x:y]]]
            keys, count = Keys(), 0
            return _batch(settled, open_)

        for b in slices(batches, SCAN):
            for a, h, text in zip(*(b.column(c).to_pylist() for c in ("a", "h", "text")), strict=True):
                if len(text) < window:
                    continue
                at, first, last, piece_hash = document_anchors(text, window, piece)
                held.append((np.full(len(at), keys.number(a, h), np.int64), at.astype(np.uint32), (at - first).astype(np.uint16), (at - last).astype(np.uint16), piece_hash))
                count += len(at)
                if count >= CHUNK_ANCHORS:
                    yield flush()
        if held:
            yield flush()

    def repeated(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, blobs = _passed(table)
        if blobs:
            got = [unpack_places(d, *_TOLD) for d in blobs]
            a, h, at, most, least = (np.concatenate([g[k] for g in got]) for k in range(5))
            piece_hash = np.concatenate([np.cumsum(g[5], dtype=np.uint64) for g in got])
            told = np.concatenate([g[6] for g in got]) > 0
            order = np.argsort(piece_hash, kind="stable")
            s = piece_hash[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            times = np.diff(np.append(first, len(s)))
            i = order[np.repeat(times > 1, times)]
            i = i[~told[i]]
            rows += by_part(*numbered(a[i], h[i]), buckets, at[i], most[i], least[i], piece_hash[i])
        return _table(rows, "part")

    packed = docs.select("a", "h", "text").mapInArrow(scan, "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(repeated, "part int, data binary")
    return collected(packed, _ANCHOR, "anchors")


def _cut(sorted_: np.ndarray) -> list[tuple[tuple[int, int], int]]:
    return [((x, y), sorted_[x]) for x, y in runs_of(sorted_)]


def suffix_runs(docs: DataFrame, places: DataFrame, length: int, buckets: int) -> DataFrame:
    """Front-coded sorted runs (bucket, kind 0, data) of what stands after and before the documents' anchors.

    Equal surroundings are one string. If rows of different keys have it in one chunk, all their windows repeat, so they
    are settled (kind 1: spans) and two of the places stand for the rest.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes, int], list[tuple[int, int]]] = {}
        total, keys = 0, Keys()

        def flush() -> pa.RecordBatch:
            nonlocal total, keys
            after = sorted(held)
            tables = keys.tables()
            members, told, spans = [], np.zeros(len(after), np.uint8), []
            for i, k in enumerate(after):
                found = held[k]
                other = next((p for p in found if p[0] != found[0][0]), None)
                if other:
                    told[i] = 1
                    most, least = len(k[1]), k[2]
                    longer = max(least, length - (len(k[0]) - 8))
                    spans += [(p, at - most, most - least + 1, 1) for p, at in found]
                    if longer <= most:
                        spans += [(p, at - most, most - longer + 1, 0) for p, at in found]
                    found = [found[0], other]
                elif len(found) > 2:  # of equal rows two do
                    found = [p for p, times in Counter(found).items() for _ in range(min(times, 2))]
                members.append(found)
            done = np.array(spans, np.int64).reshape(-1, 4)
            settled = by_part(done[:, 0], *tables, buckets, done[:, 1].astype(np.uint32), done[:, 2].astype(np.uint32), done[:, 3].astype(np.uint8))
            hashes = np.array([int.from_bytes(k[0][:8], "big") for k in after], np.uint64)
            open_ = []
            for (x, y), b in _cut(hash_bucket(hashes, buckets)):
                part = after[x:y]
                rp, rest = _front([k[0] for k in part])
                before = [k[0][:8] + k[1] for k in part]
                order = sorted(range(len(part)), key=before.__getitem__)
                lp, left = _front([before[i] for i in order])
                sizes = np.array([len(k[0]) for k in part], np.uint32)
                behind = np.array([len(before[i]) for i in order], np.uint32)
                n = np.array([len(m) for m in members[x:y]], np.uint32)
                flat = np.array([p for m in members[x:y] for p in m], np.int64).reshape(-1, 2)
                meta = pack(rp, sizes, lp, behind, np.array(order, np.uint32), n, np.array([k[2] for k in part], np.uint16), told[x:y])
                open_.append((int(b), joined(meta, rest, left, pack_places(flat[:, 0], *tables, flat[:, 1].astype(np.uint32)))))
            held.clear()
            total, keys = 0, Keys()
            return _batch(settled, open_)

        for b in slices(batches):
            for a, h, text, blob in zip(*(b.column(c).to_pylist() for c in ("a", "h", "text", "anchors")), strict=True):
                number = keys.number(a, h)
                for at, most, least, piece_hash in zip(*(x.tolist() for x in unpack(blob, *_ANCHOR)), strict=True):
                    key = (piece_hash.to_bytes(8, "big") + text[at : at - least + length], text[at - most : at][::-1], least)
                    found = held.get(key)
                    if found is None:
                        held[key] = [(number, at)]
                        total += length + most
                    else:
                        found.append((number, at))
                        total += 24
                    if total > CHUNK_BYTES:
                        yield flush()
                        number = keys.number(a, h)
        if held:
            yield flush()

    return docs.join(places, ["a", "h"]).select("a", "h", "text", "anchors").mapInArrow(build, "bucket int, kind int, data binary")


def merged_repeats(runs: DataFrame, length: int, shared: int, buckets: int) -> DataFrame:
    """Merge the runs of each bucket; per row (a, h, spans): starts and counts of repeated windows of both lengths."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, blobs = _passed(table)
        if not blobs:
            return _table(rows, "part")
        after, before, base = [], [], [0]
        n_, a_, h_, at_, most_, least_, longer_, told_ = ([] for _ in range(8))
        for blob in blobs:
            meta, rest, left, where = parted(blob)
            rp, sizes, lp, behind, order, n, least, told = unpack(meta, *(np.uint32,) * 6, np.uint16, np.uint8)
            after.append((_unfront(rp, sizes, rest), rp.tolist()))
            before.append((_unfront(lp, behind, left), lp.tolist(), order.tolist()))
            reach = np.empty(len(order), np.int64)
            reach[order] = behind.astype(np.int64) - 8
            a, h, at = unpack_places(where, np.uint32)
            for held, x in zip((n_, a_, h_, at_, most_, least_, longer_, told_), (n, a, h, at, reach, least, np.maximum(least, length + 8 - sizes.astype(np.int64)), told), strict=True):
                held.append(x.astype(np.int64))
            base.append(base[-1] + len(sizes))
        n, a, h, at, most, least, longer, told = (np.concatenate(x) for x in (n_, a_, h_, at_, most_, least_, longer_, told_))
        starts = np.cumsum(n) - n
        mark = mix64(a.view(np.uint64)) ^ h.view(np.uint64)
        low, high = np.minimum.reduceat(mark, starts), np.maximum.reduceat(mark, starts)
        # for removal every place is a mark of its own
        place_low, place_high = starts, starts + n - 1
        right, right_prefix = merge_runs(after)
        left, left_prefix = merge_runs([(s, p) for s, p, _ in before])
        heads = [after[r][0][i][:8] for r, i in right]
        right = [base[r] + i for r, i in right]
        left = [base[r] + before[r][2][i] for r, i in left]
        found: list[tuple[int, int, int, int]] = []
        s = 0
        while s < len(right):
            e = s + 1
            while e < len(right) and heads[e] == heads[s]:
                e += 1
            members = right[s:e]
            if e - s == 1:
                i = members[0]
                if n[i] > 1 and not told[i]:  # one row that holds it several times
                    found.append((i, int(longer[i]), int(most[i]), 0))
            elif not told[members].all():
                local = {m: i for i, m in enumerate(members)}
                rights, rps = list(range(e - s)), [max(0, p - 8) for p in right_prefix[s:e]]
                lefts, lps = [local[m] for m in left[s:e]], [max(0, p - 8) for p in left_prefix[s:e]]
                for kind, size, least_of, lo, hi in ((0, length, longer, place_low, place_high), (1, shared, least, low, high)):
                    got = repeated_offsets(rights, rps, lefts, lps, least_of[members], most[members], size, lo[members], hi[members])
                    found += [(members[i], x, y, kind) for i, x, y in got]
            s = e
        f = np.array(found, np.int64).reshape(-1, 4)
        f = f[(told[f[:, 0]] == 0) & (f[:, 1] <= f[:, 2])]
        if len(f):
            reps = n[f[:, 0]]
            i = np.repeat(starts[f[:, 0]] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            first, last, kind = (np.repeat(f[:, k], reps) for k in (1, 2, 3))
            rows += by_part(*numbered(a[i], h[i]), buckets, (at[i] - last).astype(np.uint32), (last - first + 1).astype(np.uint32), kind.astype(np.uint8))
        return _table(rows, "part")

    return collected(runs.groupBy("bucket").applyInArrow(merge, "part int, data binary"), _SPAN, "spans")


def covered(size: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` bytes the windows of ``length`` bytes cover that begin at ``start`` and the ``count`` - 1 places after."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + count + length - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, shared: int = SHARED, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_shared.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the corpus, the same
    document included and overlaps too. n_shared counts the bytes that a string of ``shared`` bytes (at most ``length``)
    covers which another document also holds; they stay unless the longer strings cover them. A null text is empty;
    shorter texts keep all. Every row is a document of its own, rows without or with the same doc_id as well, so equal
    rows repeat each other (but count as one document in n_shared) and get equal results. Ties of hashes only cost
    comparisons: what is removed is decided by bytes. An empty table gives one.
    """
    if not 0 < piece <= shared <= length:
        raise ValueError("needs piece <= shared <= length")
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col)
    n = buckets or max(16, -(-plan_bytes(rows) // BUCKET_BYTES))
    places = written(repeated_anchors(rows, shared, piece, n), "anchors")
    release(spark)
    runs = written(suffix_runs(rows, places, length, n), "suffix-runs")
    release(spark)
    drop_written(places)
    spans = written(merged_repeats(runs, length, shared, n), "spans")
    release(spark)
    drop_written(runs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc, text, blob in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                gone, runs_, kept, common_ = 0, 0, text, 0
                if blob is not None:
                    start, count, short = unpack(blob, *_SPAN)
                    start, count, short = start.astype(np.int64), count.astype(np.int64), short > 0
                    common_ = int(covered(len(text), start[short], count[short], shared).sum())
                    cover = covered(len(text), start[~short], count[~short], length)
                    gone = int(cover.sum())
                    if gone:
                        runs_ = int(np.count_nonzero(cover[1:] & ~cover[:-1])) + int(cover[0])
                        kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                out.append((doc, len(text), gone, runs_, hashlib.sha256(kept).hexdigest(), common_))
            kinds = (*(pa.int64(),) * 4, pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    return rows.join(spans, ["a", "h"], "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
