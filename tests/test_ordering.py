"""Global order, sorted search and packed vectors against Python's own integers."""

import bisect
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import packed, vectorised
from strandlake.operators import ordering

TOP = 2**63 - 1


def test_numbered_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 7, 7, 7, rng.randint(-50, 50)]), i) for i in range(900)]  # 7 is a hot key
    table = spark.createDataFrame(rows, "v long, id long").repartition(6)
    for ranges in (1, 3, 17):
        got = {r.id: r.place for r in ordering.numbered(table, "v", "id", ranges=ranges).collect()}
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert got == {i: k + 1 for k, (_, i) in enumerate(want)}
        got = {r.id: r.n for r in ordering.numbered(table, F.desc("v"), F.desc("id"), name="n", ranges=ranges).collect()}
        assert got == {i: k + 1 for k, (_, i) in enumerate(want[::-1])}
    assert ordering.numbered(table.limit(0), "v", "id").collect() == []


def test_hot_keys_are_split_over_ranges(spark, monkeypatch):
    sizes = []
    keep = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda df, name: sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) or keep(df, name))
    ordering.numbered(spark.range(4000).select(F.lit(1).alias("v"), "id"), "v", "id", ranges=8)
    assert len(sizes) == 8 and max(sizes) < 1000


@pytest.mark.parametrize(("block", "ranges"), [(1, 3), (7, 1), (64, 5), (1 << 14, 4)])
def test_search_over_a_whole_column(spark, block, ranges):
    rng = random.Random(block)
    values = [rng.randint(-40, 40) for _ in range(150)] + [5] * 200 + [TOP, -TOP - 1, TOP - 1, 10**15] + [None] * 5
    asked = [*range(-45, 46), None, 5, 5, TOP, -TOP - 1, TOP - 1, 10**15, 10**15 + 1, None]
    blocks = ordering.sorted_blocks(spark.createDataFrame([(v,) for v in values], "v long").repartition(4), "v", ranges, block)
    targets = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(asked)], "i long, t long, key string, start int")
    order = sorted(v for v in values if v is not None)
    got = {r.i: r.place for r in ordering.lower_bounds(blocks, targets, "t").collect()}
    assert got == {i: None if t is None else bisect.bisect_left(order, t) for i, t in enumerate(asked)}


def test_search_over_no_values_and_for_no_targets(spark):
    none = spark.createDataFrame([(None,)], "v long")
    targets = spark.createDataFrame([(3,), (None,)], "t long")
    assert sorted(map(str, ordering.lower_bounds(ordering.sorted_blocks(none, "v"), targets, "t").collect())) == ["Row(t=3, place=0)", "Row(t=None, place=None)"]
    some = ordering.sorted_blocks(spark.range(9), "id")
    assert ordering.lower_bounds(some, targets.limit(0), "t").collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=70), st.randoms())
def test_packed_vectors_load_store_and_search(width, values, rng):
    v = [x & ((1 << width) - 1) for x in values]
    p = packed.PackedInts.of(np.array(v, np.uint64), width)
    at = rng.sample(range(len(v)), rng.randint(1, len(v)))
    assert p[np.array(at)].tolist() == [v[i] for i in at]
    new = [rng.getrandbits(width) for _ in at]
    p[np.array(at)] = np.array(new, np.uint64)
    for i, x in zip(at, new, strict=True):
        v[i] = x
    assert p[np.arange(len(v))].tolist() == v
    order = sorted(v)
    targets = [*v, 0, (1 << width) - 1, *(min(x + 1, (1 << 64) - 1) for x in v)]
    assert packed.PackedInts.of(np.array(order, np.uint64), width).lower_bound(np.array(targets, np.uint64)).tolist() == [bisect.bisect_left(order, t) for t in targets]


#: (size, width, fill) of the vectors that the survey lists, and sizes to change to.
CASES = [(4096, 1, 1), (2048, 2, 2), (512, 9, 0x154), (256, 32, 0xDEADBEEF), (1369, 11, 0x555), (128, 57, 0xFEDCBADEADBEEF), (0, 5, 0), (1, 64, 2**64 - 1)]


def test_packed_columns(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        size, width, fill = CASES[k % len(CASES)]
        v = [fill] * size if k < len(CASES) else [rng.getrandbits(width) for _ in range(size)]
        rows.append((k, width, len(v), vectorised.pack_ints(np.array(v, np.uint64), width) if v else b"", rng.randrange(-1, size + 2), rng.getrandbits(63), size * 2 // 3, size * 4 // 3, v))
    rows.append((99, None, 3, b"abc", 0, 1, 1, 1, []))
    rows.append((98, 4, 3, None, 0, 1, 1, 1, []))
    table = spark.createDataFrame([r[:-1] for r in rows], "k long, width int, n long, data binary, i long, x long, less long, more long").repartition(3)
    d, w, n = F.col("data"), F.col("width"), F.col("n")
    out = table.select("k", packed.element(d, w, F.col("i")).alias("e"), packed.with_element(d, w, F.col("i"), F.col("x")).alias("put"), packed.resize(d, w, F.col("less")).alias("less"), packed.resize(d, w, F.col("more")).alias("more"), packed.sort_packed(d, w, n).alias("sorted"), packed.lower_bound(packed.sort_packed(d, w, n), w, n, F.col("x")).alias("at"))
    got = {r.k: r for r in out.collect()}
    for k, width, size, data, i, x, less, more, v in rows:
        r = got[k]
        if width is None or data is None:
            assert (r.e, r.less, r.more, r.at) == (None, None, None, None)
            continue
        bits = lambda u: vectorised.pack_ints(np.array(u, np.uint64), width) if u else b""  # noqa: B023, E731
        held = 8 * len(data) // width  # the last byte may have room for more
        assert r.e == (None if not 0 <= i < held else (v[i] if i < size else 0) - (2**64 if i < size and v[i] >> 63 else 0))
        if 0 <= i < size:
            assert bytes(r.put) == bits([*v[:i], x & ((1 << width) - 1), *v[i + 1 :]])
        elif i < 0 or i >= held:
            assert bytes(r.put) == data
        assert bytes(r.less) == bits(v[:less]) and bytes(r.more) == bits(v + [0] * (more - size))
        assert bytes(r.sorted) == bits(sorted(v)) and r.at == bisect.bisect_left(sorted(v), x)


def test_vectors_of_sliced_and_empty_arrays():
    data = pa.array([b"ab", None, b"", b"cdefghijk"], pa.binary())
    words, begin, size = packed._vectors(data.slice(2, 2))
    assert (begin.tolist(), size.tolist()) == ([0, 0], [0, 9]) and words.tobytes()[:9] == b"cdefghijk"
    assert packed._vectors(data.slice(0, 0))[1].tolist() == []
