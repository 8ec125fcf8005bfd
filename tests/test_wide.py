"""Wide windows, two-word codes, packed sequences, validity and lookup tables against plain Python."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import bits
from strandlake.functions import nucleotides as nt
from strandlake.operators import kmers as ops
from strandlake.operators import packed_sequences, tables

CODE = {c: i for i, c in enumerate("ACTG")}
MASK = (1 << 64) - 1


def code_of(kmer):
    out = 0
    for c in kmer.upper():
        out = out * 4 + CODE[c]
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=60), st.integers(1, 60))
def test_minima_of_any_window(values, w):
    x = np.array(values, np.int64)
    if w > len(x):
        return
    best, at = ops._minima(x, w)
    for i, (b, p) in enumerate(zip(best.tolist(), at.tolist(), strict=True)):
        inside = values[i : i + w]
        assert b == min(inside) and p == max(j for j in range(i, i + w) if values[j] == b)


def test_wide_windows_cost_as_much_as_narrow_ones():
    x = np.random.default_rng(1).integers(0, 4**12, 2_000_000)
    seconds = []
    for w in (4, 1000):
        ops._minima(x, w)
        began = time.time()
        ops._minima(x, w)
        seconds.append(time.time() - began)
    assert seconds[1] < 2 * seconds[0] + 0.05


SEQS = ["", "ACGT", "acgtACGTNACGTTGCA" * 9, "N" * 90, "é" + "ACGTTGCATT" * 12 + "😀" + "GATTACA" * 13, "A" * 63, "ACTG" * 50, None, "TTTT\nACGT-acgu" * 8]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, s, "x", 3) for i, s in enumerate(SEQS)], "seq_id long, sequence string, data string, n int").repartition(3)


@pytest.mark.parametrize("k", [32, 33, 40, 47, 63])
def test_codes_of_two_words(table, k):
    rows = ops.two_word_kmers(table, k)
    hi, lo = nt.canonical_words(F.col("hi"), F.col("lo"), k)
    other = nt.reverse_complement_words(F.col("hi"), F.col("lo"), k)
    back = nt.reverse_complement_words(*other, k)
    got = sorted((r.seq_id, r.pos, r.hi & MASK, r.lo & MASK, r.ch & MASK, r.cl & MASK) for r in rows.select("seq_id", "pos", "hi", "lo", hi.alias("ch"), lo.alias("cl")).collect())
    want = []
    for i, s in enumerate(SEQS):
        for p in range(len(s or "") - k + 1):
            if set(s[p : p + k]) <= set("ACGTacgt"):
                c = code_of(s[p : p + k])
                m = min(c, code_of(s[p : p + k].upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))))
                want.append((i, p, c >> 64, c & MASK, m >> 64, m & MASK))
    assert got == want and len(want) > 20
    assert rows.filter((back[0] != F.col("hi")) | (back[1] != F.col("lo"))).count() == 0
    wide = ops.wide_kmers(table, k).groupBy("seq_id").count().collect()
    assert {r.seq_id: r["count"] for r in wide} == {i: sum(w[0] == i for w in want) for i in {w[0] for w in want}}


def test_codes_of_two_words_in_slices(spark, monkeypatch):
    text = "".join(random.Random(3).choice("ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTN") for _ in range(900))
    rows = spark.createDataFrame([(1, text)], "seq_id long, sequence string")
    whole = sorted(map(tuple, ops.two_word_kmers(rows, 35).collect()))
    runs = sorted((r.run, r["count"]) for r in ops.two_word_kmers(rows, 35).groupBy("run").count().collect())
    assert [n for _, n in runs] == [len(x) - 34 for x in text.split("N") if len(x) >= 35] and len(whole) > 50


def test_swap_and_offsets(spark):
    row = spark.createDataFrame([(0x0123456789ABCDEF, 0x1122334455667788, 1000)], "hi long, lo long, n long")
    hi, lo = bits.byte_swap_wide(F.col("hi"), F.col("lo"))
    word, bit = bits.split_offset(F.col("n"))
    r = row.select(hi, lo, word, bit, *bits.split_offset(F.col("n"), 8)).first()
    assert [v & MASK for v in r] == [0x8877665544332211, 0xEFCDAB8967452301, 15, 40, 125, 0]
    with pytest.raises(ValueError, match="power"):
        bits.split_offset(F.col("n"), 48)


def test_packed_sequences(table):
    rows = packed_sequences.pack_sequences(table)
    assert {r.seq_id: r.sequence for r in packed_sequences.unpack_sequences(rows).collect()} == {i: s for i, s in enumerate(SEQS) if s is not None}
    assert {r.seq_id: (r.n, len(r.data)) for r in rows.collect()} == {i: (len(s), -(-len(s) // 4)) for i, s in enumerate(SEQS) if s is not None}
    for k in (1, 3, 16, 31):
        assert sorted(map(tuple, packed_sequences.packed_kmers(rows, k).collect())) == sorted(map(tuple, ops.kmers(table, k).select("seq_id", "pos", "code").collect()))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ACGTacgtNé\U0001f600", max_size=80))
def test_packing_loses_nothing(text):
    assert packed_sequences.unpack_text(*packed_sequences.pack_text(text)) == text


def test_packed_kmers_in_slices(spark, monkeypatch):
    text = "".join(random.Random(4).choice("ACGTACGTacgtN") for _ in range(500))
    n, *rest = packed_sequences.pack_text(text)
    rows = spark.createDataFrame([(1, n, *rest)], "seq_id long, n long, data binary, places array<long>, lengths array<int>, letters string")
    want = [(1, p, code_of(text[p : p + 6])) for p in range(len(text) - 5) if "N" not in text[p : p + 6]]
    assert sorted(map(tuple, packed_sequences.packed_kmers(rows, 6).collect())) == want


def test_validity(table):
    for k in (1, 4, 31):
        got = sorted((r.seq_id, r.pos, r.code, r.valid) for r in ops.windows(table, k).collect())
        want = []
        for i, s in enumerate(SEQS):
            for p in range(len(s or "") - k + 1):
                w = s[p : p + k]
                want.append((i, p, code_of("".join(c if c in "ACGTacgt" else "A" for c in w)), set(w) <= set("ACGTacgt")))
        assert got == want
    for r in table.select("sequence", ops.validity(F.col("sequence")).alias("v")).collect():
        if r.sequence is not None:
            flags = np.unpackbits(np.frombuffer(r.v, np.uint8), bitorder="little")[: len(r.sequence)].tolist()
            assert flags == [int(c in "ACGTacgt") for c in r.sequence]


def test_forbidden_minimizers_as_bitmap(spark):
    rows = spark.createDataFrame([(1, "ACGTTGCAACGGTTACGATTACAGATTACCA")], "seq_id long, sequence string")
    bad = {r.code for r in ops.kmers(rows, 14).collect() if r.pos % 2}
    got = [(r.pos, r.min_value, r.min_pos) for r in ops.minimizers(rows, 14, 3, forbidden=bad).orderBy("pos").collect()]
    codes = [(r.pos, r.code) for r in ops.kmers(rows, 14).orderBy("pos").collect()]
    want = []
    for p in range(2, len(codes)):
        free = [(c, -q) for q, c in codes[p - 2 : p + 1] if c not in bad]
        if free:
            want.append((p, min(free)[0], -min(free)[1]))
    assert got == want
    with pytest.raises(ValueError, match="14"):
        ops.minimizers(rows, 15, 3, forbidden=bad)


def test_lookup_tables(spark):
    """Codes without entries, null codes, several blocks, and one code that most rows have."""
    rng = random.Random(7)
    entries = [(c, rng.choice([0, 1, 2**40, 77])) for c in rng.sample(range(4**14), 500)] + [(5, 9), (5, 11), (65535, 1), (65536, 2), (None, 3), (8, None)]
    codes = [5] * 3000 + [rng.choice(entries)[0] for _ in range(400)] + [rng.randrange(4**14) for _ in range(100)] + [None, 7, 8, 65536]
    rows = spark.createDataFrame([(i, c, "d") for i, c in enumerate(codes)], "i long, code long, data string").repartition(5)
    table = tables.direct_table(spark.createDataFrame(entries, "code long, rank long"))
    want = {}
    for c, r in entries:
        if c is not None and r is not None:
            want[c] = max(r, want.get(c, 0))
    for task_rows in (100, 10**6):
        got = {r.i: (r.code, r.data, r.rank) for r in tables.looked_up(rows, table, task_rows=task_rows).collect()}
        assert got == {i: (c, "d", want.get(c)) for i, c in enumerate(codes)}
    assert tables.looked_up(rows.limit(0), table).collect() == []


@pytest.mark.parametrize("k", [1, 5, 31, 32, 33, 40, 64, 70])
def test_canonical_extremes_of_any_length(spark, monkeypatch, k):
    """Also over slices: the least and greatest of a slice travel, never its k-mers."""
    monkeypatch.setattr(ops, "SLICE", 50)
    rng = random.Random(k)
    seqs = {i: "".join(rng.choice("ACGTacgt") if rng.random() < 0.995 else "N" for _ in range(rng.randint(0, 400))) for i in range(12)}
    flip = str.maketrans("ACGT", "TGCA")
    digits = str.maketrans("ACTG", "0123")
    want = {}
    for i, s in seqs.items():
        s = s.upper()
        found = [min(x.translate(digits), x.translate(flip)[::-1].translate(digits)) for x in (s[p : p + k] for p in range(len(s) - k + 1)) if "N" not in x]
        if found:
            want[i] = len(found), int(min(found), 4), int(max(found), 4)
    table = spark.createDataFrame([*seqs.items(), (99, None)], "seq_id long, sequence string")
    rows = ops.canonical_extremes(table, k).groupBy("seq_id").agg(F.sum("n").alias("n"), F.min("least").alias("a"), F.max("most").alias("z")).collect()
    number = lambda words: sum((w + 2**63) << 64 * j for j, w in enumerate(reversed(words)))
    assert {r.seq_id: (r.n, number(r.a), number(r.z)) for r in rows} == want


@pytest.mark.parametrize("w", [1, 4, 200])
def test_minimizer_totals(spark, w):
    """The sums of the rows of minimizers, also where a run and its minimum go on in the next slice."""
    rng = random.Random(w)
    seqs = ["".join(rng.choice("ACGTN" if i < 6 else "ACGT") for _ in range(n)) for i, n in enumerate([0, 3, 8, 300, 900, 2000, 4000, ops.SLICE + 700])]
    table = spark.createDataFrame([*enumerate(seqs), (99, None)], "seq_id long, sequence string")
    each = ops.minimizers(table, 5, w).groupBy("seq_id", "run").agg(F.count("*").alias("n"), F.count_distinct("min_pos").alias("m"), F.sum("min_value").alias("c"), F.sum("min_pos").alias("p"))
    want = each.groupBy("seq_id").agg(*[F.sum(c) for c in "nmcp"])
    got = ops.minimizer_totals(table, 5, w).groupBy("seq_id").agg(*[F.sum(c) for c in ("n", "n_minima", "codes", "places")])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("k", [3, 8, 13])
def test_distinct_codes(spark, k):
    rng = random.Random(k)
    table = spark.createDataFrame([(i, "".join(rng.choice("ACGTacgtN") for _ in range(500))) for i in range(20)] + [(99, None)], "seq_id long, sequence string")
    got = [r.code for r in ops.distinct_codes(table, k).collect()]
    assert sorted(got) == sorted(r.code for r in ops.kmers(table, k).select("code").distinct().collect())


def test_packed_rows_in_parts_of_a_batch(spark, monkeypatch):
    """A batch of many texts is packed and unpacked by parts, in order."""
    monkeypatch.setattr(packed_sequences, "CHARS", 100)
    texts = {i: "ACGTN acgt"[: i % 11] * (i % 7) for i in range(300)}
    table = spark.createDataFrame(list(texts.items()), "seq_id long, sequence string").coalesce(1)
    rows = packed_sequences.pack_sequences(table)
    assert {r.seq_id: r.sequence for r in packed_sequences.unpack_sequences(rows).collect()} == texts
