"""Properties of the functions, and the FASTA/FASTQ reader at every split."""

import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import bits, nucleotides, vectorised
from strandlake.operators import kmers as ops
from strandlake.sources import fastx

FA = b">s1\nAT\n>s2\nGC\n>s3\nAC\n>s4\nTA\n"
FQ = b"@s1\nAT\n+\nII\n@s2\nGC\n+\nII\n@s3\nAC\n+\n@E\n@s4\nTA\n+\nII\n"


@pytest.mark.parametrize(("data", "kind"), [(FA, "fasta"), (FQ, "fastq"), (FA[:-1], "fasta"), (FQ.replace(b"\n", b"\r\n"), "fastq")])
def test_every_split_gives_all_records_once(data, kind):
    whole = [r[1:3] for r in fastx.read_range(io.BytesIO(data), 0, len(data), kind)]
    assert whole == [("s1", "AT"), ("s2", "GC"), ("s3", "AC"), ("s4", "TA")]
    for cut in range(len(data) + 1):
        parts = [r[1:3] for a, b in ((0, cut), (cut, len(data))) for r in fastx.read_range(io.BytesIO(data), a, b, kind)]
        assert parts == whole, cut


@pytest.mark.parametrize(("data", "kind", "message"), [(b"AC\n>s\nA\n", "fasta", "No header"), (b">s\n>t\nA\n", "fasta", "Empty sequence"), (b"@s\nAC\nx\nII\n", "fastq", "quality header"), (b"@s\nAC\n+\nI\n", "fastq", "newline after quality")])
def test_malformed_input(data, kind, message):
    with pytest.raises(ValueError, match=message):
        list(fastx.read_range(io.BytesIO(data), 0, len(data), kind))
    list(fastx.read_range(io.BytesIO(data), 0, len(data), kind, strict=False))


def test_unterminated_record_and_suffix():
    assert len(list(fastx.read_range(io.BytesIO(FA[:-1]), 0, 99, "fasta", strict_terminator=True))) == 3
    assert list(fastx.read_range(io.BytesIO(b""), 0, 0, "fasta")) == []
    with pytest.raises(ValueError, match="unsupported"):
        fastx.format_of("x.txt")


def test_data_source(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(FQ)
    fastx.register(spark)
    rows = spark.read.format("fastx").option("split_bytes", "11").load(str(tmp_path / "a.fq"))
    assert sorted((r.header, r.quality) for r in rows.collect()) == [("s1", "II"), ("s2", "II"), ("s3", "@E"), ("s4", "II")]


def test_strands_and_codes(spark):
    k = 11
    rows = spark.range(500).select((F.xxhash64("id").bitwiseAND(F.lit(4**k - 1).cast("long"))).alias("c"))
    rc = nucleotides.reverse_complement_code(F.col("c"), k)
    out = rows.select("c", rc.alias("rc"), nucleotides.reverse_complement_code(rc, k).alias("back"), nucleotides.encode_kmer(nucleotides.decode_kmer(F.col("c"), k)).alias("again"), nucleotides.canonical(F.col("c"), k).alias("a"), nucleotides.canonical(rc, k).alias("b"), nucleotides.restore_parity(nucleotides.canonical_parity(F.col("c"), k)).alias("p"), vectorised.unhash64(vectorised.hash64(F.col("c"))).alias("h")).collect()
    assert all(r.c == r.back == r.again == r.h and r.a == r.b and r.p in (r.c, r.rc) for r in out)
    assert spark.range(1).select(nucleotides.encode_kmer(F.lit("ACTG")), vectorised.hash64(F.lit(1).cast("long"))).first()[:] == (27, 4717996019076358352)
    with pytest.raises(ValueError, match="odd"):
        nucleotides.canonical_parity(F.col("c"), 4)


@pytest.mark.parametrize("k", [1, 2, 3, 15, 16, 31])
def test_kmers_of_edge_sequences(spark, k):
    seqs = ["", "A" * (k - 1), "N" * 50, "ACGT" * 12 + "N" + "acgtT" * 9, "é" + "G" * k, None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, sequence string")
    want = sorted((i, p) for i, s in enumerate(seqs) if s for p in range(len(s) - k + 1) if set(s[p : p + k]) <= set("ACGTacgt"))
    assert sorted((r.seq_id, r.pos) for r in ops.kmers(rows, k).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 57), st.lists(st.integers(0, 2**57 - 1), max_size=40))
def test_packing_round_trip(width, values):
    v = np.array([x & ((1 << width) - 1) for x in values], np.int64)
    data = vectorised.pack_ints(v, width)
    assert len(data) == -(-len(v) * width // 8)
    assert vectorised.unpack_ints(data, width, len(v)).tolist() == v.tolist() if len(v) else data == b""


def test_bits(spark):
    x = F.col("x")
    r = spark.createDataFrame([(0x0123456789ABCDEF,)], "x long").select(bits.byte_swap(x), bits.rotate_left(x, 8), bits.peek(x, 8, 4), bits.poke(x, F.lit(0).cast("long"), 8, 0), bits.from_variable_bytes(bits.variable_bytes(x)), bits.count_leading_zeros(x)).first()
    assert [v & (2**64 - 1) for v in r] == [0xEFCDAB8967452301, 0x23456789ABCDEF01, 0xDE, 0x0123456789ABCD00, 0x0123456789ABCDEF, 7]


def test_fastq_by_text_reader(spark, tmp_path):
    data = FQ + b"@@x\n@A\n+x\n@@\n\n@\n\n+\n\n@last\nACG\n+\n+@I"
    (tmp_path / "a.fq").write_bytes(data)
    (tmp_path / "b.fq").write_bytes(data.replace(b"\n", b"\r\n"))
    want = sorted(r[1:] for r in fastx.read_range(io.BytesIO(data), 0, len(data), "fastq"))
    assert ("s3", "AC", "@E") in want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1, 2, 3, 5, 7, 11, 16, 1 << 20):  # records cross any number of blocks
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(map(tuple, fastx.read_fastq(spark, str(tmp_path)).collect())) == sorted(want * 2), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("data", "message"), [(b"AC\n@s\nA\n+\nI\n", "Expected header"), (b"@s\nAC\nx\nII\n", "quality header"), (b"@s\nAC\n+\nI\n", "newline after quality"), (b"@s\nAC\n+\n", "Truncated")])
def test_fastq_by_text_reader_malformed(spark, tmp_path, data, message):
    (tmp_path / "a.fq").write_bytes(data)
    with pytest.raises(Exception, match=message):
        fastx.read_fastq(spark, str(tmp_path)).collect()
    assert fastx.read_fastq(spark, str(tmp_path), strict=False).count() == (1 if data.startswith(b"AC") else 0)


def test_fasta_leaves_out_what_precedes_the_first_record(spark, tmp_path):
    (tmp_path / "a.fa").write_text("stray\nlines\n>s1\nAC\n\nGT\n>s2\nTT")
    (tmp_path / "b.fa").write_text(">s3\nGG\n")
    got = {(r.header, r.sequence) for r in fastx.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {("s1", "ACGT"), ("s2", "TT"), ("s3", "GG")}


def test_fastx_reads_folders_in_splits_of_any_size(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"f{n}.fq").write_text("".join(f"@{n}{i}\nAC\n+\n@E\n" for i in range(4)))
    fastx.register(spark)
    for size in (1, 7, 13, 1000):
        rows = spark.read.format("fastx").option("path", str(tmp_path)).option("split_bytes", str(size)).load().collect()
        assert sorted((r.header, r.quality) for r in rows) == [(f"{n}{i}", "@E") for n in range(3) for i in range(4)]


def test_slices_of_a_long_sequence_agree_with_the_whole(monkeypatch):
    import random

    from strandlake.operators import kmers as ops

    random.seed(2)
    text = "".join(random.choice("ACGTACGTACGTN") for _ in range(700))
    flat = lambda parts: [x.tolist() for x in (np.concatenate(c) for c in zip(*parts, strict=True))]
    whole = flat(ops._scan(text, 3)), flat(ops._window_minima(text, 3, 4, True, None))
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(ops, "SLICE", size)
        assert (flat(ops._scan(text, 3)), flat(ops._window_minima(text, 3, 4, True, None))) == whole


def test_strict_bases_and_wide_words(spark):
    from strandlake.functions import bits
    from strandlake.functions import nucleotides as nt

    with pytest.raises(Exception, match="Invalid DNA"):
        spark.createDataFrame([("ACN",)], "s string").select(nt.require_valid(F.col("s"))).collect()
    x, mask = 0x0123456789ABCDEF_FEDCBA9876543210, (1 << 64) - 1
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    row = spark.createDataFrame([(signed(x & mask), signed(x >> 64))], "lo long, hi long")
    for n in (0, 1, 13, 64, 77, 127):
        left = row.select(*bits.shift_left_wide([F.col("lo"), F.col("hi")], n)).first()
        right = row.select(*bits.shift_right_wide([F.col("lo"), F.col("hi")], n)).first()
        assert [v & mask for v in left] == [x << n & mask, x << n >> 64 & mask]
        assert [v & mask for v in right] == [x >> n & mask, x >> n >> 64]
