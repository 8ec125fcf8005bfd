"""Chunks, split records and streams give the k-mers of the whole sequences."""

import io
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import feeds
from strandlake.operators import kmers as ops
from strandlake.operators import ordering
from strandlake.sources import fastx

CODE = {c: i for i, c in enumerate("ACTG")}


def by_hand(sequence, k):
    out = []
    for p in range(len(sequence) - k + 1):
        if set(sequence[p : p + k]) <= set("ACGTacgt"):
            code = 0
            for c in sequence[p : p + k].upper():
                code = code * 4 + CODE[c]
            out.append((p, code))
    return out


@pytest.mark.parametrize("k", [1, 2, 5, 16, 31])
def test_chunks_of_any_length(spark, k):
    """Also chunks shorter than k - 1, empty and null ones, and the survey's feed of 16 and 2 bases."""
    rng = random.Random(k)
    whole = {i: "".join(rng.choice("ACGTacgtN") if rng.random() < 0.1 else rng.choice("ACGT") for _ in range(rng.randint(0, 150))) for i in range(12)}
    whole[20] = "ATGCTGGCTGCTATTC" + "GC"
    rows = []
    for i, s in whole.items():
        at, part = 0, 0
        while at < len(s):
            n = 16 if i == 20 else rng.choice([0, 1, 1, 2, 7, 40])
            rows.append((i, part, s[at : at + n], "x"))
            at, part = at + n, part + rng.randint(1, 3)
        rows.append((i, part, None, "x"))
    table = spark.createDataFrame(rows, "seq_id long, part long, sequence string, start string").drop("start").repartition(5)
    got = sorted(map(tuple, feeds.chunked_kmers(table, k).collect()))
    assert got == sorted((i, p, c) for i, s in whole.items() for p, c in by_hand(s, k))
    if k == 16:
        assert sum(i == 20 for i, *_ in got) == 3


FASTA = {
    "a.fa": "stray\nlines\n>s1 first\nACGTAC\nGT\n\nNNACGT\n>s2\n>s3 empty before\nTTTTGGGGCCCCAAAACGCGATATCGGATTACA\n>last header without bases and rather long",
    "b.fa": ">one line\n" + "ACGTTGCA" * 20 + "\n>crlf\r\nAC\r\nGT\r\nAC\r\n",
    "c.fa": "ACGT\nACGT\n",
    "d.fa": ">x\nA\nC\nG\nT\nA\nC\nG\nT\n>y > z\nG\nG>G\nAC",
}


def records_by_hand(text):
    """(byte place of the header or None, header, bases) of each record, and what precedes the first one."""
    out, at = [[None, None, ""]], 0
    for line in text.splitlines(keepends=True):
        if line.startswith(">"):
            out.append([at, line[1:].rstrip("\r\n"), ""])
        else:
            out[-1][2] += line.strip("\r\n")
        at += len(line)
    return out


@pytest.mark.parametrize("split", [1, 3, 8, 40, 1000])
def test_records_over_splits_of_any_size(spark, tmp_path, split):
    for name, text in FASTA.items():
        (tmp_path / name).write_bytes(text.encode())
    k = 5
    rows = feeds.stitched(spark, str(tmp_path), k, split)
    got = sorted((r.path.rpartition("/")[2], -1 if r.record is None else r.record, r.pos, r.code) for r in feeds.fed_kmers(rows, k, ["path", "record"]).collect())
    want = sorted((name, -1 if at is None else at, p, c) for name, text in FASTA.items() for at, _, s in records_by_hand(text) for p, c in by_hand(s, k))
    assert got == want
    heads = {(r.path.rpartition("/")[2], r.record): r.header for r in rows.filter("header IS NOT NULL").collect()}
    assert heads == {(name, at): h for name, text in FASTA.items() for at, h, _ in records_by_hand(text) if at is not None}
    # places over all files: every base counts, also before the first header
    flat = "".join(s for _, text in sorted(FASTA.items()) for _, _, s in records_by_hand(text))
    for r in rows.collect():
        assert flat[r.file_start : r.file_start + len(r.sequence)] == r.sequence


def test_pieces_of_every_byte_range():
    """At every split, pieces hold each base once and each header once, whole."""
    text = (FASTA["a.fa"] + "\n").encode()
    whole = records_by_hand(text.decode())
    for cut in range(len(text) + 1):
        rows = [r for a, z in ((0, cut), (cut, len(text))) if z > a for r in fastx.read_pieces(io.BytesIO(text), a, z)]
        assert [r[2] for r in rows if r[1] is not None] == [h for at, h, _ in whole if at is not None]
        assert sum(r[7] for r in rows) == (1 if cut in (0, len(text)) else 2)


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, 1, 50])) for i in range(300)]
    table = spark.createDataFrame(rows, "i long, n long").repartition(4)
    for ranges in (1, 7):
        got = {r.i: r.before for r in ordering.running_totals(table, "n", "i", ranges=ranges).collect()}
        upto = 0
        for i, n in rows:
            assert got[i] == upto
            upto += n or 0


def test_a_stream_of_chunks_equals_the_batch(spark, tmp_path):
    """Chunks that arrive in several micro-batches, some before their turn."""
    from strandlake.streaming import kmer_stream

    rng = random.Random(5)
    whole = {i: "".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randint(0, 120))) for i in range(8)}
    chunks = [(i, n, s[a : a + 13]) for i, s in whole.items() for n, a in enumerate(range(0, len(s), 13))]
    rng.shuffle(chunks)
    for n in range(3):
        spark.createDataFrame(chunks[n::3], "seq_id long, part long, sequence string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, part long, sequence string").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    run = kmer_stream.stream_chunked_kmers(stream, 7).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(run.recentProgress) >= 3
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted((i, p, c) for i, s in whole.items() for p, c in by_hand(s, 7))
    batch = spark.createDataFrame(chunks, "seq_id long, part long, sequence string")
    assert got == sorted(map(tuple, feeds.chunked_kmers(batch, 7).collect()))


def test_scan_of_whole_sequences_agrees(spark):
    table = spark.createDataFrame([(1, 0, "ACGTNACGTT")], "seq_id long, part long, sequence string")
    whole = ops.kmers(table, 3).select("seq_id", "pos", "code")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, feeds.chunked_kmers(table, 3).select("seq_id", "pos", "code").collect()))
    assert feeds.chunked_kmers(table.filter(F.lit(False)), 3).collect() == []


@pytest.mark.parametrize("layout", ["records", "pieces"])
def test_small_ranges_share_a_task(tmp_path, layout):
    """Tasks grow with the bytes: ranges of 10 bytes of a small file are one task, and every range is read."""
    (tmp_path / "a.fa").write_text("".join(f">s{i}\n{'ACGT' * i}\n" for i in range(1, 60)))
    reader = fastx.FastxReader({"path": str(tmp_path / "a.fa"), "split_bytes": "10", "layout": layout})
    parts = reader.partitions()
    assert len(parts) == 1
    rows = [r for b in reader.read(parts[0]) for r in b.to_pylist()]
    assert [r["header"] for r in rows if r["header"] is not None] == [f"s{i}" for i in range(1, 60)]
    if layout == "pieces":
        assert len({r["split"] for r in rows}) == -(-(tmp_path / "a.fa").stat().st_size // 10)


def test_totals_are_those_of_the_kmers(spark, tmp_path):
    """Chunks without a k-mer keep a row, so that their record isn't lost."""
    (tmp_path / "a.fa").write_text(">x\n" + "ACGTTGCANNAC\n" * 9 + ">short\nAC\n>none\nNNNNNNN\n>y\nGATTACA\n")
    pieces = feeds.stitched(spark, str(tmp_path), 4, 7)
    got = feeds.fed_totals(pieces, 4, ["path", "record"]).groupBy("record").agg(*[getattr(F, f)(c).alias(c) for f, c in (("sum", "n"), ("min", "first"), ("max", "last"), ("sum", "total"), ("sum", "codes"))])
    want = feeds.fed_kmers(pieces, 4, ["record"]).groupBy("record").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.sum("pos").alias("total"), F.sum("code").alias("codes"))
    assert sorted(map(tuple, got.filter("n > 0").collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("n = 0").count() == 2
