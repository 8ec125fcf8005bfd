"""FASTA and FASTQ as a Spark data source, ``spark.read.format("fastx")``, and native readers and writers.

Options: path (a file, or a folder of files), format (fasta or fastq; from the suffix otherwise), strict (true: malformed input is an error,
false: it is skipped), strict_terminator (true: an unterminated last record is dropped), split_bytes, layout. Splits are byte
ranges; a reader starts at the first record that begins in its range and reads the last one to its end. Small neighbouring
ranges of a file are one task, so tasks grow in number with the bytes and not with the ranges. With the layout
``pieces`` (FASTA only) a reader takes the bytes of its range alone, wherever records begin and end, so that a record of
any length is read by as many tasks as it has ranges; ``strandlake.operators.feeds.stitched`` puts its pieces in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.scratch import stored

#: Bytes of a split, unless the option says otherwise, and of the neighbouring splits that one task reads, about.
SPLIT_BYTES, TASK_BYTES = 32 << 20, 4 << 20
PIECES = "path string, split long, row int, record long, header string, rest string, rest_ended boolean, sequence string, before long, last boolean, header_open boolean"
SCHEMA = "offset long, header string, sequence string, quality string"
SUFFIXES = {".fa": "fasta", ".fasta": "fasta", ".fq": "fastq", ".fastq": "fastq"}


def format_of(path: str) -> str:
    for suffix, kind in SUFFIXES.items():
        if path.endswith(suffix):
            return kind
    raise ValueError(f"unsupported file format: {path}")


@dataclass
class ByteRange(InputPartition):
    """Bytes of a file that one task reads, in ranges of the reader's ``split`` each."""

    start: int
    end: int
    path: str = ""


class Lines:
    """Lines of a file from a byte offset, with their offsets."""

    def __init__(self, data, at: int):
        self.data, self.at = data, at
        data.seek(at)

    def next(self) -> tuple[int, bytes] | None:
        at, line = self.at, self.data.readline()
        self.at += len(line)
        return (at, line) if line else None


def _bare(line: bytes) -> bytes:
    return line.rstrip(b"\n").rstrip(b"\r")


def _align(data, start: int, mark: bytes, fastq: bool) -> int | None:
    """The first record that begins at or after ``start``."""
    lines = Lines(data, max(0, start - 1))
    if start:
        lines.next()  # the rest of the line that holds the byte before the range
    seen = []
    while (line := lines.next()) is not None:
        if not fastq:
            if line[1].startswith(mark):
                return line[0]
            continue
        # a quality line may begin with @ as well: then the line after it does so too, as the next header
        seen.append(line)
        if len(seen) >= 2 and seen[-2][1].startswith(mark):
            return seen[-1][0] if seen[-1][1].startswith(mark) else seen[-2][0]
    return None  # a last line that begins with @ is a quality: a record has four lines


def read_range(data, start: int, end: int, kind: str, strict: bool = True, strict_terminator: bool = False) -> Iterator[tuple[int, str, str, str | None]]:
    """The records that begin in [start, end) of a seekable binary file."""
    fastq = kind == "fastq"
    mark = b"@" if fastq else b">"
    if start == 0 and strict:
        data.seek(0)
        first = data.read(1)
        if first and first != mark:
            raise ValueError("No header found at the start of the file")
    at = _align(data, start, mark, fastq)
    if at is None or at >= end:
        return
    lines = Lines(data, at)
    line = lines.next()
    while line is not None and line[0] < end:
        offset, head = line
        if not head.startswith(mark):
            if strict and _bare(head):
                raise ValueError("Expected header")
            line = lines.next()
            continue
        header, parts, ended = _bare(head)[1:].decode("latin-1"), [], head.endswith(b"\n")
        if fastq:
            rest = [lines.next() for _ in range(3)]
            whole = all(r is not None for r in rest)
            ended = whole and rest[2][1].endswith(b"\n")
            line = lines.next()
            if not whole or strict_terminator and not ended:
                if strict and not strict_terminator:
                    raise ValueError("Truncated record")
                continue
            seq, plus, quality = (_bare(r[1]) for r in rest)
            problem = "Expected quality header" if not plus.startswith(b"+") else "Expected newline after quality" if len(seq) != len(quality) else ""
            if problem:
                if strict:
                    raise ValueError(problem)
                continue
            yield offset, header, seq.decode("latin-1"), quality.decode("latin-1")
            continue
        while (line := lines.next()) is not None and not line[1].startswith(mark):
            parts.append(_bare(line[1]))
            ended = line[1].endswith(b"\n")
        sequence = b"".join(parts)
        if strict_terminator and not ended:
            continue
        if not sequence and strict:
            raise ValueError("Empty sequence")
        yield offset, header, sequence.decode("latin-1"), None


def read_pieces(data, start: int, end: int) -> list[tuple]:
    """What the bytes [start, end) of a seekable FASTA file hold, as rows of ``PIECES`` after path and split.

    Without a record: ``rest`` (of a line that begins before the range; whether it is a header is known to earlier ranges
    only) and the sequence up to the first header. Then a row per record that begins in the range, with its whole header
    line, even if that ends behind the range. ``before`` counts the bases of the range's rows before, without the rest.
    """
    data.seek(max(0, start - 1))
    block = data.read(end - max(0, start - 1))
    fresh = start == 0 or block[:1] == b"\n"
    block = block[min(start, 1) :]
    heads, at = [], 0 if fresh and block[:1] == b">" else block.find(b"\n>") + 1
    while at or fresh and not heads and block[:1] == b">":
        heads.append(at)
        at = block.find(b"\n>", at) + 1
    bases = lambda b: b.translate(None, b"\r\n").decode("latin-1")
    rows: list[list] = []
    if not heads or heads[0]:
        top = block[: heads[0]] if heads else block
        cut = 0 if fresh else (top.find(b"\n") + 1 or len(top))
        ended = fresh or top[cut - 1 : cut] == b"\n"
        rows.append([None, None, bases(top[:cut]), ended, bases(top[cut:]), False if ended else None])
    for a, z in zip(heads, [*heads, len(block)][1:], strict=True):
        line = block.find(b"\n", a, z)
        whole = line >= 0
        head = block[a + 1 : line] if whole else block[a + 1 : z] + data.readline()
        rows.append([start + a, _bare(head).decode("latin-1"), None, None, bases(block[line + 1 : z]) if whole else "", not whole])
    out, before = [], 0
    for n, (record, header, rest, ended, sequence, header_open) in enumerate(rows):
        out.append((n, record, header, rest, ended, sequence, before, n == len(rows) - 1, header_open))
        before += len(sequence)
    return out


def _open(path: str):
    if "://" not in path or path.startswith("file:"):
        return open(path.removeprefix("file://").removeprefix("file:"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _files(path: str) -> list[tuple[str, int]]:
    """The data files of a path and their sizes; names that begin with . or _ are none."""
    from pyarrow import fs

    local = "://" not in path and not path.startswith("file:")
    plain = path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path
    store, inner = (fs.LocalFileSystem(), plain) if local or path.startswith("file:") else fs.FileSystem.from_uri(path)
    top = store.get_file_info(inner)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.type == fs.FileType.File:
        return [(path, top.size)]
    found = [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((prefix + f.path, f.size) for f in found)


#: Rows of an Arrow batch, and characters of its sequences, about: a longer record is a batch of its own.
BATCH_ROWS, BATCH_CHARS = 4096, 16 << 20


def _by_size(rows: Iterator[tuple], at: int) -> Iterator[list[tuple]]:
    """Rows in runs of bounded number and size of the text at place ``at``."""
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += len(r[at])
        if len(held) == BATCH_ROWS or chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = options.get("format")
        self.strict = options.get("strict", "true").lower() == "true"
        self.strict_terminator = options.get("strict_terminator", "false").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.pieces = options.get("layout", "records") == "pieces"
        if not self.kind:
            for path, _ in _files(self.path):
                format_of(path)

    def partitions(self) -> list[ByteRange]:
        step = max(1, TASK_BYTES // self.split) * self.split
        found = [ByteRange(s, min(size, s + step), path) for path, size in _files(self.path) for s in range(0, size, step)]
        return found or [ByteRange(0, 0, "")]

    def read(self, partition: ByteRange) -> Iterator:
        """The records or pieces of a task's byte ranges, as Arrow batches."""
        if not partition.path:
            return
        kind = self.kind or format_of(partition.path)
        ranges = [(s, min(partition.end, s + self.split)) for s in range(partition.start, partition.end, self.split)]
        with _open(partition.path) as f:
            if self.pieces:
                if kind != "fasta":
                    raise ValueError("only FASTA is read in pieces")
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())
                rows, at, names = ((partition.path, s, *r) for s, e in ranges for r in read_pieces(f, s, e)), 7, [c.split()[0] for c in PIECES.split(", ")]
            else:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
                rows, at, names = (r for s, e in ranges for r in read_range(f, s, e, kind, self.strict, self.strict_terminator)), 2, ["offset", "header", "sequence", "quality"]
            for part in _by_size(rows, at):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)


class FastxSource(DataSource):
    """``fastx``: rows of offset (byte place of the record), header, sequence and quality (null for FASTA), or of ``PIECES``."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return PIECES if self.options.get("layout") == "pieces" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastxReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines; blank ones stay and so does an unterminated last one."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and sequence of FASTA files or folders by Spark's own text reader: a record per row, any store.

    What stands before the first ``>`` of a file belongs to no record and is left out.
    """
    block = F.col("_metadata.file_block_start")
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), block.alias("block"), "value")

    def records(batches):
        at = None
        for b in batches:
            keep = []
            for p, k, value in zip(*(b.column(c).to_pylist() for c in ("path", "block", "value")), strict=True):
                first, at = (p, k) != at and k == 0, (p, k)  # the first row of a file still has its mark
                if not first:
                    keep.append(value)
                elif value.startswith(">"):
                    keep.append(value[1:])
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.string())], ["r"])

    rows = rows.mapInArrow(records, "r string")
    body = F.regexp_replace(F.col("r"), "^[^\n]*\n?", "")
    return rows.select(F.regexp_extract("r", "^([^\r\n]*)", 1).alias("header"), F.regexp_replace(body, "[\r\n]", "").alias("sequence")).filter("header <> '' OR sequence <> ''")


#: Blocks of FASTQ files at most that Spark's text reader is asked for at once: one slim row each is broadcast.
MOST_BLOCKS = 1 << 20


def _headers(marked: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    """The lines where records begin, from line ``at`` between two records on, and the lines of the last record at the end.

    Records have four lines each; a line between records that has no mark is none of a record.
    """
    found, n = [], len(marked)
    while at < n:
        fine = marked[at::4]
        stop = int(np.argmin(fine)) if not fine.all() else len(fine)
        found.append(np.arange(at, at + 4 * stop, 4))
        if stop == len(fine):
            return np.concatenate(found), (n - at) % 4
        at += 4 * stop + 1
    return np.concatenate(found) if found else np.zeros(0, np.int64), 0


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of each batch by the block that they stand in; a block's rows come in order."""
    for b in batches:
        path, block = b.column("path"), np.asarray(b.column("block"))
        new = np.append(True, block[1:] != block[:-1])
        if len(path) > 1:
            new[1:] |= np.asarray(pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)))
        cuts = np.flatnonzero(new).tolist()
        for s, e in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            yield path[s].as_py(), int(block[s]), b.slice(s, e - s)


def _bare_lines(lines: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(lines, "\r$", "")


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block its lines, the state at its end for each state at its start, and its first and last three lines.

    A state is the number of lines of a record that is open: 0 between records.
    """
    kinds = {"path": pa.string(), "block": pa.int64(), "n": pa.int64(), "ends": pa.list_(pa.int32()), "head": pa.list_(pa.string()), "tail": pa.list_(pa.string())}
    at, marks, head, tail = None, [], [], []

    def done() -> pa.RecordBatch:
        marked = np.concatenate(marks)
        ends = [_headers(marked, 0)[1]] + [_headers(marked, 4 - s)[1] if len(marked) >= 4 - s else s + len(marked) for s in (1, 2, 3)]
        row = [*at, len(marked), ends, head, tail]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds.values(), strict=True)], list(kinds))

    for path, block, b in _by_block(batches):
        if (path, block) != at:
            if at is not None:
                yield done()
            at, marks, head, tail = (path, block), [], [], []
        lines = b.column("value")
        marks.append(np.asarray(pc.starts_with(lines, "@")))
        if len(head) < 3:
            head += _bare_lines(lines.slice(0, 3 - len(head))).to_pylist()
        tail = (tail + _bare_lines(lines.slice(max(0, len(lines) - 3))).to_pylist())[-3:]
    if at is not None:
        yield done()


def _joined_blocks(table: pa.Table) -> pa.Table:
    """Of the blocks of one file, in order: the state where each begins, the records that cross blocks, and whether one stays open."""
    rows, state, part = [], 0, []
    path = None
    for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
        path = r["path"]
        rows.append((path, r["block"], state, None))
        take = min((4 - state) % 4, r["n"])
        if state:
            part += r["head"][:take]
            if len(part) == 4:
                rows.append((path, None, None, part))
                part = []
        was, state = state, r["ends"][state]
        if state and not (was and take == r["n"] and was + take < 4):
            part = r["tail"][-state:]
    if state:
        rows.append((path, None, state, None))
    columns = list(zip(*rows, strict=True))
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("path", "block", "state", "lines"), columns, (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)})


def _whole_records(strict: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records that lie in one block, from its lines and the state where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, skip = None, None, 0
        for path, block, b in _by_block(batches):
            if (path, block) != at:
                at, held, skip = (path, block), None, (4 - b.column("state")[0].as_py()) % 4
            lines = b.column("value")
            skipped = min(skip, len(lines))
            skip -= skipped
            lines = lines.slice(skipped)
            if held is not None:
                lines = pa.concat_arrays([held, lines])
            marked = np.asarray(pc.starts_with(lines, "@"))
            heads, open_ = _headers(marked, 0)
            if strict and 4 * len(heads) - (4 - open_) % 4 < len(lines):  # some lines are of no record
                mine = np.zeros(len(lines) + 4, bool)
                for k in range(4):
                    mine[heads + k] = True
                if any(_bare_lines(lines.filter(pa.array(~mine[: len(lines)]))).to_pylist()):
                    raise ValueError("Expected header")
            if open_:
                heads = heads[:-1]
            held = lines.slice(len(lines) - open_) if open_ else None
            if len(heads):
                columns = [_bare_lines(lines.take(pa.array(heads + k))) for k in range(4)]
                yield pa.RecordBatch.from_arrays(columns, ["header", "sequence", "plus", "quality"])

    return run


def read_fastq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """header, sequence and quality of FASTQ files or folders by Spark's own text reader, any store.

    Lines are counted from the start of each file, so any line may begin with @ or +. A first pass makes one slim row per
    block of Spark's: how it changes the place in a record, and the lines at its edges. The blocks of a file are put in
    order from these rows, which also gives the records that cross blocks; a second pass reads the others where they lie.
    ``strict``: malformed input is an error, otherwise it is skipped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    blocks = lines.mapInArrow(_block_ends, "path string, block long, n long, ends array<int>, head array<string>, tail array<string>")
    placed = stored(blocks.groupBy("path").applyInArrow(_joined_blocks, "path string, block long, state int, lines array<string>"), "fastq-blocks")
    counts = placed.agg(F.count("block").alias("blocks"), F.count_if(F.col("block").isNull() & F.col("state").isNotNull()).alias("open")).first()
    if strict and counts["open"]:
        raise ValueError("Truncated record")
    if counts["blocks"] > MOST_BLOCKS:
        raise ValueError("too many blocks: raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    starts = F.broadcast(placed.filter("block IS NOT NULL").select("path", "block", "state"))
    rows = lines.join(starts, ["path", "block"]).select("path", "block", "value", "state").mapInArrow(_whole_records(strict), "header string, sequence string, plus string, quality string")
    rows = rows.unionByName(placed.filter("lines IS NOT NULL").select(*[F.get("lines", F.lit(k)).alias(c) for k, c in enumerate(("header", "sequence", "plus", "quality"))]))
    problem = F.when(~F.col("plus").startswith("+"), "Expected quality header").when(F.length("sequence") != F.length("quality"), "Expected newline after quality")
    right = F.when(problem.isNull(), True).otherwise(F.raise_error(problem).cast("boolean") if strict else F.lit(False))
    return rows.filter(right).select(F.substr("header", F.lit(2)).alias("header"), "sequence", "quality")


def write_fasta(df: DataFrame, path: str, header: str = "header", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), F.col(sequence))).write.text(path)


def write_fastq(df: DataFrame, path: str, header: str = "header", sequence: str = "sequence", quality: str = "quality") -> None:
    parts = (F.lit("@"), F.col(header).cast("string"), F.lit("\n"), F.col(sequence), F.lit("\n+\n"), F.col(quality))
    df.select(F.concat(*parts)).write.text(path)
