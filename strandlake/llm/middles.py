"""Fill-in-the-middle: documents cut at two token boundaries and put together again in another order.

The cuts are found by bit-parallel arithmetic on big integers, one bit per UTF-8 byte, the first byte highest.
``bytes.translate`` turns a text into the digits of its class masks; one shift and one boolean operation mark every byte
where a token begins; ``bit_count`` gives their number; and the bit of a given rank is found by halving the mask and
counting the ones of the upper half, so that the work is linear in the text. All classes are ASCII, so no cut falls
inside a character. Rows are independent of each other: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import id_text, slices

#: What marks the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Percent of documents that are cut, and percent of these whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80

_SPACE = bytes(b"01"[c == 32 or 9 <= c <= 13] for c in range(256))
_LEAD = bytes(b"01"[c & 0xC0 != 0x80] for c in range(256))


def starts_mask(data: bytes) -> int:
    """A one for each byte that begins a token (white space and the word after it, or white space at the end)."""
    if not data:
        return 0
    space = int(data.translate(_SPACE), 2)
    # a white space byte after another kind of byte; the first byte always begins a token
    return (space & ~(space >> 1)) | 1 << (len(data) - 1)


def select(mask: int, width: int, rank: int) -> int:
    """The place, from the highest of ``width`` bits on, of the one with ``rank`` ones before it; ``width`` if there is none."""
    at = 0
    if rank >= mask.bit_count():
        return width
    while width > 1:
        low = width >> 1
        upper = mask >> low
        ones = upper.bit_count()
        if rank < ones:
            mask, width = upper, width - low
        else:
            rank, mask, at, width = rank - ones, mask & ((1 << low) - 1), at + width - low, low
    return at


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the seed and the decimal doc_id; a null one counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def transform(data: bytes, doc_id: int | None, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of the prefix and of the middle (None if plain), and the text in its new order."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = (x.encode() for x in sentinels)
    mask, width = starts_mask(data), len(data)
    n = mask.bit_count()
    if not data or h3 % 100 >= rate or p in data or s in data or m in data:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = select(mask, width, first), select(mask, width, second)
    if data.isascii():
        prefix_chars, middle_chars = a, b - a
    else:
        lead = int(data.translate(_LEAD), 2)
        prefix_chars = (lead >> (width - a)).bit_count()
        middle_chars = (lead >> (width - b)).bit_count() - prefix_chars
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", prefix_chars, middle_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", prefix_chars, middle_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (the text in its new order) of every row.

    ``form`` is plain, psm or spm; a text that is empty or null, or holds a sentinel, stays plain. The draws depend on
    the seed and doc_id alone, so repeated rows and reruns agree; a null doc_id draws as if it had no digits, and stays
    null. Other columns are left out, whatever their names. An empty table gives an empty one; a text of any length is
    handled in one piece, in memory of a few times its size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for b in slices(batches):
            ids = b.column("doc_id")
            rows = [transform(t, i, seed, rate, suffix_first, sentinels) for i, t in zip(ids.to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text as it was, from the output and its form alone. Only whole sentinels stand in an output that isn't plain."""
    parts = F.split(output, "|".join(re.sub(r"([^\w])", r"\\\1", x) for x in sentinels), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document's output and of the text restored from it."""
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
