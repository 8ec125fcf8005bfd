"""Column functions on nucleotide strings and on k-mers packed in longs (A=0, C=1, T=2, G=3, first base highest)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.bits import shift_right_wide

ALPHABET = "ACTG"
#: In this order a letter's class cycles through the alphabet: how sequences are derived from prose.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DERIVED = ("ACTG" * 7)[:26] * 2
MAX_LONG_K = 31


def _hex(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def derived_sequence(text: Column) -> Column:
    """A sequence from prose: letters become bases, everything else stays and is invalid."""
    return F.translate(text, LETTERS, DERIVED)


def is_valid(seq: Column) -> Column:
    return ~seq.rlike("[^ACGTacgt]")


def encode_base(char: Column) -> Column:
    """0 to 3 for acgtACGT, else 255."""
    return F.when(char.isin("a", "A"), 0).when(char.isin("c", "C"), 1).when(char.isin("t", "T"), 2).when(char.isin("g", "G"), 3).otherwise(255)


def complement(seq: Column) -> Column:
    """A and T, C and G change places; other characters stay."""
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def encode_kmer(kmer: Column) -> Column:
    """The code of a k-mer of at most 31 valid upper-case bases."""
    return F.conv(F.translate(kmer, ALPHABET, "0123"), 4, 10).cast("long")


def decode_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", ALPHABET)


def _other_strand(x: Column) -> Column:
    """All 32 bases of a word in reverse order and complemented: two-bit groups swapped by halves, high bits flipped."""
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, shift).bitwiseAND(_hex(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(_hex(mask)), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return x.bitwiseXOR(_hex(0xAAAAAAAAAAAAAAAA))


def reverse_complement_code(code: Column, k: int) -> Column:
    return F.shiftrightunsigned(_other_strand(code), 64 - 2 * k)


def reverse_complement_words(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
    """The other strand of a k-mer of 32 to 63 bases in two words: words change places, then all moves down."""
    low, high = shift_right_wide([_other_strand(hi), _other_strand(lo)], 128 - 2 * k)
    return high, low


def unsigned(x: Column) -> Column:
    """A long whose signed order is the unsigned order of ``x``."""
    return x.bitwiseXOR(_hex(1 << 63))


def canonical_words(hi: Column, lo: Column, k: int) -> tuple[Column, Column]:
    """The smaller of the two strands, both words read as unsigned."""
    other_hi, other_lo = reverse_complement_words(hi, lo, k)
    mine = (unsigned(hi) < unsigned(other_hi)) | (hi == other_hi) & (unsigned(lo) <= unsigned(other_lo))
    return F.when(mine, hi).otherwise(other_hi), F.when(mine, lo).otherwise(other_lo)


def canonical(code: Column, k: int) -> Column:
    """The smaller of the two strands."""
    return F.least(code, reverse_complement_code(code, k))


def canonical_parity(code: Column, k: int) -> Column:
    """The strand with an odd number of ones, without its lowest bit; only odd k make that the same for both strands."""
    if k % 2 == 0:
        raise ValueError("the parity form needs an odd k")
    strand = F.when(F.bit_count(code) % 2 == 1, code).otherwise(reverse_complement_code(code, k))
    return F.shiftrightunsigned(strand, 1)


def restore_parity(value: Column) -> Column:
    """The strand that ``canonical_parity`` chose."""
    return F.shiftleft(value, 1).bitwiseOR((1 - F.bit_count(value) % 2).cast("long"))


def sub_kmer(code: Column, k: int, offset: int) -> Column:
    """k bases, ``offset`` bases from the right."""
    return F.shiftrightunsigned(code, 2 * offset).bitwiseAND(F.lit(4**k - 1).cast("long"))


def suffix_kmer(code: Column, k: int) -> Column:
    return code.bitwiseAND(F.lit(4**k - 1).cast("long"))


def prefix_kmer(code: Column, offset: int) -> Column:
    return F.shiftrightunsigned(code, 2 * offset)


def push_back(code: Column, k: int, base: int) -> Column:
    """The window one base further to the right: the first base goes, ``base`` (0 to 3) comes last."""
    return F.shiftleft(suffix_kmer(code, k - 1), 2).bitwiseOR(F.lit(base).cast("long"))


def push_front(code: Column, k: int, base: int) -> Column:
    """The window one base further to the left: the last base goes, ``base`` comes first."""
    return F.shiftrightunsigned(code, 2).bitwiseOR(F.lit(base << 2 * (k - 1)).cast("long"))


def base_at(code: Column, k: int, i: int) -> Column:
    """The base at place ``i`` (from 0 on the left) of a packed k-mer."""
    return F.element_at(F.array(*map(F.lit, ALPHABET)), (sub_kmer(code, 1, k - 1 - i) + 1).cast("int"))


def to_digits(kmer: Column) -> Column:
    """A k-mer of any length in base-4 digits, whose order as strings is that of the codes."""
    return F.translate(kmer, ALPHABET, "0123")


def from_digits(digits: Column) -> Column:
    return F.translate(digits, "0123", ALPHABET)


def canonical_digits(kmer: Column) -> Column:
    """The smaller strand of a k-mer of any length, in base-4 digits: beyond 31 bases no long holds it."""
    return F.least(to_digits(kmer), to_digits(reverse_complement(kmer)))


def require_valid(seq: Column) -> Column:
    """The sequence itself, or an error if it holds anything but bases."""
    return F.when(is_valid(seq), seq).otherwise(F.raise_error(F.lit("Invalid DNA")).cast("string"))


# Fixed value: fixed-point units per bit of entropy.
PRECISION = 65535 * 1.88416938536372
DENOMINATOR = int(PRECISION)


def entropy_table(k: int) -> list[int]:
    """Fixed-point -p log2 p for each count of a 2-mer among the k - 1 of a k-mer."""
    n = k - 1
    return [0] + [int(-math.log2(i / n) * (i / n) * PRECISION) for i in range(1, n)] + [0] if n else [0]


def entropy_numerator(kmer: Column, k: int) -> Column:
    """The fixed-point 2-mer entropy of a k-mer string."""
    table = F.array(*[F.lit(v) for v in entropy_table(k)])
    pairs = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.substr(kmer, i, F.lit(2)))
    terms = F.transform(F.array_distinct(pairs), lambda d: F.get(table, F.size(F.filter(pairs, lambda p: p == d))))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def entropy(kmer: Column, k: int) -> Column:
    return entropy_numerator(kmer, k) / F.lit(PRECISION)


def entropy_threshold(bits: float) -> int:
    return int(bits * PRECISION)
