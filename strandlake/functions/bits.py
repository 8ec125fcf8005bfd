"""Bit functions on longs that hold unsigned words of ``width`` bits (64: the long's own bits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(value: int) -> Column:
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def bitmask(n: int, pos: int = 0) -> Column:
    """n ones from bit ``pos`` on."""
    if not 0 <= n <= 64 or not 0 <= pos <= 64 - n:
        raise ValueError("the mask doesn't fit")
    return _lit(((1 << n) - 1) << pos)


def parity(x: Column) -> Column:
    return F.bit_count(x) % 2


def bit_length(x: Column) -> Column:
    """Bits up to the highest one; 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def count_leading_zeros(x: Column, width: int = 64) -> Column:
    return F.lit(width) - bit_length(x)


def ilog2(x: Column) -> Column:
    """log2 rounded up; 0 for 0 and 1."""
    return F.when(x > 1, bit_length(x - 1)).otherwise(0)


def ilog2p1(x: Column) -> Column:
    """Bits that store x, at least one."""
    return F.greatest(bit_length(x), F.lit(1))


def next_power(x: Column) -> Column:
    return F.expr("1L") * F.pow(F.lit(2), ilog2(x)).cast("long")


def rotate_left(x: Column, n: int, width: int = 64) -> Column:
    n %= width
    moved = F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, width - n)) if n else x
    return moved.bitwiseAND(bitmask(width))


def rotate_right(x: Column, n: int, width: int = 64) -> Column:
    return rotate_left(x, width - n % width, width)


def peek(x: Column, n: int = 1, pos: int = 0) -> Column:
    """The n bits from ``pos`` on."""
    return F.shiftrightunsigned(x, pos).bitwiseAND(bitmask(n))


def poke(x: Column, value: Column, n: int = 1, pos: int = 0) -> Column:
    """``x`` with the n bits from ``pos`` on replaced by those of ``value``."""
    change = x.bitwiseXOR(F.shiftleft(value, pos)).bitwiseAND(bitmask(n, pos))
    return x.bitwiseXOR(change)


def reverse_groups(x: Column, group: int = 1, width: int = 64) -> Column:
    """Groups of ``group`` bits (a power of two) in reverse order."""
    step = group
    while step < width:
        mask = sum(((1 << step) - 1) << at for at in range(0, width, 2 * step))
        x = F.shiftrightunsigned(x, step).bitwiseAND(_lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(_lit(mask)), step))
        step *= 2
    return x


def tile_group(x: Column, group: int = 1, width: int = 64) -> Column:
    """The lowest group repeated over the word; ``x`` has no other bits."""
    step = group
    while step < width:
        x = x.bitwiseOR(F.shiftleft(x, step))
        step *= 2
    return x.bitwiseAND(bitmask(width))


def byte_swap(x: Column, width: int = 64) -> Column:
    return reverse_groups(x, 8, width)


def byte_swap_wide(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The 16 bytes of two words in reverse order."""
    return byte_swap(lo), byte_swap(hi)


def split_offset(n: Column, word_bits: int = 64) -> tuple[Column, Column]:
    """The word of a bit offset, and the bit in it."""
    shift = word_bits.bit_length() - 1
    if word_bits != 1 << shift:
        raise ValueError("words have a power of two of bits")
    return F.shiftright(n, shift), n.bitwiseAND(F.lit(word_bits - 1).cast("long"))


def variable_bytes(x: Column) -> Column:
    """A non-negative long in seven-bit groups, lowest first, with the high bit set on all but the last."""
    groups = F.greatest(F.ceil(bit_length(x) / 7), F.lit(1)).cast("int")
    hexes = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.lpad(F.hex(F.call_function("shiftrightunsigned", x, 7 * i).bitwiseAND(F.lit(127)) + F.when(i < groups - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.concat_ws("", hexes))


def from_variable_bytes(b: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(b) - 1)
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + F.call_function("shiftleft", F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("long").bitwiseAND(F.lit(127)), 7 * i))


def parity_of(values: Column) -> Column:
    """The parity of all bits of an array of longs, as 0 or 1."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(parity(x).cast("long")))


def store_be(x: Column, n: int = 8) -> Column:
    """The lowest n bytes of a long, highest first."""
    return F.unhex(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(2 * n)))


def store_le(x: Column, n: int = 8) -> Column:
    """The lowest n bytes of a long, lowest first."""
    return F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x), 16, "0"), 15 - 2 * i, 2) for i in range(n)]))


def load_be(b: Column, n: int = 8) -> Column:
    """The first n bytes of a binary as an unsigned number (n = 8: as the long of those bits)."""
    return F.conv(F.hex(F.substring(b, 1, n)), 16, -10).cast("long")


def load_le(b: Column, n: int = 8) -> Column:
    return F.conv(F.concat(*[F.hex(F.substring(b, i, 1)) for i in range(n, 0, -1)]), 16, -10).cast("long")


def shift_left_wide(words: list[Column], n: int, width: int = 64) -> list[Column]:
    """An integer in words of ``width`` bits, lowest first, shifted by any number of bits; what leaves the words is lost."""
    by, n = divmod(n, width)
    zero = F.lit(0).cast("long")
    full = [zero] * by + words
    out = []
    for i in range(len(words)):
        low = F.shiftrightunsigned(full[i - 1], width - n) if n and i else zero
        out.append(F.shiftleft(full[i], n).bitwiseOR(low).bitwiseAND(bitmask(width)))
    return out


def shift_right_wide(words: list[Column], n: int, width: int = 64) -> list[Column]:
    """The same to the right, without sign."""
    by, n = divmod(n, width)
    zero = F.lit(0).cast("long")
    full = words[by:] + [zero] * (by + 1)
    return [F.shiftrightunsigned(full[i], n).bitwiseOR(F.shiftleft(full[i + 1], width - n) if n else zero).bitwiseAND(bitmask(width)) for i in range(len(words))]


def peek_wide(words: list[Column], n: int, pos: int, width: int = 64) -> Column:
    """The n bits (at most ``width``) from ``pos`` on of an integer in words, across their bounds."""
    return shift_right_wide(words, pos, width)[0].bitwiseAND(bitmask(n))


def poke_wide(words: list[Column], value: Column, n: int, pos: int, width: int = 64) -> list[Column]:
    """The words with the n bits from ``pos`` on replaced by those of ``value``."""
    zero = F.lit(0).cast("long")
    rest = [zero] * (len(words) - 1)
    new = shift_left_wide([value.bitwiseAND(bitmask(n)), *rest], pos, width)
    hole = shift_left_wide([bitmask(n), *rest], pos, width)
    return [w.bitwiseAND(F.bitwise_not(h)).bitwiseOR(v) for w, h, v in zip(words, hole, new, strict=True)]
