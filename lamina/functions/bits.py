"""Bit operations on lanes of a given width, shifts with counts beyond the width, and bit counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.arithmetic import masked
from lamina.types import lit, pattern, tag_of, unpattern

__all__ = ["binary_and", "binary_andnot", "binary_or", "binary_xor", "inv", "lzc", "lzc_imask", "lzc_scalar", "popcnt", "shift_left", "shift_left_wrapping", "shift_right", "shift_right_wrapping", "tzc"]


def _bits(tag: str, op: Callable[..., Column], *lanes: Column) -> Column:
    return unpattern(op(*(pattern(x, tag) for x in lanes)), tag)


def binary_and(left: Column, right: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_bits(tag, lambda a, b: a.bitwiseAND(b), left, right), mask, keep, tag)


def binary_andnot(left: Column, right: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    """Inverts the left."""
    return masked(_bits(tag, lambda a, b: F.bitwise_not(a).bitwiseAND(b), left, right), mask, keep, tag)


def binary_or(left: Column, right: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_bits(tag, lambda a, b: a.bitwiseOR(b), left, right), mask, keep, tag)


def binary_xor(left: Column, right: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_bits(tag, lambda a, b: a.bitwiseXOR(b), left, right), mask, keep, tag)


def inv(data: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_bits(tag, F.bitwise_not, data), mask, keep, tag)


def popcnt(data: Column, tag: str) -> Column:
    """Set bits within the lane's width, in the lane's type."""
    return F.bit_count(pattern(data, tag)).cast(tag_of(tag).spark)


def lzc(data: Column, tag: str) -> Column:
    """Zero bits above the first set bit; the width for zero."""
    t = tag_of(tag)
    x = pattern(data, t)
    return F.when(x == 0, F.lit(t.bits)).otherwise(t.bits - F.length(F.bin(x))).cast(t.spark)


def lzc_scalar(data: Column, tag: str) -> Column:
    return lzc(data, tag).cast("bigint")


def lzc_imask(word: Column, lanes: int) -> Column:
    """Of a packed mask of `lanes` bits."""
    return F.when(word == 0, F.lit(lanes)).otherwise(lanes - F.length(F.bin(word))).cast("bigint")


def tzc(word: Column, lanes: int) -> Column:
    """Zero bits below the first set bit of a packed mask; `lanes` for zero."""
    below = word.bitwiseXOR(F.when(word == F.lit(-(1 << 63)), word).otherwise(word - 1)).bitwiseAND(F.bitwise_not(word))
    least = F.when(word == F.lit(-(1 << 63)), F.lit(63)).otherwise(F.bit_count(below))
    return F.when(word == 0, F.lit(lanes)).otherwise(least).cast("bigint")


def _count(shift: Column | int) -> Column:
    return (F.lit(shift) if isinstance(shift, int) else shift).cast("bigint")


def shift_left(data: Column, shift: Column | int, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    """Counts from the width on leave zero."""
    t, n = tag_of(tag), _count(shift)
    moved = F.call_function("shiftleft", pattern(data, t), F.pmod(n, F.lit(64)).cast("int"))
    return masked(F.when((n < 0) | (n >= t.bits), lit(0, t)).otherwise(unpattern(moved, t)), mask, keep, tag)


def shift_right(data: Column, shift: Column | int, tag: str, preserve_sign: bool | None = None) -> Column:
    """Fills with the sign (signed types, unless preserve_sign is False) or zeros; counts from the width on leave the fill."""
    t, n = tag_of(tag), _count(shift)
    sign = t.signed if preserve_sign is None else preserve_sign
    far = (n < 0) | (n >= t.bits)
    if sign and t.signed:
        return unpattern(F.call_function("shiftright", data.cast("bigint"), F.when(far, F.lit(63)).otherwise(n).cast("int")), t)
    moved = F.call_function("shiftrightunsigned", pattern(data, t), F.pmod(n, F.lit(64)).cast("int"))
    return F.when(far, lit(0, t)).otherwise(unpattern(moved, t))


def shift_left_wrapping(data: Column, shift: Column | int, tag: str) -> Column:
    return shift_left(data, F.pmod(_count(shift), F.lit(tag_of(tag).bits)), tag)


def shift_right_wrapping(data: Column, shift: Column | int, tag: str) -> Column:
    return shift_right(data, F.pmod(_count(shift), F.lit(tag_of(tag).bits)), tag)


