"""Mask algebra, on boolean columns and on packed masks (bigint words of up to 64 lanes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["extract_imask", "insert_imask", "mask_binary_and", "mask_binary_not", "mask_binary_or", "mask_binary_xor", "mask_deinterleave_odd", "mask_false", "mask_interleave_lo", "mask_population_count", "mask_true", "overlay_imask", "set_mask_lane", "shift_left_imask", "shift_right_imask", "test_imask"]


def _low(lanes: int) -> Column:
    return F.lit(-1 if lanes >= 64 else (1 << lanes) - 1).cast("bigint")


def _shl(word: Column, n: Column | int) -> Column:
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", word.cast("bigint"), n))


def _shr(word: Column, n: Column | int) -> Column:
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", word.cast("bigint"), n))


def mask_binary_and(a: Column, b: Column) -> Column:
    return a & b


def mask_binary_or(a: Column, b: Column) -> Column:
    return a | b


def mask_binary_xor(a: Column, b: Column) -> Column:
    return a != b


def mask_binary_not(a: Column) -> Column:
    return ~a


def mask_true() -> Column:
    return F.lit(True)


def mask_false() -> Column:
    return F.lit(False)


def mask_population_count(word: Column) -> Column:
    """Of a packed mask; over rows it is count_if."""
    return F.bit_count(word).cast("bigint")


def shift_right_imask(word: Column, shift: Column | int, lanes: int) -> Column:
    return _shr(word.bitwiseAND(_low(lanes)), shift)


def shift_left_imask(word: Column, shift: Column | int, lanes: int) -> Column:
    return _shl(word, shift).bitwiseAND(_low(lanes))


def test_imask(word: Column, position: Column | int, lanes: int) -> Column:
    """1 or 0; positions from `lanes` on are off."""
    p = F.lit(position) if isinstance(position, int) else position
    return F.when(p < lanes, _shr(word, p).bitwiseAND(F.lit(1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


test_imask.__test__ = False


def set_mask_lane(mask: Column, index: Column | int, value: Column | int) -> Column:
    """An array of booleans with one lane replaced."""
    i = F.lit(index) if isinstance(index, int) else index
    v = (F.lit(value) if isinstance(value, int) else value) != 0
    return F.transform(mask, lambda m, k: F.when(k == i, v).otherwise(m))


def overlay_imask(a: Column, b: Column, position: Column | int, lanes: int) -> Column:
    """a or b moved to the position; bits beyond the lanes fall off."""
    return a.bitwiseOR(_shl(b, position)).bitwiseAND(_low(lanes))


def insert_imask(orig: Column, data: Column, position: Column | int, lanes: int, width: int) -> Column:
    """orig, of `lanes` lanes, with the `width` bits at the position replaced."""
    window = _shl(_low(width), position)
    return orig.bitwiseAND(F.bitwise_not(window)).bitwiseOR(_shl(data.bitwiseAND(_low(width)), position)).bitwiseAND(_low(lanes))


def extract_imask(word: Column, position: Column | int, width: int) -> Column:
    return _shr(word, position).bitwiseAND(_low(width))


def mask_interleave_lo(a: Column, b: Column) -> Column:
    """Of arrays of booleans: the low halves, lane by lane."""
    half = F.floor(F.size(a) / 2).cast("int")
    return F.flatten(F.zip_with(F.slice(a, F.lit(1), half), F.slice(b, F.lit(1), half), lambda x, y: F.array(x, y)))


def mask_deinterleave_odd(a: Column, b: Column) -> Column:
    odd = lambda x: F.filter(x, lambda m, i: i % 2 == 1)
    return F.concat(odd(a), odd(b))
