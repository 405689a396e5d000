"""add, sub, mul, div, mod, neg, abs, max, min: wrapping integers, IEEE floats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.types import WIDE, Tag, _dec, less, lit, tag_of, wide, wrap, zero

__all__ = ["abs_", "add", "blend_add", "div", "masked", "max_", "min_", "mod", "mod_imm", "mul", "mul_imm", "neg", "sub"]


def masked(value: Column, mask: Column | None, keep: Column | None, tag: str | Tag) -> Column:
    """value where the mask is on, else the kept column or zero; a null mask is off."""
    return value if mask is None else F.when(mask, value).otherwise(zero(tag) if keep is None else keep)


def _both(left: Column, right: Column, tag: str | Tag, op: Callable[[Column, Column], Column]) -> Column:
    t = tag_of(tag)
    return op(left, right).cast(t.spark) if t.floating else wrap(op(wide(left, t), wide(right, t)), t)


def add(left: Column, right: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_both(left, right, tag, lambda a, b: a + b), mask, keep, tag)


def sub(left: Column, right: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_both(left, right, tag, lambda a, b: a - b), mask, keep, tag)


def blend_add(mask: Column, left: Column, right: Column, adder: Column, tag: str) -> Column:
    """left where the mask is on, right + adder elsewhere."""
    return F.when(mask, left).otherwise(add(right, adder, tag))


def _product(left: Column, right: Column, t: Tag) -> Column:
    if t.floating:
        return (left * right).cast(t.spark)
    if t.bits < 32:
        return wrap(left.cast("bigint") * right.cast("bigint"), t)
    if t.bits == 32:
        return wrap(wrap(left.cast("decimal(12,0)") * right.cast("decimal(12,0)"), "si64"), t)
    # 64 bits: halves of 32 bits keep every product under 38 digits
    a, b = (F.pmod(x.cast(WIDE), _dec(1 << 64)) for x in (left, right))
    low = lambda x: F.pmod(x, _dec(1 << 32)).cast("decimal(10,0)")
    high = lambda x: F.call_function("div", x, _dec(1 << 32)).cast("decimal(10,0)")
    cross = low(low(a) * high(b) + high(a) * low(b))
    return wrap((low(a) * low(b)).cast(WIDE) + (cross * _dec(1 << 32)).cast(WIDE), t)


def mul(factor1: Column, factor2: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return masked(_product(factor1, factor2, tag_of(tag)), mask, keep, tag)


def mul_imm(data: Column, factor: int | float, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    return mul(data, lit(factor, tag), tag, mask, keep)


def _ieee_quotient(a: Column, b: Column, t: Tag) -> Column:
    nan, inf = lit(float("nan"), t), lit(float("inf"), t)
    negative = (a < 0) != b.cast("string").startswith("-")  # -0.0 prints its sign
    by_zero = F.when((a == 0) | F.isnan(a), nan).when(negative, -inf).otherwise(inf)
    return F.when(b == 0, by_zero).otherwise((a / F.when(b == 0, lit(1, t)).otherwise(b)).cast(t.spark))


def div(dividend: Column, divisor: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    """Truncates toward zero; the least value by -1 is itself. An integer divisor of 0 raises where it is divided by."""
    t = tag_of(tag)
    if t.floating:
        return masked(_ieee_quotient(dividend, divisor, t), mask, keep, tag)
    if t.bits < 64:
        value = wrap(F.call_function("div", dividend.cast("bigint"), divisor.cast("bigint")), t)
    elif t.signed:
        value = F.when(divisor == -1, wrap(-dividend.cast(WIDE), t)).otherwise(F.call_function("div", dividend, divisor))
    else:
        a, b = dividend.cast(t.spark), divisor.cast(t.spark)
        value = ((a - a % b) / b).cast(t.spark)  # exact: the numerator is a multiple of b
    return masked(value, mask, keep, tag)


def mod(dividend: Column, divisor: Column, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    """The remainder has the dividend's sign; the least value by -1 leaves 0; a float by 0 leaves NaN."""
    t = tag_of(tag)
    if t.floating:
        value = F.when(divisor == 0, lit(float("nan"), t)).otherwise((dividend % F.when(divisor == 0, lit(1, t)).otherwise(divisor)).cast(t.spark))
    elif t.signed:
        value = F.when(divisor == -1, zero(t)).otherwise(dividend % divisor).cast(t.spark)
    else:
        value = (dividend % divisor).cast(t.spark)
    return masked(value, mask, keep, tag)


def mod_imm(dividend: Column, divisor: int, tag: str, mask: Column | None = None, keep: Column | None = None) -> Column:
    if divisor == 0:
        raise ValueError("zero_divisor")
    return mod(dividend, lit(divisor, tag), tag, mask, keep)


def neg(data: Column, tag: str) -> Column:
    t = tag_of(tag)
    if not t.signed:
        raise TypeError(f"neg is not defined for {t.name}")
    return (-data).cast(t.spark) if t.floating else wrap(-wide(data, t), t)


def abs_(data: Column, tag: str) -> Column:
    t = tag_of(tag)
    return data if not t.signed else F.abs(data) if t.floating else wrap(F.abs(wide(data, t)), t)


def max_(a: Column, b: Column, tag: str) -> Column:
    """b if a < b, else a: NaN never displaces the first."""
    return F.when(less(a, b, tag), b).otherwise(a)


def min_(a: Column, b: Column, tag: str) -> Column:
    return F.when(less(b, a, tag), b).otherwise(a)


