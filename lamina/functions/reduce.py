"""Reductions over rows. No active row gives zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.types import WIDE, lit, pattern, same, tag_of, unpattern, wrap, zero

__all__ = ["count_matches", "hadd", "hand", "hmax", "hmin", "hor"]


def _on(x: Column, mask: Column | None) -> Column:
    return x if mask is None else F.when(mask, x)


def hadd(vec: Column, tag: str, mask: Column | None = None) -> Column:
    """The sum, wrapped to the lane type once at the end; partial sums are decimals, so none overflows."""
    t = tag_of(tag)
    if t.floating:
        return F.coalesce(F.sum(_on(vec.cast("double"), mask)), F.lit(0.0)).cast(t.spark)
    exact = F.sum(_on(vec.cast("decimal(20,0)"), mask)).cast(WIDE)
    exact = F.coalesce(exact, F.lit(0).cast(WIDE))
    return wrap(exact, t) if t.bits == 64 else wrap(wrap(exact, "si64"), t)


def _extreme(vec: Column, tag: str, mask: Column | None, greatest: bool) -> Column:
    x = _on(vec, mask)
    if tag_of(tag).floating:
        x = F.when(~F.isnan(x), x)  # NaN displaces nothing
    return F.coalesce((F.max if greatest else F.min)(x), zero(tag))


def hmax(vec: Column, tag: str, mask: Column | None = None) -> Column:
    return _extreme(vec, tag, mask, True)


def hmin(vec: Column, tag: str, mask: Column | None = None) -> Column:
    return _extreme(vec, tag, mask, False)


def hand(vec: Column, tag: str, mask: Column | None = None) -> Column:
    return unpattern(F.coalesce(F.bit_and(_on(pattern(vec, tag), mask)), F.lit(0).cast("bigint")), tag)


def hor(vec: Column, tag: str, mask: Column | None = None) -> Column:
    return unpattern(F.coalesce(F.bit_or(_on(pattern(vec, tag), mask)), F.lit(0).cast("bigint")), tag)


def count_matches(data: Column, value: object, tag: str) -> Column:
    """Rows equal to a value, in the lane type."""
    t = tag_of(tag)
    n = F.count_if(same(data, value if isinstance(value, Column) else lit(value, t), t))
    return n.cast(t.spark) if t.floating else wrap(n, t)
