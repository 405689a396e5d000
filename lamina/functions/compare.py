"""Predicates, ordered on floats: NaN equals nothing and is on neither side of anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.types import less, same, tag_of

__all__ = ["between_exclusive", "between_inclusive", "between_left_inclusive", "between_right_inclusive", "equal", "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal", "nequal", "unequal_zero"]


def _on(test: Column, mask: Column | None) -> Column:
    return test if mask is None else F.coalesce(mask, F.lit(False)) & test


def equal(left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(same(left, right, tag), mask)


def nequal(left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(~same(left, right, tag), mask)


def less_than(left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(less(left, right, tag), mask)


def greater_than(left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(less(right, left, tag), mask)


def less_than_or_equal(left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on((left <= right) & ~F.isnan(right) if tag_of(tag).floating else left <= right, mask)


def greater_than_or_equal(left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return less_than_or_equal(right, left, tag, mask)


def between_inclusive(x: Column, left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(less_than_or_equal(left, x, tag) & less_than_or_equal(x, right, tag), mask)


def between_left_inclusive(x: Column, left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(less_than_or_equal(left, x, tag) & less_than(x, right, tag), mask)


def between_right_inclusive(x: Column, left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(less_than(left, x, tag) & less_than_or_equal(x, right, tag), mask)


def between_exclusive(x: Column, left: Column, right: Column, tag: str, mask: Column | None = None) -> Column:
    return _on(less_than(left, x, tag) & less_than(x, right, tag), mask)


def unequal_zero(data: Column, tag: str) -> Column:
    """True for NaN."""
    return (data != 0) | F.isnan(data) if tag_of(tag).floating else data != 0
