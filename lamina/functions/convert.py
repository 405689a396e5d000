"""Conversions between lane types, and between arrays of lanes (registers) of different sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.types import lit, tag_of, wide, wrap

__all__ = ["cast", "concat", "convert_down", "convert_lanes", "convert_up", "extract", "insert", "reinterpret", "resize_down", "resize_up_undef", "resize_up_zero", "to_integral", "to_mask", "to_vector"]


def cast(data: Column, source: str, target: str) -> Column:
    """Numeric conversion: toward zero from floats, two's complement between integers. Floats out of range raise, NaN too."""
    s, t = tag_of(source), tag_of(target)
    if s.floating and not t.floating:
        return F.when(data < 0, F.ceil(data)).otherwise(F.floor(data)).cast("bigint" if t.bits < 64 or t.signed else "decimal(38,0)").cast(t.spark)
    return data.cast(t.spark) if t.floating else wrap(wrap(wide(data, s), "si64") if s.bits == 64 and t.bits < 64 else wide(data, t) if t.bits == 64 else data.cast("bigint"), t)


convert_lanes = cast


def reinterpret(data: Column, source: str, target: str) -> Column:
    """The same bits as another type of the same width. Bits of floats have no built-in; they go through Arrow."""
    s, t = tag_of(source), tag_of(target)
    if s.bits != t.bits:
        raise TypeError("lane_count_mismatch")
    if s.floating == t.floating:
        return data if s.floating else wrap(wide(data, s), t)
    into = np.dtype(f"{'f' if t.floating else 'i'}{t.bits // 8}")
    kind = t.spark if t.floating else ("int" if t.bits == 32 else "bigint")

    @F.pandas_udf(kind)
    def view(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(x.to_numpy(np.dtype(f"{'f' if s.floating else 'i'}{s.bits // 8}")).view(into))

    if s.floating:
        return wrap(view(data), t)
    return view(wrap(wide(data, s), f"si{s.bits}"))


def to_vector(mask: Column, tag: str) -> Column:
    """All bits set where the mask is on: -1, or the greatest unsigned value; zero elsewhere."""
    t = tag_of(tag)
    return F.when(mask, lit(-1 if t.signed else str(t.high), t)).otherwise(lit(0, t))


def to_integral(mask: Column) -> Column:
    """An array of booleans as a bigint: lane i at bit i (64 lanes at most)."""
    return F.aggregate(F.transform(mask, lambda m, i: F.when(m, F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def to_mask(word: Column, lanes: int) -> Column:
    """The booleans of a packed mask."""
    return F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: F.getbit(word, i) == 1)


def extract(data: Column, index: int, lanes: int) -> Column:
    """The index-th run of `lanes` lanes."""
    return F.slice(data, index * lanes + 1, lanes)


def insert(orig: Column, data: Column, index: int, lanes: int) -> Column:
    """orig with its index-th run of `lanes` lanes replaced."""
    return F.concat(F.slice(orig, 1, index * lanes), data, F.slice(orig, F.lit((index + 1) * lanes + 1), F.size(orig)))


def resize_down(data: Column, lanes: int) -> Column:
    return F.slice(data, 1, lanes)


def resize_up_undef(data: Column, lanes: int, tag: str) -> Column:
    """New lanes are null."""
    return F.concat(data, F.array_repeat(F.lit(None).cast(tag_of(tag).spark), F.lit(lanes) - F.size(data)))


def resize_up_zero(data: Column, lanes: int, tag: str) -> Column:
    return F.concat(data, F.array_repeat(lit(0, tag), F.lit(lanes) - F.size(data)))


def concat(low: Column, high: Column) -> Column:
    return F.concat(low, high)


def convert_up(data: Column, index: int, lanes: int, source: str, target: str) -> Column:
    """The index-th run of `lanes` narrow lanes, as wider ones."""
    return F.transform(extract(data, index, lanes), lambda x: cast(x, source, target))


def convert_down(data: Column, index: int, lanes: int, source: str, target: str) -> Column:
    """Narrow lanes at the index-th run of a register of `lanes` lanes; zeros elsewhere."""
    n = F.size(data)
    narrow = F.transform(data, lambda x: cast(x, source, target))
    z = lit(0, target)
    return F.concat(F.array_repeat(z, n * index), narrow, F.array_repeat(z, F.lit(lanes) - n * (index + 1)))
