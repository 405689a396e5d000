"""The ten scalar types, and what Spark does not give for free: wrapping, unsigned views, IEEE comparison.

| tag | held as |
|---|---|
| si8 si16 si32 si64 | tinyint smallint int bigint |
| ui8 ui16 ui32 ui64 | smallint int bigint decimal(20,0) |
| f32 f64 | float double |
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = 1 << 64
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Tag:
    name: str
    bits: int
    signed: bool
    floating: bool
    spark: str

    @property
    def low(self) -> int:
        return -(1 << (self.bits - 1)) if self.signed else 0

    @property
    def high(self) -> int:
        return (1 << (self.bits - (1 if self.signed else 0))) - 1


TAGS = {
    t.name: t
    for t in (
        Tag("si8", 8, True, False, "tinyint"),
        Tag("si16", 16, True, False, "smallint"),
        Tag("si32", 32, True, False, "int"),
        Tag("si64", 64, True, False, "bigint"),
        Tag("ui8", 8, False, False, "smallint"),
        Tag("ui16", 16, False, False, "int"),
        Tag("ui32", 32, False, False, "bigint"),
        Tag("ui64", 64, False, False, "decimal(20,0)"),
        Tag("f32", 32, True, True, "float"),
        Tag("f64", 64, True, True, "double"),
    )
}
INTEGERS = tuple(t for t in TAGS if t[0] in "su")


def tag_of(tag: str | Tag) -> Tag:
    return tag if isinstance(tag, Tag) else TAGS[tag]


def lit(value: object, tag: str | Tag) -> Column:
    return F.lit(value).cast(tag_of(tag).spark)


def _dec(x: int) -> Column:
    return F.lit(str(x)).cast(WIDE)


def wide(x: Column, tag: str | Tag) -> Column:
    """x where sums and differences of two values are exact: bigint for up to 32 bits, else decimal."""
    return x.cast("bigint" if tag_of(tag).bits < 64 else WIDE)


def wrap(x: Column, tag: str | Tag) -> Column:
    """An integer (bigint for up to 32 bits, else decimal or bigint) reduced to the tag's range by two's complement."""
    t = tag_of(tag)
    if t.floating:
        return x.cast(t.spark)
    if t.bits < 64:
        mask = F.lit((1 << t.bits) - 1).cast("bigint")
        low = x.cast("bigint").bitwiseAND(mask)
        if t.signed:
            half = F.lit(1 << (t.bits - 1)).cast("bigint")
            low = (low.bitwiseXOR(half)) - half
        return low.cast(t.spark)
    y = F.pmod(x.cast(WIDE), _dec(U64))
    if t.signed:
        return F.when(y >= _dec(1 << 63), y - _dec(U64)).otherwise(y).cast("bigint")
    return y.cast("decimal(20,0)")


def pattern(x: Column, tag: str | Tag) -> Column:
    """The bits of an integer lane as bigint: zero-extended below 64 bits, the two's complement pattern at 64."""
    t = tag_of(tag)
    if t.bits < 64:
        return x.cast("bigint").bitwiseAND(F.lit((1 << t.bits) - 1).cast("bigint"))
    return x.cast("bigint") if t.signed else wrap(x, "si64")


def unpattern(x: Column, tag: str | Tag) -> Column:
    """The lane whose bits are the low bits of a bigint."""
    t = tag_of(tag)
    if t.bits < 64:
        return wrap(x, t)
    return x.cast("bigint") if t.signed else wrap(x, "ui64")


def less(a: Column, b: Column, tag: str | Tag) -> Column:
    """a < b; false if either is NaN."""
    return (a < b) & ~F.isnan(b) if tag_of(tag).floating else a < b


def same(a: Column, b: Column, tag: str | Tag) -> Column:
    """a = b; false if either is NaN."""
    return (a == b) & ~F.isnan(a) if tag_of(tag).floating else a == b


def zero(tag: str | Tag) -> Column:
    return lit(0, tag)
