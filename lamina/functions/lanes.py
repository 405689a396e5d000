"""Lanes within a register: arrays of lanes of one type, and selection of single lanes.

A register is an array column; out-of-range lanes of checked forms raise `index_out_of_bounds`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.convert import to_integral
from lamina.types import lit, same, tag_of, wrap, zero

__all__ = [
    "align_right_lanes", "compress", "conflict", "conflict_free", "custom_sequence", "expand", "extract_value", "extract_value_at", "from_array", "gather", "gather_masked", "gather_narrow", "gather_narrow_partial", "insert_value", "insert_value_at",
    "interleave_lo", "load", "masked_load", "masked_set1", "mov", "permute_lanes", "permute_lanes_imm", "random_step", "reverse", "scatter", "select", "sequence", "set1", "set_", "set_undef", "set_zero", "table_lookup", "to_array", "to_ostream",
]


def select(mask: Column, true_values: Column, false_values: Column) -> Column:
    return F.when(mask, true_values).otherwise(false_values)


def mov(mask: Column, src: Column, tag: str, data: Column | None = None) -> Column:
    """src where the mask is on, else zero; with data: data where the mask is on, else src."""
    return F.when(mask, src).otherwise(zero(tag)) if data is None else F.when(mask, data).otherwise(src)


def set1(value: object, tag: str) -> Column:
    return lit(value, tag)


def masked_set1(mask: Column, data: Column, value: object, tag: str) -> Column:
    """The value where the mask is on; the lane stays where it is off."""
    return F.when(mask, lit(value, tag)).otherwise(data)


def set_zero(tag: str) -> Column:
    return zero(tag)


def set_undef(tag: str) -> Column:
    """Undefined lanes are null."""
    return F.lit(None).cast(tag_of(tag).spark)


def set_(values: list[object], tag: str) -> Column:
    return F.array(*(lit(v, tag) for v in values))


def load(name: str) -> Column:
    return F.col(name)


def masked_load(mask: Column, name: str, tag: str, keep: Column | None = None) -> Column:
    return F.when(mask, F.col(name)).otherwise(zero(tag) if keep is None else keep)


def to_array(lane: Column, pos: Column) -> Column:
    """Aggregate: the lanes of a group in the order of pos."""
    return F.transform(F.sort_array(F.collect_list(F.struct(pos.alias("p"), lane.alias("v")))), lambda s: s["v"])


def from_array(register: Column) -> Column:
    """Generator: pos, lane."""
    return F.posexplode(register).alias("pos", "lane")


def _in_range(register: Column, index: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("index_out_of_bounds: "), index.cast("string")))
    return F.when((index >= 0) & (index < F.size(register)), index).otherwise(bad.cast("int"))


def extract_value(register: Column, index: int) -> Column:
    return F.get(register, F.lit(index))


def extract_value_at(register: Column, index: Column) -> Column:
    return F.get(register, _in_range(register, index))


def insert_value(register: Column, index: int, value: Column) -> Column:
    return F.transform(register, lambda x, i: F.when(i == index, value).otherwise(x))


def insert_value_at(register: Column, index: Column, value: Column) -> Column:
    at = _in_range(register, index)
    return F.transform(register, lambda x, i: F.when(i == at, value).otherwise(x))


def sequence(lanes: int, tag: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda i: i.cast(tag_of(tag).spark))


def custom_sequence(start: int, step: int, lanes: int, tag: str) -> Column:
    """start, start + step, ...; wrapped."""
    t = tag_of(tag)

    def at(i: Column) -> Column:
        exact = F.lit(str(start)).cast("decimal(21,0)") + i.cast("decimal(10,0)") * F.lit(str(step)).cast("decimal(20,0)")
        return wrap(exact, t) if t.bits == 64 else wrap(wrap(exact, "si64"), t)

    return F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), at)


def compress(mask: Column, data: Column, tag: str) -> Column:
    """Active lanes packed to the front, zeros behind them."""
    packed = F.transform(F.filter(F.arrays_zip(data.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])
    return F.concat(packed, F.array_repeat(zero(tag), F.size(data) - F.size(packed)))


def _rank(mask: Column, i: Column) -> Column:
    """How many lanes before i are active."""
    return F.size(F.filter(F.slice(mask, F.lit(1), i), lambda m: m))


def expand(mask: Column, to_keep: Column, to_expand: Column) -> Column:
    """Packed lanes spread over the active lanes; inactive ones keep theirs."""
    return F.transform(to_keep, lambda k, i: F.when(F.get(mask, i), F.get(to_expand, _rank(mask, i))).otherwise(k))


def conflict(data: Column, tag: str) -> Column:
    """For each lane the earlier lanes with an equal value, a bit each, as far as the lane's width goes."""
    t = tag_of(tag)
    one = F.lit(1).cast("bigint")

    def earlier(x: Column, i: Column) -> Column:
        bits = F.transform(F.slice(data, F.lit(1), i), lambda y, k: F.when(same(y, x, t) & (k < t.bits), F.call_function("shiftleft", one, k)).otherwise(F.lit(0).cast("bigint")))
        return wrap(F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b)), t)

    return F.transform(data, earlier)


def conflict_free(mask: Column, data: Column, tag: str) -> Column:
    """The packed mask of active lanes whose value no earlier lane, active or not, has."""
    t = tag_of(tag)
    return to_integral(F.transform(data, lambda x, i: F.get(mask, i) & ~F.exists(F.transform(F.slice(data, F.lit(1), F.least(i, F.lit(t.bits))), lambda y: same(y, x, t)), lambda e: e)))


def reverse(data: Column) -> Column:
    return F.reverse(data)


def interleave_lo(left: Column, right: Column) -> Column:
    half = F.floor(F.size(left) / 2).cast("int")
    return F.flatten(F.zip_with(F.slice(left, F.lit(1), half), F.slice(right, F.lit(1), half), lambda a, b: F.array(a, b)))


def align_right_lanes(left: Column, right: Column, count: int) -> Column:
    """A window of the lanes of right, then left, that begins `count` lanes in."""
    return F.slice(F.concat(right, left), F.pmod(F.lit(count), F.size(left)) + 1, F.size(left))


def permute_lanes_imm(data: Column, control: int) -> Column:
    """Within each group of four lanes, two bits of control choose the source lane; a shorter last group takes them modulo its length."""
    selectors = F.array(*(F.lit((control >> (2 * p)) & 3) for p in range(4)))

    def source(x: Column, i: Column) -> Column:
        start = i - i % 4
        return F.get(data, start + F.get(selectors, i % 4) % F.least(F.lit(4), F.size(data) - start))

    return F.transform(data, source)


def _unsigned(i: Column, tag: str) -> Column:
    t = tag_of(tag)
    return F.when(i < 0, i.cast("decimal(20,0)") + F.lit(str(1 << t.bits)).cast("decimal(20,0)")).otherwise(i.cast("decimal(20,0)"))


def permute_lanes(data: Column, indexes: Column, index_tag: str = "si32", mask: Column | None = None, src: Column | None = None, tag: str | None = None) -> Column:
    """data[unsigned(index) mod lanes]; off-mask lanes come from src, or are zero."""

    def pick(i: Column, k: Column) -> Column:
        value = F.get(data, F.pmod(_unsigned(i, index_tag), F.size(data)).cast("int"))
        return value if mask is None else F.when(F.get(mask, k), value).otherwise(F.get(src, k) if src is not None else zero(tag))

    return F.transform(indexes, pick)


def table_lookup(left: Column, indexes: Column, right: Column, index_tag: str = "si32") -> Column:
    """(left then right)[unsigned(index) mod twice the lanes]."""
    return permute_lanes(F.concat(left, right), indexes, index_tag)


def gather(base: Column, index: Column) -> Column:
    """base[index] lane by lane, of an array held in the row; out of range is null. Between tables see operators.positional."""
    return F.transform(index, lambda i: F.get(base, i.cast("int")))


def gather_masked(mask: Column, base: Column, index: Column, source: Column) -> Column:
    return F.transform(index, lambda i, k: F.when(F.get(mask, k), F.get(base, i.cast("int"))).otherwise(F.get(source, k)))


gather_narrow = gather


def gather_narrow_partial(base: Column, index: Column, lanes: int, tag: str) -> Column:
    """Lanes without an index are zero."""
    return F.concat(gather(base, index), F.array_repeat(zero(tag), F.lit(lanes) - F.size(index)))


def scatter(base: Column, index: Column, values: Column, mask: Column | None = None) -> Column:
    """base with values stored at their indexes; of equal indexes the last lane wins."""
    writes = F.arrays_zip(index.alias("i"), values.alias("v"), *([] if mask is None else [mask.alias("m")]))
    writes = writes if mask is None else F.filter(writes, lambda w: w["m"])

    def now(x: Column, j: Column) -> Column:
        here = F.filter(writes, lambda w: w["i"] == j)
        return F.when(F.size(here) > 0, F.try_element_at(F.transform(here, lambda w: w["v"]), F.lit(-1))).otherwise(x)

    return F.transform(base, now)


def random_step(seed: int | None = None) -> Column:
    """64 random bits from Spark's generator, where the original asks the processor: not reproducible unless seeded."""
    r = lambda k: F.floor(F.rand(None if seed is None else seed + k) * (1 << 32)).cast("bigint")
    return F.call_function("shiftleft", r(0), F.lit(32)).bitwiseXOR(r(1))


def to_ostream(data: Column, tag: str, separator: str = " ") -> Column:
    """The lanes as text."""
    return F.array_join(F.transform(data, lambda x: x.cast("string")), separator)
