"""Queries for lane functions: each runs a function over lanes of every type, beside its SQL.

Lanes come from `events`: x_<tag>, y_<tag> and z_<tag> spread over the type's range, with the least and
greatest values, 0, 1 and -1 on some rows; m is a mask, s a shift count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lamina.functions as fn
from lamina.sources.tables import table
from lamina.types import INTEGERS, TAGS, lit, wrap

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SQL_TYPE = {"si8": "tinyint", "si16": "smallint", "si32": "integer", "si64": "bigint", "ui8": "smallint", "ui16": "integer", "ui32": "bigint", "ui64": "decimal(20,0)", "f32": "float", "f64": "double"}
FLOATS = ("f32", "f64")
# multiplier, divisor and period of special rows for each lane
_LANES = {"x": (2654435761, 1024, 97), "y": (40503000, 7, 89), "z": (9973 * 65537, 11, 83)}


def sql_wrap(e: str, tag: str) -> str:
    """A hugeint expression reduced to the tag's range."""
    t = TAGS[tag]
    m, h = 1 << t.bits, (1 << (t.bits - 1)) if t.signed else 0
    return f"(((({e}) % {m}::hugeint + {m}::hugeint + {h}::hugeint) % {m}::hugeint) - {h}::hugeint)::{SQL_TYPE[tag]}"


def _specials(tag: str) -> list[object]:
    t = TAGS[tag]
    return ["-Infinity", "NaN", "0", "1", "-1"] if t.floating else [t.low, t.high, 0, 1, -1 if t.signed else t.high - 1]


def _spark_lane(name: str, tag: str, plain: bool) -> Column:
    k, d, period = _LANES[name]
    e, t = F.col("event_id"), TAGS[tag]
    base = e * F.lit(k).cast("bigint")
    if t.floating:
        value = ((F.pmod(F.call_function("div", base, F.lit(64).cast("bigint")), F.lit(20001)) - 10000) / 8.0).cast(t.spark)  # base / 64 would be a double, inexact from 2**53
    else:
        spread = F.pmod(F.call_function("div", base, F.lit(d).cast("bigint")), F.lit(1 << 31).cast("bigint"))
        value = wrap(spread * F.lit(7046029).cast("bigint"), t) if t.bits < 64 else spread * F.lit((1 << 32) - 5).cast("bigint") - F.lit(1 << 62).cast("bigint")
        value = value if t.name != "ui64" else (value.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast(t.spark)
    if not plain:
        for i, v in enumerate(_specials(tag)):
            value = F.when(F.pmod(e, F.lit(period)) == i, lit(str(v), tag)).otherwise(value)
    return value.alias(f"{name}_{tag}")


def _sql_lane(name: str, tag: str, plain: bool) -> str:
    k, d, period = _LANES[name]
    t = TAGS[tag]
    base = f"(event_id * {k}::bigint)"
    if t.floating:
        value = f"((({base} // 64) % 20001 - 10000) / 8.0)::{SQL_TYPE[tag]}"
    else:
        spread = f"({base} // {d}) % {1 << 31}"
        value = sql_wrap(f"({spread})::hugeint * 7046029::hugeint", tag) if t.bits < 64 else f"(({spread})::hugeint * {(1 << 32) - 5}::hugeint - {1 << 62}::hugeint{f' + {1 << 63}::hugeint' if tag == 'ui64' else ''})::{SQL_TYPE[tag]}"
    if not plain:
        cases = " ".join(f"when event_id % {period} = {i} then {repr(str(v))}::{SQL_TYPE[tag]}" for i, v in enumerate(_specials(tag)))
        value = f"case {cases} else {value} end"
    return f"{value} as {name}_{tag}"


def spark_lanes(spark: SparkSession, sf_dir: str, tags: tuple[str, ...], names: str = "xyz", plain: bool = False) -> DataFrame:
    lanes = [_spark_lane(n, t, plain) for t in tags for n in names]
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("pos"), *lanes, (F.pmod(e, F.lit(3)) != 0).alias("m"), F.pmod(e * 7, F.lit(71)).cast("int").alias("s"))


def sql_lanes(tags: tuple[str, ...], names: str = "xyz", plain: bool = False) -> str:
    lanes = ", ".join(_sql_lane(n, t, plain) for t in tags for n in names)
    return f"(select event_id as pos, {lanes}, event_id % 3 <> 0 as m, (event_id * 7 % 71)::integer as s from events) lanes"


def U(x: str, tag: str) -> str:  # noqa: N802
    """A lane's bits as ubigint."""
    m = 1 << TAGS[tag].bits
    return f"((({x}::hugeint % {m}::hugeint) + {m}::hugeint) % {m}::hugeint)::ubigint"


def back(u: str, tag: str) -> str:
    return sql_wrap(f"({u})::hugeint", tag)


def H(x: str) -> str:  # noqa: N802
    return f"{x}::hugeint"


Spark = Callable[[str, Column, Column, Column], Column]
Sql = Callable[[str, str, str, str], str]


def register(name: str, spark_f: Spark, sql_f: Sql, tags: tuple[str, ...], names: str = "xy", plain_floats: bool = True) -> None:
    """One query with a column r_<tag> for each tag."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ints, floats = tuple(t for t in tags if t in INTEGERS), tuple(t for t in tags if t in FLOATS)
        df = spark_lanes(spark, sf_dir, ints, names)
        if floats:
            more = [_spark_lane(n, t, plain_floats) for t in floats for n in names]
            df = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), *[_spark_lane(n, t, False) for t in ints for n in names], *more, (F.pmod("event_id", F.lit(3)) != 0).alias("m"), F.pmod(F.col("event_id") * 7, F.lit(71)).cast("int").alias("s"))
        lane = lambda n, t: F.col(f"{n}_{t}") if n in names else F.lit(None)
        return df.select("pos", *(_clean(spark_f(t, lane("x", t), lane("y", t), lane("z", t)), t, result_floats(name)).alias(f"r_{t}") for t in tags))

    ints, floats = tuple(t for t in tags if t in INTEGERS), tuple(t for t in tags if t in FLOATS)
    lanes = ", ".join([_sql_lane(n, t, False) for t in ints for n in names] + [_sql_lane(n, t, plain_floats) for t in floats for n in names])
    src = f"(select event_id as pos, {lanes}, event_id % 3 <> 0 as m, (event_id * 7 % 71)::integer as s from events) lanes"
    out = ", ".join(f"{_sql_clean(sql_f(t, f'x_{t}', f'y_{t}', f'z_{t}'), t, result_floats(name))} as r_{t}" for t in tags)
    QUERIES[name] = query
    ORACLE_SQL[name] = f"select pos, {out} from {src}"


def result_floats(name: str) -> bool:
    return not any(name.startswith(f"p_{p}") for p in ("equal", "nequal", "less", "greater", "between", "unequal", "cast"))


def _clean(c: Column, tag: str, on: bool) -> Column:
    """Float results: no negative zero, null for NaN, so that both engines hash them alike."""
    return F.when(~F.isnan(c), c + F.lit(0).cast(TAGS[tag].spark)) if on and tag in FLOATS else c


def _sql_clean(e: str, tag: str, on: bool) -> str:
    return f"case when not isnan({e}) then ({e}) + 0::{SQL_TYPE[tag]} end" if on and tag in FLOATS else e


def forms(name: str, spark_f: Callable[..., Column], sql_f: Sql, tags: tuple[str, ...], names: str = "xy", keep: str = "x") -> None:
    """Plain, zero-masked and pass-through forms of one function."""
    register(f"p_{name}", lambda t, x, y, z: spark_f(t, x, y, z), sql_f, tags, names)
    kept = lambda x, y: x if keep == "x" else y
    register(f"p_{name}_zero", lambda t, x, y, z: spark_f(t, x, y, z, mask=F.col("m")), lambda t, x, y, z: f"case when m then {sql_f(t, x, y, z)} else 0::{SQL_TYPE[t]} end", tags, names)
    register(f"p_{name}_keep", lambda t, x, y, z: spark_f(t, x, y, z, mask=F.col("m"), keep=kept(x, y)), lambda t, x, y, z: f"case when m then {sql_f(t, x, y, z)} else {kept(x, y)} end", tags, names)


ALL = (*INTEGERS, *FLOATS)
SIGNED = ("si8", "si16", "si32", "si64")


def _arith(op: str) -> Sql:
    return lambda t, x, y, z: f"({x} {op} {y})::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(f"{H(x)} {op} {H(y)}", t)


def _mul(t: str, x: str, y: str, _: str) -> str:
    if t in FLOATS:
        return f"({x} * {y})::{SQL_TYPE[t]}"
    if TAGS[t].bits < 64:
        return sql_wrap(f"{H(x)} * {H(y)}", t)
    return sql_wrap(f"(({U(x, t)}::uhugeint * {U(y, t)}::uhugeint) % {1 << 64}::uhugeint)::hugeint", t)


forms("add", lambda t, x, y, z, **k: fn.add(x, y, t, **k), _arith("+"), ALL)
forms("sub", lambda t, x, y, z, **k: fn.sub(x, y, t, **k), _arith("-"), ALL)
forms("mul", lambda t, x, y, z, **k: fn.mul(x, y, t, **k), _mul, ALL)
forms("mul_imm", lambda t, x, y, z, **k: fn.mul_imm(x, 37, t, **k), lambda t, x, y, z: _mul(t, x, f"37::{SQL_TYPE[t]}", z), ALL, "x")


def _nz(y: Column, t: str) -> Column:
    return F.when(y == 0, lit(1, t)).otherwise(y)


def _sql_nz(y: str, t: str) -> str:
    return f"(case when {y} = 0 then 1::{SQL_TYPE[t]} else {y} end)"


forms("div", lambda t, x, y, z, **k: fn.div(x, _nz(y, t), t, **k), lambda t, x, y, z: f"({x} / {_sql_nz(y, t)})::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(f"{H(x)} // {_sql_nz(y, t)}::hugeint", t), ALL)
forms("mod", lambda t, x, y, z, **k: fn.mod(x, _nz(y, t), t, **k), lambda t, x, y, z: f"({x} % {_sql_nz(y, t)})::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(f"{H(x)} % {_sql_nz(y, t)}::hugeint", t), ALL)
forms("mod_imm", lambda t, x, y, z, **k: fn.mod_imm(x, 7, t, **k), lambda t, x, y, z: f"({x} % 7::{SQL_TYPE[t]})::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(f"{H(x)} % 7::hugeint", t), ALL, "x")
register("p_blend_add", lambda t, x, y, z: fn.blend_add(F.col("m"), x, y, z, t), lambda t, x, y, z: f"case when m then {x} else {_arith('+')(t, y, z, '')} end", ALL, "xyz")
register("p_neg", lambda t, x, y, z: fn.neg(x, t), lambda t, x, y, z: f"(-{x})::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(f"-({H(x)})", t), (*SIGNED, *FLOATS), "x")
register("p_abs", lambda t, x, y, z: fn.abs_(x, t), lambda t, x, y, z: f"abs({x})" if t in FLOATS else sql_wrap(f"abs({H(x)})", t), ALL, "x")


def _lt(x: str, y: str, t: str) -> str:
    return f"({x} < {y} and not isnan({y}))" if t in FLOATS else f"({x} < {y})"


def _eq(x: str, y: str, t: str) -> str:
    return f"({x} = {y} and not isnan({x}))" if t in FLOATS else f"({x} = {y})"


def _le(x: str, y: str, t: str) -> str:
    return f"({x} <= {y} and not isnan({y}))" if t in FLOATS else f"({x} <= {y})"


register("p_max", lambda t, x, y, z: fn.max_(x, y, t), lambda t, x, y, z: f"case when {_lt(x, y, t)} then {y} else {x} end", ALL, "xy", False)
register("p_min", lambda t, x, y, z: fn.min_(x, y, t), lambda t, x, y, z: f"case when {_lt(y, x, t)} then {y} else {x} end", ALL, "xy", False)

# bits
register("p_popcnt", lambda t, x, y, z: fn.popcnt(x, t), lambda t, x, y, z: f"length(replace(to_binary({U(x, t)}), '0', ''))::{SQL_TYPE[t]}", INTEGERS, "x")
_sql_lzc = lambda t, x, to: f"(case when {x} = 0 then {TAGS[t].bits} else {TAGS[t].bits} - length(to_binary({U(x, t)})) end)::{to}"
register("p_lzc", lambda t, x, y, z: fn.lzc(x, t), lambda t, x, y, z: _sql_lzc(t, x, SQL_TYPE[t]), INTEGERS, "x")
register("p_lzc_scalar", lambda t, x, y, z: fn.lzc_scalar(x, t), lambda t, x, y, z: _sql_lzc(t, x, "bigint"), INTEGERS, "x")
forms("binary_and", lambda t, x, y, z, **k: fn.binary_and(x, y, t, **k), lambda t, x, y, z: back(f"{U(x, t)} & {U(y, t)}", t), INTEGERS)
forms("binary_or", lambda t, x, y, z, **k: fn.binary_or(x, y, t, **k), lambda t, x, y, z: back(f"{U(x, t)} | {U(y, t)}", t), INTEGERS)
forms("binary_xor", lambda t, x, y, z, **k: fn.binary_xor(x, y, t, **k), lambda t, x, y, z: back(f"xor({U(x, t)}, {U(y, t)})", t), INTEGERS)
forms("binary_andnot", lambda t, x, y, z, **k: fn.binary_andnot(x, y, t, **k), lambda t, x, y, z: back(f"xor({U(x, t)}, {(1 << TAGS[t].bits) - 1}::ubigint) & {U(y, t)}", t), INTEGERS)
forms("inv", lambda t, x, y, z, **k: fn.inv(x, t, **k), lambda t, x, y, z: back(f"xor({U(x, t)}, {(1 << TAGS[t].bits) - 1}::ubigint)", t), INTEGERS, "x")


def _sql_left(t: str, x: str, n: str) -> str:
    return f"case when {n} >= {TAGS[t].bits} then 0::{SQL_TYPE[t]} else {sql_wrap(f'(({U(x, t)}::uhugeint * (1::ubigint << ({n} % 64)::ubigint)::uhugeint) % {1 << 64}::uhugeint)::hugeint', t)} end"


def _sql_right(t: str, x: str, n: str) -> str:
    bits = TAGS[t].bits
    p = f"(1::hugeint << least({n}, {bits - 1 if TAGS[t].signed else 64})::hugeint)"
    floor = f"((({H(x)}) - ((({H(x)}) % {p} + {p}) % {p})) // {p})"
    return sql_wrap(floor, t) if TAGS[t].signed else f"case when {n} >= {bits} then 0::{SQL_TYPE[t]} else {sql_wrap(floor, t)} end"


forms_shift = lambda t, x, y, z, **k: fn.shift_left(x, 3, t, **k)
register("p_shift_left_imm", forms_shift, lambda t, x, y, z: _sql_left(t, x, "3"), INTEGERS, "x")
register("p_shift_left_imm_keep", lambda t, x, y, z: fn.shift_left(x, 3, t, mask=F.col("m"), keep=x), lambda t, x, y, z: f"case when m then {_sql_left(t, x, '3')} else {x} end", INTEGERS, "x")
register("p_shift_left_scalar", lambda t, x, y, z: fn.shift_left(x, F.lit(11), t), lambda t, x, y, z: _sql_left(t, x, "11"), INTEGERS, "x")
register("p_shift_left", lambda t, x, y, z: fn.shift_left(x, F.col("s"), t), lambda t, x, y, z: _sql_left(t, x, "s"), INTEGERS, "x")
register("p_shift_right_imm", lambda t, x, y, z: fn.shift_right(x, 3, t), lambda t, x, y, z: _sql_right(t, x, "3"), INTEGERS, "x")
register("p_shift_right_scalar", lambda t, x, y, z: fn.shift_right(x, F.lit(11), t), lambda t, x, y, z: _sql_right(t, x, "11"), INTEGERS, "x")
register("p_shift_right", lambda t, x, y, z: fn.shift_right(x, F.col("s"), t), lambda t, x, y, z: _sql_right(t, x, "s"), INTEGERS, "x")
register("p_shift_left_wrapping_scalar", lambda t, x, y, z: fn.shift_left_wrapping(x, 67, t), lambda t, x, y, z: _sql_left(t, x, f"(67 % {TAGS[t].bits})"), INTEGERS, "x")
register("p_shift_left_wrapping", lambda t, x, y, z: fn.shift_left_wrapping(x, F.col("s"), t), lambda t, x, y, z: _sql_left(t, x, f"(s % {TAGS[t].bits})"), INTEGERS, "x")
register("p_shift_right_wrapping_scalar", lambda t, x, y, z: fn.shift_right_wrapping(x, 67, t), lambda t, x, y, z: _sql_right(t, x, f"(67 % {TAGS[t].bits})"), INTEGERS, "x")
register("p_shift_right_wrapping", lambda t, x, y, z: fn.shift_right_wrapping(x, F.col("s"), t), lambda t, x, y, z: _sql_right(t, x, f"(s % {TAGS[t].bits})"), INTEGERS, "x")

# predicates, with NaN and infinities in the float lanes
_TESTS: dict[str, tuple[Callable[..., Column], Callable[[str, str, str, str], str], str]] = {
    "equal": (lambda t, x, y, z, **k: fn.equal(x, y, t, **k), lambda t, x, y, z: _eq(x, y, t), "xy"),
    "nequal": (lambda t, x, y, z, **k: fn.nequal(x, y, t, **k), lambda t, x, y, z: f"(not {_eq(x, y, t)})", "xy"),
    "less_than": (lambda t, x, y, z, **k: fn.less_than(x, y, t, **k), lambda t, x, y, z: _lt(x, y, t), "xy"),
    "greater_than": (lambda t, x, y, z, **k: fn.greater_than(x, y, t, **k), lambda t, x, y, z: _lt(y, x, t), "xy"),
    "less_than_or_equal": (lambda t, x, y, z, **k: fn.less_than_or_equal(x, y, t, **k), lambda t, x, y, z: _le(x, y, t), "xy"),
    "greater_than_or_equal": (lambda t, x, y, z, **k: fn.greater_than_or_equal(x, y, t, **k), lambda t, x, y, z: _le(y, x, t), "xy"),
    "between_inclusive": (lambda t, x, y, z, **k: fn.between_inclusive(x, y, z, t, **k), lambda t, x, y, z: f"({_le(y, x, t)} and {_le(x, z, t)})", "xyz"),
    "between_left_inclusive": (lambda t, x, y, z, **k: fn.between_left_inclusive(x, y, z, t, **k), lambda t, x, y, z: f"({_le(y, x, t)} and {_lt(x, z, t)})", "xyz"),
    "between_right_inclusive": (lambda t, x, y, z, **k: fn.between_right_inclusive(x, y, z, t, **k), lambda t, x, y, z: f"({_lt(y, x, t)} and {_le(x, z, t)})", "xyz"),
    "between_exclusive": (lambda t, x, y, z, **k: fn.between_exclusive(x, y, z, t, **k), lambda t, x, y, z: f"({_lt(y, x, t)} and {_lt(x, z, t)})", "xyz"),
}
for _name, (_spark, _sql, _names) in _TESTS.items():
    register(f"p_{_name}", _spark, _sql, ALL, _names, False)
    register(f"p_{_name}_masked", lambda t, x, y, z, f=_spark: f(t, x, y, z, mask=F.col("m")), lambda t, x, y, z, f=_sql: f"(m and {f(t, x, y, z)})", ALL, _names, False)
register("p_unequal_zero", lambda t, x, y, z: fn.unequal_zero(x, t), lambda t, x, y, z: f"({x} <> 0)", ALL, "x", False)

# conversions; narrowing wraps, floats go toward zero
_CASTS = (("f64", "si32"), ("f32", "si16"), ("si32", "f64"), ("ui32", "f64"), ("si64", "si8"), ("si16", "ui64"), ("ui64", "si32"), ("ui8", "si8"), ("si8", "ui16"))
for _s, _t in _CASTS:
    _sql_cast = (lambda s, t: lambda _, x, y, z: f"trunc({x})::{SQL_TYPE[t]}" if s in FLOATS else f"{x}::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(H(x), t))(_s, _t)
    for _form in ("cast", "convert_lanes"):
        register(f"p_{_form}_{_s}_{_t}".replace("p_convert", "p_cast_convert"), (lambda s, t: lambda _, x, y, z: fn.cast(x, s, t))(_s, _t), _sql_cast, (_s,), "x")
for _s, _t in (("si32", "ui32"), ("ui64", "si64"), ("si8", "ui8"), ("ui16", "si16")):
    register(f"p_cast_reinterpret_{_s}_{_t}", (lambda s, t: lambda _, x, y, z: fn.reinterpret(x, s, t))(_s, _t), (lambda t: lambda _, x, y, z: sql_wrap(H(x), t))(_t), (_s,), "x")
register("p_to_vector", lambda t, x, y, z: fn.to_vector(F.col("m"), t), lambda t, x, y, z: f"case when m then {-1 if TAGS[t].signed else TAGS[t].high}::{SQL_TYPE[t]} else 0::{SQL_TYPE[t]} end", INTEGERS, "x")

# selection, constants, masked loads and stores
register("p_select", lambda t, x, y, z: fn.select(F.col("m"), x, y), lambda t, x, y, z: f"case when m then {x} else {y} end", ALL)
register("p_mov_zero", lambda t, x, y, z: fn.mov(F.col("m"), x, t), lambda t, x, y, z: f"case when m then {x} else 0::{SQL_TYPE[t]} end", ALL, "x")
register("p_mov_keep", lambda t, x, y, z: fn.mov(F.col("m"), x, t, y), lambda t, x, y, z: f"case when m then {y} else {x} end", ALL)
register("p_set1", lambda t, x, y, z: fn.set1(42, t), lambda t, x, y, z: f"42::{SQL_TYPE[t]}", ALL, "x")
register("p_masked_set1", lambda t, x, y, z: fn.masked_set1(F.col("m"), x, 42, t), lambda t, x, y, z: f"case when m then 42::{SQL_TYPE[t]} else {x} end", ALL, "x")
register("p_set_zero", lambda t, x, y, z: fn.set_zero(t), lambda t, x, y, z: f"0::{SQL_TYPE[t]}", ALL, "x")
register("p_set_undef", lambda t, x, y, z: fn.set_undef(t), lambda t, x, y, z: f"null::{SQL_TYPE[t]}", ALL, "x")
register("p_load", lambda t, x, y, z: fn.load(f"x_{t}"), lambda t, x, y, z: x, ALL, "x")
register("p_load_zero", lambda t, x, y, z: fn.masked_load(F.col("m"), f"x_{t}", t), lambda t, x, y, z: f"case when m then {x} else 0::{SQL_TYPE[t]} end", ALL, "x")
register("p_load_keep", lambda t, x, y, z: fn.masked_load(F.col("m"), f"x_{t}", t, y), lambda t, x, y, z: f"case when m then {x} else {y} end", ALL)
register("p_store_masked", lambda t, x, y, z: fn.select(F.col("m"), y, x), lambda t, x, y, z: f"case when m then {y} else {x} end", ALL)
register("p_load_convert_up", lambda t, x, y, z: fn.cast(x, t, "si64"), lambda t, x, y, z: f"{x}::bigint", ("si8", "si16", "si32", "ui8", "ui16", "ui32"), "x")


# reductions
def _reduce(name: str, spark_f: Callable[..., Column], sql_f: Callable[[str, str], str], tags: tuple[str, ...]) -> None:
    for mask in (False, True):

        def query(spark: SparkSession, sf_dir: str, mask: bool = mask) -> DataFrame:
            df = table(spark, sf_dir, "events").select(*[_spark_lane("x", t, t in FLOATS) for t in tags], (F.pmod("event_id", F.lit(3)) != 0).alias("m"))
            return df.agg(*[spark_f(F.col(f"x_{t}"), t, **({"mask": F.col("m")} if mask else {})).alias(f"r_{t}") for t in tags])

        lanes = ", ".join(_sql_lane("x", t, t in FLOATS) for t in tags)
        out = ", ".join(f"{sql_f(f'x_{t}', t)} as r_{t}" for t in tags)
        key = f"p_{name}{'_masked' if mask else ''}"
        QUERIES[key] = query
        ORACLE_SQL[key] = f"select {out} from (select * from (select {lanes}, event_id % 3 <> 0 as m from events) {'where m' if mask else ''})"


_reduce("hadd", fn.hadd, lambda x, t: f"coalesce(sum({x}::double), 0)::{SQL_TYPE[t]}" if t in FLOATS else sql_wrap(f"coalesce(sum({H(x)}), 0)", t), (*INTEGERS, "f64"))
_reduce("hmax", fn.hmax, lambda x, t: f"coalesce(max({x}), 0)::{SQL_TYPE[t]}", ALL)
_reduce("hmin", fn.hmin, lambda x, t: f"coalesce(min({x}), 0)::{SQL_TYPE[t]}", ALL)
_reduce("hand", fn.hand, lambda x, t: back(f"coalesce(bit_and({U(x, t)}), 0)", t), INTEGERS)
_reduce("hor", fn.hor, lambda x, t: back(f"coalesce(bit_or({U(x, t)}), 0)", t), INTEGERS)
QUERIES["p_count_matches"] = lambda spark, sf: spark_lanes(spark, sf, INTEGERS, "x").agg(*[fn.count_matches(F.col(f"x_{t}"), 1, t).alias(f"r_{t}") for t in INTEGERS])
ORACLE_SQL["p_count_matches"] = f"select {', '.join(sql_wrap(f'count_if(x_{t} = 1)::hugeint', t) + f' as r_{t}' for t in INTEGERS)} from {sql_lanes(INTEGERS, 'x')}"

# masks, as boolean columns and as words of 64 lanes
_MASKS: dict[str, tuple[Callable[[], Column], str]] = {
    "mask_binary_and": (lambda: fn.mask_binary_and(F.col("a"), F.col("b")), "a and b"),
    "mask_binary_or": (lambda: fn.mask_binary_or(F.col("a"), F.col("b")), "a or b"),
    "mask_binary_xor": (lambda: fn.mask_binary_xor(F.col("a"), F.col("b")), "a <> b"),
    "mask_binary_not": (lambda: fn.mask_binary_not(F.col("a")), "not a"),
    "mask_true": (lambda: fn.mask_true(), "true"),
    "mask_false": (lambda: fn.mask_false(), "false"),
    "mask_population_count": (lambda: fn.mask_population_count(F.col("w")), "length(replace(to_binary(w::ubigint), '0', ''))::bigint"),
    "lzc_imask": (lambda: fn.lzc_imask(F.col("w"), 16), "(case when w = 0 then 16 else 16 - length(to_binary(w::ubigint)) end)::bigint"),
    "tzc": (lambda: fn.tzc(F.col("w"), 16), "(case when w = 0 then 16 else length(to_binary(w::ubigint)) - length(rtrim(to_binary(w::ubigint), '0')) end)::bigint"),
    "shift_right_imask": (lambda: fn.shift_right_imask(F.col("w"), F.col("n"), 16), "case when n >= 64 then 0 else w >> n end"),
    "shift_left_imask": (lambda: fn.shift_left_imask(F.col("w"), F.col("n"), 16), "case when n >= 16 then 0 else (w << n) & 65535 end"),
    "test_imask": (lambda: fn.test_imask(F.col("w"), F.col("n"), 16), "case when n < 16 then (w >> n) & 1 else 0 end"),
    "overlay_imask": (lambda: fn.overlay_imask(F.col("w"), F.col("u"), F.col("n"), 16), "case when n >= 16 then w else (w | (u << n)) & 65535 end"),
    "insert_imask": (lambda: fn.insert_imask(F.col("w"), F.col("u"), 4, 16, 8), "(w & xor(65535, 255 << 4)) | ((u & 255) << 4)"),
    "insert_imask_at": (lambda: fn.insert_imask(F.col("w"), F.col("u"), F.pmod("n", F.lit(9)), 16, 8), "((w & xor(65535, 255::bigint << (n % 9))) | ((u & 255) << (n % 9))) & 65535"),
    "extract_imask": (lambda: fn.extract_imask(F.col("w"), 4, 8), "(w >> 4) & 255"),
    "extract_imask_at": (lambda: fn.extract_imask(F.col("w"), F.pmod("n", F.lit(9)), 8), "(w >> (n % 9)) & 255"),
}


def _mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("pos"), (F.pmod(e, F.lit(3)) != 0).alias("a"), (F.pmod(e, F.lit(2)) == 0).alias("b"), F.pmod(e * 40503, F.lit(65536)).alias("w"), F.pmod(e * 30011, F.lit(65536)).alias("u"), F.pmod(e, F.lit(21)).alias("n"))


_MASK_SQL = "(select event_id as pos, event_id % 3 <> 0 as a, event_id % 2 = 0 as b, event_id * 40503 % 65536 as w, event_id * 30011 % 65536 as u, event_id % 21 as n from events)"
for _name, (_column, _expr) in _MASKS.items():
    QUERIES[f"p_{_name}"] = lambda spark, sf, c=_column: _mask_rows(spark, sf).select("pos", c().alias("r"))
    ORACLE_SQL[f"p_{_name}"] = f"select pos, {_expr} as r from {_MASK_SQL}"
