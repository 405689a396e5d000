"""Queries for functions across the lanes of a register: eight lanes of `events` a register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lamina.functions as fn
from lamina.operators import positional, sorting
from lamina.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LANES = 8


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, v, w (int lanes with repeats), i (indexes), m (mask)."""
    e = F.col("event_id")
    n = F.lit(5)
    return table(spark, sf_dir, "events").select(e.alias("pos"), F.pmod(e * 7 + F.floor(e / 3), n).cast("int").alias("v"), (e * 3 + 100).cast("int").alias("w"), (F.pmod(e * 5, F.lit(19)) - 4).cast("int").alias("i"), (F.pmod(e, F.lit(3)) != 1).alias("m"))


ROWS_SQL = "(select event_id as pos, ((event_id * 7 + event_id // 3) % 5)::integer as v, (event_id * 3 + 100)::integer as w, (event_id * 5 % 19 - 4)::integer as i, event_id % 3 <> 1 as m from events)"
REGISTERS_SQL = f"(select * from (select pos // {LANES} as chunk, list(v order by pos) as v, list(w order by pos) as w, list(i order by pos) as i, list(m order by pos) as m, count(*) as n from {ROWS_SQL} group by 1) where n = {LANES})"


def registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.registers(rows(spark, sf_dir), ["v", "w", "i", "m"], LANES).where(F.size("v") == LANES)


def text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")


def sql_text(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda q: coalesce(q::varchar, '-')), ',')"


def register(name: str, column: Callable[..., Column], sql: str, array: bool = True) -> None:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        made = column(*map(F.col, "vwim"))
        return registers(spark, sf).select("chunk", (text(made) if array else made).alias("r"))

    QUERIES[f"o_{name}"] = query
    ORACLE_SQL[f"o_{name}"] = f"select chunk, {sql_text(sql) if array else sql} as r from {REGISTERS_SQL}"


L = LANES
_mod = lambda k, n: f"((({k}) % {n} + {n}) % {n})"
_u = f"(i[k] + case when i[k] < 0 then {1 << 32} else 0 end)"
_each = f"range(1, {L + 1})"

register("to_array", lambda v, w, i, m: v, "v")
register("set", lambda v, w, i, m: fn.set_([3, 1, 2], "si32"), "[3, 1, 2]")
register("sequence", lambda v, w, i, m: fn.sequence(L, "si32"), f"range(0, {L})")
register("custom_sequence", lambda v, w, i, m: fn.custom_sequence(250, 3, L, "ui8"), f"list_transform(range(0, {L}), lambda k: (250 + 3 * k) % 256)")
register("extract_value", lambda v, w, i, m: fn.extract_value(v, 2), "v[3]", False)
register("extract_value_at", lambda v, w, i, m: fn.extract_value_at(w, F.get(v, F.lit(0))), "w[v[1] + 1]", False)
register("insert_value", lambda v, w, i, m: fn.insert_value(v, 2, F.lit(9)), f"list_transform({_each}, lambda k: case when k = 3 then 9 else v[k] end)")
register("insert_value_at", lambda v, w, i, m: fn.insert_value_at(w, F.get(v, F.lit(1)), F.lit(9)), f"list_transform({_each}, lambda k: case when k = v[2] + 1 then 9 else w[k] end)")
register("to_integral", lambda v, w, i, m: fn.to_integral(m), f"list_sum(list_transform({_each}, lambda k: case when m[k] then 1 << (k - 1) else 0 end))::bigint", False)
register("to_mask", lambda v, w, i, m: F.transform(fn.to_mask(fn.to_integral(m), L), lambda b: b.cast("int")), "list_transform(m, lambda b: b::integer)")
register("load_mask_repr", lambda v, w, i, m: F.transform(fn.to_mask(fn.to_integral(m), L), lambda b: b.cast("int")), "list_transform(m, lambda b: b::integer)")
register("extract", lambda v, w, i, m: fn.extract(v, 1, 4), "v[5:8]")
register("insert", lambda v, w, i, m: fn.insert(v, fn.resize_down(w, 4), 1, 4), "v[1:4] || w[1:4]")
register("resize_down", lambda v, w, i, m: fn.resize_down(v, 4), "v[1:4]")
register("resize_up_zero", lambda v, w, i, m: fn.resize_up_zero(v, 12, "si32"), "v || [0, 0, 0, 0]")
register("resize_up_undef", lambda v, w, i, m: fn.resize_up_undef(v, 12, "si32"), "v || [null, null, null, null]::integer[]")
register("concat", lambda v, w, i, m: fn.concat(v, w), "v || w")
register("convert_up", lambda v, w, i, m: fn.convert_up(w, 1, 4, "si32", "si64"), "w[5:8]")
register("convert_down", lambda v, w, i, m: fn.convert_down(w, 1, 16, "si32", "ui8"), "[0, 0, 0, 0, 0, 0, 0, 0] || list_transform(w, lambda x: x % 256)")
_packed = f"list_filter({_each}, lambda k: m[k])"
register("compress", lambda v, w, i, m: fn.compress(m, w, "si32"), f"list_transform({_packed}, lambda k: w[k]) || list_transform(list_filter({_each}, lambda k: not m[k]), lambda k: 0)")
register("expand", lambda v, w, i, m: fn.expand(m, v, w), f"list_transform({_each}, lambda k: case when m[k] then w[len(list_filter(m[1:k], lambda b: b))] else v[k] end)")
register("conflict", lambda v, w, i, m: fn.conflict(v, "si32"), f"list_transform({_each}, lambda k: coalesce(list_sum(list_transform(list_filter({_each}, lambda j: j < k and v[j] = v[k]), lambda j: 1 << (j - 1))), 0)::integer)")
register("conflict_free", lambda v, w, i, m: fn.conflict_free(m, v, "si32"), f"coalesce(list_sum(list_transform(list_filter({_each}, lambda k: m[k] and len(list_filter({_each}, lambda j: j < k and v[j] = v[k])) = 0), lambda k: 1 << (k - 1))), 0)::bigint", False)
register("reverse", lambda v, w, i, m: fn.reverse(v), "list_reverse(v)")
register("interleave_lo", lambda v, w, i, m: fn.interleave_lo(v, w), f"list_transform({_each}, lambda k: case when k % 2 = 1 then v[(k + 1) // 2] else w[k // 2] end)")
register("align_right_lanes", lambda v, w, i, m: fn.align_right_lanes(v, w, 3), "(w || v)[4:11]")
register("permute_lanes_imm", lambda v, w, i, m: fn.permute_lanes_imm(w, 0b00011011), "list_transform([4, 3, 2, 1, 8, 7, 6, 5], lambda k: w[k])")
register("permute_lanes", lambda v, w, i, m: fn.permute_lanes(w, i), f"list_transform({_each}, lambda k: w[{_u} % {L} + 1])")
register("permute_lanes_keep", lambda v, w, i, m: fn.permute_lanes(w, i, mask=m, src=v), f"list_transform({_each}, lambda k: case when m[k] then w[{_u} % {L} + 1] else v[k] end)")
register("permute_lanes_zero", lambda v, w, i, m: fn.permute_lanes(w, i, mask=m, tag="si32"), f"list_transform({_each}, lambda k: case when m[k] then w[{_u} % {L} + 1] else 0 end)")
register("table_lookup", lambda v, w, i, m: fn.table_lookup(v, i, w), f"list_transform({_each}, lambda k: (v || w)[{_u} % {2 * L} + 1])")
register("gather", lambda v, w, i, m: fn.gather(w, v), f"list_transform({_each}, lambda k: w[v[k] + 1])")
register("gather_narrow", lambda v, w, i, m: fn.gather_narrow(w, v), f"list_transform({_each}, lambda k: w[v[k] + 1])")
register("gather_narrow_partial", lambda v, w, i, m: fn.gather_narrow_partial(w, fn.resize_down(v, 4), L, "si32"), f"list_transform({_each}, lambda k: case when k <= 4 then w[v[k] + 1] else 0 end)")
register("gather_masked", lambda v, w, i, m: fn.gather_masked(m, w, v, i), f"list_transform({_each}, lambda k: case when m[k] then w[v[k] + 1] else i[k] end)")
_last = f"list_max(list_filter({_each}, lambda j: v[j] = k - 1))"
register("scatter", lambda v, w, i, m: fn.scatter(i, v, w), f"list_transform({_each}, lambda k: coalesce(w[list_max(list_filter({_each}, lambda j: v[j] = k - 1))], i[k]))")
register("scatter_masked", lambda v, w, i, m: fn.scatter(i, v, w, m), f"list_transform({_each}, lambda k: coalesce(w[list_max(list_filter({_each}, lambda j: m[j] and v[j] = k - 1))], i[k]))")
_ints = lambda c: F.transform(c, lambda b: b.cast("int"))
register("mask_interleave_lo", lambda v, w, i, m: _ints(fn.mask_interleave_lo(m, fn.reverse(m))), f"list_transform({_each}, lambda k: (case when k % 2 = 1 then m[(k + 1) // 2] else m[{L + 1} - k // 2] end)::integer)")
register("mask_deinterleave_odd", lambda v, w, i, m: _ints(fn.mask_deinterleave_odd(m, fn.reverse(m))), f"list_transform({_each}, lambda k: (case when k <= 4 then m[2 * k] else m[{L + 1} - 2 * (k - 4)] end)::integer)")
register("set_mask_lane", lambda v, w, i, m: _ints(fn.set_mask_lane(m, 2, 0)), f"list_transform({_each}, lambda k: (case when k = 3 then false else m[k] end)::integer)")
register("to_ostream", lambda v, w, i, m: fn.to_ostream(v, "si32"), "array_to_string(v, ' ')", False)
register("array_sort", lambda v, w, i, m: F.array_sort(w), "list_sort(w)")

QUERIES["o_from_array"] = lambda spark, sf: registers(spark, sf).select("chunk", F.posexplode("v").alias("lane", "r"))
ORACLE_SQL["o_from_array"] = f"select chunk, (k - 1)::integer as lane, v[k] as r from (select chunk, v, unnest({_each}) as k from {REGISTERS_SQL})"
QUERIES["o_compress_store"] = lambda spark, sf: positional.compress_store(rows(spark, sf), "m").select("pos", "w")
ORACLE_SQL["o_compress_store"] = f"select row_number() over (order by pos) - 1 as pos, w from {ROWS_SQL} where m"
QUERIES["o_expand_load"] = lambda spark, sf: positional.expand_load(rows(spark, sf).drop("w"), "m", rows(spark, sf), "w").select("pos", "w")
ORACLE_SQL["o_expand_load"] = f"with r as {ROWS_SQL}, k as (select pos, m, sum(m::int) over (order by pos) - 1 as k from r) select k.pos, case when k.m then r.w else 0 end as w from k left join r on r.pos = k.k"


def _gather_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = rows(spark, sf)
    at = F.pmod(F.col("pos") * 17, F.lit(base.count() + 7))  # a few ids name no row
    return positional.gather(base.select(F.col("pos").alias("ord"), at.alias("row_id")), base, "w").select("ord", "w")


def _scatter_rows(spark: SparkSession, sf: str) -> DataFrame:
    base = rows(spark, sf)
    at = F.pmod((F.col("pos") - F.col("pos") % 3) * 17, F.lit(max(1, base.count())))  # ids repeat: the last write stays
    return positional.scatter(base.select("pos", "w"), base.select(F.col("pos").alias("ord"), at.alias("row_id"), F.col("v").alias("w")), "w")


QUERIES["o_gather_rows"] = _gather_rows
ORACLE_SQL["o_gather_rows"] = f"with r as {ROWS_SQL} select a.pos as ord, b.w from r a left join r b on b.pos = a.pos * 17 % ((select count(*) from events) + 7)"
QUERIES["o_scatter_rows"] = _scatter_rows
ORACLE_SQL["o_scatter_rows"] = f"with r as {ROWS_SQL}, n as (select (pos - pos % 3) * 17 % (select count(*) from events) as row_id, max_by(v, pos) as v from r group by 1) select r.pos, coalesce(n.v, r.w) as w from r left join n on n.row_id = r.pos"
QUERIES["o_random_step"] = lambda spark, sf: rows(spark, sf).select("pos", fn.random_step(1).alias("r"))


# loads and stores
QUERIES["o_load_scalar"] = lambda spark, sf: positional.load_scalar(rows(spark, sf), "w", rows(spark, sf).count() // 2).select("w")
ORACLE_SQL["o_load_scalar"] = f"select w from {ROWS_SQL} where pos = (select count(*) // 2 from events)"
QUERIES["o_store_scalar"] = lambda spark, sf: positional.store_scalar(rows(spark, sf), "w", rows(spark, sf).count() // 2, -7).select("pos", "w")
ORACLE_SQL["o_store_scalar"] = f"select pos, case when pos = (select count(*) // 2 from events) then -7 else w end as w from {ROWS_SQL}"
QUERIES["o_store"] = lambda spark, sf: positional.store(registers(spark, sf), "w", LANES)
ORACLE_SQL["o_store"] = f"select chunk * {L} + k - 1 as pos, w[k] as v from (select chunk, w, unnest({_each}) as k from {REGISTERS_SQL})"
_WORD = f"list_sum(list_transform({_each}, lambda k: case when m[k] then 1 << (k - 1) else 0 end))::bigint"
for _layout, _made, _stored in (
    ("native", lambda: _ints(F.col("mask")), "list_transform(m, lambda b: b::integer)"),
    ("integral", lambda: F.col("mask"), _WORD),
    ("bytes", lambda: F.hex("mask"), "array_to_string(list_transform(m, lambda b: case when b then '01' else '00' end), '')"),
    ("bits", lambda: F.hex("mask"), f"lpad(to_hex({_WORD}), 2, '0')"),
):
    _array = _layout == "native"
    QUERIES[f"o_store_mask_{_layout}"] = lambda spark, sf, x=_layout, c=_made, a=_array: positional.store_mask(registers(spark, sf), "m", x).select("chunk", (text(c()) if a else c()).alias("r"))
    ORACLE_SQL[f"o_store_mask_{_layout}"] = f"select chunk, {sql_text(_stored) if _array else _stored} as r from {REGISTERS_SQL}"
register("cosort", lambda v, w, i, m: sorting.cosort_registers(v, w), f"list_transform(list_sort(list_transform({_each}, lambda k: v[k]::bigint * 100 + k)), lambda x: w[x % 100])")
