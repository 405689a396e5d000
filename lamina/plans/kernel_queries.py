"""Queries of whole-column operators, filter-sum kernels, sorting, runs, joins and analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lamina.functions as fn
from lamina.analytics import catalog, datasets, measurements
from lamina.operators import algo, positional, sorting
from lamina.sources import columnfile
from lamina.sources.shared import folder
from lamina.sources.tables import sample_rows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# ---- whole-column operators over events: pos = event_id, a = value, b = user_id
def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("a"), (F.col("user_id") % 100).cast("double").alias("b"), (F.pmod("event_id", F.lit(3)) != 0).alias("m"))


_EV = "(select event_id as pos, value as a, (user_id % 100)::double as b, event_id % 3 <> 0 as m from events)"


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of row ids with repeats, out of order, one for each event, over the whole table."""
    events = table(spark, sf, "events")
    e = F.col("event_id")
    return events.select(e.alias("ord"), F.pmod((e - e % 3) * 37, F.lit(max(1, events.count()))).alias("row_id"))


_ST = f"(select i.ord, i.row_id, e.* from (select event_id as ord, (event_id - event_id % 3) * 37 % (select count(*) from events) as row_id from events) i join {_EV} e on e.pos = i.row_id)"
_one: Callable[[Column], Column] = lambda a: fn.greater_than(a, F.lit(50.0), "f64")
_two: Callable[[Column, Column], Column] = lambda a, b: fn.less_than(a, b, "f64")
_FORMS = {"unary": ("a", _one, "a > 50"), "binary": (["a", "b"], _two, "a < b")}
_total = lambda *c: F.coalesce(F.sum(F.floor(sum(c[1:], c[0])).cast("bigint")), F.lit(0))
_VALUE = {"unary": "floor(a)::bigint", "binary": "floor(a + b)::bigint"}
_MAP = {"unary": (lambda a: fn.mul_imm(a, 2.0, "f64"), "a * 2"), "binary": (lambda a, b: fn.add(a, b, "f64"), "a + b")}

for _f, (_in, _op, _sql) in _FORMS.items():
    add(f"a_predicate_{_f}", lambda s, d, i=_in, o=_op: algo.predicate(_events(s, d), o, i, "r").select("pos", "r"), f"select pos, {_sql} as r from {_EV}")
    add(f"a_predicate_words_{_f}", lambda s, d, i=_in, o=_op: algo.pack_mask(algo.predicate(_events(s, d), o, i, "r"), "r", 32), f"select pos // 32 as chunk, sum(case when {_sql} then 1::bigint << (pos % 32) else 0 end)::bigint as word from {_EV} group by 1")
    add(f"a_count_{_f}", lambda s, d, i=_in, o=_op: algo.count(_events(s, d), o, i), f"select count_if({_sql})::bigint as n from {_EV}")
    add(f"a_count_masked_{_f}", lambda s, d, i=_in, o=_op: algo.count(_events(s, d), o, i, "m"), f"select count_if(m and {_sql})::bigint as n from {_EV}")
    add(f"a_count_selected_{_f}", lambda s, d, i=_in, o=_op: algo.count(_events(s, d), o, i, ids=_ids(s, d)), f"select count_if({_sql})::bigint as n from {_ST}")
    add(f"a_select_{_f}", lambda s, d, i=_in, o=_op: algo.select(_events(s, d), o, i), f"select pos, a as v from {_EV} where {_sql}")
    add(f"a_select_masked_{_f}", lambda s, d, i=_in, o=_op: algo.select(_events(s, d), o, i, "m"), f"select pos, a as v from {_EV} where m and {_sql}")
    add(f"a_select_indices_{_f}", lambda s, d, i=_in, o=_op: algo.select_indices(_events(s, d), o, i), f"select pos as row_id from {_EV} where {_sql}")
    add(f"a_select_masked_indices_{_f}", lambda s, d, i=_in, o=_op: algo.select_indices(_events(s, d), o, i, "m"), f"select pos as row_id from {_EV} where m and {_sql}")
    add(f"a_select_selected_indices_{_f}", lambda s, d, i=_in, o=_op: algo.refine_indices(_events(s, d), o, i, _ids(s, d)), f"select ord, row_id from {_ST} where {_sql}")
    add(f"a_transform_{_f}", lambda s, d, i=_in, o=_MAP[_f][0]: algo.transform(_events(s, d), o, i, "r").select("pos", "r"), f"select pos, {_MAP[_f][1]} as r from {_EV}")
    add(f"a_transform_selected_{_f}", lambda s, d, i=_in, o=_MAP[_f][0]: algo.transform(_events(s, d), o, i, "r", _ids(s, d)), f"select ord, {_MAP[_f][1]} as r from {_ST}")
    add(f"a_transform_where_{_f}", lambda s, d, i=_in, o=_MAP[_f][0]: algo.transform_where(_events(s, d).withColumn("r", F.lit(-1.0)), o, i, "m", "r").select("pos", "r"), f"select pos, case when m then {_MAP[_f][1]} else -1.0 end::double as r from {_EV}")
    add(f"a_transform_masked_{_f}", lambda s, d, i=_in, o=_MAP[_f][0]: algo.transform_masked(_events(s, d), lambda m, *c: F.when(m, o(*c)).otherwise(F.lit(0.0)), i, "m", "r").select("pos", "r"), f"select pos, case when m then {_MAP[_f][1]} else 0.0 end::double as r from {_EV}")
    add(f"a_aggregate_{_f}", lambda s, d, i=_in: algo.aggregate(_events(s, d), _total, i), f"select coalesce(sum({_VALUE[_f]}), 0)::bigint as v from {_EV}")
    add(f"a_aggregate_masked_{_f}", lambda s, d, i=_in: algo.aggregate(_events(s, d), lambda m, *c: F.coalesce(F.sum(F.when(m, F.floor(sum(c[1:], c[0])).cast("bigint"))), F.lit(0)), i, "m"), f"select coalesce(sum({_VALUE[_f]}), 0)::bigint as v from {_EV} where m")
    add(f"a_aggregate_selected_{_f}", lambda s, d, i=_in: algo.aggregate(_events(s, d), _total, i, ids=_ids(s, d)), f"select coalesce(sum({_VALUE[_f]}), 0)::bigint as v from {_ST}")


def _consumed(spark: SparkSession, sf: str, form: str, **how: object) -> DataFrame:
    """Runs a sink that counts the rows it was given; returns that count."""
    n = spark.sparkContext.accumulator(0)
    if how.pop("stream", False):
        how["ids"] = _ids(spark, sf)
    masked = "mask" in how
    algo.consume(_events(spark, sf), lambda rows: n.add(sum(1 for r in rows if not masked or r[0])), _FORMS[form][0], **how)
    return spark.range(1).select(F.lit(n.value).cast("bigint").alias("n"))


for _f in _FORMS:
    add(f"a_consume_{_f}", lambda s, d, f=_f: _consumed(s, d, f), "select count(*) as n from events")
    add(f"a_consume_masked_{_f}", lambda s, d, f=_f: _consumed(s, d, f, mask="m"), f"select count_if(m)::bigint as n from {_EV}")
    add(f"a_consume_selected_{_f}", lambda s, d, f=_f: _consumed(s, d, f, stream=True), f"select count(*) as n from {_ST}")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = algo.for_each_chunk(_events(spark, sf), lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([pc.sum(pc.cast(pc.floor(b.column(0)), pa.int64())).as_py()])], names=["n", "v"]), "n long, v long", "a")
    return rows.agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


add("a_for_each_chunk", _chunks, f"select count(*) as n, sum(floor(a)::bigint)::bigint as v from {_EV}")
for _layout, _words in (("integral", "ceil(count(*) / 16)"), ("native", "ceil(count(*) / 16)"), ("bytes", "count(*)"), ("bits", "ceil(count(*) / 8)")):
    add(f"a_mask_count_{_layout}", lambda s, d, x=_layout: algo.chunk_count(_events(s, d), x, 16), f"select {_words}::bigint as words from events")

# ---- filter, filter, sum: a = l_linenumber, b = l_partkey, c = whole quantity
_LI = "(select l_linenumber as a, l_partkey as b, trunc(l_quantity)::integer as c from lineitem)"


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").cast("int").alias("c"))


def q1(spark: SparkSession, sf: str) -> DataFrame:
    """Fused: both filters reach the scan, one partial sum a task."""
    return _lineitem(spark, sf).where((F.col("a") < 4) & (F.col("b") > 100)).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))


_Q1 = f"select coalesce(sum(c), 0)::bigint as total from {_LI} where a < 4 and b > 100"
add("q1_filter_sum", q1, _Q1)
add("q1_scalar_control", q1, _Q1)
BATCH = 64  # rows a batch


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by ordinal: a, b and c of the two filters and the sum."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 7).alias("a"), (F.col("o_orderkey") % 5).alias("b"), F.col("o_totalprice").cast("int").alias("c"))


_PAIR = "select coalesce(sum(trunc(o_totalprice)::integer), 0)::bigint as total from orders where o_custkey % 7 < 4 and o_orderkey % 5 > 0"
_both = lambda a, b: (a < 4) & (b > 0)
_sum = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total")


def _full_mask(spark: SparkSession, sf: str, layout: str) -> DataFrame:
    """The whole mask is made first, in its layout, and then consumed beside the column."""
    rows = algo.predicate(_pair(spark, sf), _both, ["a", "b"])
    if layout == "native":
        return rows.agg(_sum(F.when(F.col("m"), F.col("c"))))
    if layout == "integral":  # a word a register of 16 lanes, tested lane by lane
        words = algo.pack_mask(rows, lanes=16)
        lane = F.pmod(F.col("pos"), F.lit(16)).cast("int")
        return rows.withColumn("chunk", F.floor(F.col("pos") / 16)).join(words, "chunk").agg(_sum(F.when(F.getbit("word", lane) == 1, F.col("c"))))
    on = algo.unpack_mask(algo.pack_mask(rows, lanes=64), 64).where("m").select(F.col("pos").alias("_p"))
    return rows.join(on, F.col("pos") == F.col("_p")).agg(_sum(F.col("c")))


def _batch_mask(spark: SparkSession, sf: str, layout: str) -> DataFrame:
    """A batch of rows at a time: its mask, then the sum over its lanes."""
    batch = positional.registers(algo.predicate(_pair(spark, sf), _both, ["a", "b"]), ["m", "c"], BATCH)
    bits = F.aggregate(F.transform("m", lambda m, i: F.when(m, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))
    if layout == "native":
        mask = F.col("m")
    elif layout == "integral":  # a word for each eight lanes
        batch = batch.withColumn("words", F.transform(F.sequence(F.lit(0), F.ceil(F.size("m") / 8).cast("int") - 1), lambda k: F.slice("m", k * 8 + 1, F.lit(8))))
        mask = F.flatten("words")
    else:
        batch = batch.withColumn("word", bits)
        mask = F.transform(F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.getbit(F.col("word"), i) == 1)
    lanes = F.zip_with(mask, F.col("c"), lambda m, c: F.when(m, c).otherwise(0).cast("bigint"))
    return batch.select(F.aggregate(lanes, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("n")).agg(_sum(F.col("n")))


for _layout in ("native", "integral", "bit"):
    add(f"q2_full_{_layout}_mask", lambda s, d, x=_layout: _full_mask(s, d, x), _PAIR)
    add(f"q2_batch_{_layout}_mask", lambda s, d, x=_layout: _batch_mask(s, d, x), _PAIR)


def _full_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Row ids of all matches, then a gather and sum."""
    o = _pair(spark, sf)
    ids = algo.as_stream(algo.select_indices(o, lambda a: a < 3, "a"))
    return algo.selected(o, ids).agg(_sum(F.col("c")), F.count("*").alias("produced"))


def _batch_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The same a batch of rows at a time: its list of positions, and a gather from its lanes."""
    batch = positional.registers(_pair(spark, sf), ["a", "c"], BATCH)
    at = F.filter(F.sequence(F.lit(0), F.size("a") - 1), lambda i: F.get("a", i) < 3)
    batch = batch.select("c", at.alias("at"))
    total = F.aggregate("at", F.lit(0).cast("bigint"), lambda x, i: x + F.get("c", i))
    return batch.select(total.alias("n"), F.size("at").alias("k")).agg(_sum(F.col("n")), F.coalesce(F.sum("k"), F.lit(0)).alias("produced"))


for _scope, _query in (("batch", _batch_positions), ("full", _full_positions)):
    add(f"q3_{_scope}_positions", _query, "select coalesce(sum(trunc(o_totalprice)::integer), 0)::bigint as total, count(*) as produced from orders where o_custkey % 7 < 3")

SALTS = (0, 1, 3, 7, 15, 31, 63, 127)  # fixed values
for _k in (1, 4, 8):

    def _q6(spark: SparkSession, sf: str, k: int = _k) -> DataFrame:
        second = F.col("b") < 1000
        sums = [F.coalesce(F.sum(F.when(second, F.col("c").bitwiseXOR(F.lit(x)))), F.lit(0)).cast("bigint").alias(f"s{i}") for i, x in enumerate(SALTS[:k])]
        return _lineitem(spark, sf).where("a < 5").agg(F.count("*").alias("after_a"), F.count_if(second).alias("after_b"), *sums)

    add(f"q6_filter_filter_{_k}_sums", _q6, "select count(*) as after_a, count_if(b < 1000)::bigint as after_b, " + ", ".join(f"coalesce(sum(xor(c, {x})) filter (b < 1000), 0)::bigint as s{i}" for i, x in enumerate(SALTS[:_k])) + f" from {_LI} where a < 5")

    def _q7(spark: SparkSession, sf: str, k: int = _k) -> DataFrame:
        """A mask a filter, each made from the one before; the sums consume the last."""
        rows = algo.predicate(_lineitem(spark, sf), lambda a: a < 5, "a", "m1")
        rows = algo.predicate(rows, lambda m, b: m & (b < 1000), ["m1", "b"], "m2")
        sums = [F.coalesce(F.sum(F.when(F.col("m2"), F.col("c").bitwiseXOR(F.lit(x)))), F.lit(0)).cast("bigint").alias(f"s{i}") for i, x in enumerate(SALTS[:k])]
        return rows.agg(F.count_if("m1").alias("after_a"), F.count_if("m2").alias("after_b"), *sums)

    add(f"q7_masked_{_k}_sums", _q7, ORACLE_SQL[f"q6_filter_filter_{_k}_sums"])

# ---- sorting and runs
_S = ["o_orderstatus", "o_custkey"]
_ORD = "(select o_orderkey as pos, o_orderstatus, o_custkey, o_totalprice from orders)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderstatus", "o_custkey", "o_totalprice")


add("s1_sort_columns", lambda s, d: sorting.sort_columns(_orders(s, d), _S, [False, True], "pos"), f"select * from {_ORD} order by o_orderstatus, o_custkey desc, pos")
add("s2_sort_parallel", lambda s, d: sorting.sort_columns_parallel(_orders(s, d), _S, None, "pos"), f"select * from {_ORD} order by o_orderstatus, o_custkey, pos")
add("s3_sort_key", lambda s, d: sorting.sort_key(_orders(s, d), "o_custkey"), f"select * from {_ORD} order by o_custkey")
add("s4_sort_runs", lambda s, d: sorting.sorted_runs(_orders(s, d), ["o_custkey"]), "select begin, \"end\" from (select sum(n) over (order by o_custkey) - n as begin, sum(n) over (order by o_custkey) as \"end\", n from (select o_custkey, count(*) as n from orders group by 1)) where n > 1".replace("sum(n) over (order by o_custkey) - n as begin", "(sum(n) over (order by o_custkey) - n)::bigint as begin").replace('sum(n) over (order by o_custkey) as "end"', '(sum(n) over (order by o_custkey))::bigint as "end"'))
add("s5_argsort", lambda s, d: sorting.sort_index(_orders(s, d), _S, [False, True]), f"select row_number() over (order by o_orderstatus, o_custkey desc, pos) - 1 as ord, pos as row_id from {_ORD}")
add("s6_sample_sort", lambda s, d: sorting.sample_sort(_orders(s, d), ["o_custkey", "pos"]), f"select * from {_ORD}")
add("s8_argsort_three", lambda s, d: sorting.sort_index(_orders(s, d), ["o_orderstatus", "o_custkey", "o_totalprice"]), f"select row_number() over (order by o_orderstatus, o_custkey, o_totalprice, pos) - 1 as ord, pos as row_id from {_ORD}")
add("s9_apply_permutation", lambda s, d: sorting.apply_permutation(sorting.sort_index(_orders(s, d), ["o_custkey"]), _orders(s, d)).select("ord", "o_custkey", "o_totalprice"), f"select row_number() over (order by o_custkey, pos) - 1 as ord, o_custkey, o_totalprice from {_ORD}")
add("s10_sort_values", lambda s, d: sorting.sort_values(_orders(s, d), "o_custkey", True), "select row_number() over (order by o_custkey desc) - 1 as ord, o_custkey from orders")
add("s11_sort_register", lambda s, d: table(s, d, "embeddings").select("vec_id", F.element_at(sorting.sort_array_column(F.col("embedding")), 1).alias("least"), F.element_at(sorting.sort_array_column(F.col("embedding")), -1).alias("greatest")), "select vec_id, list_sort(embedding)[1] as least, list_sort(embedding)[-1] as greatest from embeddings")
add("s13_partition_step", lambda s, d: _orders(s, d).select("pos", sorting.partition_side(F.col("o_custkey"), sorting.median_of_three(F.lit(100), F.lit(700), F.lit(300))).alias("side")), f"select pos, sign(o_custkey - 300)::integer as side from {_ORD}")


def _run_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.floor(F.col("event_id") / (F.pmod(F.floor(F.col("event_id") / 50), F.lit(5)) + 1)).alias("v"))


_RUNS = 'with e as (select event_id as pos, event_id // (event_id // 50 % 5 + 1) as v from events), b as (select pos, coalesce(v <> lag(v) over (order by pos), true) as nb from e), g as (select pos, sum(nb::int) over (order by pos) as g from b) select min(pos) as begin, max(pos) + 1 as "end" from g group by g having count(*) > 1'
add("s14_equal_runs", lambda s, d: sorting.equal_runs(_run_rows(s, d), "v", block=128), _RUNS)
add("s15_equal_runs_delta", lambda s, d: sorting.equal_runs_delta(_run_rows(s, d), "v"), _RUNS)
add("s16_equal_runs_scan", lambda s, d: sorting.equal_runs_scan(_run_rows(s, d), "v"), _RUNS)
add("s17_runs_from_frequencies", lambda s, d: sorting.sorted_runs(_orders(s, d), _S), 'select begin, "end" from (select (sum(n) over w - n)::bigint as begin, (sum(n) over w)::bigint as "end", n from (select o_orderstatus, o_custkey, count(*) as n from orders group by 1, 2) window w as (order by o_orderstatus, o_custkey)) where n > 1')
add("s18_distinct_frequencies", lambda s, d: sorting.distinct_frequencies(_orders(s, d), "o_custkey"), "select o_custkey as value, count(*) as n from orders group by 1")
add("s19_scan_lt_gt", lambda s, d: sorting.scan_lt(_orders(s, d), "o_custkey", 100).union(sorting.scan_gt(_orders(s, d), "o_custkey", 1000)).select("pos", "o_custkey"), f"select pos, o_custkey from {_ORD} where o_custkey < 100 or o_custkey > 1000")
add("s20_sort_image", lambda s, d: sorting.sort_image(_orders(s, d), _S, [True, False]), f"select row_number() over (order by o_orderstatus desc, o_custkey, pos) - 1 as ord, * from {_ORD}")
add("s20_conformance", lambda s, d: sorting.conformance(sorting.sort_image(_orders(s, d), _S, [True, False]), _orders(s, d), _S, [True, False]), "select 0::bigint as missing, 0::bigint as foreign, 0::bigint as disordered")


# ---- joins and keys
def _keys(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))


_KEYS = "lineitem, part, orders, customer where l_partkey = p_partkey and l_orderkey = o_orderkey and o_custkey = c_custkey"
add("j1_key_columns", lambda s, d: _keys(s, d).groupBy("p_brand", "year", "quarter", "c_mktsegment").agg(F.count("*").alias("n")), f"select p_brand, year(o_orderdate)::integer as year, quarter(o_orderdate)::integer as quarter, c_mktsegment, count(*) as n from {_KEYS} group by all")
add("j1_nation_keys", lambda s, d: _keys(s, d).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "p_type").agg(F.count("*").alias("n")), f"select n_name, p_type, count(*) as n from nation, {_KEYS} and c_nationkey = n_nationkey group by all")


def _star(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("store_nation"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("ship_day"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.month("o_orderdate").alias("month"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("credit"))
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_name", "p_size")
    joined = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


_STAR = """(select *, s_nationkey as store_nation, datediff('day', date '1992-01-01', l_shipdate::date)::integer as ship_day, year(o_orderdate)::integer as year, quarter(o_orderdate)::integer as quarter, month(o_orderdate)::integer as month, floor(c_acctbal / 1000)::bigint as credit
    from lineitem, part, orders, customer, supplier, nation where l_partkey = p_partkey and l_orderkey = o_orderkey and o_custkey = c_custkey and l_suppkey = s_suppkey and c_nationkey = n_nationkey)"""
KEY_SETS = {  # the roles of five published sort keys, on this schema
    "q067": ["p_type", "p_brand", "p_name", "year", "quarter", "month", "s_name"],
    "q050": ["s_name", "store_nation", "ship_day", "l_returnflag", "l_linestatus"],
    "q010": ["c_mktsegment", "o_orderpriority", "credit", "n_name", "year"],
    "q064": ["p_name", "s_name", "year", "n_name", "c_nationkey", "month"],
    "q081": ["c_name", "n_name", "credit", "c_mktsegment", "l_returnflag"],
}


def _coded_keys(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Joined, each key column coded densely, and sorted; equal rows counted."""
    rows = _star(spark, sf).groupBy(*columns).agg(F.count("*").alias("n"))
    for i, c in enumerate(columns):
        rows = sorting.dense_codes(rows, c, f"k{i}").drop(c)
    return sorting.sort_columns(rows, [f"k{i}" for i in range(len(columns))])


for _name, _set in KEY_SETS.items():
    _codes = ", ".join(f"(dense_rank() over (order by {c}) - 1)::bigint as k{i}" for i, c in enumerate(_set))
    add(f"j1_{_name}_codes", lambda s, d, x=_set: _coded_keys(s, d, x), f"select n, {_codes} from (select count(*) as n, {', '.join(_set)} from {_STAR} group by all)")

add("j2_dense_codes", lambda s, d: sorting.dense_codes(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", "code"), "select p_partkey, p_brand, (dense_rank() over (order by p_brand nulls first) - 1)::bigint as code from part")
add("j3_group_share", lambda s, d: sorting.group_share(_orders(s, d), "o_custkey").select("n_distinct", F.round("largest_share", 9).alias("largest_share")), "select count(o_custkey) as n_distinct, round(max(n) / sum(n), 9)::double as largest_share from (select o_custkey, count(*) as n from orders group by 1)")
add("j4_sample_rows", lambda s, d: sample_rows(_orders(s, d), 100, "pos"), f"select * from {_ORD} order by md5('1:' || pos), pos limit 100")


def _column_file(spark: SparkSession, sf: str) -> DataFrame:
    """Keys written as column files, a file a partition, and read back."""
    columnfile.register(spark)
    rows = _orders(spark, sf).select("pos", F.col("o_custkey").alias("k0"), F.floor("o_totalprice").alias("k1"))
    path = folder(spark, "column-file")
    rows.repartitionByRange("pos").write.format("columnfile").mode("append").option("path", path).save()
    return spark.read.format("columnfile").option("path", path).load()


add("j5_column_file", _column_file, f"select pos, o_custkey as k0, floor(o_totalprice)::bigint as k1 from {_ORD}")

# ---- measurement analytics: scenario = event_type, plan = user_id % 4, cost = value + 1
_R = lambda c, name=None: F.round(c, 6).alias(name or c)


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("scenario"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("plan"), (F.col("value") + 1).alias("cost"), F.col("event_id").alias("round"))


_SAMPLES = "(select event_type as scenario, 'p' || (user_id % 4) as plan, value + 1 as cost, event_id as round from events)"


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).groupBy("scenario", "plan").agg(F.round(F.median("cost"), 6).alias("cost"))


_COSTS = f"(select scenario, plan, round(median(cost), 6) as cost from {_SAMPLES} group by all)"


def _expected(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("scenario_id"), F.floor(F.col("event_id") / 7).alias("paired_block"))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("scenario_id"), F.floor(F.col("event_id") / 6).alias("paired_block"), F.when(F.col("event_id") % 97 == 3, "failed").otherwise("ok").alias("status"))


add("m1_validate", lambda s, d: measurements.validate(_expected(s, d), _observed(s, d), ["scenario_id", "paired_block"]), """with e as (select 's' || (event_id % 4) as scenario_id, event_id // 7 as paired_block from events), o as (select 's' || (event_id % 5) as scenario_id, event_id // 6 as paired_block, case when event_id % 97 = 3 then 'failed' else 'ok' end as status from events)
 select scenario_id, paired_block, 'missing' as kind from e anti join o using (scenario_id, paired_block)
 union all select distinct scenario_id, paired_block, 'foreign' from o anti join e using (scenario_id, paired_block)
 union all select scenario_id, paired_block, 'duplicate' from o group by all having count(*) > 1
 union all select distinct scenario_id, paired_block, 'failed' from o where status <> 'ok'""")
_STATS = ("median", "min", "max", "p05", "p95", "mad", "relative_mad")
add("m2_reduce_cells", lambda s, d: measurements.reduce_cells(_samples(s, d), ["scenario", "plan"], "cost").select("scenario", "plan", "n", *[_R(c) for c in _STATS]),
    f"select scenario, plan, count(*) as n, round(median(cost), 6) as median, round(min(cost), 6) as min, round(max(cost), 6) as max, round(quantile_cont(cost, 0.05), 6) as p05, round(quantile_cont(cost, 0.95), 6) as p95, round(mad(cost), 6) as mad, round(mad(cost) / median(cost), 6) as relative_mad from {_SAMPLES} group by all")
add("m2_inconsistent", lambda s, d: measurements.inconsistent(table(s, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]),
    "select * from (select l_orderkey, min(l_returnflag) <> max(l_returnflag) as l_returnflag, min(l_linestatus) <> max(l_linestatus) as l_linestatus from lineitem group by 1) where l_returnflag or l_linestatus")
add("m3_choose", lambda s, d: measurements.choose(_costs(s, d), "scenario", "plan", "cost").select("scenario", "winner", "best", "runner_up", _R("margin")),
    f"""with c as {_COSTS}, b as (select scenario, min(cost) as best from c group by 1), w as (select c.scenario, min(plan) as winner, any_value(best) as best from c join b using (scenario) where cost <= best * 1.005 group by 1),
    r as (select c.scenario, min({{'c': cost, 'p': plan}}) as x from c join w using (scenario) where plan <> winner group by 1) select w.scenario, winner, best, r.x.p as runner_up, round(r.x.c / best - 1, 6) as margin from w left join r using (scenario)""")  # fmt: skip
add("m3_fixed_plan_regrets", lambda s, d: measurements.fixed_plan_regrets(_costs(s, d), "scenario", "plan", "cost").select("plan", "scenarios", _R("mean_regret"), _R("max_regret"), _R("p95_regret")),
    f"with c as {_COSTS}, r as (select plan, cost / min(cost) over (partition by scenario) - 1 as regret from c) select plan, count(*) as scenarios, round(avg(regret), 6) as mean_regret, round(max(regret), 6) as max_regret, round(quantile_disc(regret, 0.95), 6) as p95_regret from r group by 1")


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(27).select(F.lit("p").alias("plan"), (F.col("id") % 3 * 100).cast("double").alias("rows"), (F.floor(F.col("id") / 3) % 3 * 10).cast("double").alias("batch"), (F.floor(F.col("id") / 9) * 0.5).alias("sel"), (F.col("id") * F.col("id") * 1.0).alias("cost"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(e.alias("point_id"), F.lit("p").alias("plan"), (e % 230).cast("double").alias("rows"), (e % 21).cast("double").alias("batch"), (e % 11 / 10).alias("sel"))


_W = lambda x, g, step: f"greatest(0, 1 - abs({x} - {g}) / {step})"
add("m4_interpolate", lambda s, d: measurements.interpolate(_points(s, d), _grid(s), ["rows", "batch", "sel"], ["plan"], "cost").select("point_id", _R("cost")),
    f"""with g as (select (id % 3 * 100)::double as r, (id // 3 % 3 * 10)::double as b, id // 9 * 0.5::double as s, (id * id)::double as cost from range(27) t(id)),
    p as (select event_id as point_id, (event_id % 230)::double as r, (event_id % 21)::double as b, event_id % 11 / 10 as s from events)
    select point_id, case when max(p.r) <= 200 then round(sum({_W('p.r', 'g.r', 100)} * {_W('p.b', 'g.b', 10)} * {_W('p.s', 'g.s', 0.5)} * cost), 6) end as cost from p, g group by 1""")  # fmt: skip
add("m5_regrets", lambda s, d: measurements.regrets(_costs(s, d), _costs(s, d).groupBy("scenario").agg(F.max("plan").alias("plan")), "scenario", "plan", "cost").select("scenario", "plan", _R("regret")),
    f"with c as {_COSTS}, k as (select scenario, max(plan) as plan from c group by 1) select k.scenario, k.plan, round(c.cost / b.best - 1, 6) as regret from k join c using (scenario, plan) join (select scenario, min(cost) as best from c group by 1) b on b.scenario = k.scenario")
add("m6_scenario_matrix", lambda s, d: measurements.scenario_matrix([s.range(3).toDF("a"), s.range(4).toDF("b"), s.range(2).select((F.col("id") % 1).alias("c"))], ["a", "b", "c"]).select("a", "b", "c"), "select distinct a, b, c % 1 as c from range(3) t(a), range(4) u(b), range(2) v(c)")


def _rounds(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    factor = F.when(F.col("c") == 0, 1.0).when(F.col("c") == 1, 0.7).when(F.col("c") == 2, F.when(e % 3 == 0, 0.6).otherwise(1.2)).otherwise(0.8)
    rows = table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"))
    return rows.select((e % 4).alias("set_id"), F.floor(e / 4 % 3).alias("scenario"), F.when(F.col("c") == 0, "default").otherwise(F.concat(F.lit("c"), F.col("c").cast("string"))).alias("candidate"), F.floor(e / 12).alias("round"), ((100 + e % 7) * factor).alias("cost"))


add("m7_dominant", lambda s, d: measurements.dominant(_rounds(s, d)).select("set_id", "selected", "status", _R("improvement")),
    """with r as (select event_id % 4 as set_id, event_id // 4 % 3 as scenario, case c when 0 then 'default' else 'c' || c end as candidate, event_id // 12 as round, (100 + event_id % 7) * case c when 0 then 1.0 when 1 then 0.7 when 2 then case when event_id % 3 = 0 then 0.6 else 1.2 end else 0.8 end::double as cost from events, range(4) t(c)),
    g as (select a.set_id, a.scenario, a.candidate, (b.cost - a.cost) / b.cost as gain from r a join r b on a.set_id = b.set_id and a.scenario = b.scenario and a.round = b.round where b.candidate = 'default' and a.candidate <> 'default'),
    s as (select set_id, candidate, scenario, median(gain) as med, mad(gain) as dev, count(*) as n, count_if(gain > 0) as wins from g group by all),
    w as (select set_id, candidate, bool_and(n >= 3 and 3 * wins >= 2 * n and med >= 0.05 and dev <= greatest(0.02, 0.75 * med)) as ok, min(med) as least from s group by all),
    b as (select set_id, min({'l': -least, 'c': candidate}) as x from w where ok and least > 0 group by 1)
    select t.set_id, coalesce(x.c, 'default') as selected, case when x is null then 'inconclusive' else 'dominant' end as status, round(coalesce(-x.l, 0), 6) as improvement from (select distinct set_id from r) t left join b using (set_id)""")  # fmt: skip
add("m8_explore", lambda s, d: measurements.explore(_samples(s, d), ["scenario"], "plan", ["p0", "p1", "p2", "p3"], "cost").select("scenario", *[_R(f"p{i}") for i in range(4)]), "select scenario, " + ", ".join(f"round(median(cost) filter (plan = 'p{i}'), 6) as p{i}" for i in range(4)) + f" from {_SAMPLES} group by 1")
add("m8_top", lambda s, d: measurements.top(_samples(s, d), 10, "cost", "round").select("round", _R("cost")), f"select round, round(cost, 6) as cost from {_SAMPLES} order by cost, round limit 10")
add("m8_ratio", lambda s, d: measurements.ratio(_samples(s, d), ["scenario"], "plan", "p0", "p1", "cost").select("scenario", _R("first"), _R("second"), _R("ratio")),
    f"select scenario, round(a, 6) as first, round(b, 6) as second, round(a / b, 6) as ratio from (select scenario, median(cost) filter (plan = 'p0') as a, median(cost) filter (plan = 'p1') as b from {_SAMPLES} group by 1) where a is not null and b is not null")
add("m8_scaling", lambda s, d: measurements.scaling(_samples(s, d).withColumn("workers", F.col("round") % 4 + 1), ["scenario"], "workers", "cost").select("scenario", "workers", _R("median"), _R("speedup"), _R("efficiency")),
    f"with c as (select scenario, round % 4 + 1 as workers, median(cost) as m from {_SAMPLES} group by all) select c.scenario, c.workers, round(c.m, 6) as median, round(b.m / c.m, 6) as speedup, round(b.m / c.m / c.workers, 6) as efficiency from c left join c b on b.scenario = c.scenario and b.workers = 1")
add("m8_distinct", lambda s, d: measurements.distinct_values(_samples(s, d), ["scenario"], ["plan", "round"]), f"select scenario, count(distinct plan) as plan, count(distinct round) as round from {_SAMPLES} group by 1")

# ---- datasets
_D = ["o_orderstatus", "o_custkey", "o_orderpriority"]


_LOWS = tuple(zip((0, *datasets.GROUP_BOUNDS), datasets.GROUP_BOUNDS, strict=False))


def _describe_sql(source: str, columns: list[str]) -> str:
    hist = ", ".join(f"count_if(n > {a} and n <= {b})::bigint as groups_to_{b}" for a, b in _LOWS)
    parts = [f"select {j} as prefix, count(*) as distinct_prefixes, coalesce(sum(n) filter (n > 1), 0)::bigint as tied_rows, max(n) as max_group, count_if(n > 1)::bigint as nontrivial_groups, {hist} from (select count(*) as n from {source} group by {', '.join(columns[:j])})" for j in range(1, len(columns) + 1)]
    return " union all ".join(parts)


def _closed_sql(groups: list[tuple[int, int]]) -> str:
    """The description of groups of equal sizes: (size, number) for each prefix."""
    return " union all ".join(
        f"select {j} as prefix, {k}::bigint as distinct_prefixes, {size * k if size > 1 else 0}::bigint as tied_rows, {size}::bigint as max_group, {k if size > 1 else 0}::bigint as nontrivial_groups, "
        + ", ".join(f"{k if a < size <= b else 0}::bigint as groups_to_{b}" for a, b in _LOWS)
        for j, (size, k) in enumerate(groups, 1)
    )


add("d4_describe", lambda s, d: datasets.describe(table(s, d, "orders"), _D), _describe_sql("orders", _D))
add("d4_in_order", lambda s, d: datasets.in_order_fraction(_orders(s, d), ["o_custkey"]).select(F.round("in_order", 9).alias("in_order"), "ascending_runs"), "with x as (select o_custkey <= lead(o_custkey) over (order by o_orderkey) as up from orders) select round(avg(up::int), 9) as in_order, count_if(not up)::bigint + 1 as ascending_runs from x")
add("d4_inversions", lambda s, d: datasets.inversions(table(s, d, "customer").select(F.col("c_custkey").alias("pos"), F.floor("c_acctbal").cast("bigint").alias("r")), "r"), "select count(*) as inversions from customer a, customer b where a.c_custkey < b.c_custkey and floor(a.c_acctbal) > floor(b.c_acctbal)")
add("d4_sort_work", lambda s, d: datasets.sort_work(table(s, d, "orders"), _D).select(F.round("weighted_work", 2).alias("weighted_work"), "scan_volume", F.round("duplicate_share", 9).alias("duplicate_share")),
    "with " + ", ".join(f"g{j} as (select sum(case when n > 1 then n else 0 end)::bigint as tied, sum(case when n > 1 then n * log2(n) else 0 end) as work from (select count(*) as n from orders{' group by ' + ', '.join(_D[:j]) if j else ''}))" for j in range(len(_D) + 1))
    + " select round(" + " + ".join(f"{len(_D) - j} * g{j}.work" for j in range(len(_D))) + ", 2) as weighted_work, " + " + ".join(f"g{j}.tied" for j in range(len(_D) - 1)) + f" as scan_volume, round(g{len(_D)}.tied / (select count(*) from orders), 9) as duplicate_share from " + ", ".join(f"g{j}" for j in range(len(_D) + 1)))
add("d4_order_measures", lambda s, d: datasets.order_measures(_orders(s, d), ["o_orderstatus", "o_custkey"]).select(F.round("displacement", 6).alias("displacement"), F.round("adjacency", 9).alias("adjacency")),
    f"with p as (select pos, row_number() over (order by o_orderstatus nulls first, o_custkey nulls first, pos) - 1 as o from {_ORD}) select round((select avg(abs(o - pos)) from p), 6) as displacement, round((select count(*) from p a join p b on b.pos = a.pos + 1 and b.o = a.o + 1) / greatest((select count(*) from p) - 1, 1), 9) as adjacency")
_N, _SEED, _PRIME = 4096, 17, (1 << 31) - 1


def _sql_hash(column: int, pos: str = "pos", seed: int = _SEED) -> str:
    """Two halves of 31 bits; fixed values as the generator states them."""
    half = lambda x, d: f"(xor({x}, ({x}) >> 15) * {d}::bigint % {_PRIME})"
    mixed = [f"((({pos}) % {_PRIME} * {a * pow(48_271, column, _PRIME) % _PRIME}::bigint + ({pos}) // {_PRIME} * {b} + {(seed * 1_000_003 + column * 7919 + k * 104_729 + 12_345) % _PRIME}) % {_PRIME})" for k, (a, b) in enumerate(((1103515245, 69069), (1812433253, 22695477)))]
    return f"({half(mixed[0], 1597334677)} * 2147483648::bigint + {half(mixed[1], 747796405)})"


def _below(column: int, n: int, pos: str = "pos") -> str:
    return f"{_sql_hash(column, pos)} % {n}"


_PLACE = f"(pos * 2531 + {_SEED}) % {_N}"
_UNIQUE = [(1, _N)] * 3
_DEEP = [_below(1, 1024), _below(2, 1024)]
_FIRST = f"({_below(0, 4096)})"
#: closed descriptions, or the three columns in SQL
_SHAPES_SQL: dict[str, list] = {
    "unique_first": _UNIQUE, "unique_last": [(64, 64), (64, 64), (1, _N)], "balanced_hierarchy": [(256, 16), (16, 256), (1, _N)], "all_equal_prefix": [(_N, 1), (_N, 1), (1, _N)],
    "reverse_sorted": _UNIQUE, "permutation_local": _UNIQUE, "permutation_blocked": _UNIQUE, "permutation_random": _UNIQUE,
    "independent_uniform": [_below(0, 1024), *_DEEP], "low_cardinality": [_below(j, 4) for j in range(3)],
    "skewed_zipf": [f"least(floor(exp({_sql_hash(0)}::double * pow(2::double, -62) * ln(1025::double)))::bigint - 1, 1023)", _below(1, 64), _below(2, 64)],
    "heavy_hitter": [f"case when {_PLACE} < 3686 then 0 else 1 + {_below(0, _N)} end", _below(1, _N), _below(2, _N)],
    "correlated_forward": [_FIRST, f"{_FIRST} // 2", f"{_FIRST} // 4"], "correlated_reverse": [f"{_FIRST} // 4", f"{_FIRST} // 2", _FIRST],
    "correlated_noisy": [_FIRST, *(f"case when {_sql_hash(50 + j)}::double * pow(2::double, -62) < 0.1 then {_below(j, 4096)} else {_FIRST} // {1 << j} end" for j in (1, 2))],
    "prefix_presorted": [f"pos * 16 // {_N}", *_DEEP], "clustered_runs": [_below(0, 1 << 20, "pos // 64"), *_DEEP], "organ_pipe": [f"least(pos, {_N - 1} - pos)", *_DEEP], "sawtooth": ["pos % 1024", *_DEEP],
    "duplicates_at_pivot": [f"case when {_PLACE} < 2048 then 2048 else {_below(0, _N)} end", *_DEEP],
    "extreme_values": [f"case {_below(0, 64)} when 0 then 0 when 1 then 4294967295 else {_below(1, 1 << 32)} end", *_DEEP],
    "tpcds_q67": [_below(0, 10), _below(1, 99), _below(2, 710)],
}
for _shape, _made in _SHAPES_SQL.items():
    _columns_sql = f"(select {', '.join(f'{c} as k{i}' for i, c in enumerate(_made))} from range({_N}) t(pos))"
    add(f"d1_{_shape}", lambda s, d, x=_shape: datasets.describe(datasets.generate(s, x, _N, 3, _SEED), ["k0", "k1", "k2"]), _closed_sql(_made) if isinstance(_made[0], tuple) else _describe_sql(_columns_sql, ["k0", "k1", "k2"]))

_size = lambda s, d: table(s, d, "orders").count()
_T = "(select count(*) as t from orders)"
add("d2_split_balanced", lambda s, d: datasets.split_sizes(s, _size(s, d), "balanced", 64), f"select i as part, t // 64 + (i < t % 64)::bigint as size from {_T}, range(64) r(i)")
add("d2_split_fixed", lambda s, d: datasets.split_sizes(s, _size(s, d), "fixed", group=64), f"select i as part, least(64, t - i * 64)::bigint as size from (select t, unnest(range((t + 63) // 64)) as i from {_T})")
add("d2_split_multiple", lambda s, d: datasets.split_sizes(s, _size(s, d), "multiple", 16, 8), f"select i as part, (t // 8 // 16 + (i < t // 8 % 16)::bigint) * 8 + case when i = 15 then t % 8 else 0 end as size from {_T}, range(16) r(i)")
add("d2_split_zipf", lambda s, d: datasets.split_sizes(s, _size(s, d), "zipf", 16), f"with w as (select i, 1 / (i + 1)::double as w from range(16) r(i)), c as (select i, floor(t * (select sum(x.w) from w x where x.i <= y.i) / (select sum(w) from w) + 0.5)::bigint as mark from w y, {_T}) select i as part, mark - coalesce(lag(mark) over (order by i), 0) as size from c")
add("d3_shuffle_rows", lambda s, d: datasets.shuffle_rows(_orders(s, d), 64).select("pos", "new_pos"), f"select pos, pos // 64 * 64 + row_number() over (partition by pos // 64 order by {_sql_hash(0, 'pos', 1)}, pos) - 1 as new_pos from {_ORD}")
_W64 = f"{1 << 64}::uhugeint"
add("d5_splitmix64", lambda s, d: _orders(s, d).select("pos", datasets.splitmix64(F.col("pos")).alias("h")),
    f"""with a as (select pos, ((pos::uhugeint + {0x9E3779B97F4A7C15}::uhugeint) % {_W64})::ubigint as z from {_ORD}), b as (select pos, ((xor(z, z >> 30)::uhugeint * {0xBF58476D1CE4E5B9}::uhugeint) % {_W64})::ubigint as z from a),
    c as (select pos, ((xor(z, z >> 27)::uhugeint * {0x94D049BB133111EB}::uhugeint) % {_W64})::ubigint as z from b), e as (select pos, xor(z, z >> 31) as z from c) select pos, (z::hugeint - case when z >= {1 << 63}::ubigint then {1 << 64}::hugeint else 0::hugeint end)::bigint as h from e""")  # fmt: skip
add("d6_filter_sum_rows", lambda s, d: datasets.filter_sum_rows(s, 10_000, 0.3, 0.5).agg(F.count_if(F.col("a") < 0).alias("after_a"), F.count_if((F.col("a") < 0) & (F.col("b") > 0)).alias("after_b")), "select 3000::bigint as after_a, 1500::bigint as after_b")
_touched = lambda s, layout, first: datasets.filter_sum_rows(s, 10_000, first, 0.5, layout=layout).where("a < 0").agg(F.count("*").alias("after_a"), F.count_if(F.col("b") > 0).alias("after_b"), F.countDistinct(F.floor(F.col("pos") / 64)).alias("clusters"), F.count_if(F.col("pos") % 2 == 1).alias("odd"))
add("d7_clustered_rows", lambda s, d: _touched(s, "clustered", 0.1), "select 1000::bigint as after_a, 500::bigint as after_b, 16::bigint as clusters, 500::bigint as odd")
add("d7_alternating_rows", lambda s, d: _touched(s, "alternating", 0.6), "select 6000::bigint as after_a, 3000::bigint as after_b, 157::bigint as clusters, 1000::bigint as odd")


# ---- catalogue: parts as candidates of a brand, types as names
def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") % 3).alias("distance"), (F.col("p_size") % 5).alias("specificity"), (F.col("p_partkey") % 4).alias("flags"), (F.col("p_partkey") % 6).alias("caps"))


add("k1_catalog", lambda s, d: catalog.functions_catalog(s))
add("k2_select_candidates", lambda s, d: catalog.select_candidates(_candidates(s, d), ["p_brand"], "distance", "specificity", "flags", "caps", "p_partkey").select("p_brand", "p_partkey"), "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size % 3, p_size % 5, p_partkey % 4 desc, p_partkey % 6 desc, p_partkey) as n from part) where n = 1")


def _nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"))
    edges = nodes.where("name % 3 <> 0").select("name", (F.col("name") + F.when(F.col("name") % 2 == 0, 1).otherwise(5)).alias("needs"))
    return nodes, edges


add("k3_resolvable", lambda s, d: catalog.resolvable(*_nodes(s, d)), """with recursive e as (select n_nationkey as name, n_nationkey + case when n_nationkey % 2 = 0 then 1 else 5 end as needs from nation where n_nationkey % 3 <> 0),
    bad as (select name from e where needs not in (select n_nationkey from nation) union select e.name from e join bad on e.needs = bad.name) select n_nationkey as name from nation where n_nationkey not in (select name from bad)""")
add("k4_ancestors", lambda s, d: catalog.ancestors(table(s, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("name"), F.floor((F.col("n_nationkey") - 1) / 2).cast("int").alias("parent"))), """with recursive c as (select n_nationkey as name, (n_nationkey - 1) // 2 as ancestor, 1 as distance from nation where n_nationkey > 0
    union all select c.name, (c.ancestor - 1) // 2, distance + 1 from c where c.ancestor > 0) select name, ancestor, min(distance) as distance from c group by all""")
add("k5_coverage", lambda s, d: catalog.coverage(table(s, d, "part").withColumn("c", F.col("p_size") > 25), "p_brand", "c").select("p_brand", "total", "covered", _R("share")), "select p_brand, count(*) as total, count_if(p_size > 25)::bigint as covered, round(avg((p_size > 25)::int), 6) as share from part group by 1")
