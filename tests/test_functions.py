"""Golden lanes and edge cases of the lane functions."""

import math

import pytest
from pyspark.sql import functions as F

import lamina.functions as fn
from lamina.operators import algo, positional, sorting
from lamina.types import TAGS, lit


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_add_wraps_si32(spark):
    a = [2147483647, -2147483648, 2147483647, -2147483648, 1073741824, -1073741824, 1, -1]
    b = [1, -1, 2147483647, -2147483648, 1073741824, -1073741824, -2, 2]
    assert list(one(spark, *(fn.add(lit(x, "si32"), lit(y, "si32"), "si32") for x, y in zip(a, b, strict=True)))) == [-2147483648, 2147483647, -2, 0, -2147483648, -2147483648, -1, 1]


@pytest.mark.parametrize("tag", ["si8", "si64", "ui64", "ui32"])
def test_arithmetic_against_python(spark, tag):
    t = TAGS[tag]
    values = [t.low, t.high, 0, 1, t.high - 1, t.high // 3]

    def wrapped(x):
        x %= 1 << t.bits
        return x - (1 << t.bits) if t.signed and x > t.high else x

    pairs = [(a, b) for a in values for b in values]
    got = one(spark, *(f(lit(str(a), tag), lit(str(b), tag), tag) for a, b in pairs for f in (fn.add, fn.sub, fn.mul)))
    want = [wrapped(x) for a, b in pairs for x in (a + b, a - b, a * b)]
    assert [int(x) for x in got] == want


def test_least_value_by_minus_one_and_zero_divisor(spark):
    got = one(spark, fn.div(lit(-128, "si8"), lit(-1, "si8"), "si8"), fn.mod(lit(-128, "si8"), lit(-1, "si8"), "si8"), fn.div(lit(-7, "si32"), lit(2, "si32"), "si32"), fn.mod(lit(-7, "si32"), lit(3, "si32"), "si32"), fn.abs_(lit(-128, "si8"), "si8"))
    assert list(got) == [-128, 0, -3, -1, -128]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, fn.div(F.col("id").cast("int"), F.col("id").cast("int"), "si32"))
    with pytest.raises(ValueError, match="zero_divisor"):
        fn.mod_imm(F.lit(1), 0, "si32")


def test_float_division_and_comparison(spark):
    nan, inf = lit("NaN", "f64"), lit("Infinity", "f64")
    zero, one_ = lit(0.0, "f64"), lit(1.0, "f64")
    got = one(spark, fn.div(one_, zero, "f64"), fn.div(-one_, zero, "f64"), fn.div(zero, zero, "f64"), fn.equal(nan, nan, "f64"), fn.nequal(nan, nan, "f64"), fn.greater_than(nan, inf, "f64"), fn.max_(one_, nan, "f64"), fn.min_(nan, one_, "f64"))
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2])
    assert list(got)[3:6] == [False, True, False] and got[6] == 1.0 and math.isnan(got[7])


def test_casts_go_toward_zero_and_wrap(spark):
    got = one(spark, fn.cast(lit(1.9, "f64"), "f64", "si32"), fn.cast(lit(-1.9, "f64"), "f64", "si32"), fn.cast(lit(300, "si32"), "si32", "ui8"), fn.cast(lit(200, "ui8"), "ui8", "si8"), fn.reinterpret(lit(1.0, "f32"), "f32", "ui32"), fn.reinterpret(lit(1065353216, "ui32"), "ui32", "f32"))
    assert list(got) == [1, -1, 44, -56, 1065353216, 1.0]


def test_shifts_beyond_the_width(spark):
    x = lit(-2, "si8")
    assert list(one(spark, fn.shift_left(x, 8, "si8"), fn.shift_right(x, 9, "si8"), fn.shift_right(lit(254, "ui8"), 9, "ui8"), fn.shift_left_wrapping(x, 9, "si8"), fn.shift_right(x, 1, "si8", preserve_sign=False))) == [0, -1, 0, -4, 127]


def test_bit_counts(spark):
    assert list(one(spark, fn.popcnt(lit(-1, "si8"), "si8"), fn.lzc(lit(1, "ui8"), "ui8"), fn.lzc(lit(0, "si16"), "si16"), fn.tzc(F.lit(8).cast("bigint"), 16), fn.tzc(F.lit(0).cast("bigint"), 16))) == [8, 7, 16, 3, 16]


def test_blend_add_keeps_left_where_active(spark):
    assert list(one(spark, *(fn.blend_add(F.lit(m), lit(1, "si8"), lit(100, "si8"), lit(100, "si8"), "si8") for m in (True, False)))) == [1, -56]


def test_conflict_and_expand(spark):
    a = F.array(*map(F.lit, [5, 7, 5, 7, 5]))
    m = F.array(*map(F.lit, [True, False, True, True, False]))
    got = one(spark, fn.conflict(a, "si32"), fn.conflict_free(m, a, "si32"), fn.compress(m, a, "si32"), fn.expand(m, a, F.array(*map(F.lit, [1, 2, 3, 4, 5]))))
    assert [list(got[0]), got[1], list(got[2]), list(got[3])] == [[0, 0, 1, 2, 5], 1, [5, 5, 7, 0, 0], [1, 7, 2, 3, 5]]


def test_runtime_index_is_checked(spark):
    with pytest.raises(Exception, match="index_out_of_bounds"):
        one(spark, fn.extract_value_at(F.array(F.lit(1)), F.lit(3)))


def test_empty_reductions_are_zero(spark):
    row = spark.range(0).select(F.col("id")).agg(fn.hadd(F.col("id"), "si64").alias("a"), fn.hmax(F.col("id"), "si64").alias("b"), fn.hand(F.col("id"), "si64").alias("c")).first()
    assert list(row) == [0, 0, 0]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 15, 16, 1003])
def test_whole_column_operators_at_boundary_lengths(spark, n):
    df = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % 5).alias("v"), (F.col("id") % 3 == 0).alias("m"))
    test = lambda v: v > 2
    want = [i for i in range(n) if i % 5 > 2]
    assert algo.count(df, test, "v").first()[0] == len(want)
    assert sorted(r[0] for r in algo.select_indices(df, test, "v").collect()) == want
    assert sorted(r[0] for r in algo.select_indices(df, test, "v", "m").collect()) == [i for i in want if i % 3 == 0]
    assert algo.chunk_count(df, "bits").first()[0] == -(-n // 8)
    packed = positional.compress_store(df, "m")
    assert sorted(r.pos for r in packed.collect()) == list(range(len(range(0, n, 3))))


def test_streams_keep_order_and_repeats(spark):
    df = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") * 10).alias("v"))
    ids = spark.createDataFrame([(0, 7), (1, 2), (2, 7)], "ord long, row_id long")
    assert [tuple(r) for r in algo.refine_indices(df, lambda v: v > 30, "v", ids).orderBy("ord").collect()] == [(0, 7), (2, 7)]
    assert algo.aggregate(df, lambda v: F.sum(v), "v", ids=ids).first()[0] == 160
    with pytest.raises(algo.CheckedError):
        algo.refine_indices(df, lambda v: v > 30, "v", ids.union(spark.createDataFrame([(3, 99)], ids.schema)), checked=True)


def test_scatter_last_wins(spark):
    base = spark.range(3).select(F.col("id").alias("pos"), F.lit(0).cast("long").alias("v"))
    writes = spark.createDataFrame([(0, 1, 5), (1, 1, 6)], "ord long, row_id long, v long")
    assert {r.pos: r.v for r in positional.scatter(base, writes, "v").collect()} == {0: 0, 1: 6, 2: 0}


def test_lexicographic_example(spark):
    rows = [(0, 2, 1, 7), (1, 1, 3, 9), (2, 1, 3, 4), (3, 1, 2, 8), (4, 2, 1, 5), (5, 1, 2, 6)]
    df = spark.createDataFrame(rows, "pos long, a int, b int, c int")
    order = [r.row_id for r in sorting.sort_index(df, ["a", "b", "c"], [False, True, False]).orderBy("ord").collect()]
    assert order == [2, 1, 5, 3, 4, 0]
    assert sorted((r.begin, r.end) for r in sorting.sorted_runs(df, ["a"]).collect()) == [(0, 4), (4, 6)]


@pytest.mark.parametrize("block", [2, 3, 100])
def test_equal_runs_across_blocks(spark, block):
    values = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v int")
    assert sorted((r.begin, r.end) for r in sorting.equal_runs(df, "v", block=block).collect()) == [(0, 2), (3, 8), (9, 11)]
