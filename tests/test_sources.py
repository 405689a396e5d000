import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.analytics import datasets
from lamina.operators import positional, sorting
from lamina.sources import columnfile


@pytest.mark.parametrize("width", [4, 8])
def test_column_file_round_trip(spark, tmp_path, width):
    columnfile.register(spark)
    df = datasets.generate(spark, "independent_uniform", 1000, 3)
    df.repartitionByRange(3, "pos").write.format("columnfile").mode("append").option("path", str(tmp_path / "x")).option("element_bytes", width).save()
    back = spark.read.format("columnfile").option("path", str(tmp_path / "x")).load()
    assert sorted(map(tuple, df.collect())) == sorted((r[0], *map(int, r[1:])) for r in back.collect())


def test_bad_header_is_refused(tmp_path):
    columnfile.write_file(str(tmp_path / "a"), [np.arange(3)])
    (tmp_path / "a").write_bytes((tmp_path / "a").read_bytes()[:-1])
    with pytest.raises(ValueError, match="length"):
        columnfile.read_header(str(tmp_path / "a"))


def test_shapes_have_their_structure(spark):
    first = lambda shape, **o: datasets.describe(datasets.generate(spark, shape, 1024, 3, **o), ["k0"]).first()
    assert first("unique_first").distinct_prefixes == 1024
    assert first("all_equal_prefix").distinct_prefixes == 1
    assert first("unique_last", group=64).max_group == 64
    assert datasets.inversions(datasets.generate(spark, "reverse_sorted", 200, 1), "k0").first()[0] == 199 * 100


def test_hashes(spark):
    assert datasets.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert spark.range(1).select(datasets.splitmix64(F.col("id"))).first()[0] % (1 << 64) == 0xE220A8397B1DCDAF


@pytest.mark.parametrize("kind", ["balanced", "fixed", "multiple", "zipf"])
@pytest.mark.parametrize("total", [0, 1, 1000, 1003])
def test_sizes_sum_to_the_total(spark, kind, total):
    sizes = [r["size"] for r in datasets.split_sizes(spark, total, kind, 16, 8).orderBy("part").collect()]
    assert sum(sizes) == total and min(sizes, default=0) >= 0
    if kind == "multiple":
        assert all(x % 8 == 0 for x in sizes[:-1])


def test_uniform_values_are_spread(spark):
    rows = datasets.generate(spark, "independent_uniform", 1 << 16, 2, cardinality=64).groupBy("k0").agg(F.count("*").alias("n")).collect()
    assert len(rows) == 64 and all(abs(r["n"] - 1024) < 6 * 32 for r in rows)
    assert datasets.generate(spark, "independent_uniform", 1 << 16, 2, cardinality=256).select("k0", "k1").distinct().count() > 40_000  # 41,427 expected


def test_conformance_counts_what_is_wrong(spark):
    rows = spark.createDataFrame([(0, 2, "a"), (1, None, "b"), (2, 1, "c"), (3, 2, "a")], "pos long, k int, s string")
    right = sorting.sort_image(rows, ["k", "s"], [True, False])
    assert [(r["pos"]) for r in right.orderBy("ord").collect()] == [0, 3, 2, 1]
    assert tuple(sorting.conformance(right, rows, ["k", "s"], [True, False]).first()) == (0, 0, 0)
    assert tuple(sorting.conformance(right.withColumn("ord", 3 - F.col("ord")), rows, ["k", "s"], [True, False]).first()) == (0, 0, 2)
    assert tuple(sorting.conformance(right.withColumn("pos", F.when(F.col("pos") == 2, 9).otherwise(F.col("pos"))), rows, ["k"], [True]).first()) == (1, 1, 0)
    empty = rows.where("false")
    assert tuple(sorting.conformance(sorting.sort_image(empty, ["k"]), empty, ["k"]).first()) == (0, 0, 0)


def test_wide_masks_are_stored_lowest_byte_first(spark):
    rows = spark.createDataFrame([(0, [i in (0, 9, 63) for i in range(64)]), (1, [True, False, True])], "chunk long, m array<boolean>")
    got = dict(positional.store_mask(rows, "m", "bits").collect())
    assert bytes(got[0]) == bytes([1, 2, 0, 0, 0, 0, 0, 128]) and bytes(got[1]) == bytes([5])
    assert dict(positional.store_mask(rows, "m").collect()) == {0: (1 | 1 << 9 | 1 << 63) - (1 << 64), 1: 5}
