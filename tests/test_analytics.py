"""Measurements and shapes against plain Python, with nulls and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.analytics import datasets, measurements


@pytest.mark.parametrize("layout", ["random", "clustered", "alternating"])
@pytest.mark.parametrize("rows", [1, 63, 64, 1003])
def test_layouts_are_bijections(spark, layout, rows):
    got = spark.range(rows).select(datasets._place(F.col("id"), rows, layout, 17).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(rows))
    made = datasets.filter_sum_rows(spark, rows, 0.3, 0.5, layout=layout)
    k = round(rows * 0.3)
    assert (made.where("a < 0").count(), made.where("a < 0 and b > 0").count()) == (k, round(k * 0.5))


def test_inconsistent_cells(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), ("b", 1, "x"), ("c", None, None), ("c", None, None), ("d", 1, "x"), ("d", 2, "x")]
    samples = spark.createDataFrame(rows, "cell string, sum int, digest string")
    got = {tuple(r) for r in measurements.inconsistent(samples, ["cell"], ["sum", "digest"]).collect()}
    assert got == {("b", False, True), ("d", True, False)}
    assert measurements.inconsistent(samples.limit(0), ["cell"], ["sum", "digest"]).isEmpty()


def test_sort_work(spark):
    keys = [(0, 0), (0, 0), (0, 1), (1, 5), (1, 6)]
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "a int, b int, pos long")
    row = datasets.sort_work(df, ["a", "b"]).first()
    assert row.weighted_work == pytest.approx(2 * 5 * math.log2(5) + 3 * math.log2(3) + 2)
    assert (row.scan_volume, row.duplicate_share) == (5, 0.4)
    assert tuple(datasets.sort_work(df.limit(0), ["a", "b"]).first()) == (0.0, 0, 0.0)


def test_order_measures(spark):
    df = spark.createDataFrame([(2, 0), (1, 1), (1, 2), (None, 3)], "a int, pos long")
    row = datasets.order_measures(df, ["a"]).first()  # places 3, 1, 2, 0
    assert (row.displacement, row.adjacency) == (1.5, pytest.approx(1 / 3))
    assert tuple(datasets.order_measures(df.limit(0), ["a"]).first()) == (0.0, 0.0)


@pytest.mark.parametrize("rows", [0, 1, 2, 300, 3000])
def test_inversions(spark, rows):
    ranks = [None if i % 41 == 7 else i * 7919 % 1009 if i % 3 else i // 2 for i in range(rows)]
    df = spark.createDataFrame(list(enumerate(ranks)), "pos long, r long")
    key = np.array([-1 if r is None else r for r in ranks], np.int64)
    assert datasets.inversions(df, "r").first()[0] == sum(int((key[: i] > key[i]).sum()) for i in range(rows))


def test_ratio_and_scaling(spark):
    rows = [("s", 1, 8.0), ("s", 2, 4.0), ("s", 4, 4.0), ("t", 2, 1.0)]
    df = spark.createDataFrame(rows, "shape string, workers int, cost double")
    got = {(r.shape, r.workers): (r.speedup, r.efficiency) for r in measurements.scaling(df, ["shape"], "workers", "cost").collect()}
    assert got == {("s", 1): (1.0, 1.0), ("s", 2): (2.0, 1.0), ("s", 4): (2.0, 0.5), ("t", 2): (None, None)}
    plans = df.withColumn("plan", F.concat(F.lit("w"), F.col("workers").cast("string")))
    assert [tuple(r) for r in measurements.ratio(plans, ["shape"], "plan", "w1", "w2", "cost").collect()] == [("s", 8.0, 4.0, 2.0)]
    assert {tuple(r) for r in measurements.distinct_values(df, ["shape"], ["workers", "cost"]).collect()} == {("s", 3, 2), ("t", 1, 1)}
