"""The filter and sum over a stream of rows: a running total a batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_filter_sum(stream: DataFrame, test: Column, value: Column) -> DataFrame:
    """Complete-mode aggregate of a stream: total and rows of what passes the test."""
    return stream.where(test).agg(F.coalesce(F.sum(value.cast("bigint")), F.lit(0)).alias("total"), F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Rows a key and time window; windows close after `late`."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
