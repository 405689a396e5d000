"""Whole-column operators: predicate, count, select, transform, aggregate and consume.

Each has forms over one or two columns (give one or two names), under a mask (`mask`, a boolean
column name), and over a stream of row ids (`ids`, a table of `ord` and `row_id`: order and repeats
count). Operators are callables over Columns. The ordinal of a row is the column `pos`.

A selection of rows by id is an equi-join on the ordinal, which Catalyst broadcasts or sorts by
size; the order of a stream is kept in `ord` and given only when rows are written out in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Op = Callable[..., Column]
LAYOUTS = ("integral", "native", "bytes", "bits")


class CheckedError(ValueError):
    """insufficient_input, insufficient_output, index_out_of_bounds, lane_count_mismatch or zero_divisor."""


def _columns(inputs: str | Sequence[str]) -> list[Column]:
    return [F.col(c) for c in ([inputs] if isinstance(inputs, str) else inputs)]


def selected(df: DataFrame, ids: DataFrame, pos: str = "pos", scale: int = 0, width: int = 1) -> DataFrame:
    """The rows that a stream of ids names, with `ord` and `row_id`; scale: ids count in steps of so many bytes of lanes of `width`."""
    at = F.col("row_id") if not scale else (F.col("row_id") * scale / width).cast("bigint")
    stream = ids.select("ord", "row_id", at.alias("_at"))
    return stream.join(df, F.col("_at") == F.col(pos)).drop("_at")


def check_ids(df: DataFrame, ids: DataFrame, pos: str = "pos") -> None:
    """Before anything runs: every id names a row."""
    if not ids.join(df.select(F.col(pos).alias("_pos")), F.col("row_id") == F.col("_pos"), "left_anti").isEmpty():
        raise CheckedError("index_out_of_bounds")


def check_lengths(*frames: DataFrame) -> None:
    """Before anything runs: all columns are as long as the first."""
    n = [f.count() for f in frames]
    if any(k < n[0] for k in n[1:]):
        raise CheckedError("insufficient_input")


# masks and their storage
def predicate(df: DataFrame, op: Op, inputs: str | Sequence[str], out: str = "m") -> DataFrame:
    """df with a mask column; no null: a null test is off."""
    return df.withColumn(out, F.coalesce(op(*_columns(inputs)), F.lit(False)))


def mask_chunk_count(n: int, layout: str, lanes: int) -> int:
    """Storage units of a mask of n rows."""
    return {"bytes": n, "bits": math.ceil(n / 8)}.get(layout, math.ceil(n / lanes))


def integral_mask_chunk_count(n: int, lanes: int) -> int:
    return math.ceil(n / lanes)


native_mask_chunk_count = integral_mask_chunk_count


def byte_mask_count(n: int) -> int:
    return n


def bit_mask_count(n: int) -> int:
    return math.ceil(n / 8)


def chunk_count(df: DataFrame, layout: str = "integral", lanes: int = 8) -> DataFrame:
    """One row, `words`: what a predicate over df writes."""
    n = F.count(F.lit(1))
    return df.agg({"bytes": n, "bits": F.ceil(n / 8)}.get(layout, F.ceil(n / lanes)).cast("bigint").alias("words"))


def pack_mask(df: DataFrame, mask: str = "m", lanes: int = 8, pos: str = "pos") -> DataFrame:
    """chunk, word: lane i of a chunk of `lanes` rows at bit i of a bigint."""
    lane = F.pmod(F.col(pos), F.lit(lanes)).cast("int")
    bit = F.when(F.col(mask), F.call_function("shiftleft", F.lit(1).cast("bigint"), lane)).otherwise(F.lit(0).cast("bigint"))
    return df.groupBy(F.floor(F.col(pos) / lanes).alias("chunk")).agg(F.bit_or(bit).alias("word"))


def unpack_mask(words: DataFrame, lanes: int = 8) -> DataFrame:
    """pos, m of packed words (the last chunk is given whole)."""
    rows = words.select("chunk", "word", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    return rows.select((F.col("chunk") * lanes + F.col("lane")).alias("pos"), (F.getbit("word", F.col("lane")) == 1).alias("m"))


# counts
def count(df: DataFrame, op: Op, inputs: str | Sequence[str], mask: str | None = None, ids: DataFrame | None = None, out: str = "n", pos: str = "pos") -> DataFrame:
    rows = df if ids is None else selected(df, ids, pos)
    test = op(*_columns(inputs))
    return rows.agg(F.count_if(test if mask is None else F.col(mask) & test).alias(out))


# selections
def select(df: DataFrame, op: Op, inputs: str | Sequence[str], mask: str | None = None, out: str = "v", pos: str = "pos") -> DataFrame:
    """pos and the (left) value of the rows where op, and the mask, hold."""
    columns = _columns(inputs)
    test = op(*columns)
    return df.where(test if mask is None else F.col(mask) & test).select(pos, columns[0].alias(out))


def select_indices(df: DataFrame, op: Op, inputs: str | Sequence[str], mask: str | None = None, pos: str = "pos") -> DataFrame:
    test = op(*_columns(inputs))
    return df.where(test if mask is None else F.col(mask) & test).select(F.col(pos).alias("row_id"))


def as_stream(indices: DataFrame) -> DataFrame:
    """row ids in their own order as a stream: the id serves as ord, which only orders."""
    return indices.select(F.col("row_id").alias("ord"), "row_id")


def refine_indices(df: DataFrame, op: Op, inputs: str | Sequence[str], ids: DataFrame, pos: str = "pos", checked: bool = False) -> DataFrame:
    """The ids of a stream whose rows pass op, with their ord: order and repeats stay."""
    if checked:
        check_ids(df, ids, pos)
    return selected(df, ids, pos).where(op(*_columns(inputs))).select("ord", "row_id")


# maps
def transform(df: DataFrame, op: Op, inputs: str | Sequence[str], out: str = "v", ids: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """df with a column; over a stream: ord and the value."""
    if ids is None:
        return df.withColumn(out, op(*_columns(inputs)))
    return selected(df, ids, pos).select("ord", op(*_columns(inputs)).alias(out))


def transform_where(df: DataFrame, op: Op, inputs: str | Sequence[str], mask: str, out: str) -> DataFrame:
    """The column out gets a new value where the mask is on, and stays elsewhere."""
    return df.withColumn(out, F.when(F.col(mask), op(*_columns(inputs))).otherwise(F.col(out)))


def transform_masked(df: DataFrame, op: Op, inputs: str | Sequence[str], mask: str, out: str = "v") -> DataFrame:
    """Every row gets op(mask, ...)."""
    return df.withColumn(out, op(F.col(mask), *_columns(inputs)))


# folds
def aggregate(df: DataFrame, fold: Op, inputs: str | Sequence[str], mask: str | None = None, ids: DataFrame | None = None, finalize: Callable[[Column], Column] = lambda x: x, out: str = "v", pos: str = "pos") -> DataFrame:
    """One row: finalize(fold(columns)); fold is an aggregate over Columns and gets the mask first where one is given."""
    rows = df if ids is None else selected(df, ids, pos)
    columns = _columns(inputs)
    return rows.agg(finalize(fold(*columns) if mask is None else fold(F.col(mask), *columns)).alias(out))


# sinks
def consume(df: DataFrame, op: Callable[[Any], None], inputs: str | Sequence[str], mask: str | None = None, ids: DataFrame | None = None, pos: str = "pos") -> None:
    """op gets each partition's rows of the input columns, for its effects; under a mask, all rows with their mask first."""
    rows = df if ids is None else selected(df, ids, pos)
    rows.select(*([] if mask is None else [F.col(mask)]), *_columns(inputs)).foreachPartition(op)


def for_each_chunk(df: DataFrame, op: Callable[[Any], Any], schema: str, inputs: str | Sequence[str]) -> DataFrame:
    """op maps each Arrow batch of the input columns to a batch of the schema."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield op(batch)

    return df.select(*_columns(inputs)).mapInArrow(run, schema)
