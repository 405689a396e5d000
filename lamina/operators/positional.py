"""Gather, scatter, compress and expand between tables, by the ordinal `pos`.

Ordinals of compressed rows come from two passes: counts a range of rows, then a running number within
the range: no task sees more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.shared import cut

RANGE = 1 << 16


def running_count(df: DataFrame, test: Column, pos: str = "pos", out: str = "k") -> DataFrame:
    """df with the number of rows before this one, in the order of pos, where test holds."""
    df = df.withColumn("_t", F.coalesce(test, F.lit(False))).withColumn("_r", F.floor(F.col(pos) / RANGE))
    sums = df.groupBy("_r").agg(F.count_if("_t").alias("_n"))
    ahead = sums.select("_r", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.coalesce(F.sum(F.col("_t").cast("bigint")).over(Window.partitionBy("_r").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(ahead, "_r").withColumn(out, F.col("_ahead") + within).drop("_t", "_r", "_ahead")


def compress_store(df: DataFrame, mask: str, pos: str = "pos") -> DataFrame:
    """The active rows under new, dense ordinals."""
    return running_count(df, F.col(mask), pos, "_k").where(F.col(mask)).withColumn(pos, F.col("_k")).drop("_k")


def expand_load(df: DataFrame, mask: str, source: DataFrame, value: str, fill: object = 0, pos: str = "pos") -> DataFrame:
    """df with `value`: the source's next lane on every active row, fill elsewhere."""
    ranked = running_count(df, F.col(mask), pos, "_k")
    lanes = source.select(F.col(pos).alias("_p"), F.col(value))
    joined = ranked.join(lanes, F.col(mask) & (F.col("_k") == F.col("_p")), "left")
    return joined.withColumn(value, F.when(F.col(mask), F.col(value)).otherwise(F.lit(fill))).drop("_k", "_p")


def gather(index: DataFrame, base: DataFrame, value: str, pos: str = "pos", mask: str | None = None, source: str | None = None) -> DataFrame:
    """index (ord, row_id) with the base's value at row_id; an id that names no row gives null; off-mask rows give `source`."""
    lanes = base.select(F.col(pos).alias("_p"), F.col(value).alias("_v"))
    out = index.join(lanes, F.col("row_id") == F.col("_p"), "left")
    kept = F.col("_v") if mask is None else F.when(F.col(mask), F.col("_v")).otherwise(F.col(source))
    return out.withColumn(value, kept).drop("_p", "_v")


def scatter(base: DataFrame, writes: DataFrame, value: str, pos: str = "pos", mask: str | None = None) -> DataFrame:
    """base with writes (ord, row_id, value) stored; of equal ids the last ord wins."""
    writes = writes if mask is None else writes.where(F.col(mask))
    new = writes.groupBy("row_id").agg(F.max_by(F.struct(F.col(value).alias("x")), "ord").alias("_w"))
    joined = base.join(new, F.col(pos) == F.col("row_id"), "left")
    return joined.withColumn(value, F.when(F.col("_w").isNotNull(), F.col("_w.x")).otherwise(F.col(value))).drop("row_id", "_w")


def registers(df: DataFrame, columns: list[str], lanes: int, pos: str = "pos") -> DataFrame:
    """chunk and, of each column, an array of its `lanes` lanes in order."""
    row = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("_p"), *columns)))
    grouped = df.groupBy(F.floor(F.col(pos) / lanes).alias("chunk")).agg(row.alias("_r"))
    return grouped.select("chunk", *(_field("_r", c).alias(c) for c in columns))


def _field(rows: str, name: str) -> Column:
    return F.transform(rows, lambda s: s[name])


def load_scalar(df: DataFrame, value: str, at: int, pos: str = "pos") -> DataFrame:
    """The one value at an ordinal; none if there is no such row. The test reaches the scan."""
    return df.where(F.col(pos) == at).select(value)


def store_scalar(df: DataFrame, value: str, at: int, scalar: object, pos: str = "pos") -> DataFrame:
    """df with one value stored at an ordinal; other rows stay."""
    kind = df.schema[value].dataType
    return df.withColumn(value, F.when(F.col(pos) == at, F.lit(scalar).cast(kind)).otherwise(F.col(value)))


def store(registers_: DataFrame, column: str, lanes: int, out: str = "v") -> DataFrame:
    """Registers (chunk and an array) written to the shared folder lane after lane, and read from there: pos, out."""
    rows = registers_.select("chunk", F.posexplode(column).alias("_i", out)).select((F.col("chunk") * lanes + F.col("_i")).alias("pos"), out)
    return cut(rows, "store")


def store_mask(registers_: DataFrame, mask: str, layout: str = "integral") -> DataFrame:
    """Masks (chunk and an array of booleans, 64 lanes at most) written to the shared folder and read from there: chunk, mask.

    native: the booleans; integral: a bigint, lane i at bit i; bytes: a byte 0 or 1 a lane; bits: the bigint's bytes, lowest first, as many as the lanes fill.
    """
    m = F.col(mask)
    if layout == "bytes":
        m = F.unhex(F.array_join(F.transform(m, lambda b: F.when(b, "01").otherwise("00")), ""))
    elif layout != "native":
        one = F.lit(1).cast("bigint")
        lane = F.transform(m, lambda b, i: F.when(b, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint")))
        word = F.aggregate(lane, F.lit(0).cast("bigint"), lambda x, y: x.bitwiseOR(y))
        if layout == "bits":
            octet = lambda k: F.lpad(F.hex(F.call_function("shiftrightunsigned", word, k * 8).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0")
            word = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / 8).cast("int")), octet), ""))
        m = word
    return cut(registers_.select("chunk", m.alias("mask")), "store-mask")
