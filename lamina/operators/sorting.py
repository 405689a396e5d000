"""Multi-column sort, permutations, runs of equal values, distinct frequencies.

Ordering is by range partitions sorted locally (`orderBy`). Ordinals of a sorted table come from one range
sort: a row's place within its range, which the sort itself gives, and the sizes of the ranges before it. The
sorted rows are written once, so both are of the same ranges. The row's own ordinal is the last key: rows of one
value may lie in many ranges, and no task holds more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.sources.shared import cut


def _order(columns: list[str], descending: list[bool] | None) -> list[Column]:
    down = descending or [False] * len(columns)
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in zip(columns, down, strict=True)]


def sort_columns(df: DataFrame, columns: list[str], descending: list[bool] | None = None, tie: str | None = None) -> DataFrame:
    """Rows in lexicographic order; ties are in no order unless a tie column is given."""
    return df.orderBy(*_order(columns, descending), *([F.col(tie)] if tie else []))


sort_columns_parallel = sort_columns


def sort_key(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By one key, the other columns as payload."""
    return sort_columns(df, [key], [descending])


def sample_sort(df: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Range partitions by sampled splitters, each sorted: in order partition by partition."""
    split = df.repartitionByRange(*([partitions] if partitions else []), *columns)
    return split.sortWithinPartitions(*columns)


def ranked(df: DataFrame, order: list[Column], out: str = "ord") -> DataFrame:
    """df with each row's place in the order, from 0. One shuffle; the window is over a row a range."""
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn("_r", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = placed.groupBy("_r").agg(F.count("*").alias("_m"))
    ahead = sizes.select("_r", F.coalesce(F.sum("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return placed.join(F.broadcast(ahead), "_r").withColumn(out, F.col("_ahead") + F.col("_i")).drop("_r", "_i", "_ahead")


def run_begins(df: DataFrame, columns: list[str], descending: list[bool] | None = None) -> DataFrame:
    """columns, begin, end of every group of equal rows as it lies in the sorted table: from frequencies, whose range sort gives the sums of smaller keys."""
    order = _order(columns, descending)
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    ranged = cut(counts.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_r", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    sizes = ranged.groupBy("_r").agg(F.sum("_n").alias("_m"))
    ahead = sizes.select("_r", F.coalesce(F.sum("_m").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_within", within).join(F.broadcast(ahead), "_r").withColumn("begin", F.col("_ahead") + F.col("_within"))
    return out.select(*columns, "begin", (F.col("begin") + F.col("_n")).alias("end"))


def sort_index(df: DataFrame, columns: list[str], descending: list[bool] | None = None, pos: str = "pos") -> DataFrame:
    """ord, row_id: the permutation that sorts; ties by pos."""
    slim = df.select(*dict.fromkeys([*columns, pos]))
    return ranked(slim, [*_order(columns, descending), F.col(pos).asc()]).select("ord", F.col(pos).alias("row_id"))


sort_index_parallel = sort_index


def apply_permutation(index: DataFrame, df: DataFrame, pos: str = "pos") -> DataFrame:
    """ord and the rows of df that the permutation puts there."""
    return index.join(df, F.col("row_id") == F.col(pos)).drop("row_id")


def sort_array_column(register: Column) -> Column:
    """Lanes of a register in order."""
    return F.array_sort(register)


def sort_values(df: DataFrame, key: str, descending: bool = False, pos: str = "pos") -> DataFrame:
    """ord and the key alone, in order; the row's own ordinal only spreads equal keys over ranges."""
    return ranked(df.select(key, pos), [*_order([key], [descending]), F.col(pos).asc()]).select("ord", key)


def cosort_registers(key: Column, payload: Column) -> Column:
    """The payload's lanes in the order of the key's, equal keys in the order of their lanes."""
    lanes = F.transform(key, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    return F.transform(F.array_sort(lanes), lambda s: F.get(payload, s["i"]))


def sort_image(df: DataFrame, columns: list[str], descending: list[bool] | None = None, pos: str = "pos") -> DataFrame:
    """ord and every column of the stably sorted table: what any sort of it has to give."""
    return ranked(df, [*_order(columns, descending), F.col(pos).asc()])


def conformance(image: DataFrame, df: DataFrame, columns: list[str], descending: list[bool] | None = None) -> DataFrame:
    """One row: rows of df that the image (ord and df's columns) lacks, rows it has besides, neighbours in the wrong order. A right image gives zeros."""
    names = df.columns
    sides = image.select(*names, F.lit(1).alias("_d")).union(df.select(*names, F.lit(-1).alias("_d")))
    off = sides.groupBy(*names).agg(F.sum("_d").alias("_d")).agg(F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("foreign"))
    here = image.select("ord", *(F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)))
    next_ = image.select((F.col("ord") - 1).alias("ord"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)))
    wrong = F.lit(False)
    for i, down in reversed(list(enumerate(descending or [False] * len(columns)))):
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        later, earlier = (b, a) if down else (a, b)  # nulls first, or last where descending
        before = F.coalesce(later > earlier, later.isNotNull() & earlier.isNull())
        wrong = before | (a.eqNullSafe(b) & wrong)
    order = here.join(next_, "ord").agg(F.count_if(wrong).alias("disordered"))
    both = off.withColumn("disordered", F.lit(0)).unionByName(order, allowMissingColumns=True)
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("missing", "foreign", "disordered")))


def partition_side(x: Column, pivot: Column) -> Column:
    """-1, 0 or 1: before, equal to or behind the pivot."""
    return F.when(x < pivot, -1).when(x == pivot, 0).otherwise(1)


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def pseudomedian_of_nine(values: list[Column]) -> Column:
    return median_of_three(*(median_of_three(*values[i : i + 3]) for i in (0, 3, 6)))


def equal_runs(df: DataFrame, column: str, pos: str = "pos", block: int = 1 << 16) -> DataFrame:
    """begin, end of the maximal runs of more than one equal value, in the order of pos (dense from 0).

    Runs are found a block of rows at a time; runs that meet at a block's edge are then joined over the
    blocks' first and last runs.
    """
    marked = df.select(F.col(pos).alias("_p"), F.col(column).alias("_v")).withColumn("_b", F.floor(F.col("_p") / block))
    w = Window.partitionBy("_b").orderBy("_p")
    new = F.coalesce((~F.col("_v").eqNullSafe(F.lag("_v").over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    runs = marked.withColumn("_g", F.sum(new.cast("int")).over(w)).groupBy("_b", "_g").agg(F.min("_p").alias("begin"), (F.max("_p") + 1).alias("end"), F.first("_v").alias("_v"))
    inner = runs.where((F.pmod("begin", F.lit(block)) != 0) & (F.pmod("end", F.lit(block)) != 0))
    edge = runs.where((F.pmod("begin", F.lit(block)) == 0) | (F.pmod("end", F.lit(block)) == 0))
    e = Window.orderBy("begin")  # at most two rows a block
    breaks = F.coalesce((F.lag("end").over(e) != F.col("begin")) | ~F.col("_v").eqNullSafe(F.lag("_v").over(e)), F.lit(True))
    joined = edge.withColumn("_i", F.sum(breaks.cast("int")).over(e)).groupBy("_i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return inner.select("begin", "end").union(joined.select("begin", "end")).where("end - begin > 1")


def equal_runs_delta(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """The same runs from differences: rows unlike the one before begin a run, rows unlike the next end one; the k-th begin and the k-th end belong together.

    Neighbours meet by a join on the ordinal, and begins and ends by their place in order.
    """
    rows = df.select(F.col(pos).alias("_p"), F.struct(F.col(column)).alias("_v"))
    next_ = rows.select((F.col("_p") - 1).alias("_q"), F.col("_v").alias("_w"))
    edges = rows.join(next_, F.col("_p") == F.col("_q"), "full").where(~F.col("_v").eqNullSafe(F.col("_w")))
    ends = ranked(edges.where("_v is not null").select((F.col("_p") + 1).alias("end")), [F.col("end").asc()], "k")
    begins = ranked(edges.where("_w is not null").select((F.col("_q") + 1).alias("begin")), [F.col("begin").asc()], "k")
    return begins.join(ends, "k").where("end - begin > 1").select("begin", "end")


def equal_runs_scan(df: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """The same runs by a scan for each value: a value's rows whose ordinals rise in step are one run. A task takes all rows of a value."""
    w = Window.partitionBy(column).orderBy(pos)
    rows = df.select(column, F.col(pos).alias("_p"), (F.col(pos) - F.row_number().over(w)).alias("_g"))
    return rows.groupBy(column, "_g").agg(F.min("_p").alias("begin"), (F.max("_p") + 1).alias("end")).where("end - begin > 1").select("begin", "end")


def sorted_runs(df: DataFrame, columns: list[str], descending: list[bool] | None = None) -> DataFrame:
    """begin, end of the runs that the sorted table has: from frequencies, without sorting rows."""
    return run_begins(df, columns, descending).where("end - begin > 1").select("begin", "end")


def distinct_frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def scan_lt(df: DataFrame, column: str, bound: object) -> DataFrame:
    return df.where(F.col(column) < bound)


def scan_gt(df: DataFrame, column: str, bound: object) -> DataFrame:
    return df.where(F.col(column) > bound)


def dense_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """df with order-preserving codes from 0, nulls first: ranks of the distinct values, joined back."""
    codes = ranked(df.select(F.col(column).alias("_v")).distinct(), [F.col("_v").asc_nulls_first()], out or f"{column}_code")
    return df.join(codes, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def group_share(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values and the largest group's share of the rows."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.count(column).alias("n_distinct"), (F.max("n") / F.sum("n")).alias("largest_share"))
