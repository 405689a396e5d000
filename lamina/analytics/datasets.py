"""Key sets of known shapes, their measured structure, and data of exact selectivity.

Everything is an expression of the row number and a seed: reruns agree, and no row depends on others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.operators.sorting import ranked
from lamina.sources.shared import cut

TPC_CARDINALITIES = (10, 99, 710, 17958, 6, 4, 12, 4)  # fixed values: distinct values of the eight key columns


_P = (1 << 31) - 1  # a prime: products of two residues fit in 62 bits
_HALVES = ((1103515245, 69069, 1597334677), (1812433253, 22695477, 747796405))  # multipliers of a hash's two halves


def _hash62(pos: Column, column: int, seed: int) -> Column:
    """62 bits from an ordinal of 0 or more, in plain 64-bit arithmetic that SQL has too: multiply, exclusive or of the upper half, multiply."""
    halves = []
    for k, (a, b, d) in enumerate(_HALVES):
        start = (seed * 1_000_003 + column * 7919 + k * 104_729 + 12_345) % _P
        a = a * pow(48_271, column, _P) % _P  # columns have multipliers of their own
        x = F.pmod(F.pmod(pos, F.lit(_P)) * F.lit(a).cast("bigint") + F.call_function("div", pos, F.lit(_P)) * F.lit(b).cast("bigint") + F.lit(start).cast("bigint"), F.lit(_P).cast("bigint"))
        halves.append(F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(d).cast("bigint"), F.lit(_P).cast("bigint")))
    return halves[0] * F.lit(1 << 31).cast("bigint") + halves[1]


def _uniform(pos: Column, column: int, seed: int, n: int) -> Column:
    return F.pmod(_hash62(pos, column, seed), F.lit(n).cast("bigint"))


def _share(pos: Column, column: int, seed: int) -> Column:
    return _hash62(pos, column, seed).cast("double") * 2.0**-62


def _scattered(pos: Column, n: int, seed: int) -> Column:
    """A permutation of 0..n-1: an odd multiplier that n does not divide."""
    a = int(n * 0.6180339887) | 1
    while math.gcd(a, n) != 1:
        a += 2
    return F.pmod(pos * F.lit(a).cast("bigint") + F.lit(seed % max(n, 1)).cast("bigint"), F.lit(max(n, 1)).cast("bigint"))


Shape = Callable[[Column, int, int, int, dict], list[Column]]


def _zipf(pos: Column, seed: int, d: int, s: float) -> Column:
    u = _share(pos, 0, seed)
    x = F.exp(u * math.log(d + 1)) if s == 1 else F.pow(u * (math.pow(d + 1, 1 - s) - 1) + 1, F.lit(1 / (1 - s)))
    return F.least(F.floor(x).cast("bigint") - 1, F.lit(d - 1).cast("bigint"))


def _columns(name: str, p: Column, n: int, m: int, seed: int, o: dict) -> list[Column]:
    rest = lambda a, c: [_uniform(p, j, seed, c) for j in range(a, m)]
    zero = F.lit(0).cast("bigint")
    wide = max(2, n)
    if name == "unique_first":
        return [_scattered(p, n, seed), *rest(1, wide)]
    if name == "unique_last":
        return [F.floor(_scattered(p, n, seed) / o.get("group", 64)).cast("bigint")] * (m - 1) + [_scattered(p, n, seed)]
    if name in ("independent_uniform", "low_cardinality"):
        return rest(0, o.get("cardinality", 1024 if name == "independent_uniform" else 4))
    if name == "balanced_hierarchy":
        f, at = o.get("fanout", 16), _scattered(p, n, seed)
        return [F.pmod(F.floor(at * (f ** (j + 1)) / max(n, 1)).cast("bigint"), F.lit(f).cast("bigint")) for j in range(m)]
    if name == "skewed_zipf":
        return [_zipf(p, seed, o.get("distinct", 1024), o.get("s", 1.0)), *rest(1, 64)]
    if name == "heavy_hitter":
        return [F.when(_scattered(p, n, seed) < int(n * o.get("share", 0.9)), zero).otherwise(1 + _uniform(p, 0, seed, wide)), *rest(1, wide)]
    if name == "all_equal_prefix":
        return [zero] * (m - 1) + [_scattered(p, n, seed)]
    if name in ("correlated_forward", "correlated_reverse", "correlated_noisy"):
        first = _uniform(p, 0, seed, 4096)
        out = [F.floor(first / (1 << j)).cast("bigint") for j in range(m)]
        if name == "correlated_noisy":
            out = [out[0]] + [F.when(_share(p, 50 + j, seed) < 0.1, _uniform(p, j, seed, 4096)).otherwise(c) for j, c in enumerate(out[1:], 1)]
        return out[::-1] if name == "correlated_reverse" else out
    if name == "prefix_presorted":
        k = o.get("prefix", 1)
        return [F.floor(p * (16 ** (j + 1)) / max(n, 1)).cast("bigint") if j < k else _uniform(p, j, seed, 1024) for j in range(m)]
    if name == "clustered_runs":
        return [_uniform(F.floor(p / o.get("run", 64)), 0, seed, 1 << 20), *rest(1, 1024)]
    if name == "reverse_sorted":
        return [F.lit(n - 1).cast("bigint") - p, *rest(1, 1024)]
    if name == "organ_pipe":
        return [F.least(p, F.lit(n - 1).cast("bigint") - p), *rest(1, 1024)]
    if name == "sawtooth":
        return [F.pmod(p, F.lit(o.get("period", 1024)).cast("bigint")), *rest(1, 1024)]
    if name == "duplicates_at_pivot":
        return [F.when(_scattered(p, n, seed) < int(n * o.get("share", 0.5)), F.lit(n // 2).cast("bigint")).otherwise(_uniform(p, 0, seed, wide)), *rest(1, 1024)]
    if name == "extreme_values":
        top = F.lit((1 << 32) - 1).cast("bigint")
        at = _uniform(p, 0, seed, o.get("period", 64))
        return [F.when(at == 0, zero).when(at == 1, top).otherwise(_uniform(p, 1, seed, 1 << 32)), *rest(1, 1024)]
    if name == "permutation_local":
        return [F.floor(p / 8).cast("bigint") * 8 + F.pmod(p * 3 + F.floor(p / 8).cast("bigint"), F.lit(8).cast("bigint")), *rest(1, 1024)]
    if name == "permutation_blocked":
        b = o.get("block", 4096)
        blocks = max(1, -(-n // b))
        return [_scattered(F.floor(p / b).cast("bigint"), blocks, seed) * b + F.pmod(p, F.lit(b).cast("bigint")), *rest(1, 1024)]
    if name == "permutation_random":
        return [_scattered(p, n, seed), *rest(1, 1024)]
    if name == "tpcds_q67":
        return [_uniform(p, j, seed, TPC_CARDINALITIES[j % len(TPC_CARDINALITIES)]) for j in range(m)]
    raise ValueError(name)


SHAPES = (
    "unique_first", "unique_last", "independent_uniform", "balanced_hierarchy", "skewed_zipf", "heavy_hitter", "low_cardinality", "all_equal_prefix", "correlated_forward", "correlated_reverse", "correlated_noisy",
    "prefix_presorted", "clustered_runs", "reverse_sorted", "organ_pipe", "sawtooth", "duplicates_at_pivot", "extreme_values", "permutation_local", "permutation_blocked", "permutation_random", "tpcds_q67",
)


def generate(spark: SparkSession, shape: str, rows: int, columns: int, seed: int = 17, **options: float) -> DataFrame:
    """pos, k0, k1, ... of a shape."""
    made = _columns(shape, F.col("pos"), rows, columns, seed, options)
    return spark.range(rows).withColumnRenamed("id", "pos").select("pos", *(c.alias(f"k{i}") for i, c in enumerate(made)))


def split_sizes(spark: SparkSession, total: int, kind: str = "balanced", parts: int = 64, group: int = 64, s: float = 1.0) -> DataFrame:
    """part, size: sizes that sum to the total.

    balanced: `parts` sizes that differ by one at most; fixed: groups of `group`, the last takes the rest; multiple: `parts` sizes
    that are multiples of `group`, the last takes the rest as well; zipf: `parts` sizes that fall as a power law.
    """
    i = F.col("part")
    if kind == "fixed":
        return spark.range(-(-total // group)).toDF("part").select("part", F.least(F.lit(group).cast("bigint"), F.lit(total).cast("bigint") - i * group).alias("size"))
    rows = spark.range(parts).toDF("part")
    if kind == "balanced":
        return rows.select("part", (F.lit(total // parts).cast("bigint") + (i < total % parts).cast("bigint")).alias("size"))
    if kind == "multiple":
        units = total // group
        size = (F.lit(units // parts).cast("bigint") + (i < units % parts).cast("bigint")) * group
        return rows.select("part", (size + F.when(i == parts - 1, total % group).otherwise(0)).alias("size"))
    if kind != "zipf":
        raise ValueError(kind)
    weights = [1 / (k + 1) ** s for k in range(parts)]
    marks = [math.floor(total * sum(weights[: k + 1]) / sum(weights) + 0.5) for k in range(parts)]
    return spark.createDataFrame([(k, b - a) for k, (a, b) in enumerate(zip([0, *marks[:-1]], marks, strict=True))], "part long, size long")


def shuffle_rows(df: DataFrame, block: int, seed: int = 1, pos: str = "pos") -> DataFrame:
    """Rows in a new order within blocks of `block` rows (new ordinals in `new_pos`)."""
    w = Window.partitionBy(F.floor(F.col(pos) / block)).orderBy(_hash62(F.col(pos), 0, seed), pos)
    return df.withColumn("new_pos", F.floor(F.col(pos) / block).cast("bigint") * block + F.row_number().over(w) - 1)


GROUP_BOUNDS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 1024, 4096, 65536)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a prefix length j: distinct prefixes D_j, tied rows R_j, largest and nontrivial groups, and a histogram of group sizes."""
    out = None
    for j in range(1, len(columns) + 1):
        sizes = df.groupBy(*columns[:j]).agg(F.count("*").alias("n"))
        lows = (0, *GROUP_BOUNDS)
        histogram = [F.count_if((F.col("n") > a) & (F.col("n") <= b)).alias(f"groups_to_{b}") for a, b in zip(lows, GROUP_BOUNDS, strict=False)]
        row = sizes.agg(F.count("*").alias("distinct_prefixes"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("tied_rows"), F.max("n").alias("max_group"), F.count_if(F.col("n") > 1).alias("nontrivial_groups"), *histogram)
        row = row.select(F.lit(j).alias("prefix"), "*")
        out = row if out is None else out.union(row)
    return out


def in_order_fraction(df: DataFrame, columns: list[str], pos: str = "pos") -> DataFrame:
    """One row: of adjacent rows, the share that do not descend over all columns. Neighbours meet by a join on the ordinal."""
    here = df.select(F.col(pos).alias("_p"), F.struct(*columns).alias("_a"))
    next_ = df.select((F.col(pos) - 1).alias("_p"), F.struct(*columns).alias("_b"))
    return here.join(next_, "_p").agg(F.coalesce(F.avg((F.col("_a") <= F.col("_b")).cast("double")), F.lit(1.0)).alias("in_order"), (F.count_if(F.col("_a") > F.col("_b")) + 1).alias("ascending_runs"))


def sort_work(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: weighted_work, scan_volume and duplicate_share of a sort column by column.

    The sort by column j works on the groups of the j-1 columns before it, n log2 n for each of two rows or more, once for
    every column from j on; all rows in such groups are scanned before every column but the last. duplicate_share: of
    rows, those whose whole tuple is not unique. The table is grouped once; shorter prefixes add up longer ones' groups.
    """
    m = len(columns)
    sizes, levels = df.groupBy(*columns).agg(F.count("*").alias("n")), None
    for j in range(m, -1, -1):
        if j < m:
            sizes = sizes.groupBy(*columns[:j]).agg(F.sum("n").alias("n"))
        n = F.when(F.col("n") > 1, F.col("n"))
        level = sizes.agg(F.lit(j).alias("j"), F.coalesce(F.sum(n), F.lit(0)).alias("tied"), F.coalesce(F.sum(n * F.log2(n)), F.lit(0.0)).alias("work"), F.sum("n").alias("rows"))
        levels = level if levels is None else levels.union(level)
    j = F.col("j")
    return levels.agg(
        F.sum(F.when(j < m, (m - j) * F.col("work")).otherwise(0.0)).alias("weighted_work"),
        F.sum(F.when(j <= m - 2, F.col("tied")).otherwise(0)).alias("scan_volume"),
        F.coalesce(F.max(F.when(j == m, F.col("tied") / F.col("rows"))), F.lit(0.0)).alias("duplicate_share"),
    )


def order_measures(df: DataFrame, columns: list[str], pos: str = "pos") -> DataFrame:
    """One row: displacement, the mean distance of rows (ordinals from 0) from their places in the stable sort, and adjacency, the share of neighbours that stay neighbours in it."""
    placed = ranked(df.select(*dict.fromkeys([*columns, pos])), [*(F.col(c).asc_nulls_first() for c in columns), F.col(pos).asc()])
    here = placed.select(F.col(pos).alias("_p"), F.col("ord").alias("_o"))
    kept = here.join(here.select((F.col("_p") - 1).alias("_p"), (F.col("_o") - 1).alias("_o")), ["_p", "_o"]).agg(F.count("*").alias("kept"))
    far = here.agg(F.avg(F.abs(F.col("_o") - F.col("_p"))).alias("far"), F.count("*").alias("rows"))
    both = far.unionByName(kept, allowMissingColumns=True)
    return both.agg(F.coalesce(F.max("far"), F.lit(0.0)).alias("displacement"), (F.coalesce(F.max("kept"), F.lit(0)) / F.greatest(F.max("rows") - 1, F.lit(1))).alias("adjacency"))


DIGIT = 8  # bits


def _pairs_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, p, d) of one range, by g and p: descending pairs of d within a g. The range's first and last g, which may go on in other ranges, come with their histogram of d."""
    out: list[tuple[int | None, int | None, int, bytes | None]] = []
    group, at, seen, inside, counts = None, 0, 0, 0, np.zeros(1 << DIGIT, np.int64)
    for batch in batches:
        g, p, d = (batch.column(c).to_numpy() for c in "gpd")
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in pairwise(edges):
            if a < b and g[a] != group:
                if out:
                    inside += seen
                elif group is not None:
                    out.append((group, at, seen, counts.tobytes()))
                group, at, seen = int(g[a]), int(p[a]), 0
                counts[:] = 0
            for x in range(a, b, 1 << DIGIT):
                part = d[x : min(b, x + (1 << DIGIT))]
                greater = counts.sum() - np.cumsum(counts)
                seen += int(greater[part].sum()) + int(np.count_nonzero(np.triu(part[:, None] > part[None, :], 1)))
                counts += np.bincount(part, minlength=1 << DIGIT)
    if group is not None:
        out += [(group, at, seen, counts.tobytes()), (None, None, inside, None)]
        g, p, n, digits = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(digits, pa.binary())], names=["g", "p", "n", "digits"])


def _pairs_between(ranges: pa.Table) -> pa.Table:
    """Descending pairs between the parts of one g, a row for each range it lies in."""
    before, n = np.zeros(1 << DIGIT, np.int64), 0
    for raw in ranges.sort_by("p").column("digits").to_pylist():
        counts = np.frombuffer(raw, np.int64)
        n += int(((before.sum() - np.cumsum(before)) * counts).sum())
        before += counts
    return pa.table({"n": pa.array([n], pa.int64())})


def inversions(df: DataFrame, rank: str, pos: str = "pos") -> DataFrame:
    """One row: pairs of rows that stand in the wrong order of `rank` (equal ranks are in order, nulls come first).

    Places in the sorted table are compared digit by digit: a pair is counted at the highest digit in which its places
    differ, among the rows that agree above it. A digit takes one range sort by (digits above, pos); a range is counted
    in one pass, and between ranges only histograms of the digit meet, two a range.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = ranked(df.select(pos, rank), [F.col(rank).asc_nulls_first(), F.col(pos).asc()])
    out = None
    for shift in range(0, max(1, (placed.count() - 1).bit_length()), DIGIT):
        digit = F.shiftright("ord", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")
        rows = placed.select(F.shiftright("ord", shift + DIGIT).alias("g"), F.col(pos).cast("long").alias("p"), digit.alias("d"))
        counted = cut(rows.repartitionByRange(ranges, "g", "p").sortWithinPartitions("g", "p").mapInArrow(_pairs_within, "g long, p long, n long, digits binary"), "inversions")
        level = counted.select("n").union(counted.where("digits is not null").groupBy("g").applyInArrow(_pairs_between, "n long"))
        out = level if out is None else out.union(level)
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inversions"))


CLUSTER = 64  # rows of a cluster


def _place(pos: Column, rows: int, layout: str, seed: int) -> Column:
    """Where each row stands in the order in which rows are made to match: a bijection of 0..rows-1."""
    if layout == "random":
        return _scattered(pos, rows, seed)
    if layout == "alternating":  # every other row, then those between
        half = F.call_function("div", pos, F.lit(2))
        return F.when(pos % 2 == 0, half).otherwise(half + (rows + 1) // 2)
    if layout == "clustered":  # whole clusters, scattered; an incomplete last one stays last
        whole = rows // CLUSTER
        moved = _scattered(F.call_function("div", pos, F.lit(CLUSTER)), whole, seed) * CLUSTER + pos % CLUSTER if whole else pos
        return F.when(pos < whole * CLUSTER, moved).otherwise(pos)
    raise ValueError(f"no layout {layout!r}")


def filter_sum_rows(spark: SparkSession, rows: int, first: float, second: float, seed: int = 17, layout: str = "random") -> DataFrame:
    """pos, a, b, c: a matches (is -1) on exactly round(rows * first) rows, b (is 1) on a share of those; c in -100..100. layout: random, clustered or alternating."""
    p = F.col("pos")
    place = _place(p, rows, layout, seed)
    k = round(rows * first)
    both = round(k * second)
    a = F.when(place < k, -1).otherwise(1)
    b = F.when((place < both) | ((place >= k) & (_uniform(p, 2, seed, 2) == 0)), 1).otherwise(-1)
    return spark.range(rows).withColumnRenamed("id", "pos").select("pos", a.alias("a"), b.alias("b"), (_uniform(p, 3, seed, 201) - 100).cast("int").alias("c"))


# fixed values: constants of the SplitMix64 and FNV-1a definitions
_GAMMA, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_FNV_BASIS, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def splitmix64(x: Column) -> Column:
    """The SplitMix64 output for a bigint state, as a bigint bit pattern: also the mixing step of seeds (state xor what is mixed in)."""

    @F.pandas_udf("bigint")
    def mix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            with np.errstate(over="ignore"):
                z = s.to_numpy(np.int64).view(np.uint64) + np.uint64(_GAMMA)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX1)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX2)
                yield pd.Series((z ^ (z >> np.uint64(31))).view(np.int64))

    return mix(x)


def fnv1a(data: bytes, state: int = _FNV_BASIS) -> int:
    for b in data:
        state = (state ^ b) * _FNV_PRIME & (1 << 64) - 1
    return state
