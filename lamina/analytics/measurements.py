"""Measurement analytics: validation, cell statistics, oracle choice, interpolation, dominance, exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


AXIS_ROWS = 10_000


def scenario_matrix(axes: list[DataFrame], keys: list[str]) -> DataFrame:
    """The product of small axis tables, a row an id (the keys' hash), without repeats. Its size is the product of the axes' sizes."""
    if any(axis.limit(AXIS_ROWS + 1).count() > AXIS_ROWS for axis in axes):
        raise ValueError(f"an axis has more than {AXIS_ROWS} values")
    out = axes[0]
    for axis in axes[1:]:
        out = out.join(F.broadcast(axis), F.lit(True))
    return out.withColumn("scenario_id", F.sha2(F.concat_ws("|", *keys), 256)).dropDuplicates(["scenario_id"])


def validate(expected: DataFrame, observed: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """kind, keys: missing, foreign, duplicate and failed samples."""
    seen = observed.select(*keys)
    missing = expected.select(*keys).join(seen, keys, "left_anti").withColumn("kind", F.lit("missing"))
    foreign = seen.join(expected.select(*keys), keys, "left_anti").distinct().withColumn("kind", F.lit("foreign"))
    duplicate = observed.groupBy(*keys).count().where("count > 1").drop("count").withColumn("kind", F.lit("duplicate"))
    failed = observed.where(F.col(status) != "ok").select(*keys).distinct().withColumn("kind", F.lit("failed"))
    return missing.unionByName(foreign).unionByName(duplicate).unionByName(failed)


def reduce_cells(samples: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """Median, extremes, 5th and 95th percentile (interpolated), median absolute deviation and its share of the median."""
    stats = samples.groupBy(*keys).agg(
        F.median(cost).alias("median"), F.min(cost).alias("min"), F.max(cost).alias("max"),
        F.percentile(cost, F.lit(0.05)).alias("p05"), F.percentile(cost, F.lit(0.95)).alias("p95"), F.count(cost).alias("n"),
    )
    spread = samples.join(stats.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col(cost) - F.col("median"))).alias("mad"))
    joined = stats.join(spread, keys)
    return joined.withColumn("relative_mad", F.when(F.col("median") != 0, F.col("mad") / F.col("median")))


def inconsistent(samples: DataFrame, keys: list[str], evidence: list[str]) -> DataFrame:
    """keys and, for each column of evidence, whether a cell's samples disagree about it (a null is a value like others): cells where any do. Repetitions of one measurement have to agree."""
    differs = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
    return samples.groupBy(*keys).agg(*(differs(c).alias(c) for c in evidence)).where(" or ".join(f"`{c}`" for c in evidence))


def nearest_rank(column: Column | str, share: float) -> Column:
    """The value at rank ceil(n * share), none interpolated."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})") if isinstance(column, str) else F.percentile(column, F.lit(share))


def choose(costs: DataFrame, scenario: str, plan: str, cost: str, tolerance: float = 0.005) -> DataFrame:
    """A row a scenario: the first plan by name within the tolerance of the least cost, and the margin to the next best plan."""
    best = costs.groupBy(scenario).agg(F.min(cost).alias("best"))
    near = costs.join(best, scenario).where(F.col(cost) <= F.col("best") * (1 + tolerance))
    won = near.groupBy(scenario, "best").agg(F.min(plan).alias("winner"))
    rest = costs.join(won, scenario).where(F.col(plan) != F.col("winner"))
    second = rest.groupBy(scenario).agg(F.min(F.struct(F.col(cost).alias("c"), F.col(plan).alias("p"))).alias("s"))
    return won.join(second, scenario, "left").select(scenario, "winner", "best", F.col("s.p").alias("runner_up"), (F.col("s.c") / F.col("best") - 1).alias("margin"))


def regrets(costs: DataFrame, chosen: DataFrame, scenario: str, plan: str, cost: str) -> DataFrame:
    """scenario, plan, regret of each chosen plan (null where it has no cost): its cost over the least, less one."""
    best = costs.groupBy(scenario).agg(F.min(cost).alias("best"))
    return chosen.join(costs, [scenario, plan], "left").join(best, scenario).select(scenario, plan, (F.col(cost) / F.col("best") - 1).alias("regret"))


def fixed_plan_regrets(costs: DataFrame, scenario: str, plan: str, cost: str) -> DataFrame:
    """A row a plan: scenarios, mean, worst and 95th percentile (nearest rank) regret, were it always chosen."""
    each = regrets(costs, costs.select(scenario, plan), scenario, plan, cost)
    return each.groupBy(plan).agg(F.count("regret").alias("scenarios"), F.avg("regret").alias("mean_regret"), F.max("regret").alias("max_regret"), nearest_rank("regret", 0.95).alias("p95_regret"))


def interpolate(points: DataFrame, grid: DataFrame, axes: list[str], keys: list[str], cost: str, point: str = "point_id") -> DataFrame:
    """point and its cost, multilinear over the grid's axes; null outside the hull or where a corner lacks a cost.

    The grid is a model's table: its distinct axis values are few, and it is broadcast by Catalyst if small.
    """
    out = points
    for axis in axes:
        values = grid.select(*keys, F.col(axis).alias("_v")).distinct()
        hit = out.join(values, keys, "left").groupBy(*out.columns).agg(F.max(F.when(F.col("_v") <= F.col(axis), F.col("_v"))).alias(f"_lo_{axis}"), F.min(F.when(F.col("_v") >= F.col(axis), F.col("_v"))).alias(f"_hi_{axis}"))
        out = hit
    corners, weight = out, F.lit(1.0)
    for axis in axes:
        lo, hi, x = F.col(f"_lo_{axis}"), F.col(f"_hi_{axis}"), F.col(axis)
        share = F.when(hi == lo, 0.0).otherwise((x - lo) / (hi - lo))
        sides = F.array(F.struct(lo.alias("at"), (1 - share).alias("w")), F.struct(hi.alias("at"), F.when(hi == lo, 0.0).otherwise(share).alias("w")))
        corners = corners.withColumn(f"_c_{axis}", F.explode(sides))
        weight = weight * F.col(f"_c_{axis}.w")
    cells = grid.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(a).alias(f"_g_{a}") for a in axes], F.col(cost).alias("_cost"))
    test = F.lit(True)
    for k in keys:
        test = test & (F.col(k) == F.col(f"_k_{k}"))
    for a in axes:
        test = test & (F.col(f"_c_{a}.at") == F.col(f"_g_{a}"))
    joined = corners.withColumn("_w", weight).join(cells, test, "left")
    missing = F.max((F.col("_w").isNull() | ((F.col("_w") != 0) & F.col("_cost").isNull())).cast("int"))
    return joined.groupBy(point).agg(F.when(missing == 0, F.sum(F.when(F.col("_w") != 0, F.col("_w") * F.col("_cost")).otherwise(0.0))).alias(cost))


def dominant(samples: DataFrame, default: str = "default", threshold: float = 0.05, set_id: str = "set_id", scenario: str = "scenario", candidate: str = "candidate", round_: str = "round", cost: str = "cost") -> DataFrame:
    """A row a set: the candidate that beats the default in every scenario, by the largest least improvement, else the default (inconclusive).

    A scenario is won with three paired rounds or more, wins in two thirds of them, a median improvement at
    the threshold or above, and a deviation (MAD) of at most 0.02 or three quarters of the median.
    """
    base = samples.where(F.col(candidate) == default).select(set_id, scenario, round_, F.col(cost).alias("_base"))
    gains = samples.where(F.col(candidate) != default).join(base, [set_id, scenario, round_]).withColumn("gain", (F.col("_base") - F.col(cost)) / F.col("_base"))
    keys = [set_id, candidate, scenario]
    stats = gains.groupBy(*keys).agg(F.median("gain").alias("median"), F.count("*").alias("n"), F.count_if(F.col("gain") > 0).alias("wins"))
    mad = gains.join(stats.select(*keys, "median"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("gain") - F.col("median"))).alias("mad"))
    won = (F.col("n") >= 3) & (3 * F.col("wins") >= 2 * F.col("n")) & (F.col("median") >= threshold) & (F.col("mad") <= F.greatest(F.lit(0.02), 0.75 * F.col("median")))
    whole = stats.join(mad, keys).groupBy(set_id, candidate).agg(F.bool_and(won).alias("all"), F.min("median").alias("least"), F.count("*").alias("k"))
    scenarios = base.groupBy(set_id).agg(F.countDistinct(scenario).alias("scenarios"))
    good = whole.join(scenarios, set_id).where("all and k = scenarios and least > 0")
    best = good.groupBy(set_id).agg(F.min(F.struct((-F.col("least")).alias("l"), F.col(candidate).alias("c"))).alias("b"))
    return scenarios.join(best, set_id, "left").select(set_id, F.coalesce("b.c", F.lit(default)).alias("selected"), F.when(F.col("b").isNull(), "inconclusive").otherwise("dominant").alias("status"), F.coalesce(-F.col("b.l"), F.lit(0.0)).alias("improvement"))


def explore(results: DataFrame, rows: list[str], pivot: str, values: list[str], cost: str) -> DataFrame:
    """Medians by rows, a column for each of the stated pivot values."""
    return results.groupBy(*rows).pivot(pivot, values).agg(F.median(cost))


def ratio(results: DataFrame, rows: list[str], pivot: str, first: str, second: str, cost: str) -> DataFrame:
    """rows that have both pivot values: the medians of the first and the second, and their ratio."""
    medians = explore(results, rows, pivot, [first, second], cost).dropna(subset=[first, second])
    return medians.select(*rows, F.col(first).alias("first"), F.col(second).alias("second"), F.try_divide(F.col(first), F.col(second)).alias("ratio"))


def scaling(results: DataFrame, keys: list[str], axis: str, cost: str, base: float = 1) -> DataFrame:
    """keys, axis, median, speedup over the median at axis = base (null where that is missing) and efficiency, the speedup a unit of the axis."""
    curve = results.groupBy(*keys, axis).agg(F.median(cost).alias("median"))
    serial = curve.where(F.col(axis) == base).select(*keys, F.col("median").alias("_serial"))
    faster = curve.join(serial, keys, "left").withColumn("speedup", F.try_divide(F.col("_serial"), F.col("median"))).drop("_serial")
    return faster.withColumn("efficiency", F.try_divide(F.col("speedup"), F.col(axis)))


def distinct_values(results: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """rows and how many values each column has there, nulls not counted. The pairs are made distinct first, so no row's values meet in one task."""
    out = None
    for c in columns:
        pairs = results.select(*rows, F.col(c).alias("_v")).distinct()
        counted = pairs.groupBy(*rows).agg(F.count("_v").alias(c))
        out = counted if out is None else out.join(counted, rows)
    return out


def top(results: DataFrame, n: int, cost: str, tie: str) -> DataFrame:
    return results.orderBy(F.col(cost), tie).limit(n)


def extremes(results: DataFrame, keys: list[str], cost: str) -> DataFrame:
    """First and last by cost within the keys."""
    w = Window.partitionBy(*keys)
    return results.withColumn("_lo", F.min(cost).over(w)).withColumn("_hi", F.max(cost).over(w)).where((F.col(cost) == F.col("_lo")) | (F.col(cost) == F.col("_hi"))).drop("_lo", "_hi")
