"""Questions about a catalogue of implementations: selection, dependency closure, inheritance, coverage."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.sources.shared import cut


def functions_catalog(spark: SparkSession) -> DataFrame:
    """name, module, parameters of this library's lane functions."""
    import lamina.functions as lib

    rows = []
    for name in sorted(dir(lib)):
        f = getattr(lib, name)
        if inspect.isfunction(f) and f.__module__.startswith("lamina.functions"):
            rows.append((name.rstrip("_"), f.__module__.rsplit(".", 1)[1], len(inspect.signature(f).parameters), "mask" in inspect.signature(f).parameters))
    return spark.createDataFrame(rows, "name string, module string, parameters int, maskable boolean")


def select_candidates(candidates: DataFrame, groups: list[str], distance: str, specificity: str, flags: str, capabilities: str, order: str) -> DataFrame:
    """The best candidate of each group: nearest, most specific, then most flags and capabilities, then first."""
    w = Window.partitionBy(*groups).orderBy(F.col(distance), F.col(specificity), F.col(flags).desc(), F.col(capabilities).desc(), F.col(order))
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolvable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose dependencies, and theirs, are all there: unresolved ones are pruned until none is left. edges: name, needs."""
    left = cut(nodes.select("name").distinct(), "resolvable")
    n = left.count()
    while True:
        bad = edges.join(left.select(F.col("name").alias("needs")), "needs", "left_anti").select("name").distinct()
        left = cut(left.join(bad, "name", "left_anti"), "resolvable")
        m = left.count()
        if m == n:
            return left
        n = m


def ancestors(edges: DataFrame) -> DataFrame:
    """name, ancestor, distance along `name, parent` edges; shortest distances."""
    return edges.sparkSession.sql(
        """with recursive chain(name, ancestor, distance) as (
             select name, parent, 1 from {edges}
             union all
             select c.name, e.parent, c.distance + 1 from chain c join {edges} e on c.ancestor = e.name)
           select name, ancestor, min(distance) as distance from chain group by name, ancestor""",
        edges=edges,
    )


def coverage(rows: DataFrame, group: str, flag: str) -> DataFrame:
    """group, total, covered, share."""
    return rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("covered"), F.avg(F.col(flag).cast("double")).alias("share"))
