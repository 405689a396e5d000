"""Tables of a folder, delimited files with a stated schema, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).csv(path)


def measurements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records a line, JSON."""
    return spark.read.schema(schema).json(path)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows, the same on each run: those of the smallest hashes (top n, no full sort)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)
