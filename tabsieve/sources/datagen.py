"""The benchmark table: a key, three 32-bit integer and three 32-bit float columns, made in parallel from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def benchmark_table(spark: SparkSession, rows: int = 8_000_000, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """id from 0; uniform over [-100, 100), normal with deviations 5 and 20; integers are cut off toward zero."""
    uniform = lambda k: F.rand(seed + k) * 200 - 100
    normal = lambda k, deviation: F.randn(seed + k) * deviation
    return spark.range(0, rows, 1, partitions or spark.sparkContext.defaultParallelism).select(
        F.col("id").cast("int").alias("id"),
        uniform(0).cast("int").alias("uniformi"),
        normal(1, 5).cast("int").alias("normali5"),
        normal(2, 20).cast("int").alias("normali20"),
        uniform(3).cast("float").alias("uniformf"),
        normal(4, 5).cast("float").alias("normalf5"),
        normal(5, 20).cast("float").alias("normalf20"),
    )
