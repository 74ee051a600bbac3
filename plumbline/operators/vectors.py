"""Pooling of vectors by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pooled(df: DataFrame, group: str, vector: str, floor: float = 1e-10) -> DataFrame:
    """(group, dim, mean, std): mean and population standard deviation, its variance at least floor, by dimension. One partial aggregation, dimensions as rows."""
    long = df.select(group, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return long.groupBy(group, "dim").agg(F.avg("x").alias("mean"), F.sqrt(F.greatest(F.var_pop("x"), F.lit(floor))).alias("std"))
