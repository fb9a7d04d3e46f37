"""Small fixed spines (stages, bands, bins) used to zero-fill grouped counts.

A spine has a size fixed by the operator (6 stages, 3 bands, ``n`` bins), never
by the data, so it is safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_spine(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def int_spine(spark: SparkSession, n: int, name: str) -> DataFrame:
    return spark.range(n, numPartitions=1).select(F.col("id").cast("int").alias(name))


def value_range(df: DataFrame, c: str) -> tuple:
    """(min, max) of a column as literals: one small aggregate job.

    A scalar subquery would be re-planned for every reference to it (each one
    re-reading the input), so a histogram's range is fitted once instead.
    """
    r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    lo = F.lit(r["lo"]).cast("double")
    hi = F.lit(r["hi"]).cast("double")
    return lo, hi
