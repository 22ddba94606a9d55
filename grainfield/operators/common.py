"""Helpers of the relational operators. An image is a relation pixels(image, [t], y, x, value ..)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_group(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """df with its groups' aggregates beside each row. Aggregated map-side and joined back, so that a large image is not
    drawn into one task as a window would; groups are few, and the planner broadcasts them where they are small."""
    stats = df.groupBy(*keys).agg(*(v.alias(k) for k, v in aggregates.items()))
    return df.join(stats, keys)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: undefined is null in the whole engine."""
    return F.when(b != 0, a / b)


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, med, mad, n): median and median absolute deviation of finite values."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not keys:
        fine, keys = fine.withColumn("__all", F.lit(0)), ["__all"]
    med = fine.groupBy(*keys).agg(F.median(value).alias("med"))
    return fine.join(med, keys).groupBy(*keys).agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"), F.count(F.lit(1)).alias("n"))
