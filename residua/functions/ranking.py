"""Global ranks and running totals without a single-task window: ranks within buckets, and bucket offsets that are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(df: DataFrame, bucket: str, value: Column, name: str) -> DataFrame:
    """Sum of value in the buckets before each bucket. There is one row for each bucket."""
    sums = df.groupBy(bucket).agg(value.alias("_own"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(bucket, F.coalesce(F.sum("_own").over(before), F.lit(0)).alias(name))


def global_rank(df: DataFrame, bucket: Column, *order: Column, name: str = "rank") -> DataFrame:
    """df with the 1-based rank in (bucket, *order). The bucket must follow the order and be one of a bounded number."""
    df = df.withColumn("_bucket", bucket)
    offsets = F.broadcast(_offsets(df, "_bucket", F.count(F.lit(1)), "_before"))
    inner = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.join(offsets, "_bucket").withColumn(name, (inner + F.col("_before")).cast("long")).drop("_bucket", "_before")


def hash_rank(df: DataFrame, hashed: Column, *ties: Column, name: str = "rank") -> DataFrame:
    """Rank in the order of a hexadecimal hash, whose first three digits make 4096 even buckets."""
    df = df.withColumn("_hash", hashed)
    return global_rank(df, F.substring("_hash", 1, 3), F.col("_hash"), *ties, name=name).drop("_hash")


def running_total(df: DataFrame, bucket: Column, order: Column, value: Column, name: str) -> DataFrame:
    """Sum of value over the rows before each row in (bucket, order)."""
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    offsets = F.broadcast(_offsets(df, "_bucket", F.sum("_value"), "_before"))
    inner = F.sum("_value").over(Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return df.join(offsets, "_bucket").withColumn(name, inner + F.col("_before")).drop("_bucket", "_before", "_value")
