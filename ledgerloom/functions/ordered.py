"""Order-dependent columns over groups of any size.

A plain window sorts a whole group in one task. Here a group is cut into buckets of its order (a block of keys, an hour):
windows run within buckets, and what earlier buckets add comes from one row a bucket. No task holds more than a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carry(df: DataFrame, keys: list[str], bucket: str, total: Column, name: str) -> DataFrame:
    """One row a bucket: the sum of ``total`` over earlier buckets of the group."""
    sums = df.groupBy(*keys, bucket).agg(total.alias("_own"))
    earlier = F.sum("_own").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(*keys, bucket, F.coalesce(earlier, F.lit(0)).cast("bigint").alias(name))


def numbered(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Dense numbers from 0 within ``keys``, in the order of (bucket, order). The bucket must rise with the order."""
    base = _carry(df, keys, bucket, F.count("*"), "_base")
    inner = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    return df.withColumn("_inner", inner).join(base, [*keys, bucket]).withColumn(name, (F.col("_base") + F.col("_inner")).cast("bigint")).drop("_base", "_inner")


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all earlier rows of the group (exclusive)."""
    base = _carry(df, keys, bucket, F.sum(value), "_base")
    inner = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(base, [*keys, bucket]).withColumn(name, (F.col("_base") + F.col("_inner")).cast("bigint")).drop("_base", "_inner")


def previous(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """``value`` of the row before, within ``keys``; null for the first."""
    last = df.groupBy(*keys, bucket).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy(bucket))).select(*keys, bucket, "_before")
    inner = F.lag(F.struct(value)).over(Window.partitionBy(*keys, bucket).orderBy(*order))
    out = df.withColumn("_inner", inner).join(before, [*keys, bucket])
    return out.withColumn(name, F.coalesce("_inner", "_before")[value]).drop("_inner", "_before")
