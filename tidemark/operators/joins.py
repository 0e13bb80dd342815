"""Joins by membership, by time and by likeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member_join(left: DataFrame, array: str, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left JOIN right ON right.key = any(left.array): explode, then an equi-join in place of a nested loop."""
    one = left.withColumn("_member", F.explode_outer(array) if how == "left" else F.explode(array))
    return one.join(right, F.col("_member") == right[key], how).drop("_member")


def latest_before(points: DataFrame, keys: Sequence[str], time: str, value: str, target: Column, name: str) -> DataFrame:
    """As-of lookup: of every key the value at the latest time not after `target`; one aggregation, no join."""
    on = F.col(time) <= target
    return points.groupBy(*keys).agg(F.max_by(F.when(on, F.col(value)), F.when(on, F.col(time))).alias(name))


def token_pairs(left: DataFrame, right: DataFrame, key: str, tokens: str, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows (key_l, key_r, shared) with a common token, equal in the blocking columns.

    Tokens are exploded and met by equi-join, so no pair without a common token is ever made.
    """
    l = left.select(*block, F.col(key).alias("key_l"), F.explode(F.array_distinct(tokens)).alias("_t"))
    r = right.select(*block, F.col(key).alias("key_r"), F.explode(F.array_distinct(tokens)).alias("_t"))
    return l.join(r, [*block, "_t"]).groupBy(*block, "key_l", "key_r").agg(F.count(F.lit(1)).alias("shared"))


def hours_filled(df: DataFrame, time: str, start: Column, end: Column, aggregates: Sequence[Column], zero: Sequence[str] = ()) -> DataFrame:
    """Hourly series with every hour of [start, end]: counts named in `zero` are 0 where there is no row, the rest null."""
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(start, end, F.expr("interval 1 hour"))).alias("bucket"))
    hourly = df.groupBy(F.date_trunc("hour", time).cast("timestamp_ntz").alias("bucket")).agg(*aggregates)
    return grid.join(hourly, "bucket", "left").fillna(0, list(zero))
