"""One row or the first rows of each key, and merges by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of every key; Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def distinct_on(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order."""
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """Rows of both, new ones winning by key; the named columns keep the old value where the new is null.

    One full outer join by key; with tables bucketed by key nothing is shuffled.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there = F.col("n._new").isNotNull()
    n = new.withColumn("_new", F.lit(True)).alias("n")

    def pick(c: str) -> Column:
        newest = F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old_if_null else F.col(f"n.{c}")
        return F.when(there, newest).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, on, "full_outer").select(*(pick(c) for c in old.columns))


def append_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: new rows whose key the old table lacks."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def top_up(fresh: DataFrame, stale: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Up to `limit` rows: fresh ones first, then stale ones whose key isn't among them."""
    both = fresh.withColumn("stale", F.lit(0)).unionByName(stale.join(fresh.select(key).distinct(), key, "left_anti").withColumn("stale", F.lit(1)))
    return both.orderBy("stale", *order).limit(limit)


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of `first`, or all of `second` where that is empty, in one plan."""
    some = first.limit(1).agg((F.count(F.lit(1)) > 0).alias("_some"))
    return first.unionByName(second.join(F.broadcast(some), ~F.col("_some")).drop("_some"))


def retain(df: DataFrame, time: str, as_of: Column, days: int) -> DataFrame:
    """Rows not older than so many days (retention delete as a rewrite; drop partitions where there are any)."""
    return df.filter(F.col(time) >= as_of - F.make_interval(days=F.lit(days)))
