"""Joins of many rows with few keys to a table of one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that meet in one place; a key of more is spread over as many places as it takes.
SHARE, PLACES = 200_000, 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "left", share: int = SHARE) -> DataFrame:
    """left JOIN right ON key, where right has one row a key and `weight` rows of left bear it.

    Keys of more than `share` rows are dealt over salts: the rows of left by a hash of their place, the row
    of right to each of them.  There are at most rows / share such keys, so they may be broadcast.
    """
    n = F.least(F.lit(PLACES), F.ceil(F.col(weight) / share)).cast("int")
    heavy = right.filter(F.col(weight) > share).select(F.col(key).alias("_key"), n.alias("_places"))
    salt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_places")).cast("int"), F.lit(0))
    l = left.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left").withColumn("_salt", salt).drop("_key", "_places")
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return l.join(r, [key, "_salt"], how).drop("_salt", weight)
