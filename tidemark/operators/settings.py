"""Settings with a trail of who changed what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUE, FALSE = ("true", "1", "on", "yes"), ("false", "0", "off", "no")


def normalised(value: Column, kind: Column) -> Column:
    """The value as text of its kind (number, boolean, text); null where it isn't one."""
    low = F.lower(F.trim(value))
    number = low.try_cast("double")
    flag = F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false")
    return F.when(kind == "number", F.when(number.isNotNull() & ~F.isnan(number), number.cast("string"))).when(kind == "boolean", flag).otherwise(F.nullif(F.trim(value), F.lit("")))


def applied(settings: DataFrame, definitions: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settings after the changes, trail of the changes, changes refused).

    settings: key, value, updated_at, one row a key.  definitions: key, kind, one row a key.  changes:
    key, value, actor, changed_at.  A change of an unknown key, without a time or with a value that isn't
    of the key's kind is refused.  Changes of one key follow each other by time, then value, then actor.
    """
    tried = changes.join(definitions, "key", "left").withColumn("after", normalised(F.col("value"), F.col("kind")))
    good = F.col("kind").isNotNull() & F.col("after").isNotNull() & F.col("changed_at").isNotNull()
    refused = tried.filter(~good).select("key", "value", "actor", "changed_at", F.when(F.col("kind").isNull(), "unknown key").when(F.col("changed_at").isNull(), "no time").otherwise("invalid value").alias("reason"))
    by = Window.partitionBy("key").orderBy("changed_at", "after", "actor")
    old = settings.select("key", F.col("value").alias("_old"))
    trail = tried.filter(good).join(old, "key", "left").select("key", F.when(F.row_number().over(by) == 1, F.col("_old")).otherwise(F.lag("after").over(by)).alias("before"), "after", F.coalesce(F.nullif(F.trim("actor"), F.lit("")), F.lit("unknown")).alias("actor"), "changed_at", F.row_number().over(by).alias("n"))
    last = trail.groupBy("key").agg(F.max_by("after", "n").alias("_value"), F.max("changed_at").alias("_at"))
    after = settings.select("key", "value", "updated_at").join(last, "key", "full").select("key", F.coalesce("_value", "value").alias("value"), F.coalesce("_at", "updated_at").alias("updated_at"))
    return after, trail.drop("n"), refused
