"""Tables kept by day: what a run adds rewrites its own days, what it looks back on reads a few days and not the history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed import upsert
from .store import written


def _read(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was kept yet
        return spark.createDataFrame([], schema)


def keep(rows: DataFrame, path: str, keys: Sequence[str], time: str = "at") -> None:
    """Add rows to the table at `path`, partitioned by `day` (of `time`); a row whose key is there replaces the old one.

    Keys are null-safe and hold the time, so that no row changes its day; of rows that repeat a key one stays.  Only
    the days that the rows fall into are read and overwritten, each as a whole, so a run that is started again after
    it was cut off leaves the same table.  Rows without a time are refused, as no day would be theirs.
    """
    new = written(rows.withColumn("day", F.to_date(time)).dropDuplicates(list(keys)))
    days = [r["day"] for r in new.select("day").distinct().collect()]  # one value a day
    if None in days:
        raise ValueError(f"rows without {time}")
    if not days:
        return
    old = _read(new.sparkSession, path, new.schema).filter(F.col("day").isin(days))
    # Written aside first: a partition isn't overwritten while it is being read.
    merged = written(upsert(old, new, list(keys)))
    merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def look_back(spark: SparkSession, path: str, schema, as_of: Column, days: int = 0, hours: int = 0, time: str = "at") -> DataFrame:  # noqa: ANN001
    """Rows of the table from `days` whole days, or `hours`, before `as_of` up to it, itself left out.

    The filter on `day` leaves the other days' folders unread.  What was kept for `as_of` itself, by a run that is
    now repeated, doesn't count.
    """
    since = F.date_sub(F.to_date(as_of), days) if days else F.to_date(as_of - F.make_interval(hours=F.lit(hours)))
    x = _read(spark, path, schema).filter(F.col("day").between(since, F.to_date(as_of)) & (F.col(time) < as_of))
    return x.filter(F.col(time) >= as_of - F.make_interval(hours=F.lit(hours))) if hours else x
