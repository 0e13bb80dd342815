"""Hourly and sliding counts, latest-wins upserts and failure runs on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import distinct_on
from ..operators.store import written


def hourly(events: DataFrame, time: str, key: str, late: str = "25 hours") -> DataFrame:
    """Counts of every (key, hour); events later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), key, "n")


def upsert_into(stream: DataFrame, path: str, keys: list[str], time: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the latest row of each key (of two with the same time the newer one) in the table at `path`.

    The table is partitioned by `_bucket`, a hash of the keys.  A batch reads the buckets that its keys fall into,
    `buckets` at most, and overwrites these partitions alone, so what it writes grows with what it
    touches and no old version stays.  A batch that is run again, or was cut off between two partitions, gives
    the same rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(path).filter(F.col("_bucket").isin(touched))
        except AnalysisException:  # the first batch of all: there is no table yet
            old = new.limit(0)
        rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        latest = written(distinct_on(rows, keys, [F.desc_nulls_last(time), F.desc("_new")]).drop("_new"))
        latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding(events: DataFrame, time: str, key: str, width: str = "25 hours", step: str = "1 hour", late: str = "25 hours") -> DataFrame:
    """Counts of every key in each window of `width`, one a `step`: what bursts are measured against."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def failure_runs(runs: DataFrame, source: str, time: str, status: str, least: int = 3) -> DataFrame:
    """source, failures, at: each time a source's failures in a row reach `least`.

    State is one number a source.  Runs count in order of time within a batch, batches as they come.
    Rows without a source or time are left out; a null status is a failure.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n = state.get[0] if state.exists else 0
        out = []
        for at, s in pd.concat(list(batches)).sort_values("at")[["at", "status"]].itertuples(index=False):
            n = 0 if s == "success" else n + 1
            if n == least:
                out.append((key[0], n, at))
        state.update((n,))
        yield pd.DataFrame(out, columns=["source", "failures", "at"])

    rows = runs.filter(F.col(source).isNotNull() & F.col(time).isNotNull()).select(F.col(source).cast("string").alias("source"), F.col(time).cast("timestamp").alias("at"), F.col(status).alias("status"))
    return rows.groupBy("source").applyInPandasWithState(step, "source string, failures long, at timestamp", "n long", "append", "NoTimeout")
