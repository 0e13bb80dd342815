"""Streams that act when nothing arrives: state with timers.

These need the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DUE = "source string, visited_at timestamp, due_at timestamp"


def _told(sources: list[str], visited: list[int], due: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"source": pd.Series(sources, dtype=object), "visited": pd.Series(visited, dtype="int64"), "due": pd.Series(due, dtype="int64")})


class _Due(StatefulProcessor):
    """Holds a source's latest visit; a timer at the end of its interval, moved on by each later visit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.latest = handle, handle.getValueState("latest", "at long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = self.latest.get() if self.latest.exists() else None
        new = max((max(zip(b["at"].tolist(), b["due"].tolist(), strict=True)) for b in rows if len(b)), default=None)
        if new is not None and (known is None or new > tuple(known)):
            if known is not None:
                self.handle.deleteTimer(known[1])
            self.latest.update(new)
            self.handle.registerTimer(new[1])
        yield _told([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        at, due = self.latest.get()
        yield _told([key[0]], [at], [due])

    def close(self) -> None:
        pass


def due_sources(visits: DataFrame, source: str, time: str, minutes: str, late: str = "10 minutes") -> DataFrame:
    """source, visited_at, due_at: a row for each source once the stream's time passes its interval without a visit.

    Time is the watermark, `late` behind the latest visit of any source.  A later visit moves the timer, an earlier one that
    comes late doesn't.  State is two numbers a source.  Rows without source, time or interval are left out.
    """
    ok = F.col(source).isNotNull() & F.col(time).isNotNull() & F.col(minutes).isNotNull()
    at = F.col(time).cast("timestamp")
    rows = visits.filter(ok).select(F.col(source).cast("string").alias("source"), at.alias("seen"), F.unix_millis(at).alias("at"), (F.unix_millis(at) + F.col(minutes).cast("long") * 60000).alias("due"))
    told = rows.withWatermark("seen", late).groupBy("source").transformWithStateInPandas(_Due(), "source string, visited long, due long", "append", "eventTime")
    return told.select("source", F.timestamp_millis("visited").alias("visited_at"), F.timestamp_millis("due").alias("due_at"))
