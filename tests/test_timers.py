"""Timers and keyed tables of streams, run in one go and with restarts between files."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import timers, windows

START = datetime(2026, 4, 19)
VISITS = [  # one file each: (source, minute of the visit, interval)
    [("a", 0, 30), ("b", 0, 120), ("c", 5, 30), (None, 1, 5), ("x", 2, None)],
    [("a", 20, 30), ("a", 10, 30), ("late", 60, 15)],
    [("d", 90, 30)],
    [("a", 15, 30), ("e", 300, 60)],
    [("f", 600, 60)],
]


def due_by_hand(late=10):
    """After each file the time is `late` minutes behind the latest visit, from the file after it on."""
    known, out, told = {}, set(), set()
    top = None
    for visits in [*VISITS, []]:
        seen = top
        for s, m, every in visits:
            if s is not None and every is not None and (seen is None or m >= seen - late or True):
                if known.get(s, (-1, 0)) < (m, m + every):
                    known[s] = (m, m + every)
        for m in (m for s, m, e in visits if s and e is not None):
            top = m if top is None else max(top, m)
        mark = top - late
        for s, (m, d) in known.items():
            if d <= mark and (s, d) not in told:
                told.add((s, d))
                out.add((s, m, d))
    return out


@pytest.mark.parametrize("restarts", [False, True])
def test_due_sources(spark, tmp_path, restarts):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src, out = tmp_path / "in", str(tmp_path / "out")
        src.mkdir()
        schema = "source string, at timestamp, every int"
        for n, visits in enumerate(VISITS):
            rows = [(s, START + timedelta(minutes=m), e) for s, m, e in visits]
            (spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"w{n}")))
            (part,) = Path(tmp_path / f"w{n}").glob("part-*.parquet")
            part.rename(src / f"{n}.parquet")
            if restarts or n == len(VISITS) - 1:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
                timers.due_sources(stream, "source", "at", "every").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = {(r["source"], int((r["visited_at"] - START).total_seconds() // 60), int((r["due_at"] - START).total_seconds() // 60)) for r in spark.read.parquet(out).collect()}
        assert got == {("a", 20, 50), ("b", 0, 120), ("c", 5, 35), ("late", 60, 75), ("d", 90, 120), ("e", 300, 360)} == due_by_hand()
    finally:
        spark.conf.unset(key)


def test_upsert_touches_its_buckets_alone(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "t")
    schema = "id long, ts timestamp, v string"

    def feed(n, rows):
        spark.createDataFrame([(i, START + timedelta(minutes=m), v) for i, m, v in rows], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        windows.upsert_into(stream, table, ["id"], "ts", str(tmp_path / "c"), buckets=16).awaitTermination()
        return {f: f.stat().st_mtime_ns for f in Path(table).glob("_bucket=*/*.parquet")}

    first = feed(0, [(i, 10, "old") for i in range(200)])
    second = feed(1, [(3, 20, "new"), (5, 5, "earlier"), (1000, 1, "more"), (7, 10, "same time")])
    ids = spark.createDataFrame([(3,), (5,), (1000,), (7,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b"))
    touched = {f"_bucket={r['b']}" for r in ids.collect()}
    changed = {f.parent.name for f in set(first) ^ set(second)}
    assert changed == touched and len(touched) < 16
    got = {r["id"]: r["v"] for r in spark.read.parquet(table).collect()}
    assert got == {i: "old" for i in range(200)} | {3: "new", 1000: "more", 7: "same time"}
