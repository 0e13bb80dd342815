"""Comparison of a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("-" if pd.isna(x) else str(x)[:19] if hasattr(x, "year") else f"{float(x):.4f}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in frame.itertuples(index=False))


def compare(spark, fn, sql: str, sf_dir: str, c=None) -> str:
    """Empty if both give the same columns and rows."""
    got, want = fn(spark, sf_dir).toPandas(), (c or connect(sf_dir)).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} differ, first {bad[0]}" if bad else ""
