"""The job's later steps against plain Python, and day tables against one table over all days."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitoring as M
from tidemark.operators.daily import keep, look_back
from tidemark.plans import regional_job as J

NOW = datetime(2026, 4, 19, 12)
TOPIC = "region_id string, scope string, name string, category string, keywords array<string>, heat double, sentiment double, post_count long"


def at(x):
    return F.lit(x.isoformat(" ")).cast("timestamp_ntz")


def made(spark, seed, n=12):
    rng = random.Random(seed)
    rows = [(r, "mixed", f"name {i}", rng.choice(["a", "b", None]), [f"k{i}"], round(rng.uniform(1, 900), 3), rng.choice([None, 0.5]), i) for r in ("kr", "us") for i in range(n)]
    return rows, spark.createDataFrame(rows, TOPIC)


def stage(now, started, heat, past):
    """past: (at, heat) by time."""
    first = past[0][0] if past else started
    if now - first < timedelta(hours=6):
        return "emerging"
    peak = max([h for _, h in past] + [heat])
    falls = len(past) >= 2 and heat < past[-1][1] < past[-2][1] and heat < peak
    return "fading" if falls else "peaking"


def test_days_of_runs_equal_one_loop_over_all(spark, tmp_path):
    root = f"file://{tmp_path}"
    runs = [NOW + timedelta(hours=h) for h in (0, 5, 24, 30, 31, 96, 24 * 7, 24 * 9)]
    kept, history = [], {}
    for n, now in enumerate(runs):
        rows, topics = made(spark, n)
        got = {(r.region_id, r.name): r for r in J.finish(topics, root, at(now), "mixed").collect()}
        assert len(got) == len(rows)
        for r, _, name, cat, _, heat, _, _ in rows:
            days = {}
            for t, region, c, mean, std in kept:
                if (region, c) == (r, cat or "other") and 0 <= (now.date() - t.date()).days <= 7:
                    days[t.date()] = (mean, std)  # the day's last run counts
            mean, std = (sum(d[i] for d in days.values()) / len(days) if days else 0.0 for i in (0, 1))
            z = got[r, name].anomaly
            assert (z is None) == (std <= 0) and (z is None or math.isclose(z, (heat - mean) / std, abs_tol=6e-4)), (n, r, name)
            past = [p for p in history.get((r, name), []) if p[0] >= now - timedelta(hours=72)]
            assert got[r, name].lifecycle == stage(now, now - timedelta(hours=6), heat, past), (n, r, name)
        for r, c in {(x[0], x[3] or "other") for x in rows}:
            h = [x[5] for x in rows if (x[0], x[3] or "other") == (r, c)]
            mean = sum(h) / len(h)
            kept.append((now, r, c, mean, math.sqrt(sum((v - mean) ** 2 for v in h) / len(h))))
        for x in rows:
            history.setdefault((x[0], x[2]), []).append((now, x[5]))
    # A run that is repeated gives the same rows and leaves the same tables.
    count = lambda: {t: sorted(map(str, spark.read.parquet(f"{root}/{t}").collect())) for t in ("baselines", "heat_history", "topics", "region_snapshots")}
    before, again = count(), J.finish(made(spark, len(runs) - 1)[1], root, at(runs[-1]), "mixed")
    assert {(r.region_id, r.name): (r.anomaly, r.lifecycle) for r in again.collect()} == {k: (r.anomaly, r.lifecycle) for k, r in got.items()}
    assert count() == before and len(before["heat_history"]) == len(runs) * len(rows)
    # Only the days that count are read.
    plan = look_back(spark, f"{root}/baselines", J.BASELINES, at(runs[-1]), days=7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(look_back(spark, f"{root}/baselines", J.BASELINES, at(runs[-1]), days=7).inputFiles()) <= 8


def test_keep_rewrites_its_own_days_only(spark, tmp_path):
    import os

    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", 1, NOW), (None, 2, NOW - timedelta(days=1))], "k string, v int, at timestamp_ntz")
    keep(rows, path, ["k", "at"])
    old = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.startswith("day=2026-04-18")}
    keep(rows.limit(0), path, ["k", "at"])
    keep(spark.createDataFrame([("a", 3, NOW), ("b", 4, NOW)], rows.schema), path, ["k", "at"])
    assert sorted((r.k or "", r.v) for r in spark.read.parquet(path).collect()) == [("", 2), ("a", 3), ("b", 4)]
    assert {f: os.stat(f"{path}/{f}").st_mtime_ns for f in old} == old and old
    with pytest.raises(ValueError, match="rows without at"):
        keep(spark.createDataFrame([("a", 3, None)], rows.schema), path, ["k", "at"])


def tokens(x):
    import re
    import unicodedata

    return [w for w in re.sub(r"[^\w\s]|_", " ", unicodedata.normalize("NFKC", x).lower()).split() if len(w) >= 2][:64]


def test_portal_boost_like_two_loops(spark):
    rng = random.Random(5)
    words = ["harbour", "strike", "port", "talks", "ｗｉｄｅ", "wide", "항만", "a"]
    pick = lambda k: [rng.choice(words) for _ in range(k)]
    topics = [(rng.choice(["kr", "us"]), " ".join(pick(1)), " ".join(pick(2)), pick(rng.randint(0, 2)) or None, float(i + 1)) for i in range(60)] + [("kr", None, None, None, 9.0), ("jp", "a", "", [], 8.0)]
    signals = [(rng.choice(["kr", "us"]), rng.choice([1, 3, 20, 21, 50, None, -4]), ", ".join(pick(rng.randint(1, 4)))) for _ in range(80)] + [("kr", 1, None), ("kr", 2, "!!")]
    want = []
    for r, ko, en, kw, heat in topics:
        a, w = Counter(tokens(" ".join(x for x in [ko, en, *(kw or [])] if x))), 0.0
        for s, rank, line in signals:
            b = Counter(tokens(line or ""))
            if s == r and a and b:
                cosine = sum(a[t] * b[t] for t in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
                w += max(0, (21 - max(1, min(100, 100 if rank is None else rank))) / 20) * (round(cosine, 6) >= 0.8)
        want.append((r, ko or "", en or "", round(heat * min(1 + 0.08 * w, 1.6), 4)))
    t = spark.createDataFrame(topics, "region_id string, name_ko string, name_en string, keywords array<string>, heat double")
    s = spark.createDataFrame(signals, "region_id string, rank int, headline string")
    got = sorted((r.region_id, r.name_ko or "", r.name_en or "", r.heat) for r in M.portal_boosted(t, s).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(math.isclose(g[3], w[3], abs_tol=2e-4) for g, w in zip(got, sorted(want), strict=True))
    assert sum(g[3] not in {t[4] for t in topics} for g in got) > 5
    assert M.portal_boosted(t, s.limit(0)).count() == len(topics) and M.portal_boosted(t.limit(0), s).count() == 0


def test_excerpts(spark):
    rows = [("x", "1", "a", "A", "Alpha.", 100, 10, 5), ("x", "2", "b", " B ", "Beta  one. Two", 2000, 100, 30), ("x", "3", "c", "C" * 200, "Gamma" * 100, 50, 2, 1), ("x", "4", "d", "D", None, 500, 40, 12), ("x", "5", "e", "  ", "none", 9**9, 0, 0), ("y", "6", "f", None, "none", 1, 1, 1)]
    posts = spark.createDataFrame(rows, "g string, id string, source_id string, title string, body_preview string, views long, likes long, comments long").withColumn("posted_at", at(NOW))
    got = M.excerpts(posts, ["g"]).collect()
    assert [r.g for r in got] == ["x"]
    assert [(e.title, e.snippet, e.source_id) for e in got[0].excerpts] == [("B", "Beta one.", "b"), ("D", "", "d"), ("A", "Alpha.", "a")]


def test_a_run_from_posts_to_tables(spark, tmp_path):
    words = "alpha beta gamma delta omega sigma".split()
    rows = [("kr", i, f"s{i % 3}", f"harbour strike talks reach {w}", "First. Second.", 100, 5, 2, NOW - timedelta(minutes=30)) for i, w in enumerate(words)]
    posts = spark.createDataFrame(rows, "region_id string, id long, source_id string, title string, body_preview string, views long, likes long, comments long, posted_at timestamp_ntz")
    signals = spark.createDataFrame([("kr", 1, "old", NOW - timedelta(hours=9))], "region_id string, rank int, headline string, captured_at timestamp_ntz")
    root = f"file://{tmp_path}"
    plain = J.run(posts, signals, root, at(NOW), "news").orderBy("rank").collect()
    assert plain and plain[0].rank == 1 and plain[0].name and plain[0].canonical_key == plain[0].name.lower() and plain[0].band == "high"
    assert plain[0].excerpts[0].snippet == "First." and plain[0].lifecycle == "peaking" and plain[0].expires_at == NOW + timedelta(hours=48)
    said = " ".join([plain[0].name_ko, plain[0].name_en, *plain[0].keywords])
    loud = J.run(posts, spark.createDataFrame([("kr", 1, said, NOW - timedelta(hours=1))], signals.schema), root, at(NOW + timedelta(hours=1)), "news").orderBy("rank").collect()
    assert loud[0].heat > 0 and loud[0].lifecycle == "emerging"
    snaps = spark.read.parquet(f"{root}/region_snapshots").orderBy("at").collect()
    assert [s.topics for s in snaps] == [len(plain), len(loud)] and {s.scope for s in snaps} == {"news"}
    with pytest.raises(ValueError, match="scope"):
        J.run(posts, signals, root, at(NOW), "all")
