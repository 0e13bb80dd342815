"""Keywords, likeness, clusters, matching, streams and hooks against plain Python on small data."""

import math
import random

from pyspark.sql import functions as F

from tidemark.functions.scoring import lag_minutes
from tidemark.operators import clusters as C
from tidemark.operators import keywords as K
from tidemark.operators import similarity as S
from tidemark.operators.rounds import dominant_pairs
from tidemark.plans import pipelines as P
from tidemark.plans.endpoints import clamp, search
from tidemark.sources import hooks
from tidemark.streaming.windows import failure_runs, sliding

WORDS = "alpha beta gamma delta omega sigma".split()


def test_idf_counts_only_posts_with_terms(spark):
    posts = spark.createDataFrame([("r", 1, []), ("r", 2, ["alpha", "beta"]), ("r", 3, [])], "block string, id int, terms array<string>")
    got = K.idf(K.term_counts(posts, "block", "id", "terms"), "block", "id").collect()
    assert {r.term: (r.df, r.idf) for r in got} == {"alpha": (1, 1.0), "beta": (1, 1.0)}


def test_generic_terms_break_ties_by_term(spark):
    stats = spark.createDataFrame([("r", w, 5 if w in "ab" else 1) for w in "abcdefghij"], "block string, term string, df int")
    assert [r.term for r in K.generic_terms(stats, "block", 0.3).orderBy("term").collect()] == ["a", "b", "c"]
    assert [r.term for r in K.generic_terms(stats, "block", 0.01).collect()] == ["a"]


def test_pick_keywords_like_a_loop(spark):
    rng = random.Random(3)
    rows = [(b, "".join(rng.choice("ab") for _ in range(rng.randint(2, 7))), float(i)) for b in ("x", "y") for i in range(200)]
    rows = list({(b, t): (b, t, s) for b, t, s in rows}.values())
    want = {}
    for b in ("x", "y"):
        taken = []
        for _, t, _s in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1])):
            if len(taken) < 5 and not any(min(len(t), len(u)) >= 4 and (t in u or u in t) for u in taken):
                taken.append(t)
        want[b] = taken
    got = K.pick_keywords(spark.createDataFrame(rows, "b string, term string, score double"), "b", 5).orderBy("b", "place").collect()
    assert {b: [r.keyword for r in got if r.b == b] for b in ("x", "y")} == want
    assert K.pick_keywords(spark.createDataFrame([], "b string, term string, score double"), "b").count() == 0


def test_matches_want_every_word(spark):
    posts = spark.createDataFrame([("r", 1, ["a", "b", "b"]), ("r", 2, ["a"]), ("q", 3, ["a", "b"]), ("r", 4, None)], "b string, id int, tokens array<string>")
    words = spark.createDataFrame([("r", "a b"), ("r", "a")], "b string, keyword string")
    assert sorted((r.keyword, r.id) for r in K.matches(posts, words, "b", "id", "tokens").collect()) == [("a", 1), ("a", 2), ("a b", 1)]


def test_burst_of_bulletins(spark):
    end = "2026-04-19 12:00:00"
    rows = [("quake", f"{h} hours") for h in range(2, 26)] + [("quake", f"{m} minutes") for m in range(5, 13)] + [("sport", "30 hours")]
    posts = spark.createDataFrame(rows, "k string, ago string").withColumn("at", F.lit(end).cast("timestamp_ntz") - F.when(F.col("ago").endswith("hours"), F.make_interval(hours=F.split("ago", " ")[0].cast("int"))).otherwise(F.make_interval(mins=F.split("ago", " ")[0].cast("int"))))
    got = {r.k: r for r in K.bursts(posts, "k", "at", F.lit(end).cast("timestamp_ntz")).collect()}
    assert got["quake"].recent == 8 and got["quake"].z >= 2 and got["quake"].boost > 1
    assert got["sport"].recent == 0 and got["sport"].z < 2


def test_near_vectors_like_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [float("nan")] * 4)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(i, j) for i, a in rows[:60] for j, b in rows[:60] if i < j and round(cos(a, b), 6) >= 0.7}
    got = S.near_vectors(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 0.7)
    assert {(r.key_l, r.key_r) for r in got.collect()} == want


def test_near_vectors_are_sent_to_few_parts(spark):
    """Many small cells travel together: what is sent grows with the vectors, not with their square."""
    rng = random.Random(4)
    sent = {}
    for n in (150, 600):
        rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
        dealt, met = S._dealt, []
        try:
            S._dealt = lambda *x, dealt=dealt, met=met: met.append(dealt(*x)) or met[0]
            got = S.near_vectors(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 0.5, block=8)
            found = {(r.key_l, r.key_r) for r in got.collect()}
        finally:
            S._dealt = dealt
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        assert found == {(i, j) for i, a in rows for j, b in rows if i < j and round(cos(a, b), 6) >= 0.5}
        sent[n] = met[0].count()
    assert sent[600] <= 4.5 * sent[150] and sent[600] <= 12 * 600
    # Large cells in parts of a few vectors give the same pairs.
    got = S.near_vectors(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 0.5, block=200, held_bytes=8 * 8 * 50)
    assert {(r.key_l, r.key_r) for r in got.collect()} == found


def test_near_vectors_in_cells_and_blocks_like_all_pairs(spark):
    """Clusters far apart, one of them larger than a block, copies, vectors of another size, an empty and a null component."""
    rng = random.Random(2)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in centre[0 if i < 30 else i % 5]]) for i in range(70)] + [(i, centre[1]) for i in range(70, 74)] + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(74, 84)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and len(a) == len(b) and round(cos(a, b), 6) >= 0.8}
    odd = [(90, []), (91, [1.0, None]), (92, [float("inf"), 1.0, 0.0])]
    d = spark.createDataFrame(rows + odd, "id int, v array<double>")
    assert {(r.key_l, r.key_r) for r in S.near_vectors(d, "id", "v", 0.8, block=8).collect()} == want
    assert S.near_vectors(d.limit(0), "id", "v", 0.8).count() == 0


def test_bag_pairs_like_all_pairs(spark):
    """A word that all rows hold, copies, one-word and empty bags, at several thresholds and in blocks."""
    rng = random.Random(3)
    rows = [(i, i % 2, ["the"] * rng.randint(0, 4) + [rng.choice("abcdefghij") for _ in range(rng.randint(0, 6))]) for i in range(60)] + [(60, 0, ["the"]), (61, 1, ["the"]), (62, 0, []), (63, 0, None)]
    d = spark.createDataFrame(rows, "id int, b int, w array<string>")

    def cos(a, b):
        dot = sum(a.count(w) * b.count(w) for w in set(a))
        return dot / math.sqrt(sum(a.count(w) ** 2 for w in set(a)) * sum(b.count(w) ** 2 for w in set(b)))

    for threshold, block in ((0.3, ()), (0.8, ("b",)), (1.0, ())):
        want = {(i, j) for i, g, a in rows for j, h, b in rows if a and b and (not block or g == h) and round(cos(a, b), 6) >= threshold and set(a) & set(b)}
        assert {(r.key_l, r.key_r) for r in S.bag_pairs(d, d, "id", "w", threshold, block).collect()} == want


def topics(spark, rows):
    return spark.createDataFrame(rows, "id long, region_id string, name string, keywords array<string>, v array<double>")


def test_similar_pairs_by_vector_and_by_name(spark):
    x = topics(spark, [(1, "kr", "harbour strike", ["strike"], [0.9, 0.1, 0.05]), (2, "us", "dock walkout", ["walkout"], [0.88, 0.11, 0.06]), (3, "jp", "harbour strike talks", ["strike"], None), (4, "kr", "harbour strike again", ["strike"], None), (5, "eu", "football", ["goal"], [0.0, 0.1, 0.9])])
    n = P.nodes(x, F.col("v"))
    got = {(r.key_l, r.key_r) for r in S.similar_pairs(n).collect()}
    assert got == {(1, 2), (1, 3), (3, 4)}
    assert {r.key: r.component for r in S.issues(n, S.similar_pairs(n)).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


def overlap(spark, rows):
    kind = "key long, block string, canonical string, name_tokens array<string>, keyword_tokens array<string>, entity_tokens array<string>, phrases array<string>, vector array<double>, first_at timestamp_ntz"
    from datetime import datetime

    return spark.createDataFrame([(*r[:8], datetime.fromisoformat(r[8])) for r in rows], kind)


def test_overlaps_dominant_pairs(spark):
    at = "2026-04-19 00:00:00"
    a = overlap(spark, [(1, "ar", "casa rosada", ["casa", "rosada"], ["palace"], [], [], None, at), (2, "ar", None, ["market"], [], [], [], [1.0, 0.0], at), (3, "kr", None, ["quake", "seoul"], ["quake"], [], [], None, at)])
    b = overlap(spark, [(11, "ar", "casa rosada", ["rosada"], ["palace"], [], [], None, "2026-04-19 00:45:00"), (12, "ar", None, ["market"], [], [], [], [1.0, 0.0], at), (13, "kr", None, ["quake", "seoul", "today"], ["quake"], [], [], None, "2026-04-18 23:58:00"), (14, "kr", None, ["quake", "seoul"], ["quake"], [], [], None, at)])
    got = {(r.key_l, r.key_r, r.leader, r.lag_minutes) for r in P.scope_overlaps(a, b).collect()}
    # 2 and 12 share one word and a direction, which isn't evidence enough.
    assert got == {(1, 11, "community", 45), (3, 14, "tie", 0)}


def test_one_to_one_like_a_loop(spark):
    rng = random.Random(5)
    rows = [("r", i, j, round(rng.random(), 1)) for i in range(12) for j in range(12) if rng.random() < 0.4]
    l, r, want = set(), set(), set()
    for _, i, j, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if i not in l and j not in r:
            l.add(i), r.add(j), want.add((i, j))
    got = dominant_pairs(spark.createDataFrame(rows, "b string, i int, j int, s double"), "b", "i", "j", [("s", False)])
    assert {(x.i, x.j) for x in got.collect()} == want


def test_seeded_clusters(spark):
    words = spark.createDataFrame([("r", "harbour strike", 9.0, 1), ("r", "union", 5.0, 2), ("r", "harbour strike talks", 4.0, 3), ("r", "lottery", 3.0, 4), ("r", "nothing", 2.0, 5)], "b string, keyword string, score double, place int")
    has = {"harbour strike": [1, 2, 3], "union": [1, 2], "harbour strike talks": [9], "lottery": [7]}
    members = spark.createDataFrame([("r", k, p) for k, ps in has.items() for p in ps], "b string, keyword string, id int")
    got = C.seeded_clusters(words, members, "b", "id").collect()
    # The last two seeds: one post and one word, and no post at all.
    assert sorted((r.cluster, r.keyword, r.lead) for r in got) == [(1, "harbour strike", True), (1, "harbour strike talks", False), (1, "union", False)]
    assert {r.id for r in C.cluster_posts(C.seeded_clusters(words, members, "b", "id"), members, "b", "id").collect()} == {1, 2, 3, 9}


def test_labels(spark):
    x = spark.createDataFrame([("news update",), ("12345",), ("harbour",), ("port",), ("harbour strike",), ("지진 속보",), ("ab",)], "s string")
    assert [r.ok for r in x.select(C.names_something(F.col("s")).alias("ok")).collect()] == [False, False, True, False, True, True, False]


def test_regional_and_snapshot(spark):
    from datetime import datetime

    at = datetime(2026, 4, 19, 11, 30)
    rows = [("kr", i, f"s{i % 3}", f"harbour strike talks reach {w}", 100, 5, 2, at) for i, w in enumerate(WORDS)] + [("kr", 50, "s1", None, 0, 0, 0, None), ("us", 60, "s2", "", 0, 0, 0, at)]
    posts = spark.createDataFrame(rows, "region_id string, id long, source_id string, title string, views long, likes long, comments long, posted_at timestamp_ntz")
    out = P.regional(posts, F.lit("2026-04-19 12:00:00").cast("timestamp_ntz"))
    top = out.orderBy("rank").first()
    assert top.region_id == "kr" and top.post_count == 6 and top.sources == 3 and top.heat > 0
    assert P.snapshot(out).first().topics == out.count()


def test_velocity_of_the_global_job(spark):
    from datetime import datetime

    now = datetime(2026, 4, 19)
    rows = spark.createDataFrame([("x", 900.0, ["kr", "jp"])], "name string, heat double, regions array<string>")
    past = spark.createDataFrame([("x", 500.0, datetime(2026, 4, 18, 22)), ("x", 650.0, datetime(2026, 4, 18, 23))], "name string, heat double, at timestamp_ntz")
    got = P.propagation(rows, past, F.lit(now).cast("timestamp_ntz")).first()
    assert (got.velocity, got.acceleration, got.spread) == (250.0, 100.0, 4.0)
    line = spark.sql("select array(named_struct('first_at', timestamp_ntz '2026-04-19 00:00:00', 'region_id', 'kr'), named_struct('first_at', timestamp_ntz '2026-04-19 02:00:00', 'region_id', 'jp')) as t, array() as none")
    edge = line.select(P.timeline_edges(F.col("t")).alias("e")).first().e
    assert [(e["from"], e["to"], e.lag_minutes, e.confidence) for e in edge] == [("kr", "jp", 120, 0.9167)]


def test_global_job_by_scope(spark):
    from datetime import datetime

    from tidemark.plans.analysis import q20

    rows = [(10 * d + i, r, s, f"{r} HARBOUR", 100.0 + d, d) for d in range(1, 6) for i, (r, s) in enumerate([("AFRICA", "news"), ("EUROPE", "news"), *([("AFRICA", "community"), ("EUROPE", "community"), ("ASIA", "community")] if d == 1 else [])])]
    x = spark.createDataFrame([(*r[:5], 0.1, datetime(2001, 7, r[5]), 1) for r in rows], "id long, region_id string, scope string, name string, heat double, sentiment double, created_at timestamp_ntz, rank int")
    # ASIA's topic has no source of its region.
    own = spark.createDataFrame([(r[0], "s0" if r[1] == "ASIA" else "s1") for r in rows], "topic_id long, source_id string")
    sources = spark.createDataFrame([("s0", "r2"), ("s1", "r1")], "id string, region_id string")
    got = {r.scope: r for r in q20({"topics": x, "topic_sources": own, "sources": sources}.get).collect()}
    assert {s: r.topic_ids for s, r in got.items()} == {"community": [12, 13], "news": [30, 31, 40, 41, 50, 51]}
    assert all(r.regions == ["AFRICA", "EUROPE"] and r["rank"] == 1 for r in got.values())


def test_search_and_clamp(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, None)], "id int, v array<double>")
    assert [(r.id, r.cosine) for r in search(v, [1, 0], "id", "v").collect()] == [(1, 1.0), (3, 0.707107)]
    assert (clamp("7", 1, 5, 2), clamp(None, 1, 5, 2), clamp(-3, 1, 5, 2)) == (5, 2, 1)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", f"2026-01-01 0{i}:00:00", s) for i, s in enumerate(["success", "failed", "failed", "failed", "failed", "success"])] + [("b", "2026-01-01 00:00:00", "failed"), (None, "2026-01-01 00:00:00", "failed")]
    frame = spark.createDataFrame(rows, "source string, at string, status string").withColumn("at", F.col("at").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(frame.schema).parquet(str(src))
    q = failure_runs(stream, "source", "at", "status").writeStream.format("memory").queryName("fails").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.source, r.failures) for r in spark.table("fails").collect()] == [("a", 3)]
    q = sliding(stream, "at", "source", "3 hours").writeStream.format("memory").outputMode("update").queryName("slide").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("slide").filter("source = 'a'").agg(F.max("n")).first()[0] == 3


def test_hooks(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "de")]
    got = hooks.with_embeddings(spark.createDataFrame(rows, "id int, s string"), "s", lambda texts: [[float(len(t))] for t in texts], batch=1)
    assert {r.id: r.vector for r in got.collect()} == {1: [3.0], 2: None, 3: None, 4: [2.0]}
    x = spark.createDataFrame([('```json\n{"topics":[{"name":"a"}]}\n```',), ('[{"name":"b"}]',), ("nonsense",)], "s string").select(hooks.parsed_topics(F.col("s")).alias("t"))
    assert [r.t and r.t[0].name for r in x.collect()] == ["a", "b", None]
    y = spark.sql("select array(named_struct('text', ' Ann ', 'type', 'PERSON'), named_struct('text', '', 'type', 'x'), named_struct('text', 'Foo', 'type', 'gadget')) as e").select(hooks.entities(F.col("e")).alias("e")).first().e
    assert [(e.text, e.type) for e in y] == [("Ann", "person"), ("Foo", "other")]
    z = spark.createDataFrame([(None, " ", ["k", "l"], "n"), ("One. Two.", "t", [], "n")], "e string, t string, k array<string>, n string").select(hooks.fallback_summary(F.col("e"), F.col("t"), F.col("k"), F.col("n")).alias("s"))
    assert [r.s for r in z.collect()] == ["k, l", "One."]


def test_lag_rounds_up(spark):
    x = spark.sql("select timestamp_ntz '2026-01-01 00:00:00' as a, timestamp_ntz '2026-01-01 00:00:30' as b").select(lag_minutes(F.col("a"), F.col("b")).alias("f"), lag_minutes(F.col("b"), F.col("a")).alias("r")).first()
    assert (x.f, x.r) == (1, 0)


def test_best_terms_like_the_plain_way(spark):
    """Read in parts, with ties of score and of generic terms, copies, a repeated key, an empty post and nulls."""
    rng = random.Random(8)
    words = [a + b + c for a in "abcdefgh" for b in "xyz" for c in ("", "longer tail", "longer trail", " e")]
    rows = [(rng.choice(["r", "q"]), i, [rng.choice(words[: rng.choice([9, 96])]) for _ in range(rng.choice([3, 40, 90]))] + [f"only {i}"] * (i % 3 == 0), float(1 + i % 4)) for i in range(60)]
    rows += [(r[0], 100 + r[1], r[2], r[3]) for r in rows[:12]] + [("r", 300, [], 1.0), ("r", 301, None, 1.0)]
    kind = "block string, id int, terms array<string>, w double"
    kept = lambda x: sorted((r.block, r.id, r.place, r.term, r.score, r.df) for r in x.collect())
    run = lambda f, d, g, *more: kept(f(d, "block", "id", F.col("terms"), F.col("w"), K.phrase_boost, 5, g, *more))
    for more in ([], [("r", 0, ["ax", "bx"], 1.0), ("r", 0, ["ax"], 1.0)]):
        d = spark.createDataFrame(rows + more, kind)
        for share in (None, 0.05, 0.3):
            want = run(K._plain_best, d, share)
            assert want or share == 0.999
            for first in (None, 6):
                assert run(K.best_terms, d, share, first) == want, (share, first, len(more))


def test_scope_overlaps_of_more_than_4500_topics(spark, tmp_path):
    """A cold topic far down its side still finds its partner."""
    from tidemark import catalogue

    n, write = 4600, lambda rows, names, t: spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/{t}.parquet")
    write([(0, "AFRICA")], "r_regionkey int, r_name string", "region")
    write([(0, "ALGERIA", 0)], "n_nationkey int, n_name string, n_regionkey int", "nation")
    write([(1, 0, "BUILDING"), (2, 0, "MACHINERY")], "c_custkey bigint, c_nationkey int, c_mktsegment string", "customer")
    rows = [(i, 1, "O", 1000.0 + i) for i in range(1, n + 1)] + [(n + 1, 2, "O", 1.0), (n + 2, 2, "F", 1.0)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    orders.withColumn("o_orderdate", F.lit("2001-01-01").cast("timestamp_ntz")).withColumn("o_orderpriority", F.lit("1-URGENT")).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()["g03_scope_overlaps"](spark, str(tmp_path)).collect()
    assert [(r["key_l"], r["key_r"]) for r in got] == [(n + 1, n + 2)]


def test_best_ngrams_like_the_plain_way(spark, monkeypatch):
    """Terms hashed and counted in Arrow batches: the same best terms as by strings, whichever share of a post is read at first."""
    from tidemark.functions import titles
    from tidemark.operators import ngrams

    rng = random.Random(3)
    vocab = ["alpha", "beta", "be-ta", "gam", "gamma", "2x", "2xy", "delta.v", "東京", "東京都", "abc", "abcd"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    rows = [(rng.choice("abc"), i, [rng.choice(vocab[: rng.choice([4, 15, 72])]) for _ in range(rng.choice([0, 1, 3, 8, 30, 120]))], rng.choice([1.0, 2.5, 0.0])) for i in range(80)]
    rows += [("d", 1000, ["solo", "two", "three"], 1.0), ("e", 1001, [], 1.0), (None, 1002, ["alpha", "beta"], 1.0)]
    p = spark.createDataFrame(rows, "b string, id long, words array<string>, w double").cache()
    told = lambda x: sorted((r["b"], r["id"], r["place"], r["term"], round(r["score"], 9), r["df"]) for r in x.collect())
    plain = told(K._plain_best(p.filter("b is not null"), "b", "id", F.concat("words", titles.phrases(F.col("words"), F.col("b"))), F.col("w"), K.phrase_boost, 40, 0.02))
    monkeypatch.setattr(ngrams, "PLACE", 400)
    assert plain == told(ngrams.best_ngrams(p, "b", "id", "words", F.col("w")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert plain == told(ngrams.best_ngrams(p, "b", "id", "words", F.col("w"), first=41))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tokens_by_the_short_way_like_the_long_one(spark, monkeypatch):
    """Plain words and long titles take short ways; with these shut the tokens are the same."""
    from tidemark.functions import titles

    said = ["  [단독] 충격! BTS 신곡 공개 - YouTube #shorts", "lol lolz WWW www1 2024-01-05 a-b--c x.y. don't" + " word" * 40 + " !!!  ", "x " * 50 + "end!!!\r\n", "東京で速報 v2 a1 é für naïve" + " word" * 30 + "…©", None, " ~ " * 60, "ends" + " !  " * 40, "word " * 30 + "-" * 80]
    d = spark.createDataFrame([(t, r, "youtube_a") for t in said for r in ("kr", None)], "t string, r string, s string")
    short = d.select(titles.tokens(F.col("t"), F.col("r"), F.col("s"))).collect()
    for name, value in (("SIMPLE", "^(?!)"), ("SHORT", "^(?!)"), ("TAIL", 1 << 20)):
        monkeypatch.setattr(titles, name, value)
    assert short == d.select(titles.tokens(F.col("t"), F.col("r"), F.col("s"))).collect()
