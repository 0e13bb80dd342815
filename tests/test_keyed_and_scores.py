"""Order-dependent operators and scores on small inputs."""

from pyspark.sql import functions as F

from tidemark.functions import arrays, scoring, text, titles
from tidemark.operators.graph import connected
from tidemark.operators.joins import latest_before, token_pairs
from tidemark.operators.rounds import dominant_pairs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scores(spark):
    got = one(spark, scoring.anomaly(F.lit(180.0), F.lit(120.0), F.lit(20.0)), scoring.anomaly(F.lit(1.0), F.lit(1.0), F.lit(0.0)), scoring.js_round(F.lit(-2.5)), scoring.leader(F.lit(45)), scoring.leader(F.lit(-9)), scoring.edge_confidence(F.lit(120)), scoring.news_fallback(F.lit(0.0), F.lit(5), F.lit("news")), scoring.spread(F.lit(2), F.lit(250.0), F.lit(250.0)))
    assert (got[0], got[1], got[2], got[3], got[4]) == (3.0, None, -2.0, "community", "tie")
    assert abs(got[5] - 0.9167) < 1e-4 and 40 < got[6] < 420 and got[7] == 4.0


def test_sentiment_distribution(spark):
    got = one(spark, scoring.sentiment_distribution(F.lit(0.7)).alias("d"))["d"]
    assert abs(sum(got) - 1) < 1e-9 and got["positive"] == max(got)


def test_arrays(spark):
    a, b = F.array(*map(F.lit, (0.9, 0.1, 0.05))), F.array(*map(F.lit, (0.88, 0.11, 0.06)))
    got = one(spark, arrays.cosine(a, b), arrays.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), arrays.dice(F.array(F.lit(1)), F.array(F.lit(1))), arrays.overlaps(F.lit(None).cast("array<int>"), F.array(F.lit(1))))
    assert got[0] > 0.99 and abs(got[1] - 1 / 3) < 1e-9 and got[2] == 1.0 and got[3] is False


def test_text(spark):
    got = one(spark, titles.tokens(F.lit("Street fighter https://x.y 2024 조회는 ab"), F.lit("kr")), text.clamp(F.lit("a" * 400), 280), text.error_code(F.lit("Request failed: status 403")), text.is_placeholder(F.lit("Global Topic 6")), text.lexicon_score(F.lit("good good bad"), ["good"], ["bad"]))
    assert got[0] == ["street", "fighter", "조회"] and len(got[1]) == 280 and got[2] == "http_403" and got[3] and got[4] == 0.0


def test_components(spark):
    got = connected(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}


def test_matching_uses_each_side_once(spark):
    pairs = spark.createDataFrame([("r", 1, 10, 0.9), ("r", 1, 11, 0.8), ("r", 2, 10, 0.85), ("r", 2, 11, 0.5)], "region string, c long, n long, score double")
    assert {(r["c"], r["n"]) for r in dominant_pairs(pairs, "region", "c", "n", [("score", False)]).collect()} == {(1, 10), (2, 11)}


def test_as_of_and_token_pairs(spark):
    points = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 7.0), ("b", 4, 1.0)], "k string, t int, v double")
    assert {tuple(r) for r in latest_before(points, ["k"], "t", "v", F.lit(2), "x").collect()} == {("a", 5.0), ("b", None)}
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "x"]), (3, ["z"])], "id long, w array<string>")
    assert {tuple(r) for r in token_pairs(rows, rows, "id", "w").filter("key_l < key_r").collect()} == {(1, 2, 2)}


def test_components_of_chains_move_a_few_times_their_edges(spark):
    """Chains in order, in any order, a star, a loop, a null: least nodes as by union-find, and rounds that shrink."""
    import random

    from tidemark.operators import graph

    rng = random.Random(6)
    ids = rng.sample(range(10**6), 2000)
    edges = [(i, i + 1) for i in range(2_000_000, 2_000_600)] + [(ids[i], ids[i + 1]) for i in range(1200) if i % 12] + [(ids[1500], ids[i]) for i in range(1501, 1900)] + [(5_000_000, 5_000_000), (5_000_001, None)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    rows, plain = [], graph.written
    try:
        graph.written = lambda df: rows.append((x := plain(df)).count()) or x
        got = graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        graph.written = plain
    assert len(got) == len(top) and {r.node: r.component for r in got} == {x: find(x) for x in top}
    assert sum(rows) <= 9 * len(edges)
