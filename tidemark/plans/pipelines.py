"""The regional and the global job as single plans over all regions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text, titles
from ..functions.unicode import nfkc
from ..operators import clusters as C
from ..operators import keywords as K
from ..operators import similarity as S
from ..operators.graph import _checkpointed
from ..operators.dedupe import distinct_topics
from ..operators.keyed import top_per_key
from ..operators.monitoring import excerpts
from ..operators.ngrams import best_ngrams
from ..operators.rounds import dominant_pairs
from ..operators.store import written

#: Words of the sentiment lexicon.
POSITIVE = ["good", "great", "best", "win", "success", "love", "hope"]
NEGATIVE = ["bad", "worst", "crash", "fail", "fear", "attack", "crisis"]


def with_terms(posts: DataFrame, title: str = "title") -> DataFrame:
    """Adds `words` and `terms`: the tokens of the cleaned title, and those with the phrases they make."""
    region = F.col("region_id")
    return posts.withColumn("words", titles.tokens(F.col(title), region, F.col("source_id"))).withColumn("terms", F.concat("words", titles.phrases(F.col("words"), region)))


def containing(posts: DataFrame, keywords: DataFrame, block: str, key: str, haystack: Column) -> DataFrame:
    """block, keyword, key of the posts whose text contains a keyword.

    Keywords are few by design (30 a block at most), so they go to the posts: no post is moved.
    """
    return posts.select(block, key, haystack.alias("_h")).join(F.broadcast(keywords.select(block, "keyword")), block).filter(F.col("_h").contains(F.col("keyword"))).select(block, "keyword", key)


def regional(posts: DataFrame, as_of: Column, scope: str = "mixed", most: int = 60, least_df: int = 2) -> DataFrame:
    """Topics of every region: keywords, clusters, names, heat with bursts, sentiment, excerpts, rank.

    posts: region_id, id, source_id, title, views, likes, comments, posted_at, and body_preview if there is one.
    """
    weight = scoring.engagement_weight(F.col("views"), F.col("likes"), F.col("comments"), F.lit(0))
    parts = max(2 * posts.sparkSession.sparkContext.defaultParallelism, posts.rdd.getNumPartitions())  # a table may be one file
    p = written(posts.repartition(parts).withColumn("words", titles.tokens(F.col("title"), F.col("region_id"), F.col("source_id"))).withColumn("weight", weight))  # read by all branches; phrases are made of the words where they are needed
    if p.groupBy("region_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        best = best_ngrams(p, "region_id", "id", "words", F.col("weight"))
    else:
        best = K.best_terms(p, "region_id", "id", F.concat("words", titles.phrases(F.col("words"), F.col("region_id"))), F.col("weight"), K.phrase_boost, generic=0.02, first=K.FIRST_TERMS)
    scores = K.summed(best, "region_id")
    keywords = K.pick_keywords(scores, "region_id", least_df=F.lit(least_df))
    haystack = F.concat_ws(" ", text.key(nfkc(F.col("title"))), F.array_join("words", " "))
    members = written(containing(p, keywords, "region_id", "id", haystack))
    grown = written(C.seeded_clusters(keywords, members, "region_id", "id"))
    of = written(C.cluster_posts(grown, members, "region_id", "id").join(p, ["region_id", "id"]))
    names = C.cluster_names(grown, keywords, of, "region_id", "words", "weight")

    zero = F.lit(0)
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))) / 3.6e9
    heat = scoring.heat(F.col("views"), F.col("likes"), F.col("comments"), zero, hours, F.lit(1.0), F.lit(0.0))
    mood = text.lexicon_score(F.col("title"), POSITIVE, NEGATIVE)
    # One pass for each source of a cluster, then one for each cluster.
    one = of.groupBy("region_id", "cluster", "source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(heat).alias("heat"), F.sum(mood).alias("mood"), F.count(mood).alias("moods"), F.sum("views").alias("views"), F.sum("likes").alias("likes"), F.sum("comments").alias("comments"), F.min("posted_at").alias("first_at"))
    total = one.groupBy("region_id", "cluster").agg(F.sum("n").alias("post_count"), F.sum("heat").alias("base"), F.count(F.lit(1)).alias("sources"), (F.max("n") / F.sum("n")).alias("dominant"), (F.sum("mood") / F.nullif(F.sum("moods"), F.lit(0))).alias("mood"), *(F.sum(c).alias(f"total_{c}") for c in ("views", "likes", "comments")), F.min("first_at").alias("first_at"))
    matched = K.matches(p, keywords, "region_id", "id", "words").join(p.select("region_id", "id", "posted_at"), ["region_id", "id"])
    burst = K.bursts(matched, ["region_id", "keyword"], "posted_at", as_of).filter("z >= 2")
    boost = grown.join(burst, ["region_id", "keyword"]).groupBy("region_id", "cluster").agg(F.max("boost").alias("boost"), F.max("z").alias("burst_z"))
    words = grown.groupBy("region_id", "cluster").agg(F.array_sort(F.collect_set("keyword")).alias("keywords"))

    shown = excerpts(of if "body_preview" in of.columns else of.withColumn("body_preview", F.lit(None).cast("string")), ["region_id", "cluster"])

    x = total.join(names, ["region_id", "cluster"]).join(words, ["region_id", "cluster"]).join(boost, ["region_id", "cluster"], "left").join(shown, ["region_id", "cluster"], "left")
    base = scoring.news_fallback(F.col("base") * scoring.diversity_multiplier(F.col("sources")), F.col("post_count"), F.lit(scope))
    x = x.select("region_id", F.lit(scope).alias("scope"), "name", "keywords", F.round(base * F.coalesce("boost", F.lit(1.0)), 4).alias("heat"), F.round("burst_z", 4).alias("burst_z"), F.round("mood", 3).alias("sentiment"), "post_count", "total_views", "total_likes", "total_comments", "sources", F.round("dominant", 4).alias("dominant_share"), F.round(F.col("sources") / F.log(F.col("post_count") + F.lit(2.718281828459045)), 4).alias("diversity"), "first_at", "excerpts")
    # Of topics that say the same by name or keywords the hotter stays.
    none = F.lit(None).cast("string")
    x = written(x.withColumns({"_key": F.concat_ws("\u0001", "region_id", "name", F.array_join("keywords", "\u0001")), "name_ko": none, "name_en": F.col("name"), "canonical": none, "entities": F.lit(None).cast("array<string>")}))
    x = distinct_topics(x, ["region_id"], "_key", "heat", most=most).drop("_key", "name_ko", "name_en", "canonical", "entities")
    return x.withColumn("display", scoring.display_heat(F.col("heat"), F.max("heat").over(Window.partitionBy("region_id"))))


def snapshot(topics: DataFrame) -> DataFrame:
    """Each region's heat, topics, sentiment (topics without one are left out) and ten commonest keywords."""
    from ..operators.keyed import top_per_key

    n = topics.select("region_id", F.explode("keywords").alias("kw")).groupBy("region_id", "kw").agg(F.count(F.lit(1)).alias("n"))
    ten = top_per_key(n, ["region_id"], [F.desc("n"), F.col("kw")], 10).groupBy("region_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "kw"))), lambda k: k["kw"]).alias("top_keywords"))
    return topics.groupBy("region_id").agg(F.round(F.sum("heat"), 4).alias("heat"), F.count(F.lit(1)).alias("topics"), F.round(F.avg("sentiment"), 4).alias("sentiment")).join(ten, "region_id", "left")


def nodes(topics: DataFrame, vector: Column | None = None) -> DataFrame:
    """Similarity nodes of topics (id, region_id, name, keywords, and scope if there is one)."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}][\\p{L}\\p{N}._-]*"), 0), lambda w: F.length(w).between(2, 48) & ~w.rlike("^[0-9]+$") & ~w.isin(C.LOW_SIGNAL)))
    x = topics.withColumn("name_tokens", words(F.col("name"))).withColumn("keyword_tokens", F.array_distinct(F.concat(F.transform("keywords", lambda k: F.lower(F.trim(k))), words(F.array_join("keywords", " ")))))
    return x.select(*(c for c in ("scope",) if c in topics.columns), F.col("id").alias("key"), F.col("region_id").alias("block"), F.lower("name").alias("name"), F.get(F.filter("name_tokens", lambda w: F.length(w) >= 4), F.lit(0)).alias("primary"), "name_tokens", "keyword_tokens", F.array_distinct(F.concat("name_tokens", "keyword_tokens")).alias("tokens"), (vector if vector is not None else F.lit(None).cast("array<double>")).alias("vector"))


def propagation(rows: DataFrame, history: DataFrame, as_of: Column, by: Sequence[str] = ()) -> DataFrame:
    """Adds velocity, acceleration and spread to issues (name, heat, regions) from their history (name, heat, at), each within `by`."""
    at = lambda h: F.max_by("heat", F.when(F.col("at") <= as_of - F.make_interval(hours=F.lit(h)), F.col("at")))
    past = history.groupBy(*by, "name").agg(at(1).alias("h1"), at(2).alias("h2"))
    x = rows.join(past, [*by, "name"], "left").withColumn("velocity", F.round(F.col("heat") - F.coalesce("h1", F.lit(0.0)), 4))
    x = x.withColumn("acceleration", F.round(F.col("velocity") - F.coalesce("h1", F.lit(0.0)) + F.coalesce("h2", F.lit(0.0)), 4)).drop("h1", "h2")
    most = F.broadcast(x.groupBy(*by).agg(F.max("velocity").alias("_most")))
    return (x.join(most, list(by)) if by else x.join(most)).withColumn("spread", scoring.spread(F.size("regions"), F.col("velocity"), F.col("_most"))).drop("_most")


def timeline_edges(timeline: Column) -> Column:
    """Edges between neighbours of a timeline (region_id, first_at), with lag and confidence."""
    lag = lambda a, b: F.greatest(F.lit(0), scoring.lag_minutes(a["first_at"], b["first_at"])).cast("long")
    pair = F.zip_with(F.slice(timeline, 1, F.greatest(F.size(timeline) - 1, F.lit(0))), F.slice(timeline, 2, F.greatest(F.size(timeline) - 1, F.lit(0))), lambda a, b: F.struct(a["region_id"].alias("from"), b["region_id"].alias("to"), lag(a, b).alias("lag_minutes"), F.round(scoring.edge_confidence(lag(a, b)), 4).alias("confidence")))
    return pair


def qualified_edges(edges: Column, scope: str) -> Column:
    """Edges that count as propagation: other region, confidence, positive lag, bounded lag.  Fixed values by scope."""
    confidence, most = (0.35, 1440) if scope == "community" else (0.25, 4320)
    return F.filter(edges, lambda e: (e["from"] != e["to"]) & (e["confidence"] >= confidence) & (e["lag_minutes"] > 0) & (e["lag_minutes"] <= most))


def global_issues(topics: DataFrame, history: DataFrame, as_of: Column, threshold: float = 0.24, regions: int = 2, limit: int = 75) -> DataFrame:
    """Issues of each scope that span regions, `limit` a scope, with heat by region, first region, timeline, edges, velocity and spread.

    topics: id, scope, region_id, name, keywords, heat, sentiment, post_count, first_at; one batch selection.
    history: scope, name, heat, at.
    """
    n = _checkpointed(nodes(topics))
    groups = S.issues(n, S.similar_pairs(n, threshold, within=["scope"]), regions)
    x = topics.join(groups.withColumnRenamed("key", "id"), "id")
    score = S.representative_score(F.col("heat"), F.col("name"), text.is_placeholder(F.col("name")), F.col("post_count"))
    r = x.groupBy("scope", "component", "region_id").agg(F.round(F.sum("heat"), 3).alias("heat"), F.round(F.avg("sentiment"), 3).alias("sentiment"), F.min("first_at").alias("first_at"), F.max(F.struct(score.alias("s"), F.col("id").alias("i"), F.col("name").alias("n"))).alias("best"), F.array_sort(F.collect_list("id")).alias("ids"))
    c = r.groupBy("scope", "component").agg(F.max("best").alias("best"), F.array_sort(F.collect_list("region_id")).alias("regions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("region_id", "heat")))).alias("regional_heat"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("region_id", "sentiment")))).alias("regional_sentiment"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("topic_ids"), F.round(F.sum("heat"), 3).alias("heat"), F.array_sort(F.collect_list(F.struct("first_at", "region_id"))).alias("timeline"))
    c = top_per_key(c.withColumn("name", F.col("best.n")).drop("best"), ["scope"], [F.desc("heat"), F.col("component")], limit)
    c = c.withColumn("first_region", F.get("timeline", F.lit(0))["region_id"]).withColumn("first_at", F.get("timeline", F.lit(0))["first_at"]).withColumn("edges", timeline_edges(F.col("timeline")))
    return propagation(c, history, as_of, ["scope"])


def scope_overlaps(community: DataFrame, news: DataFrame) -> DataFrame:
    """One-to-one pairs of the same issue in community and news topics of a region, the better pair first."""
    return dominant_pairs(S.overlap_pairs(community, news), "block", "key_l", "key_r", [("score", False), ("cosine", False), ("distance", True)]).drop("distance")
