"""Community and news topics of one issue, by the tokens they share: candidates, evaluation, one-to-one choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.unicode import nfkc, plain
from .rounds import dominant_pairs
from .store import written

#: Tokens that say nothing.
GENERIC = ["topic", "issue", "global", "region", "news", "update", "with", "from", "that", "this", "have", "has", "had", "will", "was", "were", "are", "for", "you", "your", "his", "her", "its", "into", "over", "under", "after", "before", "about"]
#: Weights of a shared name token, keyword token, entity token, keyword phrase, canonical name.
CANDIDATE, OFFICIAL = (0.24, 0.18, 0.18, 0.16, 0.22), (0.16, 0.12, 0.22, 0.24, 0.26)
HIGH, MEDIUM, TIE_MINUTES = 0.72, 0.45, 10
KINDS = ("names", "keywords", "entities", "phrases")


def words(x: Column) -> Column:
    """Distinct tokens of a normalised string: letters and digits, no bare numbers, three Latin or two other characters."""
    keep = lambda t: ~t.rlike("^[0-9]*$") & ~t.isin(GENERIC) & (F.length(t) >= F.when(t.rlike("^[a-z0-9]+$"), F.lit(3)).otherwise(F.lit(2)))
    return F.array_distinct(F.filter(F.split(plain(x), " "), keep))


def evidence(topics: DataFrame, key: str, block: str, names: Column, keywords: Column, entities: Column, canonical: Column, *also: str) -> DataFrame:
    """key, block, names, keywords, entities, phrases (arrays of tokens), canonical (null if it says nothing).

    names, keywords, entities: arrays of strings.  Phrases are keywords of two tokens or more.
    """
    text = lambda a: nfkc(F.array_join(a, " "))
    flat = F.regexp_replace(plain(nfkc(canonical)), " ", "")
    says = ~plain(nfkc(canonical)).rlike("https?|www ") & (F.length(flat) >= 5) & ~flat.rlike("^(globaltopic|regiontopic|topic|issue)?[0-9]*$")
    phrase = F.filter(F.transform(F.split(nfkc(F.array_join(keywords, "\u0001")), "\u0001"), lambda k: F.array_join(words(k), " ")), lambda p: p.contains(" "))
    x = topics.select(F.col(key).alias("key"), F.col(block).alias("block"), *also, words(text(names)).alias("names"), words(text(keywords)).alias("keywords"), words(text(entities)).alias("entities"), F.array_distinct(phrase).alias("phrases"), F.when(says, flat).alias("canonical"))
    return x.withColumn("names", F.when(F.col("canonical").isNotNull(), F.array_union("names", F.array(F.col("canonical")))).otherwise(F.col("names")))


def _met(community: DataFrame, news: DataFrame) -> DataFrame:
    """Pairs of a block that share a keyword token or the canonical name: no other can be a candidate."""
    def by(token: Column) -> DataFrame:
        l, r = (x.select("block", F.col("key").alias(k), token.alias("_t")).filter("_t is not null") for x, k in ((community, "community"), (news, "news")))
        return l.join(r, ["block", "_t"]).select("block", "community", "news")

    return by(F.explode("keywords")).union(by(F.col("canonical"))).distinct()


def compared(pairs: DataFrame, community: DataFrame, news: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds to pairs (block, community, news) the shared tokens of each kind, same_canonical and lexical."""
    side = lambda x, s: x.select("block", F.col("key").alias(s), F.struct(*(c for c in x.columns if c not in ("block", "key"))).alias(f"_{s}"))
    x = pairs.join(side(community, "community"), ["block", "community"]).join(side(news, "news"), ["block", "news"])
    for k in KINDS:
        x = x.withColumn(k, F.array_intersect(F.col(f"_community.{k}"), F.col(f"_news.{k}")))
    x = x.withColumn("same_canonical", F.coalesce(F.col("_community.canonical") == F.col("_news.canonical"), F.lit(False)))
    total = sum((F.size(k) * F.lit(w) for k, w in zip(KINDS, weights, strict=False)), F.when(F.col("same_canonical"), F.lit(weights[-1])).otherwise(F.lit(0.0)))
    return x.withColumn("lexical", F.least(F.lit(1.0), total))


def tier(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def leader(lag: Column) -> Column:
    return F.when(F.abs(lag) < TIE_MINUTES, "tie").when(lag > 0, "community").otherwise("news")


def candidate_pairs(community: DataFrame, news: DataFrame, official: DataFrame, direction: str = "both") -> DataFrame:
    """Pairs that the official ones (block, community, news) lack, each topic in one pair at most, the better first.

    A candidate shares a name token and a keyword token, or the canonical name and either; its score is at
    least MEDIUM unless the canonical name is shared.  Both sides carry first_at.
    """
    x = compared(_met(community, news), community, news, CANDIDATE).join(official, ["block", "community", "news"], "left_anti")
    named, worded = F.size("names") > 0, F.size("keywords") > 0
    x = x.filter((named & worded) | (F.col("same_canonical") & (named | worded))).withColumn("score", F.round("lexical", 4)).filter((F.col("score") >= MEDIUM) | F.col("same_canonical"))
    minutes = (F.unix_micros(F.col("_news.first_at").cast("timestamp")) - F.unix_micros(F.col("_community.first_at").cast("timestamp"))) / 6e7
    x = x.withColumn("lag_minutes", F.floor(minutes + 0.5)).filter("lag_minutes is not null").withColumn("leader", leader(F.col("lag_minutes")))
    if direction != "both":
        x = x.filter(F.col("leader") == direction.split("_")[0])
    x = written(x.select("block", "community", "news", "score", tier(F.col("score")).alias("tier"), "lag_minutes", "leader", *(F.size(k).alias(k) for k in KINDS), "same_canonical").withColumn("_lag", F.abs("lag_minutes")))
    return dominant_pairs(x, "block", "community", "news", [("score", False), ("_lag", True)]).drop("_lag")


def evaluated(pairs: DataFrame, community: DataFrame, news: DataFrame) -> DataFrame:
    """score, tier, classes (kinds of evidence), exact and visible of pairs (block, community, news, cosine).

    The better of cosine and shared tokens counts.  A pair is shown with a high cosine, with an entity, phrase or
    canonical name in common, or with a medium score that two kinds of evidence carry.
    """
    x = compared(pairs, community, news, OFFICIAL)
    cosine = F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0)))
    x = x.withColumn("score", F.round(F.greatest(cosine, F.col("lexical")), 4))
    classes = sum(((F.size(k) > 0).cast("int") for k in KINDS), F.col("same_canonical").cast("int"))
    x = x.withColumn("classes", classes).withColumn("exact", F.col("same_canonical") | (F.size("entities") > 0) | (F.size("phrases") > 0))
    shown = (cosine >= HIGH) | F.col("exact") | ((F.col("score") >= MEDIUM) & (F.col("classes") >= 2))
    return x.select("block", "community", "news", "score", tier(F.col("score")).alias("tier"), "classes", "exact", shown.alias("visible"))
