"""What a topic's heat means: against the last week, against its own past, against portal headlines; and what shows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.unicode import nfkc, plain
from .keyed import distinct_on, top_per_key
from .similarity import bag_pairs
from .store import written

#: Likeness at which a headline speaks of a topic, and the last rank of a headline that counts.
ALIKE, LAST_RANK = 0.8, 20


def heat_stats(topics: DataFrame, by: Sequence[str] = ("region_id", "category"), heat: str = "heat") -> DataFrame:
    """by, mean, std (of the population) of the heats of one run; null heats are left out."""
    return topics.filter(F.col(heat).isNotNull()).groupBy(*by).agg(F.avg(heat).alias("mean"), F.stddev_pop(heat).alias("std"))


def week_of(stats: DataFrame, by: Sequence[str] = ("region_id", "category")) -> DataFrame:
    """by, mean, std: averages over days, where of each day its last run (`at`) counts."""
    last = distinct_on(stats, [*by, "day"], [F.desc("at")])
    return last.groupBy(*by).agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def weeks(stats: DataFrame, by: Sequence[str] = ("region_id", "category"), days: int = 7) -> DataFrame:
    """by, day, mean, std: for every day the averages over the `days` before it, for a run over all days at once.

    stats: one row a key and day.  Each goes to the days that look back on it, a fixed number, and these are averaged:
    no comparison of days with days.
    """
    ahead = stats.withColumn("day", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda n: F.date_add("day", n))))
    return ahead.groupBy(*by, "day").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def with_anomaly(topics: DataFrame, week: DataFrame, by: Sequence[str] = ("region_id", "category"), heat: str = "heat") -> DataFrame:
    """Adds `anomaly`: standard deviations above the week's mean; null without a week or where it doesn't spread."""
    w = week.select(*by, F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    return topics.join(w, list(by), "left").withColumn("anomaly", scoring.anomaly(F.col(heat), F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def with_lifecycle(topics: DataFrame, history: DataFrame, as_of: Column, started: Column, by: Sequence[str] = ("region_id", "name"), heat: str = "heat") -> DataFrame:
    """Adds `lifecycle` from the history (by, heat, at) that the caller looks back on.

    A topic without history is as old as the period, `started`.  The last two heats of a name are limited before the
    shuffle and first time and peak are partial sums, so a name that holds much of the history costs no task more.
    """
    h = history.filter(F.col("heat").isNotNull()).join(topics.select(*by).distinct(), list(by), "left_semi").select(*by, F.col("heat").alias("_h"), "at")
    two = top_per_key(h, list(by), [F.desc("at"), F.desc("_h")], 2, "_r").groupBy(*by).agg(*(F.max(F.when(F.col("_r") == i, F.col("_h"))).alias(f"_h{i}") for i in (1, 2)))
    past = h.groupBy(*by).agg(F.min("at").alias("_first"), F.max("_h").alias("_peak"))
    x = topics.join(past, list(by), "left").join(two, list(by), "left")
    seen = F.coalesce(F.col("_first"), started)
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / 3.6e9
    stage = scoring.lifecycle(hours, F.col(heat), F.col("_h1"), F.col("_h2"), F.greatest("_peak", F.col(heat)))
    return x.withColumn("lifecycle", stage).drop("_first", "_peak", "_h1", "_h2")


def _tokens(x: Column) -> Column:
    return F.slice(F.filter(F.split(plain(nfkc(x)), " "), lambda w: F.length(w) >= 2), 1, 64)


def portal_boosted(topics: DataFrame, signals: DataFrame, by: str = "region_id") -> DataFrame:
    """topics with their heat raised by the headlines that speak of them, the more the better these rank.

    topics: by, name_ko, name_en, keywords, heat.  signals: by, rank (null: 100), headline.  Headlines of one bag of
    words count once with the sum of their weights, topics of one bag are compared once; ranks beyond the last
    that counts never reach the comparison.
    """
    bag = F.array_join(F.array_sort("_words"), " ")
    place = F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce("rank", F.lit(100))))
    s = signals.withColumn("_weight", (LAST_RANK + 1 - place) / LAST_RANK).filter("_weight > 0").withColumn("_words", _tokens(F.col("headline"))).filter(F.size("_words") > 0)
    s = written(s.groupBy(by, bag.alias("_bag")).agg(F.sum("_weight").alias("_weight"), F.first(F.array_sort("_words")).alias("_words")))
    said = F.concat_ws(" ", "name_ko", "name_en", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    t = written(topics.withColumn("_words", _tokens(said)).withColumn("_bag", bag))
    pairs = bag_pairs(t.select(by, "_bag", "_words").dropDuplicates([by, "_bag"]), s, "_bag", "_words", ALIKE, (by,))
    weight = pairs.join(s.select(by, F.col("_bag").alias("key_r"), "_weight"), [by, "key_r"]).groupBy(by, F.col("key_l").alias("_bag")).agg(F.sum("_weight").alias("_weight"))
    raised = F.when(F.col("_weight") > 0, F.round(F.col("heat") * scoring.portal_boost(F.col("_weight")), 4)).otherwise(F.col("heat"))
    return t.join(weight, [by, "_bag"], "left").withColumn("heat", raised).select(*topics.columns)


def excerpts(posts: DataFrame, by: Sequence[str], most: int = 3) -> DataFrame:
    """by, excerpts: the posts with the most engagement, as an array of (title, snippet, source_id, posted_at).

    posts: by, id, title, body_preview, views, likes, comments, source_id, posted_at; posts without title don't count.
    """
    title = F.trim(F.regexp_replace("title", "^\\s+|\\s+$", ""))
    x = posts.withColumn("_title", title).filter("_title <> ''")
    score = scoring.excerpt_score(*(F.coalesce(c, F.lit(0)) for c in ("views", "likes", "comments")))
    best = top_per_key(x, list(by), [F.desc(F.round(score, 9)), F.col("id")], max(1, min(most, 3)), "_r")
    body = F.trim(F.regexp_replace(F.coalesce("body_preview", F.lit("")), "\\s+", " "))
    sentence = F.trim(F.substring(F.element_at(F.split(body, "(?<=[.!?。！？])\\s+", 2), 1), 1, 200))
    one = F.struct(F.col("_r").alias("r"), F.substring("_title", 1, 140).alias("title"), sentence.alias("snippet"), "source_id", "posted_at")
    shown = F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e["title"].alias("title"), e["snippet"].alias("snippet"), e["source_id"].alias("source_id"), e["posted_at"].alias("posted_at")))
    return best.groupBy(*by).agg(shown.alias("excerpts"))
