"""The regional job from posts to stored topics: boosts, names, anomaly, stage, and the tables that it keeps by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.topic_names import with_names
from ..functions.unicode import nfkc
from ..operators import monitoring as M
from ..operators.daily import keep, look_back
from ..operators.keyed import distinct_on, top_per_key
from ..operators.store import written
from . import pipelines as P

SCOPES = ("community", "news", "mixed")
#: Days and hours that a run looks back on, and those after which its topics expire.
WEEK, PAST, EXPIRY = 7, 72, 48
BASELINES = "region_id string, category string, mean double, std double, at timestamp_ntz, day date"
HISTORY = "region_id string, scope string, name string, heat double, sentiment double, post_count long, at timestamp_ntz, day date"


def resolved(topics: DataFrame) -> DataFrame:
    """topics with name_ko and name_en resolved from name, excerpts' titles and keywords, and their canonical key."""
    x = topics.withColumns({"titles": F.transform(F.coalesce("excerpts", F.array().cast("array<struct<title:string,snippet:string,source_id:string,posted_at:timestamp_ntz>>")), lambda e: e["title"]), "name_ko": F.col("name"), "name_en": F.col("name")})
    x = with_names(x).drop("titles", "name", "source_ko", "source_en", "low_ko", "low_en", "upgraded_ko", "upgraded_en")
    key = F.trim(F.regexp_replace(F.lower(nfkc(F.col("name_en"))), "\\s+", " "))
    return x.withColumns({"name": F.col("name_en"), "canonical_key": F.coalesce(F.col("canonical_key") if "canonical_key" in topics.columns else F.lit(None).cast("string"), key)})


def finish(topics: DataFrame, root: str, as_of: Column, scope: str, hours: int = 6) -> DataFrame:
    """Topics of one run with anomaly, lifecycle, heat band and expiry, stored together with what later runs look back on.

    topics: region_id, scope, name, category (null: other), heat, sentiment, post_count and more.
    Below `root` lie `baselines`, `heat_history`, `topics` and `region_snapshots`, each by day: the run reads eight days
    of the first, four of the second, and rewrites its own day of all.  It looks at what was kept before `as_of` only, so
    a run that is repeated gives the same rows and the same tables.
    """
    spark = topics.sparkSession
    x = written(topics.withColumn("category", F.coalesce("category", F.lit("other"))))
    week = M.week_of(look_back(spark, f"{root}/baselines", BASELINES, as_of, days=WEEK))
    x = M.with_anomaly(x, week)
    past = look_back(spark, f"{root}/heat_history", HISTORY, as_of, hours=PAST)
    x = M.with_lifecycle(x, past, as_of, as_of - F.make_interval(hours=F.lit(hours)))
    ratio = scoring.display_heat(F.col("heat"), F.greatest(F.max("heat").over(Window.partitionBy("region_id")), F.lit(1.0)))
    order = Window.partitionBy("region_id").orderBy(F.desc("heat"), "name")  # 60 topics a region at most
    x = written(x.withColumns({"display": ratio, "band": scoring.heat_band(ratio), "rank": F.row_number().over(order), "period_start": as_of - F.make_interval(hours=F.lit(hours)), "at": as_of, "expires_at": as_of + F.make_interval(hours=F.lit(EXPIRY))}))
    history = x.select("region_id", "scope", "name", F.col("heat").cast("double").alias("heat"), F.col("sentiment").cast("double").alias("sentiment"), F.col("post_count").cast("long").alias("post_count"), "at")
    # A name may stand for two topics of a region; the hotter one makes its history.
    keep(distinct_on(history, ["region_id", "scope", "name"], [F.desc("heat"), F.desc("post_count")]), f"{root}/heat_history", ["region_id", "scope", "name", "at"])
    keep(M.heat_stats(x).withColumn("at", as_of), f"{root}/baselines", ["region_id", "category", "at"])
    keep(x, f"{root}/topics", ["region_id", "scope", "at", "rank"])
    keep(P.snapshot(x).withColumns({"scope": F.lit(scope), "at": as_of}), f"{root}/region_snapshots", ["region_id", "scope", "at"])
    return x


def run(posts: DataFrame, signals: DataFrame, root: str, as_of: Column, scope: str = "mixed", hours: int = 6) -> DataFrame:
    """One scope of the job for all regions.

    posts: region_id, id, source_id, title, body_preview, views, likes, comments, posted_at, of the period and of
    the scope's sources.  signals: region_id, rank, headline, captured_at; those of the last six hours, the 300
    best of each region's latest, count for news.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope {scope}: not one of {', '.join(SCOPES)}")
    x = P.regional(posts, as_of, scope).withColumn("category", F.lit(None).cast("string"))
    x = resolved(x)
    if scope == "news":
        x = M.portal_boosted(x, latest_signals(signals, as_of))
    return finish(x, root, as_of, scope, hours)


def latest_signals(signals: DataFrame, as_of: Column, hours: int = 6, most: int = 300) -> DataFrame:
    """Each region's newest headlines, the better rank first where they are of one time."""
    recent = signals.filter((F.col("captured_at") >= as_of - F.make_interval(hours=F.lit(hours))) & (F.col("captured_at") <= as_of))
    return top_per_key(recent, ["region_id"], [F.desc("captured_at"), F.col("rank"), F.col("headline")], most, "_place").drop("_place")
