"""The dashboard's read endpoints as functions with parameters, out-of-range ones brought back into range."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, scoring
from ..operators.keyed import distinct_on, top_per_key, top_up
from .domain import ORDERS_AS_OF
from .relational import ago, query


def clamp(value: object, low: int, high: int, default: int) -> int:
    """A whole number in its range; the default where it isn't a number."""
    try:
        return max(low, min(high, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def regions(topics, sources, as_of, hours: object = 48):  # noqa: ANN001, ANN201
    """Each region's batch (the newest fresh one, else the newest): heat, topics, sentiment, sources."""
    fresh = F.col("created_at") >= ago(clamp(hours, 1, 168, 48), as_of)
    batch = topics.groupBy("region_id").agg(F.coalesce(F.max(F.when(fresh, F.col("created_at"))), F.max("created_at")).alias("created_at"), F.coalesce(F.max("created_at") >= ago(clamp(hours, 1, 168, 48), as_of), F.lit(False)).alias("is_fresh"))
    now = topics.join(batch, ["region_id", "created_at"])
    n = now.select("id", "region_id").join(sources.withColumnRenamed("topic_id", "id"), "id").groupBy("region_id").agg(F.countDistinct("source_id").alias("sources"))
    return now.groupBy("region_id", "is_fresh").agg(F.round(F.sum("heat"), 2).alias("heat"), F.count(F.lit(1)).alias("topics"), F.round(F.avg("sentiment"), 4).alias("sentiment")).join(n, "region_id", "left")


@query("q02_regions", "with b as (select region_id, coalesce(max(created_at) filter (created_at >= THEN_ - interval 48 hours), max(created_at)) as at_, coalesce(max(created_at) >= THEN_ - interval 48 hours, false) as is_fresh from topics group by 1), n as (select t.*, is_fresh from topics t join b on b.region_id = t.region_id and b.at_ = t.created_at) select region_id, is_fresh, round(sum(heat), 2) as heat, count(*) as topics, round(avg(sentiment), 4) as sentiment, (select count(distinct source_id) from topic_sources x join n m on m.id = x.topic_id where m.region_id = n.region_id) as sources from n group by 1, 2")
def q02(t):
    return regions(t("topics"), t("topic_sources"), ORDERS_AS_OF)


def topics_page(topics, region: str, scope: str, as_of, sort: str = "heat", limit: object = 20, offset: object = 0, hours: object = 720):  # noqa: ANN001, ANN201, PLR0913
    """One page of a region's topics, one a name; pages that are short are filled from history, marked stale."""
    order = {"heat": F.desc("heat"), "sentiment": F.desc("sentiment"), "recent": F.desc("created_at"), "diverse": F.desc(F.col("heat") * (1 + F.col("rank") / 10.0))}.get(sort, F.desc("heat"))
    x = topics.filter((F.col("region_id") == region) & (F.col("scope") == scope))
    one = lambda d: distinct_on(d, [F.lower("name")], [F.desc("created_at"), F.desc("heat"), F.desc("id")])
    fresh = F.col("created_at") >= ago(clamp(hours, 1, 8760, 720), as_of)
    now = one(x.filter(fresh)).orderBy(order, "id").offset(clamp(offset, 0, 10**6, 0)).limit(clamp(limit, 1, 200, 20))
    return top_up(now, one(x.filter(~fresh)), "name", [order, F.col("id")], clamp(limit, 1, 200, 20))


@query("q05_topics", "with x as (select *, created_at >= THEN_ - interval 720 hours as fresh from topics where region_id = 'ASIA' and scope = 'news'), f as (select distinct on (lower(name)) * from x where fresh order by lower(name), created_at desc, heat desc, id desc), s as (select distinct on (lower(name)) * from x where not fresh order by lower(name), created_at desc, heat desc, id desc) select id, name, heat, stale from (select id, name, heat, 0 as stale from (select * from f order by heat desc, id limit 20) union all select id, name, heat, 1 from s where name not in (select name from f)) order by stale, heat desc, id limit 20")
def q05(t):
    return topics_page(t("topics"), "ASIA", "news", ORDERS_AS_OF).select("id", "name", "heat", "stale")


@query("q07_topic_timeline", "with b as (select topic_name, time_bucket(interval 6 hours, posted_at, TIMESTAMP '2000-01-01') as bucket, round(avg(like_count), 7) as heat, count(*) as n from posts where posted_at >= NOW - interval 168 hours group by 1, 2) select topic_name, bucket, heat, n, case when coalesce(heat < lag(heat, 1) over w and lag(heat, 1) over w < lag(heat, 2) over w and heat < max(heat) over (partition by topic_name), false) then 'fading' else 'peaking' end as stage from b window w as (partition by topic_name order by bucket)")
def q07(t):
    b = t("posts").filter(F.col("posted_at") >= ago(168)).groupBy("topic_name", F.window("posted_at", "6 hours").alias("w")).agg(F.round(F.avg("like_count"), 7).alias("heat"), F.count(F.lit(1)).alias("n")).withColumn("bucket", F.col("w.start"))
    w = Window.partitionBy("topic_name").orderBy("bucket")
    stage = scoring.lifecycle(F.lit(24.0), F.col("heat"), F.lag("heat", 1).over(w), F.lag("heat", 2).over(w), F.max("heat").over(Window.partitionBy("topic_name")))
    return b.select("topic_name", "bucket", "heat", "n", stage.alias("stage"))


def search(vectors, query_vector, key: str, vector: str, least: float = 0.2, limit: object = 20):  # noqa: ANN001, ANN201
    """The nearest vectors of at least so much cosine; other lengths don't match.  Each task keeps its own best, no full sort."""
    q = F.array(*(F.lit(float(x)) for x in query_vector))
    c = F.when(F.size(vector) == len(query_vector), arrays.cosine(F.col(vector), q))
    return vectors.select(key, c.alias("cosine")).filter(F.col("cosine") >= least).orderBy(F.desc("cosine"), key).limit(clamp(limit, 1, 200, 20))


UNIT = [(-1.0) ** i for i in range(64)]


@query("q10_search", f"select vec_id, round(list_cosine_similarity(embedding::double[], {UNIT}::double[]), 6) as cosine from embeddings where round(list_cosine_similarity(embedding::double[], {UNIT}::double[]), 6) >= 0.2 order by cosine desc, vec_id limit 20")
def q10(t):
    return search(t("embeddings"), UNIT, "vec_id", "embedding")


@query("q11_issue_overlaps", "select o.community_id, o.news_id, c.name as community_name, n.name as news_name from overlap_events o join topics c on c.id = o.community_id join topics n on n.id = o.news_id where exists (select 1 from topic_sources x join sources s on s.id = x.source_id where x.topic_id = n.id and coalesce(s.trust_tier, 3) <= 1) order by o.detected_at desc, 1, 2 limit 200")
def q11(t):
    trusted = t("topic_sources").join(t("sources").filter("coalesce(trust_tier, 3) <= 1"), F.col("source_id") == F.col("id")).select(F.col("topic_id").alias("news_id")).distinct()
    name = lambda k: t("topics").select(F.col("id").alias(f"{k}_id"), F.col("name").alias(f"{k}_name"))
    x = t("overlap_events").join(trusted, "news_id", "left_semi").join(name("community"), "community_id").join(name("news"), "news_id")
    return x.orderBy(F.desc("detected_at"), "community_id", "news_id").limit(200).select("community_id", "news_id", "community_name", "news_name")


@query("q13_propagation_matrix", "with f as (select concat(scope, cast(rank as varchar)) as issue, region_id, min(created_at) as ft from topics group by 1, 2), e as (select region_id as f, lead(region_id) over w as g, date_diff('minute', ft, lead(ft) over w) as lag from f window w as (partition by issue order by ft, region_id)) select f as from_region, g as to_region, count(*) as n, round(avg(lag) filter (lag > 0), 4) as avg_lag, round(count(*) / sum(count(*)) over (partition by f), 4) as share from e where g is not null group by 1, 2")
def q13(t):
    f = t("topics").groupBy(F.concat("scope", F.col("rank").cast("string")).alias("issue"), "region_id").agg(F.min("created_at").alias("ft"))
    w = Window.partitionBy("issue").orderBy("ft", "region_id")
    e = f.select(F.col("region_id").alias("from_region"), F.lead("region_id").over(w).alias("to_region"), scoring.lag_minutes(F.col("ft"), F.lead("ft").over(w)).alias("lag")).filter("to_region is not null")
    n = e.groupBy("from_region", "to_region").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("lag") > 0, F.col("lag"))), 4).alias("avg_lag"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("from_region")), 4))


def transfers(events, topics, region: str | None, direction: str = "all", limit: object = 50, offset: object = 0):  # noqa: ANN001, ANN201, PLR0913
    """Pairs of community and news topics with how often, when and by how much one led the other."""
    lead = scoring.leader(F.col("lag_minutes"))
    x = events if direction == "all" else events.filter(lead == direction)
    side = topics.select(F.col("id").alias("community_id"), F.col("region_id"), F.col("name").alias("community_name"))
    side = side if region is None else side.filter(F.col("region_id") == region)
    news = topics.select(F.col("id").alias("news_id"), F.col("name").alias("news_name"))
    s = x.groupBy("community_id", "news_id").agg(F.count(F.lit(1)).alias("n"), F.max("detected_at").alias("last_at"), F.round(F.avg(F.abs("lag_minutes")), 4).alias("avg_lag"), F.max_by("lag_minutes", F.struct("detected_at", "lag_minutes")).alias("last_lag"), F.round(F.avg("cosine"), 4).alias("cosine"))
    page = s.join(side, "community_id").join(news, "news_id").orderBy(F.desc("cosine"), F.abs("last_lag"), F.desc("last_at"), "community_id", "news_id")
    return page.offset(clamp(offset, 0, 10**6, 0)).limit(clamp(limit, 1, 200, 50))


@query("q14_source_transfer", "select o.community_id, o.news_id, c.region_id, c.name as community_name, n.name as news_name, count(*) as n, max(detected_at) as last_at, round(avg(abs(lag_minutes)), 4) as avg_lag, arg_max(lag_minutes, row(detected_at, lag_minutes)) as last_lag, round(avg(cosine), 4) as cosine from overlap_events o join topics c on c.id = o.community_id and c.region_id = 'EUROPE' join topics n on n.id = o.news_id where lag_minutes >= 10 group by 1, 2, 3, 4, 5 order by cosine desc, abs(last_lag), last_at desc, 1, 2 limit 50")
def q14(t):
    return transfers(t("overlap_events"), t("topics"), "EUROPE", "community").select("community_id", "news_id", "region_id", "community_name", "news_name", "n", "last_at", "avg_lag", "last_lag", "cosine")


@query("q23_pulse_report", "select (select count(*) from posts where posted_at >= NOW - interval 48 hours) as posts, (select count(*) from runs where started_at >= NOW - interval 48 hours) as runs, (select count(*) from runs where started_at >= NOW - interval 48 hours and status = 'success') as ok, (select round(quantile_cont(latency_ms, 0.95), 4) from runs where started_at >= NOW - interval 48 hours) as p95, (select string_agg(error_code, ',' order by n desc, error_code) from (select error_code, count(*) as n from runs where started_at >= NOW - interval 48 hours and error_code is not null group by 1 order by 2 desc, 1 limit 3)) as codes")
def q23(t):
    r = t("runs").filter(F.col("started_at") >= ago(48))
    a = r.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "success").alias("ok"), F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"))
    top = top_per_key(r.filter("error_code is not null").groupBy("error_code").agg(F.count(F.lit(1)).alias("n")), [F.lit(0)], [F.desc("n"), F.col("error_code")], 3)
    codes = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "error_code"))), lambda c: c["error_code"]), ",").alias("codes"))
    p = t("posts").filter(F.col("posted_at") >= ago(48)).agg(F.count(F.lit(1)).alias("posts"))
    return p.join(F.broadcast(a)).join(F.broadcast(codes.withColumn("codes", F.nullif(F.col("codes"), F.lit("")))))


@query("q24_source_report", "select s.id, s.region_id, count(p.id) filter (p.posted_at >= NOW - interval 24 hours) as n24, count(p.id) filter (p.posted_at >= NOW - interval 168 hours) as n168, max(p.posted_at) as last_at, case when max(p.posted_at) is null then 'silent' when max(p.posted_at) >= NOW - interval 48 hours then 'live' else 'stale' end as state from sources s left join posts p on p.source_id = s.id group by 1, 2")
def q24(t):
    since = lambda h: F.count_if(F.col("posted_at") >= ago(h))
    n = t("posts").groupBy(F.col("source_id").alias("id")).agg(since(24).alias("n24"), since(168).alias("n168"), F.max("posted_at").alias("last_at"))
    state = F.when(F.col("last_at").isNull(), "silent").when(F.col("last_at") >= ago(48), "live").otherwise("stale")
    return t("sources").select("id", "region_id").join(n, "id", "left").fillna(0, ["n24", "n168"]).withColumn("state", state)
