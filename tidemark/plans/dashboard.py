"""Scans, updates, qualified issues, detail pages and health pages of the dashboard on the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.unicode import nfkc
from ..operators.keyed import distinct_on, top_per_key, upsert
from . import pipelines as P
from .analysis import j18
from .domain import ORDERS_AS_OF
from .endpoints import clamp, search
from .relational import ago, query


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def then(hours: int) -> Column:
    return ago(hours, ORDERS_AS_OF)


# Scans


@query("s05_global_history", "select issue, heat, created_at from topics where scope = 'news' and created_at >= THEN_ - interval 168 hours order by created_at, id")
def s05(t):
    return t("topics").filter((F.col("scope") == "news") & (F.col("created_at") >= then(168))).orderBy("created_at", "id").select("issue", "heat", "created_at")


@query("s06_topics_window", "select id, region_id, heat from topics where created_at >= THEN_ - interval 720 hours")
def s06(t):
    return t("topics").filter(F.col("created_at") >= then(720)).select("id", "region_id", "heat")


@query("s07_portal_page", "select id, rank, name from topics where region_id = 'AMERICA' and created_at >= THEN_ - interval 2400 hours order by rank, id limit 100")
def s07(t, limit: object = 500):
    return t("topics").filter((F.col("region_id") == "AMERICA") & (F.col("created_at") >= then(2400))).orderBy("rank", "id").limit(clamp(limit, 1, 100, 20)).select("id", "rank", "name")


def region_sources(sources: DataFrame, region: str, scope: str) -> DataFrame:
    """A region's sources: those of the first tier for news, the others for community, all for mixed."""
    own = sources.filter(F.col("region_id") == region)
    return own if scope == "mixed" else own.filter((F.col("trust_tier") == 1) == (scope == "news"))


@query("s12_region_sources", "select 'news' as scope, id from sources where region_id = 'r2' and trust_tier = 1 union all select 'community', id from sources where region_id = 'r2' and trust_tier <> 1 union all select 'mixed', id from sources where region_id = 'r2'")
def s12(t):
    of = lambda s: region_sources(t("sources"), "r2", s).select(F.lit(s).alias("scope"), "id")
    return of("news").unionByName(of("community")).unionByName(of("mixed"))


# Sinks: the table after the write


@query("k02_portal_signals", "select region_id, id, rank from (select *, row_number() over (partition by region_id order by rank, id) as r from topics where scope = 'news' and rank > 0) where r <= 50")
def k02(t):
    x = t("topics").filter((F.col("scope") == "news") & (F.col("rank") > 0)).withColumn("at", F.col("rank"))
    return top_per_key(x, ["region_id"], [F.col("at"), F.col("id")], 50).select("region_id", "id", F.col("at").alias("rank"))


@query("k03_source_status", "select s.id, max(r.started_at) as last_scraped_at, arg_max(row(case when r.status = 'failed' then coalesce(r.error_code, 'unknown error') end), row(r.started_at, r.id))[1] as last_error from sources s left join runs r on r.source_id = s.id group by 1")
def k03(t):
    """The latest run of a source: its time, and its error, which a success clears."""
    error = F.when(F.col("status") == "failed", F.coalesce("error_code", F.lit("unknown error")))
    last = t("runs").groupBy(F.col("source_id").alias("id")).agg(F.max("started_at").alias("last_scraped_at"), F.max_by(error, F.struct("started_at", "id")).alias("last_error"))
    return t("sources").select("id").join(last, "id", "left")


def _baseline(x: DataFrame, when: Column) -> DataFrame:
    return x.filter(when).groupBy("region_id", "scope", F.col("created_at").cast("date").cast("string").alias("day")).agg(F.round(F.avg("heat"), 4).alias("heat"))


@query("k10_daily_baseline", "with a as (select region_id, scope, cast(cast(created_at as date) as varchar) as day, round(avg(heat), 4) as heat from topics where rank <= 3 group by 1, 2, 3), b as (select region_id, scope, cast(cast(created_at as date) as varchar) as day, round(avg(heat), 4) as heat from topics where rank >= 3 group by 1, 2, 3) select coalesce(b.region_id, a.region_id) as region_id, coalesce(b.scope, a.scope) as scope, coalesce(b.day, a.day) as day, coalesce(b.heat, a.heat) as heat from a full join b on a.region_id = b.region_id and a.scope = b.scope and a.day = b.day")
def k10(t):
    x = t("topics")
    return upsert(_baseline(x, F.col("rank") <= 3), _baseline(x, F.col("rank") >= 3), ["region_id", "scope", "day"])


@query("k13_upsert_overlaps", "select community_id, news_id, arg_max(lag_minutes, row(part, detected_at, lag_minutes)) as lag_minutes from (select *, 0 as part from overlap_events where community_id % 2 = 0 union all select community_id, news_id, canonical_key, detected_at, lag_minutes + 1, cosine, 1 from overlap_events where news_id % 2 = 0) group by 1, 2")
def k13(t):
    one = lambda d: distinct_on(d, ["community_id", "news_id"], [F.desc("detected_at"), F.desc("lag_minutes")]).select("community_id", "news_id", "lag_minutes")
    o = t("overlap_events")
    return upsert(one(o.filter("community_id % 2 = 0")), one(o.filter("news_id % 2 = 0").withColumn("lag_minutes", F.col("lag_minutes") + 1)), ["community_id", "news_id"])


@query("k18_enrichment", "select t.id, coalesce(c.c_mktsegment, t.name) as name from topics t left join customer c on c.c_custkey = t.issue and c.c_custkey % 2 = 0")
def k18(t):
    better = t("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("issue"), "c_mktsegment")
    return t("topics").join(better, "issue", "left").select("id", F.coalesce("c_mktsegment", "name").alias("name"))


@query("k20_policy_update", "select id, case when id in ('s1', 's2') then true when id in ('s3', 's4') then false else is_core end as is_core from sources")
def k20(t):
    return t("sources").select("id", F.when(F.col("id").isin("s1", "s2"), True).when(F.col("id").isin("s3", "s4"), False).otherwise(F.col("is_core")).alias("is_core"))


# Predicates


@query("p06_time_window", "select id from posts where posted_at >= NOW - interval 24 hours and posted_at < NOW - interval 12 hours")
def p06(t):
    return t("posts").filter((F.col("posted_at") >= ago(24)) & (F.col("posted_at") < ago(12))).select("id")


def led(events: DataFrame, leader: str = "all", tie: int = 10) -> DataFrame:
    """Events that the named side led; `all` leaves the predicate out."""
    return events if leader == "all" else events.filter(scoring.leader(F.col("lag_minutes"), tie) == leader)


@query("p08_mode", "select 'all' as mode, count(*) as n from overlap_events union all select 'community', count(*) from overlap_events where lag_minutes >= 10 union all select 'news', count(*) from overlap_events where lag_minutes <= -10")
def p08(t):
    modes = [led(t("overlap_events"), m).agg(F.lit(m).alias("mode"), _n()) for m in ("all", "community", "news")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("p13_boolean_projection", "select s.id, max(r.started_at) is not null as has_run, coalesce(max(r.started_at) >= NOW - interval 2 hours, false) as is_fresh from sources s left join runs r on r.source_id = s.id group by 1")
def p13(t):
    last = t("runs").groupBy(F.col("source_id").alias("id")).agg(F.max("started_at").alias("at"))
    return t("sources").select("id").join(last, "id", "left").select("id", F.col("at").isNotNull().alias("has_run"), F.coalesce(F.col("at") >= ago(2), F.lit(False)).alias("is_fresh"))


#: An issue is a topic on one day; its regions follow one another by their first post.
FIRSTS = "f as (select concat(topic_name, ' ', cast(cast(posted_at as date) as varchar)) as issue, region_id, min(posted_at) as ft, round(sum(like_count), 4) as heat from posts group by 1, 2)"
EDGES = f"{FIRSTS}, e as (select *, lead(region_id) over w as g, cast(floor(date_diff('microsecond', ft, lead(ft) over w) / 60e6 + 0.5) as bigint) as lag from f window w as (partition by issue order by ft, region_id)), q as (select *, g is not null and lag > 0 and lag <= 4320 and round(1 - least(lag / 1440, 1), 4) >= 0.25 as good from e)"


def firsts(t) -> DataFrame:  # noqa: ANN001
    return t("posts").groupBy(F.concat_ws(" ", "topic_name", F.col("posted_at").cast("date").cast("string")).alias("issue"), "region_id").agg(F.min("posted_at").alias("first_at"), F.round(F.sum("like_count"), 4).alias("heat"))


def issue_rows(t) -> DataFrame:  # noqa: ANN001
    """issue, timeline (first_at, region_id, heat), edges and qualified edges, heat: one row an issue."""
    x = firsts(t).groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("first_at", "region_id", "heat"))).alias("timeline"), F.round(F.sum("heat"), 3).alias("heat"))
    x = x.withColumn("edges", P.timeline_edges(F.transform("timeline", lambda p: F.struct(p["first_at"].alias("first_at"), p["region_id"].alias("region_id")))))
    return x.withColumn("good", P.qualified_edges(F.col("edges"), "mixed"))


def qualified(t, regions: int = 3, heat: float = 50.0) -> DataFrame:  # noqa: ANN001
    """Issues of enough regions and heat that some edge of theirs speaks for."""
    return issue_rows(t).filter((F.size("timeline") >= regions) & (F.col("heat") >= heat) & (F.size("good") >= 1))


QUALIFIED = f"{EDGES}, i as (select issue, round(sum(heat), 3) as heat, count(*) as regions, count(*) filter (good) as edges from q group by 1 having count(*) >= 3 and round(sum(heat), 3) >= 50 and count(*) filter (good) >= 1)"


@query("p16_qualified_issues", f"with {QUALIFIED} select * from i")
def p16(t):
    return qualified(t).select("issue", "heat", F.size("timeline").cast("long").alias("regions"), F.size("good").cast("long").alias("edges"))


def pruned(x: DataFrame) -> DataFrame:
    """Issues with only the regions that a qualified edge touches, and first_at among these."""
    ends = F.array_distinct(F.concat(F.transform("good", lambda e: e["from"]), F.transform("good", lambda e: e["to"])))
    x = x.withColumn("_ends", ends).withColumn("timeline", F.filter("timeline", lambda p: F.array_contains("_ends", p["region_id"]))).drop("_ends")
    return x.withColumn("first_at", F.element_at("timeline", 1)["first_at"])


@query("p17_pruned_issues", f"with {QUALIFIED}, d as (select issue, region_id as r from q where good union select issue, g from q where good) select i.issue, min(f.ft) as first_at, string_agg(f.region_id, ',' order by f.ft, f.region_id) as regions from i join d on d.issue = i.issue join f on f.issue = d.issue and f.region_id = d.r group by 1")
def p17(t):
    return pruned(qualified(t)).select("issue", "first_at", F.array_join(F.transform("timeline", lambda p: p["region_id"]), ",").alias("regions"))


@query("p18_status_filter", f"with {FIRSTS} select issue from f group by 1 having bool_or(heat > 120)")
def p18(t):
    return issue_rows(t).filter(F.exists("timeline", lambda p: p["heat"] > 120)).select("issue")


@query("p20_bidirectional_contains", "select distinct t.id from topics t join (select distinct lower(c_mktsegment) as m from customer where c_custkey <= 3 union select 'asia building and more') k on contains(lower(t.name), k.m) or contains(k.m, lower(t.name))")
def p20(t):
    words = t("customer").filter("c_custkey <= 3").select(F.lower("c_mktsegment").alias("m")).union(t("customer").sparkSession.range(1).select(F.lit("asia building and more"))).agg(F.collect_set("m").alias("names"))
    name = F.lower("name")
    return t("topics").join(F.broadcast(words)).filter(F.exists("names", lambda n: F.contains(name, n) | F.contains(n, name))).select("id")


@query("p21_shared_regions", f"with {FIRSTS} select issue, heat from (select issue, round(sum(heat), 3) as heat, bool_or(region_id in ('r1', 'r2')) as shared from f group by 1) where shared order by heat desc, issue limit 8")
def p21(t):
    x = issue_rows(t).filter(F.arrays_overlap(F.transform("timeline", lambda p: p["region_id"]), F.array(F.lit("r1"), F.lit("r2"))))
    return x.orderBy(F.desc("heat"), "issue").limit(8).select("issue", "heat")


@query("p22_period_totals", "select region_id, count(*) as topics, round(sum(heat), 2) as heat from topics where created_at >= THEN_ - interval 4320 hours group by 1")
def p22(t):
    return t("topics").filter(F.col("created_at") >= then(4320)).groupBy("region_id").agg(_n("topics"), F.round(F.sum("heat"), 2).alias("heat"))


@query("p26_surging", "with h as (select topic_name, sum(like_count) filter (posted_at > NOW - interval 25 hours) as heat, coalesce(arg_max(like_count, row(posted_at, id)) filter (posted_at <= NOW - interval 25 hours), 0) as h1, coalesce(arg_max(like_count, row(posted_at, id)) filter (posted_at <= NOW - interval 26 hours), 0) as h2 from posts group by 1) select topic_name from h where round(coalesce(heat, 0) - h1, 4) >= 10 and round(coalesce(heat, 0) - h1 - h1 + h2, 4) > 0")
def p26(t):
    return j18(t).filter((F.col("acceleration") > 0) & (F.col("velocity") >= 10)).select("topic_name")


# Joins


@query("j05_semi_through_members", "select t.id from topics t where exists (select 1 from topic_sources x join sources s on s.id = x.source_id where x.topic_id = t.id and s.trust_tier = 1)")
def j05(t):
    arrays_of = t("topic_sources").groupBy(F.col("topic_id").alias("id")).agg(F.collect_set("source_id").alias("source_ids"))
    trusted = t("sources").filter("trust_tier = 1").select(F.col("id").alias("source_id"))
    hit = arrays_of.select("id", F.explode("source_ids").alias("source_id")).join(trusted, "source_id").select("id").distinct()
    return t("topics").join(hit, "id", "left_semi").select("id")


@query("j06_health_fan", "select s.id, coalesce(p.n, 0) as posts_24h, coalesce(r.n, 0) as runs, coalesce(r.ok, 0) as ok, r.latency, l.status as last_status, k.at_ as last_success from sources s left join (select source_id, count(*) as n from posts where posted_at >= NOW - interval 24 hours group by 1) p on p.source_id = s.id left join (select source_id, count(*) as n, count(*) filter (status = 'success') as ok, round(avg(latency_ms), 3) as latency from runs where started_at >= NOW - interval 168 hours group by 1) r on r.source_id = s.id left join (select source_id, arg_max(status, row(started_at, id)) as status from runs group by 1) l on l.source_id = s.id left join (select source_id, max(started_at) as at_ from runs where status = 'success' group by 1) k on k.source_id = s.id")
def j06(t):
    """Two scans feed all four sides: posts once, runs once."""
    recent = F.col("started_at") >= ago(168)
    p = t("posts").filter(F.col("posted_at") >= ago(24)).groupBy(F.col("source_id").alias("id")).agg(_n("posts_24h"))
    r = t("runs").groupBy(F.col("source_id").alias("id")).agg(F.count_if(recent).alias("runs"), F.count_if(recent & (F.col("status") == "success")).alias("ok"), F.round(F.avg(F.when(recent, F.col("latency_ms"))), 3).alias("latency"), F.max_by("status", F.struct("started_at", "id")).alias("last_status"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success"))
    return t("sources").select("id").join(p, "id", "left").join(r, "id", "left").fillna(0, ["posts_24h", "runs", "ok"])


@query("j09_conditional_counts", "select s.id, count(p.id) filter (p.posted_at >= NOW - interval 24 hours) as n24, count(p.id) filter (p.posted_at >= NOW - interval 168 hours) as n168, count(p.id) filter (p.posted_at >= NOW - interval 6 hours) as n6 from sources s left join posts p on p.source_id = s.id group by 1")
def j09(t):
    since = lambda h: F.count_if(F.col("posted_at") >= ago(h)).alias(f"n{h}")
    return t("sources").select("id").join(t("posts").groupBy(F.col("source_id").alias("id")).agg(since(24), since(168), since(6)), "id", "left").fillna(0)


@query("j14_unofficial_candidates", "with c as (select * from topics where scope = 'community'), n as (select * from topics where scope = 'news'), p as (select c.id as community_id, n.id as news_id, round(0.45 + 0.35 * least(c.heat, n.heat) / greatest(c.heat, n.heat), 4) as score from c join n on c.region_id = n.region_id and c.issue = n.issue) select * from p where score >= 0.6 and not exists (select 1 from overlap_events o where o.community_id = p.community_id and o.news_id = p.news_id)")
def j14(t):
    side = lambda s: t("topics").filter(F.col("scope") == s).select(F.col("id").alias(f"{s}_id"), "region_id", "issue", F.col("heat").alias(s))
    score = F.round(0.45 + 0.35 * F.least("community", "news") / F.greatest("community", "news"), 4)
    x = side("community").join(side("news"), ["region_id", "issue"]).select("community_id", "news_id", score.alias("score")).filter("score >= 0.6")
    return x.join(t("overlap_events").select("community_id", "news_id"), ["community_id", "news_id"], "left_anti")


@query("j20_both_ends", "select o.community_id, o.news_id, c.name as community_name, n.name as news_name, n.heat as news_heat from overlap_events o left join topics c on c.id = o.community_id and c.heat > 50000 left join topics n on n.id = o.news_id and n.heat > 50000")
def j20(t):
    x = t("topics").filter("heat > 50000")
    c, n = x.select(F.col("id").alias("community_id"), F.col("name").alias("community_name")), x.select(F.col("id").alias("news_id"), F.col("name").alias("news_name"), F.col("heat").alias("news_heat"))
    return t("overlap_events").join(c, "community_id", "left").join(n, "news_id", "left").select("community_id", "news_id", "community_name", "news_name", "news_heat")


@query("j25_regional_members", "select issue as component, region_id, count(*) as n, round(sum(heat), 2) as heat from topics where scope <> 'mixed' group by 1, 2")
def j25(t):
    groups = t("topics").filter("scope <> 'mixed'").groupBy(F.col("issue").alias("component")).agg(F.collect_list("id").alias("topic_ids"))
    return groups.select("component", F.explode("topic_ids").alias("id")).join(t("topics"), "id").groupBy("component", "region_id").agg(_n(), F.round(F.sum("heat"), 2).alias("heat"))


# Aggregates


@query("a14_recent_posts", "select source_id, count(*) as n from posts where posted_at >= NOW - interval 24 hours group by 1")
def a14(t):
    return t("posts").filter(F.col("posted_at") >= ago(24)).groupBy("source_id").agg(_n())


@query("a16_last_success", "select source_id, max(started_at) as at from runs where status = 'success' group by 1")
def a16(t):
    return t("runs").filter("status = 'success'").groupBy("source_id").agg(F.max("started_at").alias("at"))


@query("a18_day_counts", "select (select count(*) from posts where posted_at >= NOW - interval 24 hours) as posts, (select count(*) from runs where started_at >= NOW - interval 24 hours) as runs, (select count(*) from runs where started_at >= NOW - interval 24 hours and status = 'failed') as failed, (select count(distinct source_id) from posts where posted_at >= NOW - interval 24 hours) as sources")
def a18(t):
    p = t("posts").filter(F.col("posted_at") >= ago(24)).agg(_n("posts"), F.countDistinct("source_id").alias("sources"))
    r = t("runs").filter(F.col("started_at") >= ago(24)).agg(_n("runs"), F.count_if(F.col("status") == "failed").alias("failed"))
    return p.join(F.broadcast(r))


@query("a22_recent_and_total", "select region_id, count(*) filter (posted_at >= NOW - interval 24 hours) as recent, count(*) as total from posts group by 1")
def a22(t):
    return t("posts").groupBy("region_id").agg(F.count_if(F.col("posted_at") >= ago(24)).alias("recent"), _n("total"))


@query("a23_ingest_check", "select source_id, count(*) as n, max(posted_at) as last_at from posts where posted_at >= NOW - interval 90 minutes group by 1")
def a23(t):
    since = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_interval(mins=F.lit(90))
    return t("posts").filter(F.col("posted_at") >= since).groupBy("source_id").agg(_n(), F.max("posted_at").alias("last_at"))


@query("a36_after_sanitising", "select issue, count(distinct region_id || scope) as sides, round(sum(heat), 2) as heat from topics where not (name ilike '%household%') group by 1 having count(distinct region_id || scope) >= 2")
def a36(t):
    x = t("topics").filter(~F.col("name").ilike("%household%")).groupBy("issue").agg(F.countDistinct(F.concat("region_id", "scope")).alias("sides"), F.round(F.sum("heat"), 2).alias("heat"))
    return x.filter("sides >= 2")


@query("a45_health_tally", "with h as (select source_id, count(*) filter (status = 'failed') / count(*) as rate from runs where started_at >= NOW - interval 168 hours group by 1) select count(*) filter (rate < 0.2) as healthy, count(*) filter (rate >= 0.2) as degraded, (select string_agg(error_code, ',' order by n desc, error_code) from (select error_code, count(*) as n from runs where error_code is not null and started_at >= NOW - interval 168 hours group by 1 order by 2 desc, 1 limit 3)) as codes from h")
def a45(t):
    r = t("runs").filter(F.col("started_at") >= ago(168))
    h = r.groupBy("source_id").agg((F.count_if(F.col("status") == "failed") / F.count(F.lit(1))).alias("rate")).agg(F.count_if(F.col("rate") < 0.2).alias("healthy"), F.count_if(F.col("rate") >= 0.2).alias("degraded"))
    top = r.filter("error_code is not null").groupBy("error_code").agg(_n()).orderBy(F.desc("n"), "error_code").limit(3)
    codes = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "error_code"))), lambda c: c["error_code"]), ",").alias("codes"))
    return h.join(F.broadcast(codes.select(F.nullif(F.col("codes"), F.lit("")).alias("codes"))))


@query("a51_qualified_routes", f"with {EDGES} select count(*) filter (good) as routes, count(distinct issue) filter (good) as issues from q")
def a51(t):
    return issue_rows(t).agg(F.coalesce(F.sum(F.size("good")), F.lit(0)).cast("long").alias("routes"), F.count_if(F.size("good") > 0).alias("issues"))


# First rows, stages, sorts


@query("w06_latest_run", "select source_id, id, status from (select *, row_number() over (partition by source_id order by started_at desc, id desc) as r from runs) where r = 1")
def w06(t):
    return t("runs").groupBy("source_id").agg(F.max_by(F.struct("id", "status"), F.struct("started_at", "id")).alias("m")).select("source_id", "m.id", "m.status")


@query("w08_region_report", "with s as (select region_id, created_at, count(*) as topics, round(sum(heat), 2) as heat from topics group by 1, 2) select region_id, created_at, topics, heat from (select *, row_number() over (partition by region_id order by created_at desc) as r from s) where r = 1")
def w08(t):
    s = t("topics").groupBy("region_id", "created_at").agg(_n("topics"), F.round(F.sum("heat"), 2).alias("heat"))
    return s.groupBy("region_id").agg(F.max_by(F.struct("created_at", "topics", "heat"), "created_at").alias("m")).select("region_id", "m.*")


@query("w13_bucket_lifecycle", "with b as (select region_id, topic_name, time_bucket(interval 6 hours, posted_at, TIMESTAMP '2000-01-01') as bucket, round(avg(like_count), 7) as heat from posts where posted_at >= NOW - interval 72 hours group by 1, 2, 3), s as (select *, lag(heat, 1) over w as p1, lag(heat, 2) over w as p2, max(heat) over (partition by region_id, topic_name) as top, row_number() over (partition by region_id, topic_name order by bucket desc) as r from b window w as (partition by region_id, topic_name order by bucket)) select region_id, topic_name, case when coalesce(heat < p1 and p1 < p2 and heat < top, false) then 'fading' else 'peaking' end as stage from s where r = 1")
def w13(t):
    b = t("posts").filter(F.col("posted_at") >= ago(72)).groupBy("region_id", "topic_name", F.window("posted_at", "6 hours").alias("w")).agg(F.round(F.avg("like_count"), 7).alias("heat"))
    x = b.groupBy("region_id", "topic_name").agg(F.array_sort(F.collect_list(F.struct(F.col("w.start").alias("at"), "heat"))).alias("b"))
    heat = lambda k: F.try_element_at("b", F.lit(-k))["heat"]
    return x.select("region_id", "topic_name", scoring.lifecycle(F.lit(24.0), heat(1), heat(2), heat(3), F.array_max(F.transform("b", lambda p: p["heat"]))).alias("stage"))


@query("t06_heat_or_spread", f"with {FIRSTS}, i as (select issue, round(sum(heat), 3) as heat, count(*) as spread from f group by 1) (select 'heat' as sort, issue, heat, spread from i order by heat desc, issue limit 10) union all (select 'spread', issue, heat, spread from i order by spread desc, heat desc, issue limit 10)")
def t06(t):
    x = issue_rows(t).select("issue", "heat", F.size("timeline").cast("long").alias("spread"))
    page = lambda s, *o: x.orderBy(*o).limit(10).select(F.lit(s).alias("sort"), "issue", "heat", "spread")
    return page("heat", F.desc("heat"), "issue").unionByName(page("spread", F.desc("spread"), F.desc("heat"), "issue"))


@query("t15_ranked_posts", "select region_id, id, place from (select region_id, id, row_number() over (partition by region_id order by round(like_count + 2 * coalesce(comment_count, 0), 6) desc, posted_at desc, id) as place from posts) where place <= 12")
def t15(t):
    x = t("posts").withColumn("score", F.round(F.col("like_count") + 2 * F.coalesce("comment_count", F.lit(0)), 6))
    return top_per_key(x, ["region_id"], [F.desc("score"), F.desc("posted_at"), F.col("id")], 12, "place").select("region_id", "id", F.col("place").cast("long").alias("place"))


@query("t16_hottest", "select region_id, arg_max(name, row(heat, id)) as name, max(heat) as heat from topics group by 1")
def t16(t):
    return t("topics").groupBy("region_id").agg(F.max_by("name", F.struct("heat", "id")).alias("name"), F.max("heat").alias("heat"))


@query("t17_summary_candidates", "select id, name, heat from topics where scope = 'community' order by heat desc, id limit 5")
def t17(t):
    return t("topics").filter("scope = 'community'").orderBy(F.desc("heat"), "id").limit(5).select("id", "name", "heat")


@query("t18_event_rows", f"with {EDGES} select issue, region_id as from_region, g as to_region, ft + lag * interval 1 minute as event_at, round(1 - least(lag / 1440, 1), 4) as confidence from e where g is not null order by event_at desc, confidence desc, issue, 2 limit 36")
def t18(t):
    f, w = firsts(t), Window.partitionBy("issue").orderBy("first_at", "region_id")
    lag = scoring.lag_minutes(F.col("first_at"), F.lead("first_at").over(w))
    e = f.select("issue", F.col("region_id").alias("from_region"), F.lead("region_id").over(w).alias("to_region"), "first_at", lag.alias("lag")).filter("to_region is not null")
    e = e.select("issue", "from_region", "to_region", (F.col("first_at") + F.make_interval(mins=F.col("lag").cast("int"))).alias("event_at"), F.round(1 - F.least(F.col("lag") / 1440, F.lit(1.0)), 4).alias("confidence"))
    return e.orderBy(F.desc("event_at"), F.desc("confidence"), "issue", "from_region").limit(36)


# Merges


@query("u05_array_union", "select issue, string_agg(distinct region_id, ',' order by region_id) as regions, string_agg(distinct scope, ',' order by scope) as scopes from topics group by 1")
def u05(t):
    side = lambda when: t("topics").filter(when).groupBy("issue").agg(F.collect_set("region_id").alias("r"), F.collect_set("scope").alias("s"))
    a, b = side("id % 2 = 0"), side("id % 2 = 1").withColumnsRenamed({"r": "r2", "s": "s2"})
    none = F.array().cast("array<string>")
    both = lambda x, y: F.array_join(F.array_sort(F.array_union(F.coalesce(x, none), F.coalesce(y, none))), ",")
    return a.join(b, "issue", "full_outer").select("issue", both("r", "r2").alias("regions"), both("s", "s2").alias("scopes"))


@query("u06_timeline_merge", "with f as (select topic_name, region_id, min(posted_at) as at_ from posts group by 1, 2) select topic_name, string_agg(region_id, '>' order by at_, region_id) as path, min(at_) as first_at from f group by 1")
def u06(t):
    part = lambda when: t("posts").filter(when).groupBy("topic_name", "region_id").agg(F.min("posted_at").alias("at"))
    x = part("id % 2 = 0").unionByName(part("id % 2 = 1")).groupBy("topic_name", "region_id").agg(F.min("at").alias("at"))
    x = x.groupBy("topic_name").agg(F.array_sort(F.collect_list(F.struct("at", "region_id"))).alias("p"))
    return x.select("topic_name", F.array_join(F.transform("p", lambda p: p["region_id"]), ">").alias("path"), F.element_at("p", 1)["at"].alias("first_at"))


@query("u11_unique_names", "with x as (select issue, trim(name) as name, row_number() over (partition by issue, lower(trim(name)) order by created_at, id) as r, created_at, id from topics) select issue, string_agg(name, '|' order by created_at, id) as names from x where r = 1 and name <> '' group by 1")
def u11(t):
    """Names of an issue without regard to case and width, each as it was first seen, in that order."""
    x = t("topics").withColumn("name", F.trim(nfkc(F.col("name")))).filter("name <> ''")
    x = distinct_on(x, ["issue", F.lower("name")], [F.col("created_at"), F.col("id")])
    x = x.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "name"))).alias("n"))
    return x.select("issue", F.array_join(F.transform("n", lambda p: p["name"]), "|").alias("names"))


# Functions


@query("f42_age_buckets", "select id, case when started_at >= NOW - interval 5 minutes then 'live' when started_at >= NOW - interval 30 minutes then 'recent' when started_at >= NOW - interval 24 hours then 'today' else 'old' end as age from runs")
def f42(t):
    minutes = scoring.lag_minutes(F.col("started_at"), ago(0))
    edge = lambda m: F.col("started_at") >= ago(0) - F.make_interval(mins=F.lit(m))
    return t("runs").select("id", F.when(edge(5), "live").when(edge(30), "recent").when(edge(1440), "today").otherwise("old").alias("age")).filter(minutes.isNotNull())


@query("f46_news_signal", "select doc_id, round(least(2.4, 1 + 0.07 * least(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')), 12) + 0.05 * least(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{8,}')), 6) + case when length(coalesce(text, '')) > 280 then 0.15 else 0 end), 4) as signal from documents")
def f46(t):
    text = F.coalesce("text", F.lit(""))
    words = lambda p, most: F.least(F.size(F.regexp_extract_all(F.lower(text), F.lit(p), 0)), F.lit(most))
    return t("documents").select("doc_id", F.round(F.least(F.lit(2.4), 1 + 0.07 * words("[a-z]{3,}", 12) + 0.05 * words("[a-z]{8,}", 6) + F.when(F.length(text) > 280, 0.15).otherwise(0.0)), 4).alias("signal"))


@query("f47_source_weight", "select p.region_id, round(sum(p.like_count * coalesce(case s.trust_tier when 1 then 1.5 when 2 then 1.2 end, 1)), 2) as heat from posts p left join sources s on s.id = p.source_id group by 1")
def f47(t):
    weight = F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit(1.5), F.lit(2), F.lit(1.2)), F.col("trust_tier").cast("int")), F.lit(1.0))
    s = t("sources").select(F.col("id").alias("source_id"), "trust_tier")
    return t("posts").join(s, "source_id", "left").groupBy("region_id").agg(F.round(F.sum(F.col("like_count") * weight), 2).alias("heat"))


@query("f59_sentiment_label", "with s as (select issue, count(*) filter (sentiment > 0.2) / count(*) as p, count(*) filter (sentiment < -0.2) / count(*) as m from topics group by 1) select issue, case when p > 0.35 and m > 0.35 then 'controversial' when p > m and p >= 1 - p - m then 'positive' when m > p and m >= 1 - p - m then 'negative' else 'neutral' end as label from s")
def f59(t):
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    s = t("topics").groupBy("issue").agg(share(F.col("sentiment") > 0.2).alias("p"), share(F.col("sentiment") < -0.2).alias("m"))
    p, m, rest = F.col("p"), F.col("m"), 1 - F.col("p") - F.col("m")
    return s.select("issue", F.when((p > 0.35) & (m > 0.35), "controversial").when((p > m) & (p >= rest), "positive").when((m > p) & (m >= rest), "negative").otherwise("neutral").alias("label"))


@query("f62_comparison_badge", "with h as (select issue, sum(heat) filter (scope = 'community') as c, sum(heat) filter (scope = 'news') as n from topics group by 1) select issue, case when n is null then 'community only' when c is null then 'news only' when c / n > 1.4 then 'community' when c / n < 0.7 then 'news' else 'even' end as badge from h where coalesce(c, n) is not null")
def f62(t):
    of = lambda s: F.sum(F.when(F.col("scope") == s, F.col("heat")))
    h = t("topics").groupBy("issue").agg(of("community").alias("c"), of("news").alias("n")).filter(F.coalesce("c", "n").isNotNull())
    ratio = F.col("c") / F.col("n")
    return h.select("issue", F.when(F.col("n").isNull(), "community only").when(F.col("c").isNull(), "news only").when(ratio > 1.4, "community").when(ratio < 0.7, "news").otherwise("even").alias("badge"))


# Endpoints


@query("q01_stats", "select (select count(*) from posts) as total_posts, (select count(*) from topics) as total_topics, (select count(*) from (select distinct scope, issue from topics)) as total_global_topics, (select count(*) from region where r_regionkey <> 3) as active_regions, (select count(*) from (select s.id from sources s join runs r on r.source_id = s.id group by 1 having max(r.started_at) >= NOW - interval 90 minutes)) as collected_sources")
def q01(t):
    """The five counts of the start page; a source counts if its last visit was within 90 minutes, a region if it is active."""
    seen = t("runs").groupBy(F.col("source_id").alias("id")).agg(F.max("started_at").alias("at")).filter(F.col("at") >= ago(0) - F.make_interval(mins=F.lit(90)))
    issues = t("topics").select("scope", "issue").distinct()
    one = [t("topics").agg(_n("total_topics")), issues.agg(_n("total_global_topics")), t("region").filter("r_regionkey <> 3").agg(_n("active_regions")), t("sources").join(seen, "id", "left_semi").agg(_n("collected_sources"))]
    out = t("posts").agg(_n("total_posts"))
    for x in one:  # one row each
        out = out.join(F.broadcast(x))
    return out


@query("q03_compare_scopes", "with c as (select lower(name) as k, round(sum(heat), 2) as heat, count(*) as n from topics where region_id = 'ASIA' and scope = 'community' group by 1), n as (select lower(name) as k, round(sum(heat), 2) as heat, count(*) as n from topics where region_id = 'ASIA' and scope = 'news' group by 1) select coalesce(c.k, n.k) as topic, c.heat as community_heat, n.heat as news_heat, case when n.k is null then 'community only' when c.k is null then 'news only' when c.heat / n.heat > 1.4 then 'community' when c.heat / n.heat < 0.7 then 'news' else 'even' end as badge from c full join n on n.k = c.k")
def q03(t, region: str = "ASIA"):
    side = lambda s: t("topics").filter((F.col("region_id") == region) & (F.col("scope") == s)).groupBy(F.lower("name").alias("topic")).agg(F.round(F.sum("heat"), 2).alias(f"{s}_heat"))
    ratio = F.col("community_heat") / F.col("news_heat")
    badge = F.when(F.col("news_heat").isNull(), "community only").when(F.col("community_heat").isNull(), "news only").when(ratio > 1.4, "community").when(ratio < 0.7, "news").otherwise("even")
    return side("community").join(side("news"), "topic", "full_outer").select("topic", "community_heat", "news_heat", badge.alias("badge"))


@query("q04_regions_health", "with snapshots as (select s.region_id, case when r.id % 2 = 0 then 'community' else 'news' end as scope, started_at as snapshot_at from runs r join sources s on s.id = source_id where status = 'success'), latest as (select region_id, max(snapshot_at) as snapshot_at from snapshots where scope = 'community' group by 1), fresh as (select * from latest where snapshot_at >= NOW - interval 1 hour) select region_id, snapshot_at, (select count(*) from fresh) as active_regions, (select count(distinct region_id) from sources) as total_regions, (select max(snapshot_at) from fresh) as latest_snapshot_at from fresh order by snapshot_at desc, region_id")
def q04(t):
    """Regions whose latest community snapshot is at most an hour old, with how many there are of all."""
    s = t("sources").select(F.col("id").alias("source_id"), "region_id")
    made = t("runs").filter((F.col("status") == "success") & (F.col("id") % 2 == 0)).join(s, "source_id").select("region_id", F.col("started_at").alias("snapshot_at"))
    fresh = made.groupBy("region_id").agg(F.max("snapshot_at").alias("snapshot_at")).filter(F.col("snapshot_at") >= ago(1))
    total = fresh.agg(_n("active_regions"), F.max("snapshot_at").alias("latest_snapshot_at")).join(F.broadcast(s.agg(F.countDistinct("region_id").alias("total_regions"))))
    return fresh.join(F.broadcast(total)).select("region_id", "snapshot_at", "active_regions", "total_regions", "latest_snapshot_at").orderBy(F.desc("snapshot_at"), "region_id")


@query("q06_topic_detail", "with me as (select * from topics order by heat desc, id limit 1), rel as (select t.id, t.name, t.region_id, t.heat, row_number() over (order by t.heat desc, t.id) as r from topics t, me where t.issue = me.issue and t.id <> me.id) select me.id, me.name, me.heat, (select count(distinct source_id) from topic_sources x where x.topic_id = me.id) as sources, (select count(*) from topics t where t.region_id = me.region_id and lower(t.name) = lower(me.name)) as history, (select string_agg(id, ',' order by r) from rel where r <= 8) as related from me")
def q06(t):
    """A topic with its sources, the length of its history, and the eight hottest topics of its issue."""
    x = t("topics")
    me = x.orderBy(F.desc("heat"), "id").limit(1).withColumn("_name", F.lower("name"))  # one row, so all joins below broadcast it
    one = F.broadcast(me.select(F.col("id").alias("me"), F.col("issue").alias("my_issue"), F.col("region_id").alias("my_region"), "_name"))
    n = t("topic_sources").join(one, F.col("topic_id") == F.col("me")).agg(F.countDistinct("source_id").alias("sources"))
    old = x.join(one, (F.col("region_id") == F.col("my_region")) & (F.lower("name") == F.col("_name"))).agg(_n("history"))
    near = x.join(one, (F.col("issue") == F.col("my_issue")) & (F.col("id") != F.col("me"))).orderBy(F.desc("heat"), "id").limit(8)
    related = near.agg(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("heat")).alias("h"), "id"))), lambda p: p["id"].cast("string")), ","), F.lit("")).alias("related"))
    return me.select("id", "name", "heat").join(F.broadcast(n)).join(F.broadcast(old)).join(F.broadcast(related))


@query("q08_timeline", "select date_trunc('hour', posted_at) as hour, region_id, topic_name, round(avg(like_count), 6) as heat, count(*) as n from posts where posted_at >= NOW - interval 48 hours and region_id = 'r3' and topic_name ilike '%l%' group by 1, 2, 3 order by 1, 2, 3 limit 1000")
def q08(t, region: str | None = "r3", topic: str | None = "l", hours: object = 48):
    """Hourly heat of topics; each predicate is there only if its parameter is."""
    x = t("posts").filter(F.col("posted_at") >= ago(clamp(hours, 1, 168, 24)))
    x = x if region is None else x.filter(F.col("region_id") == region)
    x = x if topic is None else x.filter(F.col("topic_name").ilike(f"%{topic}%"))
    x = x.groupBy(F.date_trunc("hour", "posted_at").cast("timestamp_ntz").alias("hour"), "region_id", "topic_name").agg(F.round(F.avg("like_count"), 6).alias("heat"), _n())
    return x.orderBy("hour", "region_id", "topic_name").limit(1000)


@query("q09_global_topics", f"with {QUALIFIED}, d as (select issue, region_id as r from q where good union select issue, g from q where good), p as (select i.issue, i.heat, min(f.ft) as first_at, count(*) as spread, string_agg(f.region_id, '>' order by f.ft, f.region_id) as path from i join d on d.issue = i.issue join f on f.issue = d.issue and f.region_id = d.r group by 1, 2) select * from p where spread >= 2 order by spread desc, heat desc, issue limit 40")
def q09(t, sort: str = "spread", regions: object = 2, limit: object = 40):
    """Qualified issues with their pruned timelines, by spread or heat."""
    x = pruned(qualified(t)).select("issue", "heat", "first_at", F.size("timeline").cast("long").alias("spread"), F.array_join(F.transform("timeline", lambda p: p["region_id"]), ">").alias("path"))
    order = [F.desc("spread"), F.desc("heat")] if sort == "spread" else [F.desc("heat")]
    return x.filter(F.col("spread") >= clamp(regions, 1, 19, 2)).orderBy(*order, "issue").limit(clamp(limit, 1, 100, 20))


Q10_VECTOR = [1.0 if i % 3 else -1.0 for i in range(64)]


@query("q10_lexical_and_near", f"with l as (select item_id as id, 'text' as kind, round(0.3 + 0.1 * least(5, len(regexp_extract_all(lower(text), 'the'))), 6) as score from benchmark where text ilike '%the %'), v as (select vec_id as id, 'vector' as kind, round(list_cosine_similarity(embedding::double[], {Q10_VECTOR}::double[]), 6) as score from embeddings where round(list_cosine_similarity(embedding::double[], {Q10_VECTOR}::double[]), 6) >= 0.2 order by 3 desc, 1 limit 50), u as (select * from l union all select * from v) select id, max(score) as score, string_agg(kind, ',' order by kind) as kinds from u group by 1 order by score desc, id limit 30")
def q10(t):
    """Hits by words and hits by vector, one row an id, the better score counting."""
    found = F.size(F.regexp_extract_all(F.lower("text"), F.lit("the"), 0))
    words = t("benchmark").filter(F.col("text").ilike("%the %")).select(F.col("item_id").alias("id"), F.lit("text").alias("kind"), F.round(0.3 + 0.1 * F.least(F.lit(5), found), 6).alias("score"))
    near = search(t("embeddings"), Q10_VECTOR, "vec_id", "embedding", limit=50).select(F.col("vec_id").alias("id"), F.lit("vector").alias("kind"), F.col("cosine").alias("score"))
    u = words.unionByName(near).groupBy("id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    return u.orderBy(F.desc("score"), "id").limit(30)


@query("q12_portal_rankings", "with b as (select max(created_at) as at_ from topics where region_id = 'AFRICA' and scope = 'news') select t.id, t.rank, t.name, t.created_at from topics t, b where t.region_id = 'AFRICA' and t.scope = 'news' and t.created_at >= b.at_ - interval 240 hours order by t.created_at desc, t.rank, t.id limit 50")
def q12(t, region: str = "AFRICA", limit: object = 50):
    x = t("topics").filter((F.col("region_id") == region) & (F.col("scope") == "news"))
    last = x.agg(F.max("created_at").alias("at"))
    x = x.join(F.broadcast(last), F.col("created_at") >= F.col("at") - F.make_interval(hours=F.lit(240)))
    return x.orderBy(F.desc("created_at"), "rank", "id").limit(clamp(limit, 1, 100, 20)).select("id", "rank", "name", "created_at")
