"""Scans, predicates, joins, aggregates, windows and set operations on the domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import hours_filled, member_join
from ..operators.keyed import append_new, distinct_on, or_else, retain, top_per_key, top_up, upsert
from .domain import AS_OF, ORDERS_AS_OF, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register fn(t) where t(name) gives a table."""

    def add(fn):  # noqa: ANN001, ANN202
        QUERIES[name] = lambda spark, sf_dir: fn(lambda n: table(spark, sf_dir, n))
        if sql:
            SQL[name] = with_views(sql.replace("NOW", f"TIMESTAMP '{AS_OF}'").replace("THEN_", f"TIMESTAMP '{ORDERS_AS_OF}'"))
        return fn

    return add


def ago(hours: int, of: str = AS_OF):  # noqa: ANN201
    """So many hours before a fixed time; queries never read the clock."""
    return F.lit(of).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours))


@query("s01_raw_posts", "select id, source_id, posted_at from posts where source_id in ('s1','s2','s3') and posted_at >= NOW - interval 168 hours order by posted_at desc, id desc limit 4500")
def s01(t):
    return t("posts").filter(F.col("source_id").isin("s1", "s2", "s3") & (F.col("posted_at") >= ago(168))).select("id", "source_id", "posted_at").orderBy(F.desc("posted_at"), F.desc("id")).limit(4500)


@query("s03_history_by_names", "select region_id, topic_name, posted_at, like_count from posts where region_id = 'r1' and topic_name in (select topic_name from posts group by 1 having count(*) > 100) and posted_at >= NOW - interval 72 hours")
def s03(t):
    p = t("posts")
    names = p.groupBy("topic_name").count().filter("count > 100")
    return p.filter((F.col("region_id") == "r1") & (F.col("posted_at") >= ago(72))).join(names, "topic_name", "left_semi").select("region_id", "topic_name", "posted_at", "like_count")


@query("s08_timeline", "select id, name, heat from topics where name ilike '%asia%' and region_id = 'ASIA' and created_at >= THEN_ - interval 720 hours order by heat desc, id limit 1000")
def s08(t):
    return t("topics").filter(F.col("name").ilike("%asia%") & (F.col("region_id") == "ASIA") & (F.col("created_at") >= ago(720, ORDERS_AS_OF))).select("id", "name", "heat").orderBy(F.desc("heat"), "id").limit(1000)


@query("p02_array_overlap", "select topic_id from (select topic_id, list(source_id) as ids from topic_sources group by 1) where list_has_any(ids, ['s1','s2'])")
def p02(t):
    from ..functions.arrays import overlaps

    return t("topic_sources").groupBy("topic_id").agg(F.collect_set("source_id").alias("ids")).filter(overlaps(F.col("ids"), F.array(F.lit("s1"), F.lit("s2")))).select("topic_id")


@query("p03_array_contains", "select topic_id, len(ids) as n from (select topic_id, list(source_id) as ids from topic_sources group by 1) where list_contains(ids, 's7')")
def p03(t):
    return t("topic_sources").groupBy("topic_id").agg(F.collect_set("source_id").alias("ids")).filter(F.array_contains("ids", "s7")).select("topic_id", F.size("ids").cast("long").alias("n"))


@query("p05_placeholder_filter", "select id, name from topics where not regexp_matches(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), '^asia[a-z]*$')")
def p05(t):
    return t("topics").filter(~F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").rlike("^asia[a-z]*$")).select("id", "name")


@query("p07_batch_tolerance", "select count(*) as n from topics where created_at between (select max(created_at) from topics) - interval 1 second and (select max(created_at) from topics) + interval 1 second")
def p07(t):
    x = t("topics")
    last = x.agg(F.max("created_at").alias("last"))
    return x.join(F.broadcast(last), F.col("created_at").between(F.col("last") - F.expr("interval 1 second"), F.col("last") + F.expr("interval 1 second"))).agg(F.count(F.lit(1)).alias("n"))


@query("p09_exists_by_tier", "select distinct id from topics t where exists (select 1 from topic_sources x join sources s on s.id = x.source_id where x.topic_id = t.id and s.trust_tier <= 1)")
def p09(t):
    good = t("topic_sources").join(t("sources").filter("trust_tier <= 1"), F.col("source_id") == F.col("id")).select(F.col("topic_id").alias("id")).distinct()
    return t("topics").join(good, "id", "left_semi").select("id")


@query("p10_scalar_subquery", "select community_id, news_id from overlap_events where detected_at = (select max(detected_at) from overlap_events)")
def p10(t):
    o = t("overlap_events")
    return o.join(F.broadcast(o.agg(F.max("detected_at").alias("detected_at"))), "detected_at", "left_semi").select("community_id", "news_id")


@query("p12_typed_null_projection", "select id, cast(null as double) as velocity, created_at is not null as is_fresh from topics where heat > 300000")
def p12(t):
    return t("topics").filter("heat > 300000").select("id", F.lit(None).cast("double").alias("velocity"), F.col("created_at").isNotNull().alias("is_fresh"))


@query("j02_array_membership_join", "select t.id, count(s.id) as n, coalesce(min(s.name), '-') as name from topics t left join topic_sources x on x.topic_id = t.id left join sources s on s.id = x.source_id where t.heat > 200000 group by 1")
def j02(t):
    ids = t("topic_sources").groupBy("topic_id").agg(F.collect_set("source_id").alias("ids"))
    topics = t("topics").filter("heat > 200000").select("id").join(ids, F.col("id") == F.col("topic_id"), "left").select(F.col("id").alias("tid"), "ids")
    return member_join(topics, "ids", t("sources"), "id").groupBy(F.col("tid").alias("id")).agg(F.count("name").alias("n"), F.coalesce(F.min("name"), F.lit("-")).alias("name"))


@query("j03_star_join", "select o.community_id, o.news_id, c.name as community_name, n.name as news_name from overlap_events o join topics c on c.id = o.community_id join topics n on n.id = o.news_id where o.cosine >= 0.9")
def j03(t):
    c = t("topics").select(F.col("id").alias("community_id"), F.col("name").alias("community_name"))
    n = t("topics").select(F.col("id").alias("news_id"), F.col("name").alias("news_name"))
    return t("overlap_events").filter("cosine >= 0.9").join(c, "community_id").join(n, "news_id").select("community_id", "news_id", "community_name", "news_name")


@query("j10_stats_with_latest", "select canonical_key, count(*) as n, max(detected_at) as last_at, round(avg(abs(lag_minutes)), 4) as avg_lag, arg_max(community_id, row(detected_at, community_id, news_id)) as last_id from overlap_events group by 1")
def j10(t):
    return t("overlap_events").groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n"), F.max("detected_at").alias("last_at"), F.round(F.avg(F.abs("lag_minutes")), 4).alias("avg_lag"), F.max_by("community_id", F.struct("detected_at", "community_id", "news_id")).alias("last_id"))


@query("j18_as_of", "select region_id, topic_name, arg_max(like_count, row(posted_at, id)) filter (posted_at <= NOW - interval 48 hours) as before_48h from posts group by 1, 2")
def j18(t):
    p = t("posts").withColumn("at", F.struct("posted_at", "id"))
    return p.groupBy("region_id", "topic_name").agg(F.max_by(F.when(F.col("posted_at") <= ago(48), F.col("like_count")), F.when(F.col("posted_at") <= ago(48), F.col("at"))).alias("before_48h"))


@query("j21_anti_supplement", "select id from topics where scope = 'mixed' and issue not in (select issue from topics where scope = 'news')")
def j21(t):
    x = t("topics")
    return x.filter("scope = 'mixed'").join(x.filter("scope = 'news'").select("issue").distinct(), "issue", "left_anti").select("id")


@query("j23_nearest_lag", "select community_id, arg_max(id, row(heat, id)) as best from (select o.community_id, t.id, t.heat from overlap_events o join topics t on t.issue = o.canonical_key and abs(cast(extract(day from t.created_at) as bigint) * 7 - o.lag_minutes) <= 120) group by 1")
def j23(t):
    near = F.abs(F.dayofmonth("created_at").cast("long") * 7 - F.col("lag_minutes")) <= 120
    return t("overlap_events").join(t("topics"), (F.col("issue") == F.col("canonical_key")) & near).groupBy("community_id").agg(F.max_by("id", F.struct("heat", "id")).alias("best"))


@query("a01_batch_selection", "select region_id, coalesce(max(created_at) filter (created_at >= THEN_ - interval 48 hours), max(created_at)) as batch, coalesce(max(created_at) >= THEN_ - interval 48 hours, false) as is_fresh from topics group by 1")
def a01(t):
    fresh = F.col("created_at") >= ago(48, ORDERS_AS_OF)
    return t("topics").groupBy("region_id").agg(F.coalesce(F.max(F.when(fresh, F.col("created_at"))), F.max("created_at")).alias("batch"), F.coalesce(F.max("created_at") >= ago(48, ORDERS_AS_OF), F.lit(False)).alias("is_fresh"))


@query("a02_transfer_summary", "select count(*) as total, count(distinct (community_id, news_id)) as pairs, count(*) filter (lag_minutes > 0) as community_leads, count(*) filter (lag_minutes < 0) as news_leads, count(*) filter (lag_minutes = 0) as ties, round(quantile_cont(abs(lag_minutes), 0.5), 4) as p50, round(quantile_cont(abs(lag_minutes), 0.9), 4) as p90, max(detected_at) as last_at from overlap_events")
def a02(t):
    lag = F.col("lag_minutes")
    return t("overlap_events").agg(F.count(F.lit(1)).alias("total"), F.countDistinct(F.struct("community_id", "news_id")).alias("pairs"), F.count_if(lag > 0).alias("community_leads"), F.count_if(lag < 0).alias("news_leads"), F.count_if(lag == 0).alias("ties"), F.round(F.percentile(F.abs(lag), 0.5), 4).alias("p50"), F.round(F.percentile(F.abs(lag), 0.9), 4).alias("p90"), F.max("detected_at").alias("last_at"))


@query("a04_hourly_trend", "select date_trunc('hour', posted_at) as bucket, count(*) as n, round(sum(like_count), 2) as likes from posts group by 1")
def a04(t):
    return t("posts").groupBy(F.date_trunc("hour", "posted_at").cast("timestamp_ntz").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("like_count"), 2).alias("likes"))


@query("a07_region_metrics", "select region_id, round(sum(heat), 2) as heat, count(*) as topics, round(avg(sentiment), 4) as sentiment, (select count(distinct source_id) from topic_sources x join topics y on y.id = x.topic_id where y.region_id = t.region_id) as sources from topics t group by 1")
def a07(t):
    x = t("topics")
    sources = x.join(t("topic_sources"), F.col("id") == F.col("topic_id")).groupBy("region_id").agg(F.countDistinct("source_id").alias("sources"))
    return x.groupBy("region_id").agg(F.round(F.sum("heat"), 2).alias("heat"), F.count(F.lit(1)).alias("topics"), F.round(F.avg("sentiment"), 4).alias("sentiment")).join(sources, "region_id", "left")


@query("a08_region_metrics_fanout", "select region_id, round(sum(heat), 2) as heat, count(*) as topics, count(distinct source_id) as sources from topics left join topic_sources on topic_id = id group by 1")
def a08(t):
    return t("topics").join(t("topic_sources"), F.col("topic_id") == F.col("id"), "left").groupBy("region_id").agg(F.round(F.sum("heat"), 2).alias("heat"), F.count(F.lit(1)).alias("topics"), F.countDistinct("source_id").alias("sources"))


@query("a10_earliest_post", "select canonical_key, least(min(detected_at), coalesce(min(created_at), min(detected_at))) as first_at from overlap_events left join topics on id = community_id group by 1")
def a10(t):
    return t("overlap_events").join(t("topics"), F.col("id") == F.col("community_id"), "left").groupBy("canonical_key").agg(F.least(F.min("detected_at"), F.coalesce(F.min("created_at"), F.min("detected_at"))).alias("first_at"))


@query("a11_six_hour_buckets", "select topic_name, time_bucket(interval 6 hours, posted_at, TIMESTAMP '2000-01-01') as bucket, round(avg(like_count), 7) as heat, count(*) as n from posts where posted_at >= NOW - interval 168 hours group by 1, 2")
def a11(t):
    return t("posts").filter(F.col("posted_at") >= ago(168)).groupBy("topic_name", F.window("posted_at", "6 hours").alias("w")).agg(F.round(F.avg("like_count"), 7).alias("heat"), F.count(F.lit(1)).alias("n")).select("topic_name", F.col("w.start").alias("bucket"), "heat", "n")


@query("a13_scalar_counts", "select (select count(*) from posts) as posts, (select count(*) from topics) as topics, (select count(*) from sources) as sources, (select count(*) from runs) as runs, (select count(*) from overlap_events) as overlaps")
def a13(t):
    names = {"posts": "posts", "topics": "topics", "sources": "sources", "runs": "runs", "overlap_events": "overlaps"}
    parts = [t(n).agg(F.count(F.lit(1)).alias(a)) for n, a in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query("a15_run_stats", "select source_id, count(*) as runs, count(*) filter (status = 'success') as ok, round(quantile_cont(latency_ms, 0.95), 4) as p95 from runs group by 1")
def a15(t):
    return t("runs").groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "success").alias("ok"), F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"))


@query("a19_retention_metrics", "select 'posts' as tbl, count(*) as n, min(posted_at) as first_at, max(posted_at) as last_at from posts union all select 'topics', count(*), min(created_at), max(created_at) from topics")
def a19(t):
    row = lambda n, c: t(n).agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("n"), F.min(c).alias("first_at"), F.max(c).alias("last_at"))
    return row("posts", "posted_at").unionByName(row("topics", "created_at"))


@query("a21_windowed_counts", "select source_id, count(*) filter (posted_at >= NOW - interval 24 hours) as n24, count(*) filter (posted_at >= NOW - interval 168 hours) as n168, max(posted_at) as last_at from posts group by 1")
def a21(t):
    since = lambda h: F.count_if(F.col("posted_at") >= ago(h))
    return t("posts").groupBy("source_id").agg(since(24).alias("n24"), since(168).alias("n168"), F.max("posted_at").alias("last_at"))


@query("a25_heat_stats", "select topic_name, round(avg(like_count), 4) as mean, round(stddev_pop(like_count), 4) as std from posts group by 1")
def a25(t):
    return t("posts").groupBy("topic_name").agg(F.round(F.avg("like_count"), 4).alias("mean"), F.round(F.stddev_pop("like_count"), 4).alias("std"))


@query("a34_top_keywords", "select region_id, kw, n from (select region_id, kw, count(*) as n, row_number() over (partition by region_id order by count(*) desc, kw) as r from (select region_id, unnest(string_split(name, ' ')) as kw from topics) group by 1, 2) where r <= 10")
def a34(t):
    n = t("topics").select("region_id", F.explode(F.split("name", " ")).alias("kw")).groupBy("region_id", "kw").agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(n, ["region_id"], [F.desc("n"), F.col("kw")], 10).drop("rank")


@query("a35_component_rollup", "select issue, count(distinct region_id) as regions, round(sum(heat), 2) as heat, arg_max(name, row(heat, id)) as name, min(created_at) as first_at from topics group by 1")
def a35(t):
    return t("topics").groupBy("issue").agg(F.countDistinct("region_id").alias("regions"), F.round(F.sum("heat"), 2).alias("heat"), F.max_by("name", F.struct("heat", "id")).alias("name"), F.min("created_at").alias("first_at"))


@query("a38_propagation_cells", "select f as from_region, g as to_region, count(*) as n, round(avg(lag_minutes) filter (lag_minutes > 0), 4) as avg_lag from (select a.region_id as f, b.scope as g, o.lag_minutes from overlap_events o join topics a on a.id = o.community_id join topics b on b.id = o.news_id) group by 1, 2")
def a38(t):
    a = t("topics").select(F.col("id").alias("community_id"), F.col("region_id").alias("from_region"))
    b = t("topics").select(F.col("id").alias("news_id"), F.col("scope").alias("to_region"))
    lag = F.when(F.col("lag_minutes") > 0, F.col("lag_minutes"))
    return t("overlap_events").join(a, "community_id").join(b, "news_id").groupBy("from_region", "to_region").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(lag), 4).alias("avg_lag"))


@query("a40_flow_edges", "select a, b, n from (select least(x, y) as a, greatest(x, y) as b, x, n, row_number() over (partition by least(x, y), greatest(x, y) order by n desc, x) as r from (select p.region_id as x, q.region_id as y, count(*) as n from topics p join topics q on p.issue % 500 = q.issue % 500 and p.rank < q.rank and p.region_id <> q.region_id and p.scope = 'mixed' and q.scope = 'mixed' group by 1, 2)) where r = 1")
def a40(t):
    m = t("topics").filter("scope = 'mixed'")
    # Topics of one issue, region and rank are counted before they meet: a key then has few rows, however many topics.
    m = m.groupBy((F.col("issue") % 500).alias("i"), F.col("region_id").alias("x"), F.col("rank").alias("rp")).agg(F.count(F.lit(1)).alias("np"))
    q = m.select("i", F.col("x").alias("y"), F.col("rp").alias("rq"), F.col("np").alias("nq"))
    n = m.join(q, "i").filter("rp < rq and x <> y").groupBy("x", "y").agg(F.sum(F.col("np") * F.col("nq")).alias("n"))
    n = n.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y"))
    return distinct_on(n, ["a", "b"], [F.desc("n"), F.col("x")]).select("a", "b", "n")


@query("a41_error_groups", "select error_code, count(*) as n from runs where error_code is not null group by 1")
def a41(t):
    return t("runs").filter("error_code is not null").groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))


@query("a48_lead_share", "select region_id, case when c + n > 0 then round(c / (c + n), 4) end as share from (select region_id, cast(count(*) filter (scope = 'community') as double) as c, cast(count(*) filter (scope = 'news') as double) as n from topics group by 1)")
def a48(t):
    c, n = F.count_if(F.col("scope") == "community"), F.count_if(F.col("scope") == "news")
    return t("topics").groupBy("region_id").agg(F.round(F.try_divide(c, c + n), 4).alias("share"))


@query("a53_score_dedupe", "select source_id, comment_count, round(max(like_count + 1.5 * comment_count), 2) as score from posts group by 1, 2")
def a53(t):
    return t("posts").groupBy("source_id", "comment_count").agg(F.round(F.max(F.col("like_count") + 1.5 * F.col("comment_count")), 2).alias("score"))


@query("w01_top_batches", "select region_id, created_at from (select region_id, created_at, row_number() over (partition by region_id order by created_at desc) as r from (select distinct region_id, created_at from topics)) where r <= 3")
def w01(t):
    return top_per_key(t("topics").select("region_id", "created_at").distinct(), ["region_id"], [F.desc("created_at")], 3).drop("rank")


@query("w02_top_per_scope_region", "select id from (select id, row_number() over (partition by scope, region_id order by heat desc, created_at desc, id desc) as r from topics) where r <= 80")
def w02(t):
    return top_per_key(t("topics"), ["scope", "region_id"], [F.desc("heat"), F.desc("created_at"), F.desc("id")], 80).select("id")


@query("w04_distinct_on_name", "select distinct on (name) name, id from topics order by name, created_at desc, heat desc, id desc")
def w04(t):
    return distinct_on(t("topics"), ["name"], [F.desc("created_at"), F.desc("heat"), F.desc("id")]).select("name", "id")


@query("w11_adjacent_edges", "select * from (select issue, region_id as from_region, lead(region_id) over w as to_region, cast(greatest(0, date_diff('minute', created_at, lead(created_at) over w)) as bigint) as lag from (select issue, region_id, rank, id, created_at from topics where scope = 'mixed') window w as (partition by issue order by created_at, id)) where to_region is not null")
def w11(t):
    from ..functions.scoring import lag_minutes

    w = Window.partitionBy("issue").orderBy("created_at", "id")
    x = t("topics").filter("scope = 'mixed'").withColumn("to_region", F.lead("region_id").over(w)).withColumn("next", F.lead("created_at").over(w))
    return x.filter("next is not null").select("issue", F.col("region_id").alias("from_region"), "to_region", F.greatest(F.lit(0), lag_minutes(F.col("created_at"), F.col("next"))).cast("long").alias("lag"))


@query("w12_lifecycle", "select id, case when falls then 'fading' else 'peaking' end as stage from (select id, coalesce(heat < lag(heat, 1) over w and lag(heat, 1) over w < lag(heat, 2) over w and heat < max(heat) over (partition by issue), false) as falls from topics window w as (partition by issue order by created_at, id))")
def w12(t):
    from ..functions.scoring import lifecycle

    w = Window.partitionBy("issue").orderBy("created_at", "id")
    peak = F.max("heat").over(Window.partitionBy("issue"))
    return t("topics").select("id", lifecycle(F.lit(24.0), F.col("heat"), F.lag("heat", 1).over(w), F.lag("heat", 2).over(w), peak).alias("stage"))


@query("w14_batch_normalise", "select id, round(log10(1 + heat) / log10(1 + max(heat) over (partition by region_id)), 4) as display from topics")
def w14(t):
    from ..functions.scoring import display_heat

    most = t("topics").groupBy("region_id").agg(F.max("heat").alias("most"))
    return t("topics").join(most, "region_id").select("id", display_heat(F.col("heat"), F.col("most")).alias("display"))


@query("w16_three_failures", "select source_id from (select source_id, status, latency_ms, row_number() over (partition by source_id order by started_at desc, id desc) as r from runs) where r <= 3 group by 1 having count(*) = 3 and bool_and(status <> 'success' or latency_ms > 300)")
def w16(t):
    last = top_per_key(t("runs"), ["source_id"], [F.desc("started_at"), F.desc("id")], 3)
    return last.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("status") != "success") | (F.col("latency_ms") > 300)).alias("bad")).filter("n = 3 and bad").select("source_id")


@query("t01_nulls_last", "select id, nullif(rank, 5) as rank from topics where heat > 250000 order by heat desc nulls last, nullif(rank, 5) asc nulls last, id limit 50")
def t01(t):
    x = t("topics").filter("heat > 250000").select("id", F.nullif(F.col("rank"), F.lit(5)).alias("rank"), "heat")
    return x.orderBy(F.desc_nulls_last("heat"), F.asc_nulls_last("rank"), "id").limit(50).drop("heat")


@query("t03_offset_limit", "select id from topics order by heat desc, id limit 50 offset 100")
def t03(t):
    return t("topics").orderBy(F.desc("heat"), "id").offset(100).limit(50).select("id")


@query("t04_top_up", "select id, stale from (select id, heat, 0 as stale from topics where scope = 'mixed' and heat > 380000 union all select id, heat, 1 from topics where scope = 'news') order by stale, heat desc, id limit 60")
def t04(t):
    x = t("topics").select("id", "heat", "scope")
    return top_up(x.filter("scope = 'mixed' and heat > 380000"), x.filter("scope = 'news'"), "id", [F.desc("heat"), F.col("id")], 60).select("id", "stale")


@query("t07_pair_order", "select community_id, news_id from overlap_events order by cosine desc, abs(lag_minutes), detected_at desc, community_id, news_id limit 500")
def t07(t):
    return t("overlap_events").orderBy(F.desc("cosine"), F.abs("lag_minutes"), F.desc("detected_at"), "community_id", "news_id").limit(500).select("community_id", "news_id")


@query("u04_fallback", "select id from topics where scope = 'news' and heat > (select case when count(*) > 0 then 1e18 else 300000 end from topics where scope = 'nowhere')")
def u04(t):
    x = t("topics")
    return or_else(x.filter("scope = 'nowhere'").select("id"), x.filter("scope = 'news' and heat > 300000").select("id"))


@query("u08_weighted_sentiment", "select issue, round(sum(sentiment * w) / sum(w), 3) as sentiment from (select issue, sentiment, case when heat > 0 then heat else 1 end as w from topics) group by 1")
def u08(t):
    from ..functions.arrays import merge_sentiment

    return t("topics").groupBy("issue").agg(merge_sentiment("sentiment", "heat").alias("sentiment"))


@query("f39_gap_fill", "select b.bucket, coalesce(n, 0) as n, likes from (select unnest(generate_series(NOW - interval 72 hours, NOW, interval 1 hour)) as bucket) b left join (select date_trunc('hour', posted_at) as bucket, count(*) as n, round(sum(like_count), 2) as likes from posts where region_id = 'r2' and topic_name = 'purchase' group by 1) h on h.bucket = b.bucket")
def f39(t):
    p = t("posts").filter("region_id = 'r2' and topic_name = 'purchase'")
    return hours_filled(p, "posted_at", ago(72), ago(0), [F.count(F.lit(1)).alias("n"), F.round(F.sum("like_count"), 2).alias("likes")], ["n"])


@query("k01_upsert_posts", "select coalesce(n.id, o.id) as id, case when n.id is null then o.like_count else n.like_count end as like_count, case when n.id is null then o.comment_count else coalesce(n.comment_count, o.comment_count) end as comment_count from (select id, like_count, comment_count from posts where topic_name <> 'signup') o full join (select id, like_count + 1 as like_count, nullif(comment_count, 5) as comment_count from posts where topic_name in ('signup', 'view')) n on o.id = n.id")
def k01(t):
    p = t("posts").select("id", "like_count", "comment_count", "topic_name")
    new = p.filter("topic_name in ('signup', 'view')").select("id", (F.col("like_count") + 1).alias("like_count"), F.nullif(F.col("comment_count"), F.lit(5)).alias("comment_count"))
    return upsert(p.filter("topic_name <> 'signup'").drop("topic_name"), new, ["id"], ["comment_count"])


@query("k14_append_new", "select community_id, news_id from overlap_events where cosine >= 0.5 and not exists (select 1 from overlap_events o where o.cosine < 0.6 and o.community_id = overlap_events.community_id and o.news_id = overlap_events.news_id)")
def k14(t):
    o = t("overlap_events").select("community_id", "news_id", "cosine")
    return append_new(o.filter("cosine < 0.6"), o.filter("cosine >= 0.5"), ["community_id", "news_id"]).select("community_id", "news_id")


@query("k16_seed_dimension", "select coalesce(n.id, o.id) as id, coalesce(n.name, o.name) as name, n.id is not null as is_active from (select * from sources where trust_tier <= 2) o full join (select * from sources where trust_tier >= 2) n on o.id = n.id")
def k16(t):
    o = t("sources").filter("trust_tier <= 2").select("id", F.col("name").alias("old"))
    n = t("sources").filter("trust_tier >= 2").select("id", "name", F.lit(True).alias("there"))
    return o.join(n, "id", "full_outer").select("id", F.coalesce("name", "old").alias("name"), F.coalesce("there", F.lit(False)).alias("is_active"))


@query("k21_retention", "select id from posts where posted_at >= NOW - interval 14 days")
def k21(t):
    return retain(t("posts"), "posted_at", ago(0), 14).select("id")


@query("q15_source_health", "select s.id, coalesce(r.runs, 0) as runs, round(coalesce(100.0 * r.ok / r.runs, 0), 1) as rate, coalesce(p.n24, 0) as posts_24h, l.status as last_status, r.last_success, case when l.status is null then case when s.is_core then 'missing' else 'optional' end when l.status <> 'success' then case when s.is_core then 'failing' else 'optional_failing' end when 100.0 * r.ok / r.runs < 70 then 'degraded' else 'healthy' end as health from sources s left join (select source_id, count(*) as runs, count(*) filter (status = 'success') as ok, max(started_at) filter (status = 'success') as last_success from runs group by 1) r on r.source_id = s.id left join (select source_id, count(*) as n24 from posts where posted_at >= NOW - interval 48 hours group by 1) p on p.source_id = s.id left join (select source_id, arg_max(status, row(started_at, id)) as status from runs group by 1) l on l.source_id = s.id")
def q15(t):
    from ..functions.scoring import source_status

    # The four sides of the fan come from two aggregations; the small results join the dimension.
    ok = F.col("status") == "success"
    r = t("runs").groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("ok"), F.max(F.when(ok, F.col("started_at"))).alias("last_success"), F.max_by("status", F.struct("started_at", "id")).alias("last_status"))
    p = t("posts").filter(F.col("posted_at") >= ago(48)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n24"))
    x = t("sources").join(r, F.col("id") == r["source_id"], "left").drop("source_id").join(p, F.col("id") == p["source_id"], "left")
    rate = 100.0 * F.col("ok") / F.col("runs")
    return x.select("id", F.coalesce("runs", F.lit(0)).alias("runs"), F.round(F.coalesce(rate, F.lit(0.0)), 1).alias("rate"), F.coalesce("n24", F.lit(0)).alias("posts_24h"), "last_status", "last_success", source_status(F.col("is_core"), F.col("last_status"), rate).alias("health"))
