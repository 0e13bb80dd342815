"""Scans, fans of left joins, health, history and dashboard reports on the domain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, scoring
from ..operators.keyed import distinct_on, or_else, top_per_key
from .domain import ORDERS_AS_OF
from .relational import ago, query


def _n(name: str = "n"):  # noqa: ANN202
    return F.count(F.lit(1)).alias(name)


@query("s02_ranking_scan", "select id, rank, created_at from topics where region_id = 'EUROPE' and created_at >= THEN_ - interval 720 hours order by created_at desc, rank, id limit 300")
def s02(t):
    return t("topics").filter((F.col("region_id") == "EUROPE") & (F.col("created_at") >= ago(720, ORDERS_AS_OF))).orderBy(F.desc("created_at"), "rank", "id").limit(300).select("id", "rank", "created_at")


@query("s10_due_sources", "select id from (select s.id, max(started_at) as last_at, min(s.trust_tier) as tier from sources s left join runs r on r.source_id = s.id group by 1) where last_at is null or last_at + tier * interval 60 minute <= NOW")
def s10(t):
    last = t("runs").groupBy("source_id").agg(F.max("started_at").alias("last_at"))
    due = F.col("last_at") + F.make_interval(mins=F.col("trust_tier") * 60) <= ago(0)
    return t("sources").join(last, F.col("id") == F.col("source_id"), "left").filter(F.col("last_at").isNull() | due).select("id")


@query("p04_ilike_any", "select id from topics where name ilike '%auto%' or region_id ilike '%auto%' or scope ilike '%new%'")
def p04(t):
    return t("topics").filter(F.col("name").ilike("%auto%") | F.col("region_id").ilike("%auto%") | F.col("scope").ilike("%new%")).select("id")


@query("p11_prefix", "select id from runs where error_code like 'http_50%'")
def p11(t):
    return t("runs").filter(F.col("error_code").startswith("http_50")).select("id")


@query("p14_region_consistency", "select distinct t.id from topics t join topic_sources x on x.topic_id = t.id join sources s on s.id = x.source_id and cast(substr(s.region_id, 2) as int) = length(t.region_id) % 5")
def p14(t):
    own = t("topic_sources").join(t("sources"), F.col("source_id") == F.col("id")).select("topic_id", F.expr("cast(substr(region_id, 2) as int)").alias("r")).distinct()
    x = t("topics")
    return x.join(own, (x["id"] == own["topic_id"]) & (F.length(x["region_id"]) % 5 == own["r"]), "left_semi").select("id")


@query("p19_visible_pairs", "select canonical_key, count(*) as n, count(*) filter (abs(lag_minutes) > 140) as far, count(*) filter (cosine < 0.3) as weak, count(*) filter (abs(lag_minutes) <= 140 and cosine >= 0.3) as visible from overlap_events group by 1")
def p19(t):
    far, weak = F.abs("lag_minutes") > 140, F.col("cosine") < 0.3
    return t("overlap_events").groupBy("canonical_key").agg(_n(), F.count_if(far).alias("far"), F.count_if(weak).alias("weak"), F.count_if(~far & ~weak).alias("visible"))


@query("j01_batch_join", "select t.id from topics t join (select region_id, max(created_at) as created_at from topics group by 1) b on b.region_id = t.region_id and b.created_at = t.created_at")
def j01(t):
    x = t("topics")
    return x.join(x.groupBy("region_id").agg(F.max("created_at").alias("created_at")), ["region_id", "created_at"]).select("id")


@query("j04_region_pairs", "select o.community_id, o.news_id from overlap_events o join topics c on c.id = o.community_id and c.region_id = 'ASIA' join topics n on n.id = o.news_id and n.region_id = 'ASIA' order by o.detected_at desc, 1, 2 limit 500")
def j04(t):
    here = t("topics").filter("region_id = 'ASIA'").select("id")
    o = t("overlap_events").join(here.withColumnRenamed("id", "community_id"), "community_id", "left_semi").join(here.withColumnRenamed("id", "news_id"), "news_id", "left_semi")
    return o.orderBy(F.desc("detected_at"), "community_id", "news_id").limit(500).select("community_id", "news_id")


@query("j07_report_fan", "select s.id, coalesce(p.n, 0) as posts, coalesce(r.runs, 0) as runs, r.p95, f.error_code as last_error from sources s left join (select source_id, count(*) as n from posts where posted_at >= NOW - interval 72 hours group by 1) p on p.source_id = s.id left join (select source_id, count(*) as runs, round(quantile_cont(latency_ms, 0.95), 4) as p95 from runs group by 1) r on r.source_id = s.id left join (select source_id, arg_max(error_code, row(started_at, id)) as error_code from runs where status <> 'success' and started_at >= NOW - interval 72 hours group by 1) f on f.source_id = s.id")
def j07(t):
    recent_failure = (F.col("status") != "success") & (F.col("started_at") >= ago(72))
    r = t("runs").groupBy(F.col("source_id").alias("id")).agg(_n("runs"), F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"), F.max_by("error_code", F.when(recent_failure, F.struct("started_at", "id"))).alias("last_error"))
    p = t("posts").filter(F.col("posted_at") >= ago(72)).groupBy(F.col("source_id").alias("id")).agg(_n("posts"))
    return t("sources").select("id").join(r, "id", "left").join(p, "id", "left").select("id", F.coalesce("posts", F.lit(0)).alias("posts"), F.coalesce("runs", F.lit(0)).alias("runs"), "p95", "last_error")


@query("j08_recent_and_total", "select s.id, count(p.id) as total, count(p.id) filter (p.posted_at >= NOW - interval 48 hours) as recent from sources s left join posts p on p.source_id = s.id group by 1")
def j08(t):
    n = t("posts").groupBy(F.col("source_id").alias("id")).agg(_n("total"), F.count_if(F.col("posted_at") >= ago(48)).alias("recent"))
    return t("sources").select("id").join(n, "id", "left").fillna(0, ["total", "recent"])


@query("j11_lateral_unnest", "select t.id, x.source_id from topics t left join topic_sources x on x.topic_id = t.id where t.heat > 200000")
def j11(t):
    ids = t("topic_sources").groupBy(F.col("topic_id").alias("id")).agg(F.collect_set("source_id").alias("ids"))
    return t("topics").filter("heat > 200000").select("id").join(ids, "id", "left").select("id", F.explode_outer("ids").alias("source_id"))


@query("j19_baseline_lookup", "select p.id, case when b.std > 0 then round((p.like_count - b.mean) / b.std, 3) + 0.0 end as anomaly from posts p left join (select topic_name, avg(like_count) as mean, stddev_pop(like_count) as std from posts where posted_at < NOW - interval 168 hours group by 1) b on b.topic_name = p.topic_name where p.posted_at >= NOW - interval 168 hours")
def j19(t):
    p = t("posts")
    b = p.filter(F.col("posted_at") < ago(168)).groupBy("topic_name").agg(F.avg("like_count").alias("mean"), F.stddev_pop("like_count").alias("std"))
    return p.filter(F.col("posted_at") >= ago(168)).join(b, "topic_name", "left").select("id", scoring.anomaly(F.col("like_count"), F.col("mean"), F.col("std")).alias("anomaly"))


@query("j22_shared_identity", "select scope, count(*) as n from topics where issue in (select issue from topics group by 1 having count(distinct scope) > 1) group by 1")
def j22(t):
    x = t("topics")
    shared = x.groupBy("issue").agg(F.countDistinct("scope").alias("k")).filter("k > 1")
    return x.join(shared, "issue", "left_semi").groupBy("scope").agg(_n())


@query("j24_transitions", "select region_id, count(*) filter (was <> band and band in ('high', 'medium')) as moved from (select region_id, case when heat / 500000 >= 0.72 then 'high' when heat / 500000 >= 0.35 then 'medium' else 'low' end as band, lag(case when heat / 500000 >= 0.72 then 'high' when heat / 500000 >= 0.35 then 'medium' else 'low' end) over (partition by issue order by created_at, id) as was from topics) group by 1")
def j24(t):
    w = Window.partitionBy("issue").orderBy("created_at", "id")
    x = t("topics").select("region_id", "issue", "created_at", "id", scoring.heat_band(F.col("heat") / 500000).alias("band")).withColumn("was", F.lag("band").over(w))
    return x.groupBy("region_id").agg(F.count_if((F.col("was") != F.col("band")) & F.col("band").isin("high", "medium")).alias("moved"))


@query("j26_primary_secondary", "select a.region_id as primary_region, b.region_id as secondary_region, round(a.h / b.h, 4) as ratio from (select region_id, sum(heat) as h from topics group by 1) a join (select region_id, sum(heat) as h from topics group by 1) b on a.region_id < b.region_id")
def j26(t):
    totals = t("topics").groupBy("region_id").agg(F.sum("heat").alias("h")).agg(F.array_sort(F.collect_list(F.struct("region_id", "h"))).alias("all"))
    a = totals.select("all", F.posexplode("all").alias("i", "a"))
    b = a.select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    return b.select(F.col("a.region_id").alias("primary_region"), F.col("b.region_id").alias("secondary_region"), F.round(F.col("a.h") / F.col("b.h"), 4).alias("ratio"))


@query("a03_lead_counts", "select canonical_key, count(*) filter (abs(lag_minutes) < 10) as ties, count(*) filter (lag_minutes >= 10) as community, count(*) filter (lag_minutes <= -10) as news from overlap_events group by 1")
def a03(t):
    is_ = lambda x: F.count_if(scoring.leader(F.col("lag_minutes")) == x)
    return t("overlap_events").groupBy("canonical_key").agg(is_("tie").alias("ties"), is_("community").alias("community"), is_("news").alias("news"))


@query("a05_pair_stats", "select community_id, news_id, count(*) as n, min(detected_at) as first_at, max(detected_at) as last_at, round(avg(abs(lag_minutes)), 4) as lag, round(avg(cosine), 4) as cosine from overlap_events group by 1, 2")
def a05(t):
    return t("overlap_events").groupBy("community_id", "news_id").agg(_n(), F.min("detected_at").alias("first_at"), F.max("detected_at").alias("last_at"), F.round(F.avg(F.abs("lag_minutes")), 4).alias("lag"), F.round(F.avg("cosine"), 4).alias("cosine"))


@query("a06_count_of_groups", "select count(*) as n from (select canonical_key, community_id from overlap_events group by 1, 2)")
def a06(t):
    return t("overlap_events").select("canonical_key", "community_id").distinct().agg(_n())


@query("a09_baseline_average", "select topic_name, round(avg(m), 4) as mean, round(avg(s), 4) as std from (select topic_name, date_trunc('day', posted_at) as d, avg(like_count) as m, stddev_pop(like_count) as s from posts where posted_at >= NOW - interval 168 hours group by 1, 2) group by 1")
def a09(t):
    days = t("posts").filter(F.col("posted_at") >= ago(168)).groupBy("topic_name", F.date_trunc("day", "posted_at").alias("d")).agg(F.avg("like_count").alias("m"), F.stddev_pop("like_count").alias("s"))
    return days.groupBy("topic_name").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.avg("s"), 4).alias("std"))


@query("a12_mini_trend", "select region_id, string_agg(cast(n as varchar), ',' order by b) as trend from (select region_id, date_trunc('hour', posted_at) as b, count(*) as n, row_number() over (partition by region_id order by date_trunc('hour', posted_at) desc) as r from posts group by 1, 2) where r <= 8 group by 1")
def a12(t):
    n = t("posts").groupBy("region_id", F.date_trunc("hour", "posted_at").alias("b")).agg(_n())
    last = top_per_key(n, ["region_id"], [F.desc("b")], 8)
    points = F.array_sort(F.collect_list(F.struct("b", "n")))
    return last.groupBy("region_id").agg(F.array_join(F.transform(points, lambda p: p["n"].cast("string")), ",").alias("trend"))


@query("a17_global_run_stats", "select count(*) as runs, count(*) filter (status = 'success') as ok, round(quantile_cont(latency_ms, 0.95), 4) as p95, max(started_at) filter (status = 'success') as last_ok from runs")
def a17(t):
    ok = F.col("status") == "success"
    return t("runs").agg(_n("runs"), F.count_if(ok).alias("ok"), F.round(F.percentile("latency_ms", 0.95), 4).alias("p95"), F.max(F.when(ok, F.col("started_at"))).alias("last_ok"))


@query("a20_analyzer_health", "select region_id, count(*) as topics, count(*) filter (created_at >= THEN_ - interval 720 hours) as fresh, round(avg(length(name)) filter (heat > 100000), 4) as name_length from topics group by 1")
def a20(t):
    return t("topics").groupBy("region_id").agg(_n("topics"), F.count_if(F.col("created_at") >= ago(720, ORDERS_AS_OF)).alias("fresh"), F.round(F.avg(F.when(F.col("heat") > 100000, F.length("name"))), 4).alias("name_length"))


@query("a24_sitemap", "select issue, max(created_at) as last_at from topics where created_at >= THEN_ - interval 4320 hours group by 1 order by last_at desc, issue limit 500")
def a24(t):
    return t("topics").filter(F.col("created_at") >= ago(4320, ORDERS_AS_OF)).groupBy("issue").agg(F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "issue").limit(500)


@query("a32_region_snapshot", "select region_id, scope, round(sum(heat), 2) as heat, count(*) as topics, round(avg(sentiment), 4) as sentiment, count(distinct name) as names, max(created_at) as last_at from topics group by 1, 2")
def a32(t):
    return t("topics").groupBy("region_id", "scope").agg(F.round(F.sum("heat"), 2).alias("heat"), _n("topics"), F.round(F.avg("sentiment"), 4).alias("sentiment"), F.countDistinct("name").alias("names"), F.max("created_at").alias("last_at"))


@query("a37_first_per_region", "select issue, string_agg(region_id || ':' || cast(id as varchar), ',' order by created_at, id) as timeline from (select issue, region_id, arg_min(id, row(created_at, id)) as id, min(created_at) as created_at from topics group by 1, 2) group by 1")
def a37(t):
    first = t("topics").groupBy("issue", "region_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.min("created_at").alias("created_at"))
    points = F.array_sort(F.collect_list(F.struct("created_at", "id", "region_id")))
    return first.groupBy("issue").agg(F.array_join(F.transform(points, lambda p: F.concat_ws(":", p["region_id"], p["id"].cast("string"))), ",").alias("timeline"))


@query("a39_strongest_cell", "select f, g, round(n / sum(n) over (partition by f), 4) as share from (select a.region_id as f, b.scope || b.name as g, cast(count(*) as double) as n from overlap_events o join topics a on a.id = o.community_id join topics b on b.id = o.news_id group by 1, 2) qualify row_number() over (partition by f order by n desc, g) = 1")
def a39(t):
    a = t("topics").select(F.col("id").alias("community_id"), F.col("region_id").alias("f"))
    b = t("topics").select(F.col("id").alias("news_id"), F.concat("scope", "name").alias("g"))
    n = t("overlap_events").join(a, "community_id").join(b, "news_id").groupBy("f", "g").agg(_n())
    share = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("f")), 4))
    return distinct_on(share, ["f"], [F.desc("n"), F.col("g")]).select("f", "g", "share")


@query("a42_health_summary", "select count(*) as sources, count(*) filter (is_core) as core, count(*) filter (n > 0) as seen, count(*) filter (rate >= 70) as healthy, round(100.0 * count(*) filter (n > 0) / count(*), 1) as coverage from (select s.id, s.is_core, count(r.id) as n, 100.0 * count(r.id) filter (r.status = 'success') / nullif(count(r.id), 0) as rate from sources s left join runs r on r.source_id = s.id group by 1, 2)")
def a42(t):
    r = t("runs").groupBy(F.col("source_id").alias("id")).agg(_n(), (100.0 * F.count_if(F.col("status") == "success") / F.count(F.lit(1))).alias("rate"))
    x = t("sources").select("id", "is_core").join(r, "id", "left")
    seen = F.count_if(F.col("n") > 0)
    return x.agg(_n("sources"), F.count_if("is_core").alias("core"), seen.alias("seen"), F.count_if(F.col("rate") >= 70).alias("healthy"), scoring.coverage(seen, F.count(F.lit(1))).alias("coverage"))


@query("a43_region_health", "select s.region_id, count(*) as sources, coalesce(cast(sum(n) as bigint), 0) as runs, round(coalesce(100.0 * sum(ok) / nullif(sum(n), 0), 0), 1) as rate from sources s left join (select source_id, count(*) as n, count(*) filter (status = 'success') as ok from runs group by 1) r on r.source_id = s.id group by 1")
def a43(t):
    r = t("runs").groupBy(F.col("source_id").alias("id")).agg(_n(), F.count_if(F.col("status") == "success").alias("ok"))
    x = t("sources").join(r, "id", "left").groupBy("region_id")
    return x.agg(_n("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), scoring.coverage(F.sum("ok"), F.sum("n")).alias("rate"))


@query("a44_report_rollup", "select issue, arg_max(name, row(length(name), name)) as name, min(created_at) as first_at, string_agg(distinct region_id, ',' order by region_id) as regions, round(max(heat) / 500000 + case when count(distinct scope) > 1 then 0.15 else 0 end, 4) as score from topics group by 1 order by score desc, issue limit 5")
def a44(t):
    both = F.when(F.countDistinct("scope") > 1, 0.15).otherwise(0.0)
    x = t("topics").groupBy("issue").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"), F.min("created_at").alias("first_at"), F.array_join(F.array_sort(F.collect_set("region_id")), ",").alias("regions"), F.round(F.max("heat") / 500000 + both, 4).alias("score"))
    return x.orderBy(F.desc("score"), "issue").limit(5)


@query("a46_keyword_set", "select issue, kw, n from (select issue, kw, count(*) as n, row_number() over (partition by issue order by count(*) desc, kw) as r from (select issue, unnest(string_split(lower(name), ' ')) as kw from topics) group by 1, 2) where r <= 30")
def a46(t):
    n = t("topics").select("issue", F.explode(F.split(F.lower("name"), " ")).alias("kw")).groupBy("issue", "kw").agg(_n())
    return top_per_key(n, ["issue"], [F.desc("n"), F.col("kw")], 30).drop("rank")


@query("a47_overlap_lag", "select round(avg(lag_minutes), 2) as mean, min(lag_minutes) as least, max(lag_minutes) as most, count(distinct canonical_key) as keys from overlap_events")
def a47(t):
    return t("overlap_events").agg(F.round(F.avg("lag_minutes"), 2).alias("mean"), F.min("lag_minutes").alias("least"), F.max("lag_minutes").alias("most"), F.countDistinct("canonical_key").alias("keys"))


@query("a49_dashboard_totals", "select round(sum(heat), 2) as heat, cast(sum(n) as bigint) as topics, round(sum(s * greatest(n, 1)) / sum(greatest(n, 1)), 4) as sentiment from (select region_id, sum(heat) as heat, count(*) as n, avg(sentiment) as s from topics group by 1)")
def a49(t):
    r = t("topics").groupBy("region_id").agg(F.sum("heat").alias("heat"), _n(), F.avg("sentiment").alias("s"))
    w = F.greatest(F.col("n"), F.lit(1))
    return r.agg(F.round(F.sum("heat"), 2).alias("heat"), F.sum("n").alias("topics"), F.round(F.sum(F.col("s") * w) / F.sum(w), 4).alias("sentiment"))


@query("a50_trend_line", "select created_at, round(sum(heat), 2) as heat, round(avg(sentiment), 4) as sentiment, count(*) as n from topics group by 1 order by created_at desc limit 48")
def a50(t):
    return t("topics").groupBy("created_at").agg(F.round(F.sum("heat"), 2).alias("heat"), F.round(F.avg("sentiment"), 4).alias("sentiment"), _n()).orderBy(F.desc("created_at")).limit(48)


@query("a52_best_per_identity", "select issue, arg_max(id, row(heat, id)) as id from topics group by 1")
def a52(t):
    return t("topics").groupBy("issue").agg(F.max_by("id", F.struct("heat", "id")).alias("id"))


@query("w03_newest_per_source", "select id, r from (select id, row_number() over (partition by source_id order by posted_at desc, id desc) as r from posts) where r <= 5")
def w03(t):
    return top_per_key(t("posts"), ["source_id"], [F.desc("posted_at"), F.desc("id")], 5, "r").select("id", F.col("r").cast("long").alias("r"))


@query("w05_latest_snapshot", "select region_id, arg_max(id, row(created_at, id)) as id, max(created_at) >= THEN_ - interval 48 hours as is_fresh from topics group by 1")
def w05(t):
    return t("topics").groupBy("region_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), (F.max("created_at") >= ago(48, ORDERS_AS_OF)).alias("is_fresh"))


@query("w07_latest_failure", "select source_id, arg_max(error_code, row(started_at, id)) as error_code from runs where status <> 'success' and started_at >= NOW - interval 168 hours group by 1")
def w07(t):
    bad = t("runs").filter((F.col("status") != "success") & (F.col("started_at") >= ago(168)))
    return bad.groupBy("source_id").agg(F.max_by("error_code", F.struct("started_at", "id")).alias("error_code"))


@query("w09_latest_of_pair", "select distinct on (canonical_key) canonical_key, community_id, news_id from overlap_events order by canonical_key, detected_at desc, community_id desc, news_id desc")
def w09(t):
    return distinct_on(t("overlap_events"), ["canonical_key"], [F.desc("detected_at"), F.desc("community_id"), F.desc("news_id")]).select("canonical_key", "community_id", "news_id")


@query("w10_rank_by_heat", "select id, row_number() over (partition by region_id, scope, issue order by heat desc, id) as place from topics")
def w10(t):
    return t("topics").select("id", F.row_number().over(Window.partitionBy("region_id", "scope", "issue").orderBy(F.desc("heat"), "id")).cast("long").alias("place"))


@query("w15_spread", "select issue, round(r * (1 + greatest(v, 0) / greatest(1, max(v) over ())), 4) as spread from (select issue, count(distinct region_id) + count(distinct scope) as r, avg(sentiment) as v from topics group by 1)")
def w15(t):
    x = t("topics").groupBy("issue").agg((F.countDistinct("region_id") + F.countDistinct("scope")).alias("r"), F.avg("sentiment").alias("v"))
    # One row with the maximum, in place of a window over everything in one task.
    return x.join(F.broadcast(x.agg(F.max("v").alias("m")))).select("issue", scoring.spread(F.col("r"), F.col("v"), F.col("m")).alias("spread"))


@query("w17_region_status", "select region_id, topic_name, case when most > 0 and now_ / most < 0.3 then 'fading' when now_ - before_ > 0 and now_ >= most then 'accelerating' else 'steady' end as status from (select region_id, topic_name, max(like_count) filter (posted_at >= NOW - interval 72 hours) as most, arg_max(like_count, row(posted_at, id)) as now_, coalesce(arg_max(like_count, row(posted_at, id)) filter (posted_at <= NOW - interval 48 hours), 0) as before_ from posts group by 1, 2)")
def w17(t):
    at, old = F.struct("posted_at", "id"), F.col("posted_at") <= ago(48)
    x = t("posts").groupBy("region_id", "topic_name").agg(F.max(F.when(F.col("posted_at") >= ago(72), F.col("like_count"))).alias("most"), F.max_by("like_count", at).alias("cur"), F.coalesce(F.max_by("like_count", F.when(old, at)), F.lit(0.0)).alias("old"))
    return x.select("region_id", "topic_name", scoring.region_status(F.col("cur"), F.col("most"), F.col("cur") - F.col("old")).alias("status"))


@query("w18_trailing_points", "select topic_name, posted_at, id from (select topic_name, posted_at, id, row_number() over (partition by topic_name order by posted_at desc, id desc) as r from posts) where r <= 48")
def w18(t):
    return top_per_key(t("posts"), ["topic_name"], [F.desc("posted_at"), F.desc("id")], 48).select("topic_name", "posted_at", "id")


@query("w19_lane_progress", "select id, round(least(100, greatest(0, 100.0 * (epoch(created_at) - epoch(min(created_at) over w)) / nullif(epoch(max(created_at) over w) - epoch(min(created_at) over w), 0))), 4) as progress from topics window w as (partition by issue)")
def w19(t):
    w = Window.partitionBy("issue")
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    first, last = F.min(at).over(w), F.max(at).over(w)
    return t("topics").select("id", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * F.try_divide(at - first, last - first))), 4).alias("progress")).withColumn("progress", F.when(F.col("progress").isNotNull(), F.col("progress")))


@query("t02_chosen_sort", "select id from (select id, heat * (1 + rank / 10.0) as diverse from topics) order by diverse desc, id limit 200")
def t02(t):
    sorts = {"heat": F.desc("heat"), "recent": F.desc("created_at"), "diverse": F.desc(F.col("heat") * (1 + F.col("rank") / 10.0))}
    return t("topics").orderBy(sorts["diverse"], "id").limit(200).select("id")


@query("t05_nulls_first", "select id, cast(row_number() over (order by last_at asc nulls first, id) as bigint) as place from (select s.id, max(r.started_at) filter (r.status <> 'success') as last_at from sources s left join runs r on r.source_id = s.id group by 1)")
def t05(t):
    last = t("runs").filter("status <> 'success'").groupBy(F.col("source_id").alias("id")).agg(F.max("started_at").alias("last_at"))
    # The dimension is small by nature; one task orders it.
    return t("sources").select("id").join(last, "id", "left").select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("last_at"), "id")).cast("long").alias("place"))


@query("t12_top_excerpts", "select region_id, id, r from (select region_id, id, row_number() over (partition by region_id order by round(0.3 * ln(1 + like_count) + 0.4 * ln(1 + comment_count), 6) desc, id) as r from posts) where r <= 3")
def t12(t):
    score = F.round(0.3 * F.log1p("like_count") + 0.4 * F.log1p("comment_count"), 6)
    return top_per_key(t("posts").withColumn("score", score), ["region_id"], [F.desc("score"), F.col("id")], 3, "r").select("region_id", "id", F.col("r").cast("long").alias("r"))


@query("t14_custom_order", "select region_id, list_position(['ASIA', 'EUROPE'], region_id) as place, round(sum(heat), 2) as heat from topics group by 1, 2")
def t14(t):
    place = F.array_position(F.array(F.lit("ASIA"), F.lit("EUROPE")), F.col("region_id"))
    return t("topics").groupBy("region_id").agg(F.round(F.sum("heat"), 2).alias("heat")).select("region_id", F.nullif(place, F.lit(0)).alias("place"), "heat").orderBy(F.asc_nulls_last("place"), F.desc("heat"))


@query("u01_distinct", "select distinct region_id, created_at from topics")
def u01(t):
    return t("topics").select("region_id", "created_at").distinct()


@query("u02_concat_dedupe", "select id, min(p) as first_of from (select id, 0 as p from topics where heat > 400000 union all select id, 1 from topics where name ilike '%build%') group by 1 order by 2, 1 limit 20")
def u02(t):
    x = t("topics")
    both = x.filter("heat > 400000").select("id", F.lit(0).alias("p")).unionByName(x.filter(F.col("name").ilike("%build%")).select("id", F.lit(1).alias("p")))
    return both.groupBy("id").agg(F.min("p").alias("first_of")).orderBy("first_of", "id").limit(20)


@query("u07_edge_merge", "select f, g, lag_minutes, max(cosine) as confidence from (select c.region_id as f, n.region_id as g, o.lag_minutes, o.cosine from overlap_events o join topics c on c.id = o.community_id join topics n on n.id = o.news_id) group by 1, 2, 3")
def u07(t):
    c = t("topics").select(F.col("id").alias("community_id"), F.col("region_id").alias("f"))
    n = t("topics").select(F.col("id").alias("news_id"), F.col("region_id").alias("g"))
    return t("overlap_events").join(c, "community_id").join(n, "news_id").groupBy("f", "g", "lag_minutes").agg(F.max("cosine").alias("confidence"))


@query("u13_row_dedupe", "select distinct on (coalesce(nullif(name, ''), cast(issue as varchar)), scope) id from topics order by coalesce(nullif(name, ''), cast(issue as varchar)), scope, heat desc, created_at desc, id")
def u13(t):
    key = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("issue").cast("string"))
    return distinct_on(t("topics").withColumn("key", key), ["key", "scope"], [F.desc("heat"), F.desc("created_at"), F.col("id")]).select("id")


@query("f40_heat", "select id, round((26 * ln(1 + like_count) + 30 * ln(1 + comment_count)) * exp(-0.1 * greatest(0, epoch(NOW - posted_at) / 3600)) * 1.2, 4) as heat from posts")
def f40(t):
    z = F.lit(0)
    hours = (F.unix_micros(ago(0).cast("timestamp")) - F.unix_micros(F.col("posted_at").cast("timestamp"))) / 3.6e9
    return t("posts").select("id", F.round(scoring.heat(z, F.col("like_count"), F.col("comment_count"), z, hours, F.lit(1.2), F.lit(0.0)), 4).alias("heat"))


@query("f49_burst", "select topic_name, recent, round(mean, 4) as mean, round((recent - mean) / greatest(std, sqrt(mean + 1)), 4) as z from (select topic_name, max(n) filter (age = 0) as recent, avg(n) filter (age > 0) as mean, stddev_pop(n) filter (age > 0) as std from (select k.topic_name, g.age, count(p.id) as n from (select distinct topic_name from posts) k cross join (select unnest(range(25)) as age) g left join posts p on p.topic_name = k.topic_name and greatest(0, date_diff('hour', p.posted_at, NOW - interval 24 hours) - 1) = g.age and p.posted_at <= NOW - interval 24 hours group by 1, 2) group by 1)")
def f49(t):
    from ..operators.keywords import bursts

    return bursts(t("posts"), "topic_name", "posted_at", ago(24)).select("topic_name", "recent", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


@query("f57_sentiment_shares", "select id, round(p / (p + n + u + c), 6) as positive, round(c / (p + n + u + c), 6) as controversial from (select id, p, n, greatest(0.05, 1 - p - n) as u, least(0.35, 0.9 * sqrt(p * n)) as c from (select id, greatest(sentiment, 0) * 0.55 + 0.2 as p, greatest(-sentiment, 0) * 0.55 + 0.2 as n from topics))")
def f57(t):
    s = scoring.sentiment_distribution(F.col("sentiment"))
    return t("topics").select("id", F.round(s["positive"], 6).alias("positive"), F.round(s["controversial"], 6).alias("controversial"))


@query("f64_sankey", "select community_id, news_id, cast(greatest(1, floor(100 * coalesce(cosine, 0.5) + 0.5)) as bigint) as value from overlap_events order by cosine desc, community_id, news_id limit 8")
def f64(t):
    return t("overlap_events").orderBy(F.desc("cosine"), "community_id", "news_id").limit(8).select("community_id", "news_id", scoring.sankey_value(F.col("cosine")).alias("value"))


@query("k05_auto_disable", "select s.id, not coalesce(b.bad and s.is_core, false) as is_active from sources s left join (select source_id, count(*) = 3 and bool_and(status <> 'success') as bad from (select source_id, status, row_number() over (partition by source_id order by started_at desc, id desc) as r from runs) where r <= 3 group by 1) b on b.source_id = s.id")
def k05(t):
    last = top_per_key(t("runs"), ["source_id"], [F.desc("started_at"), F.desc("id")], 3)
    bad = last.groupBy(F.col("source_id").alias("id")).agg(((F.count(F.lit(1)) == 3) & F.bool_and(F.col("status") != "success")).alias("bad"))
    return t("sources").join(bad, "id", "left").select("id", (~F.coalesce(F.col("bad") & F.col("is_core"), F.lit(False))).alias("is_active"))


@query("k12_expire_active", "select id, case when created_at + interval 72 hour > THEN_ - interval 24 hour then THEN_ - interval 24 hour else created_at + interval 72 hour end as expires_at from topics")
def k12(t):
    until = F.col("created_at") + F.expr("interval 72 hours")
    return t("topics").select("id", F.least(until, ago(24, ORDERS_AS_OF)).alias("expires_at"))


@query("k19_activate_live", "select s.id, exists (select 1 from posts p where p.source_id = s.id and p.posted_at >= NOW - interval 48 hours) as is_active from sources s")
def k19(t):
    live = t("posts").filter(F.col("posted_at") >= ago(48)).select(F.col("source_id").alias("id")).distinct().withColumn("there", F.lit(True))
    return t("sources").select("id").join(live, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("is_active"))


@query("u03_fresh_or_history", "select id from topics where heat > 350000 and created_at >= THEN_ - interval 8760 hours union select id from topics where heat > 400000")
def u03(t):
    x = t("topics").filter("heat > 350000")
    return x.filter(F.col("created_at") >= ago(8760, ORDERS_AS_OF)).select("id").unionByName(x.filter("heat > 400000").select("id")).distinct()


@query("u10_shared_members", "select community_id, news_id, count(*) as shared from (select distinct o.community_id, o.news_id, a.source_id from overlap_events o join topic_sources a on a.topic_id = o.community_id join topic_sources b on b.topic_id = o.news_id and b.source_id = a.source_id) group by 1, 2")
def u10(t):
    ids = t("topic_sources").groupBy("topic_id").agg(F.collect_set("source_id").alias("ids"))
    a, b = ids.select(F.col("topic_id").alias("community_id"), F.col("ids").alias("a")), ids.select(F.col("topic_id").alias("news_id"), F.col("ids").alias("b"))
    x = t("overlap_events").select("community_id", "news_id").distinct().join(a, "community_id").join(b, "news_id").filter(arrays.overlaps(F.col("a"), F.col("b")))
    return x.select("community_id", "news_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"))


@query("q16_stale_fallback", "select id from topics where region_id = 'AFRICA' and heat > 300000")
def q16(t):
    x = t("topics").filter("region_id = 'AFRICA' and heat > 300000")
    return or_else(x.filter(F.col("created_at") >= F.lit(ORDERS_AS_OF).cast("timestamp_ntz")).select("id"), x.select("id"))
