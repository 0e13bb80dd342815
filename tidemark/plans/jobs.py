"""Steps of the regional job over whole tables: weeks of heat, stages of names, portal headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..operators.keyed import distinct_on
from .domain import ORDERS_AS_OF
from .relational import ago, query


@query("f51_week_anomaly", """with daily as (select region_id, scope, cast(created_at as date) as day, avg(heat) as mean, stddev_pop(heat) as std from topics group by 1, 2, 3),
week as (select a.region_id, a.scope, a.day, avg(b.mean) as mean, avg(b.std) as std from daily a join daily b on a.region_id = b.region_id and a.scope = b.scope and b.day < a.day and b.day >= a.day - interval 7 days group by 1, 2, 3)
select id, case when std > 0 then round((heat - mean) / std, 3) end as anomaly from topics t left join week w on w.region_id = t.region_id and w.scope = t.scope and w.day = cast(t.created_at as date)""")
def f51(t):
    x, by = t("topics").withColumn("day", F.to_date("created_at")), ["region_id", "scope", "day"]
    return M.with_anomaly(x, M.weeks(M.heat_stats(x, by), by[:2]), by).select("id", "anomaly")


@query("w12_lifecycle_of_names", """with cur as (select * from (select *, row_number() over (partition by region_id, name order by created_at desc, id) as n from topics where created_at <= THEN_) where n = 1),
past as (select region_id, name, min(created_at) as first_at, max(heat) as peak, list(heat order by created_at desc, heat desc) as h from topics where created_at < THEN_ and created_at >= THEN_ - interval 480 hours and id not in (select id from cur) group by 1, 2)
select cur.region_id, cur.name, case when date_diff('second', coalesce(first_at, THEN_ - interval 6 hours), THEN_) < 21600 then 'emerging' when heat < h[1] and h[1] < h[2] and heat < greatest(peak, heat) + 0.0 then 'fading' else 'peaking' end as lifecycle from cur left join past using (region_id, name)""")
def w12_names(t):
    now = F.lit(ORDERS_AS_OF).cast("timestamp_ntz")
    x = t("topics").withColumn("at", F.col("created_at").cast("timestamp_ntz")).filter(F.col("at") <= now)
    cur = distinct_on(x.drop("rank"), ["region_id", "name"], [F.desc("at"), F.col("id")])
    past = x.filter((F.col("at") < now) & (F.col("at") >= ago(480, ORDERS_AS_OF))).join(cur.select("id"), "id", "left_anti")
    return M.with_lifecycle(cur.select("region_id", "name", "heat"), past, now, ago(6, ORDERS_AS_OF)).select("region_id", "name", "lifecycle")


@query("f50_portal_boost", """with line as (select r_name as region_id, c_custkey % 2000 + 1 as rank, lower(r_name) || ' ' || lower(c_mktsegment) as said from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
bags as (select region_id, said, sum(greatest(0, (21 - rank) / 20)) as weight from line group by 1, 2),
texts as (select distinct region_id, name, list_filter(string_split(regexp_replace(lower(name || ' ' || split_part(name, ' ', -1)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) >= 2) as w from topics),
met as (select x.region_id, x.name, sum(weight) as weight from texts x join bags b on b.region_id = x.region_id, lateral (select list_filter(string_split(regexp_replace(b.said, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) >= 2) as v) where list_sum(list_transform(v, lambda e: len(list_filter(x.w, lambda f: f = e)))) / (sqrt(list_sum(list_transform(x.w, lambda e: len(list_filter(x.w, lambda f: f = e))))) * sqrt(list_sum(list_transform(v, lambda e: len(list_filter(v, lambda f: f = e)))))) >= 0.8 group by 1, 2)
select id, round(case when weight > 0 then least(1 + 0.08 * weight, 1.6) else 1 end, 3) as boost from topics left join met using (region_id, name)""")
def f50(t):
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    s = t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region_id"), (F.col("c_custkey") % 2000 + 1).cast("int").alias("rank"), F.concat_ws(" ", "r_name", "c_mktsegment").alias("headline"))
    x = t("topics").select("id", "region_id", F.col("name").alias("name_en"), F.lit(None).cast("string").alias("name_ko"), F.array(F.element_at(F.split("name", " "), -1)).alias("keywords"), "heat")
    # The factor is a multiple of 0.004, so unlike the heat it has no ties for two engines to round in two ways.
    return M.portal_boosted(x.withColumn("before", F.col("heat")), s).select("id", F.round(F.col("heat") / F.col("before"), 3).alias("boost"))
