"""Choices that depend on one another, and what they start from: page posts, names, title terms, identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles
from ..functions.topic_names import with_names
from ..functions.unicode import nfkc, plain
from ..operators import evidence as E
from ..operators.dedupe import distinct_topics
from ..operators.identity import ALIASES, closure, with_identity
from ..operators.keyed import top_per_key
from ..operators.rounds import fold_groups
from ..operators.store import written
from ..sources.site_pages import RULE, posts_of
from .relational import query

#: Topics of pages for DuckDB: language folder as region, title as name, link names as keywords, long capitalised words of the title as entities.
PAGES = "page as (select page_id as id, regexp_extract(url, 'https?://[^/]+/([a-z]+)/', 1) as region_id, length(html) as heat, regexp_extract(html, '<title>([^<]*)</title>', 1) as name_en, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as name_ko, regexp_extract_all(html, '<li><a href=\"/([^\"]*)\"', 1) as keywords, regexp_extract(url, '/([0-9]+)', 1) as number from pages)"
PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
BARE = "regexp_replace(lower({0}), '[\\p{{P}}\\p{{S}}\\s]+', '', 'g')"


def pages(t):  # noqa: ANN001, ANN201
    x = t("pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "https?://[^/]+/([a-z]+)/", 1).alias("region_id"), F.char_length("html").alias("heat"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name_en"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("name_ko"), F.regexp_extract_all("html", F.lit('<li><a href="/([^"]*)"'), 1).alias("keywords"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))
    return x.withColumn("canonical", F.lit(None).cast("string")).withColumn("entities", F.regexp_extract_all("name_en", F.lit("[A-Z][a-z]{5,}"), 0))


@query("u12_distinct_topics", f"""with recursive {PAGES},
label as (select id, region_id, heat, {PLAIN.format('name_en')} as en, {PLAIN.format('name_ko')} as ko, list_sort(list_distinct(list_filter(list_transform(keywords, lambda w: {PLAIN.format('w')}), lambda w: w <> ''))) as kw, array_to_string(list_sort(list_transform(regexp_extract_all(name_en, '[A-Z][a-z]{{5,}}'), lambda w: lower(w))), '|') as ents from page),
ranked as (select *, row_number() over (partition by region_id order by heat desc, id) as r from label),
run(region_id, r, kept) as (select distinct region_id, cast(0 as bigint), [{{'id': cast(-1 as bigint), 'en': '', 'ko': '', 'kw': cast([] as varchar[]), 'ents': ''}}] from ranked
  union all select t.region_id, t.r, case when len(kept) > 60 or len(list_filter(kept, lambda k: (t.ko <> '' and k.ko = t.ko) or (t.en <> '' and k.en = t.en) or (t.ents <> '' and k.ents = t.ents) or (len(t.kw) > 0 and len(k.kw) > 0 and len(list_intersect(k.kw, t.kw)) / len(list_distinct(list_concat(k.kw, t.kw))) >= 0.5))) > 0 then kept else list_append(kept, {{'id': t.id, 'en': t.en, 'ko': t.ko, 'kw': t.kw, 'ents': t.ents}}) end
  from run join ranked t on t.region_id = run.region_id and t.r = run.r + 1),
last as (select region_id, arg_max(kept, r) as kept from run group by 1)
select region_id, id, heat, row_number() over (partition by region_id order by heat desc, id) as rank from (select region_id, unnest(list_transform(kept[2:], lambda k: k.id)) as id from last) join page using (region_id, id)""")
def u12(t):
    return distinct_topics(pages(t), ["region_id"]).select("region_id", "id", "heat", F.col("rank").cast("long").alias("rank"))


@query("f16_topic_names")
def f16(t):
    """Names of page topics resolved from title, heading, links and capitalised words; compared row by row with the function in the tests."""
    x = pages(t).withColumn("titles", F.array("name_ko")).withColumn("entities", F.transform("entities", lambda e: F.struct(e.alias("text"), F.lit("other").alias("type"))))
    return with_names(x).select("id", "name_ko", "name_en", "source_ko", "source_en", "low_ko", "low_en", "upgraded_ko", "upgraded_en")


@query("f06_title_terms")
def f06(t):
    """Tokens, phrases and their script weights of page titles; compared row by row with plain Python in the tests."""
    region, x = F.col("region_id"), pages(t).select("id", "region_id", "name_en").withColumn("words", titles.tokens(F.col("name_en"), F.col("region_id"), F.lit("page")))
    x = x.withColumn("weight", F.aggregate("words", F.lit(0.0), lambda a, w: a + titles.script_multiplier(w, region)))
    return x.select("id", F.array_join("words", " ").alias("terms"), F.array_join(titles.phrases(F.col("words"), region), "|").alias("phrases"), F.round("weight", 4).alias("weight"))


EVIDENCE = """hottest as (select * from (select *, row_number() over (partition by region_id, scope order by heat desc, id) as n from topics) where n <= 80),
made as (select t.id, t.region_id as block, t.scope, t.created_at as first_at, list_distinct(string_split(lower(t.name), ' ')) as names, list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) as keywords, list_distinct(list(p_name)) as phrases, list_distinct(list(lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '', 'g')))) as entities, 'issue' || 'x' || t.issue as canonical
  from hottest t join lineitem on l_orderkey = t.id join part on p_partkey = l_partkey group by t.id, t.region_id, t.scope, t.created_at, t.name, t.issue),
evid as (select * replace (list_distinct(list_append(names, canonical)) as names) from made),
met as (select c.block, c.id as community, n.id as news, len(list_intersect(c.names, n.names)) as names, len(list_intersect(c.keywords, n.keywords)) as keywords, len(list_intersect(c.entities, n.entities)) as entities, len(list_intersect(c.phrases, n.phrases)) as phrases, c.canonical = n.canonical as same_canonical, date_diff('minute', c.first_at, n.first_at) as lag_minutes from evid c join evid n on c.block = n.block and c.scope = 'community' and n.scope = 'news')"""


def sides(t):  # noqa: ANN001, ANN201
    """Evidence of the 80 hottest community and news topics a region: names, words of their parts, brands."""
    top = top_per_key(t("topics").drop("rank"), ["region_id", "scope"], [F.desc("heat"), F.col("id")], 80)
    parts = t("lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    x = parts.join(top, "id").groupBy("id").agg(F.collect_set("p_name").alias("keywords"), F.collect_set(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "")).alias("entities"))
    x = top.join(x, "id").withColumnRenamed("created_at", "first_at")
    e = written(E.evidence(x, "id", "region_id", F.array("name"), F.col("keywords"), F.col("entities"), F.concat(F.lit("issue x "), F.col("issue").cast("string")), "scope", "first_at"))
    return tuple(e.filter(F.col("scope") == s).drop("scope") for s in ("community", "news"))


def official(t):  # noqa: ANN001, ANN201
    """Pairs that a run found: those of one issue in one region."""
    return t("overlap_events").groupBy(F.col("community_id").alias("community"), F.col("news_id").alias("news")).agg(F.max_by("cosine", F.struct("detected_at", "cosine")).alias("cosine"))


def _chosen(where: str, last: str = "") -> str:
    """DuckDB SQL of the candidates, taken one after the other within each block."""
    return f"""with recursive {EVIDENCE},
scored as (select *, round(least(1, names * 0.24 + keywords * 0.18 + entities * 0.18 + phrases * 0.16 + case when same_canonical then 0.22 else 0 end), 4) as score, case when abs(lag_minutes) < 10 then 'tie' when lag_minutes > 0 then 'community' else 'news' end as leader from met where (names > 0 and keywords > 0) or (same_canonical and (names > 0 or keywords > 0))),
cand as (select * from scored where (score >= 0.45 or same_canonical) and {where} and not exists (select 1 from overlap_events o where o.community_id = community and o.news_id = news)),
ranked as (select *, row_number() over (partition by block order by score desc, abs(lag_minutes), community, news) as r from cand),
run(block, r, cs, ns, won) as (select distinct block, cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]), false from ranked
  union all select run.block, x.r, list_append(cs, x.community), list_append(ns, x.news), true from run, lateral (select community, news, r from ranked q where q.block = run.block and q.r > run.r and not list_contains(run.cs, q.community) and not list_contains(run.ns, q.news) order by q.r limit 1) x)
select block, community, news, score, case when score >= 0.72 then 'high' when score >= 0.45 then 'medium' else 'low' end as tier, lag_minutes, leader, names, keywords, entities, phrases, same_canonical from ranked join run using (block, r) where won{last}"""


def candidates(t, direction: str = "both", region: str | None = None):  # noqa: ANN001, ANN201
    """Candidate pairs beside the official ones, of one region or of all."""
    community, news = sides(t)
    if region:
        community, news = (x.filter(F.col("block") == region) for x in (community, news))
    told = official(t).join(community.select("block", F.col("key").alias("community")), "community").select("block", "community", "news")
    return E.candidate_pairs(community, news, told, direction).withColumns({k: F.col(k).cast("long") for k in E.KINDS})


@query("t11_candidate_pairs", _chosen("true"))
def t11(t):
    return candidates(t)


@query("q14_candidate_supplement", _chosen("leader = 'community' and block = 'EUROPE'", " order by score desc, abs(lag_minutes), community, news limit 50"))
def q14_candidates(t, direction: str = "community_to_news", region: str | None = "EUROPE", limit: int = 50):
    """What the source-transfer endpoint shows beside its official pairs (q14_source_transfer)."""
    return candidates(t, direction, region).orderBy(F.desc("score"), F.abs("lag_minutes"), "community", "news").limit(limit)


@query("f56_match_evaluation", f"""with {EVIDENCE},
seen as (select community_id as community, news_id as news, arg_max(cosine, row(detected_at, cosine)) as cosine from overlap_events group by 1, 2),
s as (select b.*, cosine, round(greatest(cosine, least(1, names * 0.16 + keywords * 0.12 + entities * 0.22 + phrases * 0.24 + case when same_canonical then 0.26 else 0 end)), 4) as score, cast(names > 0 as int) + cast(keywords > 0 as int) + cast(entities > 0 as int) + cast(phrases > 0 as int) + cast(same_canonical as int) as classes, same_canonical or entities > 0 or phrases > 0 as exact from met b join seen using (community, news))
select block, community, news, score, case when score >= 0.72 then 'high' when score >= 0.45 then 'medium' else 'low' end as tier, classes, exact, cosine >= 0.72 or exact or (score >= 0.45 and classes >= 2) as visible from s""")
def f56(t):
    community, news = sides(t)
    return E.evaluated(official(t).join(community.select("block", F.col("key").alias("community")), "community"), community, news)


@query("u09_folded_issues", f"""with recursive {PAGES},
ranked as (select id, region_id, heat, name_en as en, name_ko as ko, number, {BARE.format('name_en')} as ek, {BARE.format('name_ko')} as kk, row_number() over (order by heat desc, id) as r from page),
run(r, groups, said) as (select cast(0 as bigint), [{{'founder': cast(-1 as bigint), 'en': '', 'ko': '', 'identity': '', 'ids': cast([] as varchar[])}}], cast(null as row(id bigint, founder bigint))
  union all select t.r, case when hit = 0 then list_append(groups, {{'founder': t.id, 'en': t.en, 'ko': t.ko, 'identity': mine, 'ids': [number]}}) else list_transform(groups, lambda g, i: case when i = hit then {{'founder': g.founder, 'en': case when length(t.en) > length(g.en) then t.en else g.en end, 'ko': case when length(t.ko) > length(g.ko) then t.ko else g.ko end, 'identity': case when length(t.en) > length(g.en) and ek <> '' then ek else g.identity end, 'ids': list_append(g.ids, number)}} else g end) end,
    row(t.id, case when hit = 0 then t.id else groups[hit].founder end)
  from (select groups, t.*, coalesce(nullif(ek, ''), kk) as mine, coalesce(list_min(list_transform(groups, lambda g, i: case when (coalesce(nullif(ek, ''), kk) <> '' and g.identity = coalesce(nullif(ek, ''), kk)) or list_contains(g.ids, number) then i end)), 0) as hit from run join ranked t on t.r = run.r + 1) t)
select said.founder as issue, count(*) as n, round(sum(heat), 3) as heat, string_agg(distinct region_id, ',' order by region_id) as regions from run join page on page.id = said.id where said is not null group by 1""")
def u09(t):
    bare = lambda c: F.regexp_replace(F.lower(nfkc(F.col(c))), "[\\p{P}\\p{S}\\s]+", "")
    none = F.lit(None).cast("string")
    x = written(pages(t).select(F.col("id").alias("key"), "region_id", "heat", F.col("name_en").alias("en"), F.col("name_ko").alias("ko"), bare("name_en").alias("en_key"), bare("name_ko").alias("ko_key"), none.alias("alias_en"), none.alias("alias_ko"), F.array("number").alias("ids")).withColumn("rank", F.struct((-F.col("heat")).alias("h"), F.col("key").alias("k"))))
    g = fold_groups(x)
    return g.join(x, "key").groupBy(F.col("founder").alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("heat").cast("double"), 3).alias("heat"), F.array_join(F.array_sort(F.collect_set("region_id")), ",").alias("regions"))


@query("f27_identity_rollup", f"""with recursive b as (select n_nationkey as k, {BARE.format('n_name')} as name from nation),
walk(k, here, steps) as (select k, k, 0 from b union all select k, here - 1, steps + 1 from walk where here % 4 <> 0),
roots as (select walk.k, b.name as identity from (select k, arg_max(here, steps) as here from walk group by 1) walk join b on b.k = walk.here)
select identity, count(*) as n, round(sum(c_acctbal), 2) as heat from customer join roots on k = c_nationkey group by 1""")
def f27(t):
    """Customers by the identity of their nation, where three of four nations are an alias of the one before: chains of aliases."""
    n = t("nation")
    before = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("n_name").alias("name"))
    pairs = n.filter(F.col("n_nationkey") % 4 != 0).join(before, "n_nationkey").select("name", F.col("n_name").alias("alias"))
    known = pairs.union(n.sparkSession.createDataFrame(ALIASES, "name string, alias string"))
    named = with_identity(n.select("n_nationkey", F.col("n_name").alias("name_en"), F.lit(None).cast("string").alias("name_ko")), closure(known))
    x = t("customer").join(named, F.col("n_nationkey") == F.col("c_nationkey"))
    return x.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("heat"))


@query("s17_page_posts", """with p as (select page_id, regexp_extract(url, '^[a-z]+://[^/]+') as root, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]+</a></li>', 1)) as href from pages)
select 'example.' || regexp_extract(host, '(^|[.])example[.](com|net|org)$', 2) as source, root || href as external_id, min(page_id) as page_id from p where regexp_matches(host, '(^|[.])example[.](com|net|org)$') group by 1, 2""")
def s17(t):
    """Entries of the lists on all pages, by rules for three hosts."""
    pages = t("pages")
    rules = pages.sparkSession.createDataFrame([(h, h, "li", "a", None, None, None, None, None, None, None, None) for h in ("example.com", "example.net", "example.org")], RULE)
    return posts_of(pages, rules).filter("error is null").select("source", "external_id", "page_id")
