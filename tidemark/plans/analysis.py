"""Keywords, likeness, groups and the two jobs on the domain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import keywords as K
from ..operators import similarity as S
from ..operators.graph import connected
from ..operators.keyed import top_per_key
from ..operators.store import written
from . import pipelines as P
from .domain import ORDERS_AS_OF
from .reports import p14
from .relational import ago, query

WORDS = "[a-z0-9]{3,}"
#: The terms of documents by language, for DuckDB.
TERMS = f"words as (select lang, doc_id, n_chars, unnest(regexp_extract_all(lower(text), '{WORDS}')) as term from documents), counts as (select lang, doc_id, term, count(*) as n from words group by 1, 2, 3), sizes as (select doc_id, count(*) as total from words group by 1), stats as (select lang, term, df, round(ln((posts + 1) / (df + 1)) + 1, 6) as idf from (select lang, term, count(*) as df from counts group by 1, 2) join (select lang, count(distinct doc_id) as posts from counts group by 1) using (lang))"


def docs(t):  # noqa: ANN001, ANN201
    return t("documents").select("lang", "doc_id", "n_chars", F.regexp_extract_all(F.lower("text"), F.lit(WORDS), 0).alias("terms"))


def doc_counts(t):  # noqa: ANN001, ANN201
    return K.term_counts(docs(t), "lang", "doc_id", "terms")


@query("a26_term_idf", f"with {TERMS} select lang, term, df, idf from stats")
def a26(t):
    return K.idf(doc_counts(t), "lang", "doc_id")


GENERIC = "generic as (select lang, term from (select lang, term, row_number() over (partition by lang order by df desc, term) as r, count(*) over (partition by lang) as n from stats) where r <= greatest(1, ceil(0.02 * n)))"


@query("a27_generic_terms", f"with {TERMS}, {GENERIC} select * from generic")
def a27(t):
    return K.generic_terms(K.idf(doc_counts(t), "lang", "doc_id"), "lang")


@query("a28_term_frequency", f"with {TERMS} select doc_id, term, round(n / total, 6) as tf from counts join sizes using (doc_id)")
def a28(t):
    return doc_counts(t).select("doc_id", "term", F.round(F.col("n") / F.col("total"), 6).alias("tf"))


@query("t08_top_terms", f"with {TERMS} select doc_id, term, r from (select doc_id, term, row_number() over (partition by doc_id order by round(n / total * idf, 12) desc, term) as r from counts join sizes using (doc_id) join stats using (lang, term)) where r <= 40")
def t08(t):
    best = K.best_terms(docs(t), "lang", "doc_id", F.col("terms"), F.lit(1), lambda term: F.lit(1))
    return best.select("doc_id", "term", F.col("place").cast("long").alias("r"))


def doc_scores(t):  # noqa: ANN001, ANN201
    counts = P._checkpointed(doc_counts(t))  # texts are cut into terms once
    stats = P._checkpointed(K.idf(counts, "lang", "doc_id"))
    weights = t("documents").select("lang", "doc_id", scoring.engagement_weight(F.col("n_chars"), F.lit(0), F.lit(0), F.lit(0)).alias("weight"))
    return K.keyword_scores(counts, stats, K.generic_terms(stats, "lang"), weights, "lang", "doc_id", K.phrase_boost(F.col("term")))


@query("a29_keyword_score", f"with {TERMS}, {GENERIC}, scored as (select lang, doc_id, term, df, round((1 + 0.0005::double * n_chars) * n / total * idf, 12) as s from counts join sizes using (doc_id) join stats using (lang, term) join (select doc_id, n_chars from documents) using (doc_id) where not exists (select 1 from generic g where g.lang = counts.lang and g.term = counts.term)), best as (select *, row_number() over (partition by lang, doc_id order by s desc, term) as r from scored) select lang, term, round(sum(s), 6) as score, count(*) as posts from best where r <= 40 group by 1, 2")
def a29(t):
    return doc_scores(t).select("lang", "term", "score", "posts")


@query("t09_picked_keywords")
def t09(t):
    return K.pick_keywords(doc_scores(t), "lang", least_df=F.lit(2))


@query("j12_near_vectors", "select a.vec_id as key_l, b.vec_id as key_r, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.4")
def j12(t):
    return S.near_vectors(t("embeddings"), "vec_id", "embedding", 0.4)


@query("j12_token_similarity", "with n as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')) as a, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,6}')) as k, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as w from benchmark), p as (select l.item_id as key_l, r.item_id as key_r, len(list_intersect(l.w, r.w)) as s, len(l.w) + len(r.w) as lw, len(list_intersect(l.k, r.k)) as ks, len(l.k) + len(r.k) as lk, len(list_intersect(l.a, r.a)) as ns, len(l.a) + len(r.a) as ln from n l join n r on l.item_id < r.item_id) select key_l, key_r, s as shared, round((0.45 * s / (lw - s) + coalesce(0.35 * ks / nullif(lk - ks, 0), 0) + coalesce(0.2 * 2 * ns / nullif(ln, 0), 0)) * case when s < 2 then 0.4 else 1 end, 4) as score from p where s >= 1")
def j12_tokens(t):
    from ..operators.joins import token_pairs

    words = lambda p: F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(p), 0))
    n = t("benchmark").select(F.col("item_id").alias("key"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("primary"), words("[a-z]{7,}").alias("name_tokens"), words("[a-z]{3,6}").alias("keyword_tokens"), words("[a-z]{3,}").alias("tokens"))
    side = lambda k, s: n.select(F.col("key").alias(k), F.struct("name", "primary", "name_tokens", "keyword_tokens", "tokens").alias(s))
    x = token_pairs(n, n, "key", "tokens").filter("key_l < key_r").join(side("key_l", "l"), "key_l").join(side("key_r", "r"), "key_r")
    x = x.select("key_l", "key_r", *(F.coalesce(m, F.lit(False)).alias(k) if k in ("contains", "primary") else m.alias(k) for k, m in S.measures().items()))
    return S.similarity(x).select("key_l", "key_r", F.col("shared").cast("long").alias("shared"), "score")


@query("j15_bag_cosine", "with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as w from benchmark), c as (select item_id, w, count(*) as n from w group by 1, 2), m as (select item_id, sqrt(sum(n * n)) as m from c group by 1) select a.item_id as key_l, b.item_id as key_r, round(sum(a.n * b.n) / (max(x.m) * max(y.m)), 4) as cosine from c a join c b on a.w = b.w join m x on x.item_id = a.item_id join m y on y.item_id = b.item_id group by 1, 2 having round(sum(a.n * b.n) / (max(x.m) * max(y.m)), 6) >= 0.8")
def j15(t):
    b = t("benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0).alias("w"))
    return S.bag_pairs(b, b, "item_id", "w", 0.8).select("key_l", "key_r", F.round("cosine", 4).alias("cosine"))


@query("j17_all_terms_join", "with k as (select distinct lower(c_mktsegment) || ' ' || 'the' as keyword from customer union select 'the and' union select 'was with'), d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) as w from documents) select keyword, doc_id from k join d on list_has_all(w, string_split(keyword, ' '))")
def j17(t):
    seg = t("customer").select(F.concat(F.lower("c_mktsegment"), F.lit(" the")).alias("keyword")).distinct()
    extra = seg.sparkSession.range(1).select(F.explode(F.array(F.lit("the and"), F.lit("was with"))).alias("keyword"))
    k = seg.union(extra).withColumn("b", F.lit(1))
    return K.matches(docs(t).withColumn("b", F.lit(1)), k, "b", "doc_id", "terms").select("keyword", "doc_id")


@query("j16_contained_keyword", "select keyword, doc_id from (select distinct lang as keyword from documents where lang is not null) join documents on contains(lower(text), keyword)")
def j16(t):
    k = t("documents").select(F.col("lang").alias("keyword")).dropna().distinct().withColumn("b", F.lit(1))
    return P.containing(t("documents").withColumn("b", F.lit(1)), k, "b", "doc_id", F.lower("text")).select("keyword", "doc_id")


@query("g01_components", "select id, min(id) over (partition by canonical_key, g) as component from (select distinct canonical_key, community_id as id, community_id % 3 as g from overlap_events union select distinct canonical_key, news_id, news_id % 3 from overlap_events)")
def g01(t):
    return connected(t("overlap_events").select(F.col("community_id").alias("a"), F.col("news_id").alias("b"))).select(F.col("node").alias("id"), "component")


@query("u09_merged_issues", "select issue as component, string_agg(distinct region_id, ',' order by region_id) as regions, round(sum(heat), 3) as heat, min(created_at) as first_at, count(*) as n from topics group by 1")
def u09(t):
    # Topics of one issue hang together in a chain, each with the one before it; groups are what is connected.
    before = F.lag("id").over(Window.partitionBy("issue").orderBy("created_at", "id"))
    x = written(t("topics").select("id", "issue", "region_id", "heat", "created_at", before.alias("before")))  # read twice
    groups = connected(x.select(F.col("id").alias("a"), F.coalesce("before", "id").alias("b")))
    y = x.join(groups.withColumnRenamed("node", "id"), "id").groupBy("component").agg(F.max("issue").alias("issue"), F.array_join(F.array_sort(F.collect_set("region_id")), ",").alias("regions"), F.round(F.sum("heat"), 3).alias("heat"), F.min("created_at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    return y.select(F.col("issue").alias("component"), "regions", "heat", "first_at", "n")


@query("p15_qualified_edges", "with f as (select concat(scope, cast(rank as varchar)) as issue, region_id, min(created_at) as ft from topics group by 1, 2), e as (select issue, region_id as f, lead(region_id) over w as g, greatest(0, date_diff('minute', ft, lead(ft) over w)) as lag from f window w as (partition by issue order by ft, region_id)) select issue, count(*) filter (g is not null) as edges, count(*) filter (g is not null and round(1 - least(lag / 1440, 1), 4) >= 0.25 and lag > 0 and lag <= 4320) as qualified from e group by 1")
def p15(t):
    f = t("topics").groupBy(F.concat("scope", F.col("rank").cast("string")).alias("issue"), "region_id").agg(F.min("created_at").alias("first_at"))
    e = f.groupBy("issue").agg(P.timeline_edges(F.array_sort(F.collect_list(F.struct("first_at", "region_id")))).alias("e"))
    return e.select("issue", F.size("e").cast("long").alias("edges"), F.size(P.qualified_edges(F.col("e"), "mixed")).cast("long").alias("qualified"))


@query("j18_velocity", "with h as (select topic_name, sum(like_count) filter (posted_at > NOW - interval 25 hours) as heat, coalesce(arg_max(like_count, row(posted_at, id)) filter (posted_at <= NOW - interval 25 hours), 0) as h1, coalesce(arg_max(like_count, row(posted_at, id)) filter (posted_at <= NOW - interval 26 hours), 0) as h2 from posts group by 1) select topic_name, round(coalesce(heat, 0) - h1, 4) as velocity, round(coalesce(heat, 0) - h1 - h1 + h2, 4) as acceleration from h")
def j18(t):
    at, past = F.struct("posted_at", "id"), lambda h: F.col("posted_at") <= ago(h)
    x = t("posts").groupBy("topic_name").agg(F.coalesce(F.sum(F.when(~past(25), F.col("like_count"))), F.lit(0.0)).alias("heat"), *(F.coalesce(F.max_by("like_count", F.when(past(h), at)), F.lit(0.0)).alias(f"h{h - 24}") for h in (25, 26)))
    return x.select("topic_name", F.round(F.col("heat") - F.col("h1"), 4).alias("velocity"), F.round(F.col("heat") - F.col("h1") - F.col("h1") + F.col("h2"), 4).alias("acceleration"))


def _posts(t):  # noqa: ANN001, ANN202
    hours = F.make_interval(hours=(F.col("doc_id") % 25).cast("int"))
    return t("documents").select(F.col("lang").alias("region_id"), F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("text").alias("title"), F.col("n_chars").alias("views"), F.lit(1).alias("likes"), F.lit(0).alias("comments"), (ago(0) - hours).alias("posted_at"))


@query("q19_regional_analysis")
def q19(t):
    return P.regional(_posts(t), ago(0))


@query("q21_region_snapshots")
def q21(t):
    return P.snapshot(P._checkpointed(P.regional(_posts(t), ago(0))))


@query("q20_global_analysis")
def q20(t):
    x = t("topics")
    # The job reads, for each scope, the latest three batches of each region, 4500 topics at most; those without a source of their region go.
    batches = top_per_key(x.select("scope", "region_id", "created_at").distinct(), ["scope", "region_id"], [F.desc("created_at")], 3).drop("rank")
    y = top_per_key(x.drop("rank").join(batches, ["scope", "region_id", "created_at"]), ["scope"], [F.desc("heat"), F.col("id")], 4500)
    y = y.join(p14(t), "id", "left_semi").select("id", "scope", "region_id", "name", F.array(F.element_at(F.split("name", " "), -1)).alias("keywords"), "heat", "sentiment", F.lit(1).alias("post_count"), F.col("created_at").alias("first_at"))
    history = x.select("scope", "name", "heat", F.col("created_at").alias("at"))
    return P.global_issues(P._checkpointed(y), history, F.lit(ORDERS_AS_OF).cast("timestamp_ntz"))


@query("g03_scope_overlaps")
def g03(t):
    x = t("topics")
    batches = top_per_key(x.select("region_id", "scope", "created_at").distinct(), ["region_id", "scope"], [F.desc("created_at")], 3).drop("rank")
    y = x.join(batches, ["region_id", "scope", "created_at"])
    words = F.array_distinct(F.split(F.lower("name"), " "))
    none = F.array().cast("array<string>")
    side = lambda s: y.filter(F.col("scope") == s).select(F.col("id").alias("key"), F.col("region_id").alias("block"), F.lower("name").alias("canonical"), words.alias("name_tokens"), F.slice(words, 2, 4).alias("keyword_tokens"), none.alias("entity_tokens"), none.alias("phrases"), F.lit(None).cast("array<double>").alias("vector"), F.col("created_at").alias("first_at"))
    return P.scope_overlaps(side("community"), side("news"))
