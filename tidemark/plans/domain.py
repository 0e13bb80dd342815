"""The domain's tables, bound to the star schema by expressions that read the same in both dialects."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"

VIEWS = {
    "posts": "select event_id as id, concat('s', cast(user_id % 20 as string)) as source_id, concat('r', cast(user_id % 5 as string)) as region_id, event_type as topic_name, ts as posted_at, value as like_count, cast(regexp_extract(props, '[0-9]+', 0) as bigint) as comment_count from events",
    "runs": "select event_id as id, concat('s', cast(user_id % 20 as string)) as source_id, ts as started_at, case when event_type = 'error' then 'failed' else 'success' end as status, value * 10 as latency_ms, case when event_type = 'error' then concat('http_', cast(500 + event_id % 4 as string)) end as error_code from events",
    "sources": "select concat('s', cast(s_suppkey % 22 as string)) as id, min(s_name) as name, concat('r', cast(min(s_nationkey) % 5 as string)) as region_id, min(s_suppkey) % 3 + 1 as trust_tier, min(s_suppkey) % 2 = 0 as is_core from supplier group by 1",
    "topics": "select o_orderkey as id, r_name as region_id, case o_orderstatus when 'O' then 'community' when 'F' then 'news' else 'mixed' end as scope, o_custkey as issue, concat(r_name, ' ', c_mktsegment) as name, o_totalprice as heat, (o_orderkey % 201 - 100) / 100.0 as sentiment, o_orderdate as created_at, cast(substr(o_orderpriority, 1, 1) as int) as rank from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey",
    "topic_sources": "select distinct l_orderkey as topic_id, concat('s', cast(l_suppkey % 20 as string)) as source_id from lineitem",
    "overlap_events": "select c.o_orderkey as community_id, n.o_orderkey as news_id, c.o_custkey as canonical_key, c.o_orderdate as detected_at, cast(extract(day from n.o_orderdate) - extract(day from c.o_orderdate) as bigint) * 7 as lag_minutes, (c.o_orderkey % 100) / 100.0 as cosine from orders c join orders n on c.o_custkey = n.o_custkey and c.o_orderstatus = 'O' and n.o_orderstatus = 'F' and c.o_orderkey % 3 = n.o_orderkey % 3",
}
#: Base tables that each view reads.
NEEDS = {"posts": ["events"], "runs": ["events"], "sources": ["supplier"], "topics": ["orders", "customer", "nation", "region"], "topic_sources": ["lineitem"], "overlap_events": ["orders"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, or a base table, as a lazy DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("/ 100.0", "/ double('100')")
    for base in NEEDS[name]:
        text = _replaced(text, base)
    return spark.sql(text, **{base: table(spark, sf_dir, base) for base in NEEDS[name]})


@cache
def _pattern(base: str):  # noqa: ANN202
    return re.compile(rf"(from|join) {base}\b")


def _replaced(text: str, base: str) -> str:
    return _pattern(base).sub(rf"\1 {{{base}}} as {base}", text).replace(f"as {base} c ", "as c ").replace(f"as {base} n ", "as n ")


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names ahead of it, and ahead of those it brings along."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ahead = "with " + ", ".join(f"{v} as ({VIEWS[v]})" for v in used)
    if sql.startswith("with recursive "):
        return f"with recursive {ahead[5:]}, {sql[15:]}"
    return f"{ahead}, {sql[5:]}" if sql.startswith("with ") else f"{ahead} {sql}"
