"""The operators of this subpackage applied to whole tables: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .importance import importance_resample
from .language_id import language_id
from .merkle import tampered_check
from .mixing import placed_mix
from .near_dedup import near_classes
from .packing import pack
from .pii import pii_digest
from .runtime import documents
from .simhash import simhash_components
from .substring_dedup import remove_repeats
from .suffix_dedup import repeated_spans
from .tokens import default_tokenizer, token_counts
from .topk import top_k


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.col("placed.shard").alias("shards"), F.col("placed.place").alias("places"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_tokenizer())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_check(documents(spark, sf_dir))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0])) if k.startswith("op") and k[2].isdigit()}


#: DuckDB SQL for the same rows; the other operators are held against brute force in tests/llm.
SQL = {
    "op7_top_k": """
with v as (select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as q from embeddings),
s as (select a.i, a.vec_id as query_id, b.vec_id as vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 20 = 0 and a.i <> b.i),
r as (select query_id, cast(row_number() over (partition by i order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20""",
    "op10_exact_dedup": """
with n as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as norm from documents),
k as (select doc_id, first_value(doc_id) over (partition by norm order by n desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size, sha256(norm) as text_sha256 from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from k""",
    "op12_merkle_manifest": """
with recursive bits(i, v, k) as (select i, i, 0 from range(256) r(i) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
crc as (select list(v order by i) as t from bits where k = 8),
docs as (select *, case when doc_id is not null and xor(list_reduce([4294967295] || list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ord(c) as bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as other from documents, crc),
fields as (select doc_id, source, list_transform([cast(doc_id as varchar), source, lang, cast(n_chars as varchar), text], lambda x: coalesce(strlen(x) || ':' || x, '-')) as f, coalesce(strlen(other) || ':' || other, '-') as o from docs),
leaves as (select doc_id, source, sha256(array_to_string(f, '')) as leaf, sha256(array_to_string(f[1:4], '') || o) as other from fields),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by source nulls first) - 1 as src from leaves),
tree(k, src, pos, h) as (select 0, src, pos, leaf from placed
  union all select k + 1, src, pos // 3, sha256(string_agg(h, '' order by pos)) from (select k, src, pos, h, count(*) over (partition by src) as m from tree) where m > 1 group by k, src, pos // 3),
tops as (select src, max(k) as height, arg_max(h, k) as subroot from tree group by src),
trunk(k, pos, h) as (select 0, src, subroot from tops
  union all select k + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select k, pos, h, count(*) over () as m from trunk) where m > 1 group by k, pos // 3),
whole as (select max(k) as height, arg_max(h, k) as root from trunk),
runs as (select k, src, pos // 3 as run, list(h order by pos) as hs from tree group by all),
trunks as (select k, pos // 3 as run, list(h order by pos) as hs from trunk group by all),
ids as (select p.*, subroot, root, t.height as th, w.height as wh, row_number() over () as n from placed p join tops t using (src), whole w),
steps as (
  select n, k, pos // cast(pow(3, k) as bigint) % 3 as place, hs from ids join range(40) r(k) on k < th join runs using (src, k) where run = pos // cast(pow(3, k + 1) as bigint)
  union all select n, 100 + k, src // cast(pow(3, k) as bigint) % 3, hs from ids join range(40) r(k) on k < wh join trunks using (k) where run = src // cast(pow(3, k + 1) as bigint)),
sides as (select n, list({'l': array_to_string(list_slice(hs, 1, place), ''), 'r': array_to_string(list_slice(hs, place + 2, len(hs)), '')} order by k) as path from steps group by n)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) as proof_sha256,
  list_reduce([{'l': other, 'r': ''}] || coalesce(path, []), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l as folded_root, folded_root = root as verified
from ids left join sides using (n)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
