"""Topics that say the same within a block: the hotter one stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode import nfkc, nfkc_each, plain
from .keyed import top_per_key
from .rounds import first_stays
from .store import written


def jaccard_pairs(sets: DataFrame, block: str, key: str, items: str, threshold: float) -> DataFrame:
    """block, key_l, key_r (key_l < key_r), jaccard of sets (no repeats) alike by at least `threshold`.

    Sets meet only by their rarest items: of n items the first n - ceil(threshold n) + 1, by how many sets of
    the block hold them, can't all be missed by a set that is alike.  A frequent item makes no pairs
    unless a set has nothing rarer.
    """
    one = sets.select(block, key, F.size(items).alias("_n"), F.explode(items).alias("_item"))
    held = one.groupBy(block, "_item").agg(F.count(F.lit(1)).alias("_df"))
    place = F.row_number().over(Window.partitionBy(block, key).orderBy("_df", "_item"))
    least = F.ceil(F.col("_n") * threshold - 1e-9)
    heads = written(one.join(held, [block, "_item"]).withColumn("_at", place).filter(F.col("_at") <= F.col("_n") - least + 1))
    side = lambda s: heads.select(block, "_item", F.col(key).alias(f"key_{s}"), F.col("_n").alias(f"_n{s}"))
    fit = F.least("_nl", "_nr") >= F.greatest("_nl", "_nr") * threshold - 1e-9
    met = side("l").join(side("r"), [block, "_item"]).filter((F.col("key_l") < F.col("key_r")) & fit).select(block, "key_l", "key_r").distinct()
    whole = lambda s: sets.select(block, F.col(key).alias(f"key_{s}"), F.col(items).alias(f"_{s}"))
    both = F.size(F.array_intersect("_l", "_r"))
    x = met.join(whole("l"), [block, "key_l"]).join(whole("r"), [block, "key_r"])
    return x.withColumn("jaccard", both / (F.size("_l") + F.size("_r") - both)).filter(F.col("jaccard") >= threshold).select(block, "key_l", "key_r", "jaccard")


def distinct_topics(topics: DataFrame, by: Sequence[str], key: str = "id", heat: str = "heat", likeness: float = 0.5, most: int = 60) -> DataFrame:
    """The topics that stay when each block's are taken from the hottest down and one goes if it is like one
    that stayed, with `rank`; at most `most` a block.

    topics: `by`, key, heat, name_ko, name_en, canonical (null: the first name there is), keywords, entities
    (arrays, null: none).  Two are alike by an equal name or canonical name, by the same entities, or if
    their keywords' Jaccard similarity is at least `likeness`; all without case, punctuation and width.
    Equal keyword sets count as one set, so a set that many topics share makes no pairs among them.
    """
    label = lambda c: plain(nfkc(F.col(c)))
    words = lambda c: F.filter(F.transform(nfkc_each(F.coalesce(F.col(c), F.array().cast("array<string>"))), plain), lambda w: w != "")
    block = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    x = topics.select(F.col(key).alias("key"), F.struct((-F.col(heat)).alias("h"), F.col(key).alias("k")).alias("rank"), block.alias("block"), label("name_ko").alias("ko"), label("name_en").alias("en"), plain(nfkc(F.coalesce("canonical", "name_en", "name_ko"))).alias("canonical"), F.array_sort(F.array_distinct(words("keywords"))).alias("keywords"), F.array_join(F.array_sort(words("entities")), "|").alias("entities"))
    x = written(x.withColumn("set", F.when(F.size("keywords") > 0, F.sha2(F.array_join("keywords", "\u0001"), 256))))
    token = lambda kind, c: F.when(F.col(c) != "", F.concat_ws("\u0001", "block", F.lit(kind), F.col(c)))
    # The row itself is a token too, so that a topic without any name stays.
    own = F.array_compact(F.array(token("ko", "ko"), token("en", "en"), token("canonical", "canonical"), token("entities", "entities"), token("set", "set"), F.concat_ws("\u0001", "block", F.lit("row"), F.col("key").cast("string"))))
    holds = x.select("key", "rank", F.explode(own).alias("token"))
    sets = written(x.filter("set is not null").select("block", "set", "keywords").dropDuplicates(["block", "set"]))
    near = jaccard_pairs(sets, "block", "set", "keywords", likeness)
    near = near.select("block", F.col("key_l").alias("set"), F.col("key_r").alias("other")).union(near.select("block", "key_r", "key_l"))
    looks = holds.union(x.join(near, ["block", "set"]).select("key", "rank", token("set", "other")))
    stayed = first_stays(holds, looks).withColumnRenamed("key", key)
    return top_per_key(topics.join(stayed, key), list(by), [F.desc(heat), F.col(key)], most)
