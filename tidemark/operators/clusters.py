"""Clusters of keywords grown from seeds, and the posts and names that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import phrases as phrases_of
from .keyed import top_per_key

#: Words that make no name by themselves.
LOW_SIGNAL = ["news", "issue", "topic", "update", "official", "breaking", "video", "shorts", "today", "latest", "report", "live"]


def seeded_clusters(keywords: DataFrame, members: DataFrame, block: str, key: str, most: int = 5, singles: int = 24) -> DataFrame:
    """block, cluster (its seed's place), keyword, lead: keywords in order of score seed clusters of those they share posts with.

    keywords: block, keyword, score, place (tens a block); members: block, keyword, key.  Posts stay
    distributed: a block's group holds only its keywords and how many posts each two of them share.
    A seed of one post is dropped where its score is low, and clusters of one post are limited in number.
    """
    import pandas as pd

    m = members.distinct()
    other = m.withColumnRenamed("keyword", "with")
    shared = m.join(other, [block, key]).groupBy(block, "keyword", "with").agg(F.count(F.lit(1)).alias("n"))
    listed = shared.groupBy(block, "keyword").agg(F.map_from_entries(F.collect_list(F.struct("with", "n"))).alias("shared"))
    rows = keywords.join(listed, [block, "keyword"], "left")
    kind = f"{block} {keywords.schema[block].dataType.simpleString()}, cluster int, keyword string, lead boolean"

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        words = list(group["keyword"])
        near = {k: (dict(s) if s is not None else {}) for k, s in zip(words, group["shared"], strict=True)}
        score, top = dict(zip(words, group["score"], strict=True)), group["score"].max()
        size = {k: near[k].get(k, 0) for k in words}
        used, out, lone = set(), [], 0

        def alike(a: str, b: str) -> bool:
            if " " not in a or " " not in b:
                return False
            both = set(a.split()) & set(b.split())
            telling = both - set(LOW_SIGNAL)
            return len(telling) >= 2 or (len(telling) == 1 and len(both) >= 3)

        for place, seed in zip(group["place"], words, strict=True):
            if seed in used or not size[seed]:
                continue
            if size[seed] < 2 and ((" " not in seed and len(words) >= 20) or score[seed] < 0.35 * top):
                continue
            need = 1 if size[seed] == 1 else 3 if size[seed] >= 20 else 2
            joins = (k for k in words if k != seed and k not in used and size[k] and (near[seed].get(k, 0) >= need or alike(seed, k)))
            cluster = [seed, *(k for k, _ in zip(joins, range(most - 1)))]
            # One post in all: every keyword has one, and it is the seed's.
            single = all(size[k] == 1 and near[seed].get(k, 0) == 1 for k in cluster)
            if single and (lone >= singles or (len(cluster) < 2 and not any(" " in k for k in cluster))):
                continue
            lone += single
            used.update(cluster)
            out += [(group[block].iloc[0], int(place), k, k == seed) for k in cluster]
        return pd.DataFrame(out, columns=[block, "cluster", "keyword", "lead"])

    return rows.groupBy(block).applyInPandas(grow, kind)


def cluster_posts(clusters: DataFrame, members: DataFrame, block: str, key: str) -> DataFrame:
    """block, cluster, key of each post of a cluster's keywords, once."""
    return clusters.select(block, "cluster", "keyword").join(members, [block, "keyword"]).select(block, "cluster", key).distinct()


def names_something(label: Column) -> Column:
    """Whether a label can name a topic: letters, 3 to 42 characters, not made of empty words, Latin single words of seven characters or more."""
    low = F.lower(label)
    bare = F.regexp_replace(low, "\\s+", "")
    telling = F.filter(F.split(low, "[\\s/|,:;+-]+"), lambda w: (w != "") & ~w.isin(LOW_SIGNAL) & ~w.rlike("^[0-9]+$"))
    single, latin = ~label.contains(" "), bare.rlike("^[a-z0-9._-]+$")
    return F.length(bare).between(3, 42) & (F.size(telling) >= F.when(single, 1).otherwise(F.when(latin & (F.size(F.split(low, "\\s+")) <= 2), 2).otherwise(1))) & ~(latin & (F.length(bare) < F.when(single, 7).otherwise(5))) & (F.length(F.regexp_replace(bare, "\\P{L}", "")) >= 2)


def cluster_names(clusters: DataFrame, keywords: DataFrame, posts: DataFrame, block: str, tokens: str, weight: str) -> DataFrame:
    """block, cluster, name: the best phrase of the posts' titles and keywords, else the best word with the next best.

    posts: block, cluster, tokens, weight.  Clusters with no telling label have no row.
    """
    word = posts.select(block, "cluster", F.explode(F.slice(tokens, 1, 8)).alias("label"), (F.col(weight) * 0.75).alias("s"))
    phrase = posts.select(block, "cluster", F.explode(phrases_of(F.col(tokens), F.col(block))).alias("label"), (F.col(weight) * 1.35).alias("s"))
    own = clusters.join(keywords, [block, "keyword"]).select(block, "cluster", F.col("keyword").alias("label"), (F.col("score") * F.when(F.col("keyword").contains(" "), 2.9).otherwise(1.15)).alias("s"))
    total = word.unionByName(phrase).unionByName(own).groupBy(block, "cluster", "label").agg(F.sum("s").alias("s"))
    total = total.filter(names_something(F.col("label"))).withColumn("s", F.round(F.when(F.col("label").contains(" "), F.col("s")).otherwise(F.col("s") * 0.4), 6)).withColumn("many", F.col("label").contains(" "))
    best = top_per_key(total, [block, "cluster"], [F.desc("many"), F.desc("s"), F.col("label")], 2)
    two = best.groupBy(block, "cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "many"))).alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    joined = F.concat_ws(" / ", first["label"], second["label"])
    fits = ~first["many"] & second.isNotNull() & ~first["label"].contains(second["label"]) & ~second["label"].contains(first["label"]) & (F.length(F.regexp_replace(joined, "\\s+", "")) <= 42)
    return two.select(block, "cluster", F.when(F.coalesce(fits, F.lit(False)), joined).otherwise(first["label"]).alias("name"))


def ranked(topics: DataFrame, block: str, heat: str, key: str) -> DataFrame:
    """Adds each block's rank by heat."""
    return topics.withColumn("rank", F.row_number().over(Window.partitionBy(block).orderBy(F.desc(heat), key)))
