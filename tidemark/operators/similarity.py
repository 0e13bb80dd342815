"""Similar topics across blocks: candidates by shared tokens and by near vectors, scores, and groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, scoring
from .graph import _checkpointed, connected
from .joins import token_pairs
from .store import written

#: Vectors that are multiplied at a time, cells that they are dealt into, parts that these travel in, and bytes of a part.
VECTOR_BLOCK, CELLS, PARTS, HELD_BYTES = 1024, 64, 8, 1 << 24
NODE = ("tokens", "keyword_tokens", "name_tokens")


def _cells(unit: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """Adds dim, cell (the nearest pivot of as many components, -1 if there is none) and near (the cosine to it)."""
    of_dim: dict[int, list[int]] = {}
    for i, p in enumerate(pivots):
        of_dim.setdefault(len(p), []).append(i)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            at, dim = at - at[0], np.diff(at)
            cell, near = np.full(len(dim), -1), np.full(len(dim), -1.0)
            for d, which in of_dim.items():
                rows = np.flatnonzero(dim == d)
                if len(rows):
                    cosines = flat[at[rows][:, None] + np.arange(d)] @ np.array([pivots[i] for i in which]).T
                    best = cosines.argmax(1)
                    cell[rows], near[rows] = np.array(which)[best], cosines[np.arange(len(rows)), best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dim.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(near)], ["k", "v", "dim", "cell", "near"])

    return unit.mapInArrow(place, f"k {unit.schema['k'].dataType.simpleString()}, v array<double>, dim int, cell int, near double")


def near_vectors(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = VECTOR_BLOCK, held_bytes: int = HELD_BYTES) -> DataFrame:
    """key_l < key_r, cosine of all pairs of cosine >= threshold, exactly.

    Vectors gather around pivots, the first vectors by a hash of the key, CELLS at most.  Two cells are
    compared unless their pivots lie further apart than the widest angles within both and the threshold's
    angle together.  Small cells travel together and large ones in parts, PARTS or so in all (more once a part
    would pass `held_bytes`), and any two parts with cells to compare meet in a task, which multiplies `block` vectors
    at a time.  So no cell is held whole however many vectors it has, and a vector is sent to each part once.
    Where vectors don't cluster, as in many random dimensions, nothing is pruned and comparisons grow with the
    square; what is sent grows with the input up to PARTS times held_bytes, and by the number of parts beyond.
    Null vectors, those with a null or non-finite component, and those of length zero have no partner; nor
    have vectors of different sizes.
    """
    norm = F.sqrt(arrays.dot(F.col(vector), F.col(vector)))
    unit = vectors.filter(F.col(vector).isNotNull()).withColumn("_n", norm).filter((F.col("_n") > 0) & (F.col("_n") < float("inf")))
    unit = written(unit.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double") / F.col("_n")).alias("v")))
    most = min(CELLS, max(1, unit.count() // block))
    pivots = [list(r["v"]) for r in unit.orderBy(F.xxhash64("k"), "k").limit(most).collect()]
    reach = float(np.arccos(max(-1.0, min(1.0, threshold)))) + 1e-4  # room for rounding
    gaps = {(i, j): float(np.arccos(np.clip(np.dot(p, q), -1, 1))) for i, p in enumerate(pivots) for j, q in enumerate(pivots) if len(p) == len(q)}

    def meet(table: pa.Table) -> pa.Table:
        is_left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        alone = all(table.column(x)[0] == table.column(y)[0] for x, y in (("a", "b"), ("s", "r")))
        keys = table.column("k").combine_chunks()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        cell, angle = table.column("cell").to_numpy(), table.column("angle").to_numpy()
        of = lambda rows: {c: rows[cell[rows] == c] for c in np.unique(cell[rows])}
        lefts, rights = of(np.flatnonzero(is_left)), of(np.flatnonzero(is_left if alone else ~is_left))
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for c, x in lefts.items():
            for d, y in rights.items():
                if (alone and c > d) or gaps.get((c, d), 0.0) > angle[x[0]] + angle[y[0]] + reach:
                    continue
                same = alone and c == d
                for p in range(0, len(x), block):
                    for q in range(p if same else 0, len(y), block):
                        cosines = v[x[p : p + block]] @ v[y[q : q + block]].T
                        i, j = np.divmod(np.flatnonzero(cosines >= threshold - 1e-6), cosines.shape[1])
                        if same and p == q:
                            i, j = i[i < j], j[i < j]
                        found.append((x[p + i], y[q + j], cosines[i, j]))
        i, j, cosine = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.table({"x": keys.take(pa.array(i)), "y": keys.take(pa.array(j)), "cosine": pa.array(cosine)})

    kind = unit.schema["k"].dataType.simpleString()
    met = _dealt(written(_cells(unit, pivots)), gaps, reach, block, held_bytes).groupBy("dim", "a", "b", "s", "r").applyInArrow(meet, f"x {kind}, y {kind}, cosine double")
    met = met.select(F.least("x", "y").alias("key_l"), F.greatest("x", "y").alias("key_r"), F.round("cosine", 6).alias("cosine"))
    return met.filter((F.col("key_l") < F.col("key_r")) & (F.col("cosine") >= threshold))


def _dealt(placed: DataFrame, gaps: dict[tuple[int, int], float], reach: float, block: int, held_bytes: int) -> DataFrame:
    """dim, a, b, s, r (groups of cells that meet and their parts), k, v, cell, angle, left: each vector once for every part that it meets."""
    w = Window.partitionBy("dim")  # some cells a dimension
    cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min("near")))).alias("angle"))
    held = F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(float(block)), F.sum("n").over(w) / PARTS), F.lit(held_bytes) / (8 * F.greatest("dim", F.lit(1)))))
    cells = cells.withColumn("held", held).withColumn("blocks", F.ceil(F.col("n") / F.col("held")).cast("int"))
    small = F.when(F.col("blocks") == 1, F.col("n")).otherwise(0)
    before = F.sum(small).over(w.orderBy("cell")) - small
    cells = written(cells.withColumn("of", F.when(F.col("blocks") == 1, F.floor(before / F.col("held"))).otherwise(-2 - F.col("cell")).cast("int")).drop("held"))
    apart = [(i, j, gap) for (i, j), gap in gaps.items()]
    gap = placed.sparkSession.createDataFrame(apart or [(0, 0, 0.0)], "cell_a int, cell_b int, gap double")  # CELLS squared rows at most
    side = lambda n: cells.select("dim", F.col("cell").alias(f"cell_{n}"), F.col("of").alias(n), F.col("blocks").alias(f"n_{n}"), F.col("angle").alias(f"angle_{n}"))
    pairs = side("a").join(side("b"), "dim").filter("a <= b").join(gap, ["cell_a", "cell_b"], "left").filter(F.coalesce("gap", F.lit(0.0)) <= F.col("angle_a") + F.col("angle_b") + reach)
    pairs = F.broadcast(pairs.select("dim", "a", "b", "n_a", "n_b").distinct())
    rows = placed.drop("near").join(F.broadcast(cells.select("dim", "cell", "of", "blocks", "angle")), ["dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("k", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    out = ["dim", "a", "b", "s", "r", "k", "v", "cell", "angle", "left"]
    first = rows.withColumnRenamed("of", "a").join(pairs, ["dim", "a"]).withColumn("s", F.col("own")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1))).filter("a < b or s <= r").withColumn("left", F.lit(True))
    second = rows.withColumnRenamed("of", "b").join(pairs, ["dim", "b"]).withColumn("r", F.col("own")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).filter("a < b or s < r").withColumn("left", F.lit(False))
    return first.select(*out).unionByName(second.select(*out))


def measures(l: str = "l", r: str = "r") -> dict[str, Column]:
    """Likeness of two joined nodes, each a struct column with the node's arrays, name and vector."""
    of = lambda side, c: F.col(f"{side}.{c}")
    a, b = of(l, "name"), of(r, "name")
    phrases = lambda side: F.filter(of(side, "keyword_tokens"), lambda t: t.contains(" "))
    return {
        "token_jaccard": arrays.jaccard(of(l, "tokens"), of(r, "tokens")),
        "keyword_jaccard": arrays.jaccard(of(l, "keyword_tokens"), of(r, "keyword_tokens")),
        "name_dice": arrays.dice(of(l, "name_tokens"), of(r, "name_tokens")),
        "shared": F.size(F.array_intersect(of(l, "tokens"), of(r, "tokens"))),
        "contains": (F.length(a) >= 6) & (F.length(b) >= 6) & (a.contains(b) | b.contains(a)),
        "primary": F.coalesce(of(l, "primary") == of(r, "primary"), F.lit(False)),
        "phrase": arrays.overlaps(phrases(l), phrases(r)),
    }


def similarity(pairs: DataFrame) -> DataFrame:
    """Adds `score`, 0 to 1, to pairs with the measures."""
    raw = 0.45 * F.col("token_jaccard") + 0.35 * F.col("keyword_jaccard") + 0.2 * F.col("name_dice")
    for flag, bonus in (("contains", 0.2), ("primary", 0.18), ("phrase", 0.15)):
        raw = raw + F.when(F.col(flag), bonus).otherwise(0.0)
    weak = (F.col("shared") < 2) & ~F.col("phrase") & ~F.col("contains") & ~F.col("primary")
    return pairs.withColumn("score", F.round(F.least(F.lit(1.0), raw * F.when(weak, 0.4).otherwise(1.0)), 4))


def accepted(t: float = 0.24, auto: float = 0.82, assist: float = 0.70) -> Column:
    """Whether a scored pair is one issue: any rule of evidence with its own share of the threshold will do.  Fixed values."""
    c = F.col
    at = lambda floor, share: c("score") >= max(floor, t * share)
    rules = [
        c("cosine") >= auto,
        (c("cosine") >= assist) & (c("score") + 0.15 >= t),
        (c("shared") >= 3) & at(0.18, 0.7),
        c("contains") & at(0.22, 0.75),
        c("primary") & at(0.2, 0.65),
        c("phrase") & ((c("keyword_jaccard") >= 0.13) | (c("token_jaccard") >= 0.16)) & at(0.18, 0.7),
        (c("shared") >= 1) & (c("keyword_jaccard") >= 0.11) & at(0.17, 0.68),
        (c("name_dice") >= 0.36) & (c("token_jaccard") >= 0.09) & at(0.16, 0.62),
        ((c("shared") >= 1) | c("phrase") | (c("name_dice") >= 0.3) | c("contains") | c("primary")) & (c("score") >= t),
    ]
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule, F.lit(False))
    return out


def similar_pairs(nodes: DataFrame, threshold: float = 0.24, auto: float = 0.82, assist: float = 0.70, within: Sequence[str] = ()) -> DataFrame:
    """key_l < key_r with their measures, cosine and score: pairs of nodes of different blocks that are one issue.

    nodes: key, block, name, primary, name_tokens, keyword_tokens, tokens, vector, and the columns `within`, in
    which pairs agree.  Every rule but those on
    vectors and on names that contain one another needs a common token, and names share tokens with the
    names they contain, but for parts of words; vectors bring their own candidates.
    """
    by_token = token_pairs(nodes, nodes, "key", "tokens", within).filter("key_l < key_r").select("key_l", "key_r")
    by_vector = near_vectors(nodes, "key", "vector", assist)
    both = by_token.join(by_vector, ["key_l", "key_r"], "full_outer")
    side = lambda k, name: nodes.select(F.col("key").alias(k), F.struct(*[c for c in nodes.columns if c not in ("key", "vector")]).alias(name))
    x = both.join(side("key_l", "l"), "key_l").join(side("key_r", "r"), "key_r").filter("l.block <> r.block")
    for c in within:
        x = x.filter(F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")))
    x = x.select("key_l", "key_r", "cosine", *(m.alias(n) for n, m in measures().items()))
    return similarity(x).filter(accepted(threshold, auto, assist))


def issues(nodes: DataFrame, pairs: DataFrame, blocks: int = 2) -> DataFrame:
    """key, component of the groups of similar nodes that span so many blocks."""
    members = connected(pairs.select(F.col("key_l").alias("a"), F.col("key_r").alias("b"))).select(F.col("node").alias("key"), "component")
    wide = members.join(nodes.select("key", "block"), "key").groupBy("component").agg(F.countDistinct("block").alias("n")).filter(F.col("n") >= blocks)
    return members.join(wide.select("component"), "component", "left_semi").select("key", "component")


def representative_score(heat: Column, name: Column, generic: Column, posts: Column) -> Column:
    """Which topic names its group: heat, phrases, names that say something, lengths 6 to 28, posts.  Fixed values."""
    return heat + F.when(name.contains(" "), 420).otherwise(0) + F.when(generic, -260).otherwise(240) + F.when(F.length(name).between(6, 28), 80).otherwise(0) + F.least(F.lit(80), 4 * posts)


def overlap_pairs(community: DataFrame, news: DataFrame, cosine: float = 0.82, tie: int = 10) -> DataFrame:
    """block, key_l, key_r, cosine, lag_minutes, leader, score of the pairs of one block that are the same issue.

    Sides: key, block, canonical, name_tokens, keyword_tokens, entity_tokens, phrases, vector, first_at.
    Every rule asks for a shared token or phrase, so the join on tokens loses nothing.
    """
    tokens = F.array_distinct(F.concat("name_tokens", "keyword_tokens", "entity_tokens"))
    a, b = community.withColumn("tokens", tokens), news.withColumn("tokens", tokens)
    met = token_pairs(a, b, "key", "tokens", ["block"])
    side = lambda d, k, name: d.select(F.col("key").alias(k), F.struct(*[c for c in d.columns if c not in ("key", "block", "tokens")]).alias(name))
    x = met.join(side(a, "key_l", "l"), "key_l").join(side(b, "key_r", "r"), "key_r")
    common = lambda c: F.size(F.array_intersect(f"l.{c}", f"r.{c}"))
    x = x.withColumns({"name_n": common("name_tokens"), "keyword_n": common("keyword_tokens"), "entity_n": common("entity_tokens"), "phrase": arrays.overlaps(F.col("l.phrases"), F.col("r.phrases")), "same": F.coalesce(F.col("l.canonical") == F.col("r.canonical"), F.lit(False)), "cosine": F.coalesce(arrays.cosine(F.col("l.vector"), F.col("r.vector")), F.lit(0.0)), "lag_minutes": F.coalesce(scoring.lag_minutes(F.col("l.first_at"), F.col("r.first_at")), F.lit(0).cast("long"))})
    c = F.col
    support = (c("keyword_n") >= 1) | (c("entity_n") >= 1) | c("phrase")
    is_one = (c("same") & ((c("name_n") >= 1) | (c("keyword_n") >= 1))) | ((c("name_n") >= 2) & (support | (c("cosine") >= cosine))) | (c("entity_n") >= 1) | c("phrase")
    lexical = scoring.lexical_score(c("shared"), c("name_n"), c("entity_n"), arrays.jaccard(c("l.keyword_tokens"), c("r.keyword_tokens")), c("phrase").cast("int"))
    x = x.filter(is_one).withColumn("score", F.round(c("cosine") + 0.35 * lexical + F.when(c("same"), 0.2).otherwise(0.0), 6))
    return x.select("block", "key_l", "key_r", F.coalesce("l.canonical", "r.canonical").alias("canonical"), "cosine", "lag_minutes", F.abs("lag_minutes").alias("distance"), scoring.leader(c("lag_minutes"), tie).alias("leader"), "score")


def bag_pairs(left: DataFrame, right: DataFrame, key: str, words: str, threshold: float, block: tuple[str, ...] = ()) -> DataFrame:
    """key_l, key_r, cosine of the bags of words of the two sides, of those not below the threshold.

    Words are put in order of rarity.  What follows a bag's head can't reach the threshold with any bag,
    so two bags of such a cosine have a word in common that is in both heads; only heads meet, and a
    word that many rows hold is in few of them.  The pairs that meet are measured on all their words.
    """

    def bag(d: DataFrame, k: str) -> DataFrame:
        n = d.select(*block, F.col(key).alias(k), F.explode(words).alias("_w")).groupBy(*block, k, "_w").agg(F.count(F.lit(1)).alias(f"{k}_n"))
        norm = n.groupBy(*block, k).agg(F.sqrt(F.sum(F.col(f"{k}_n") ** 2)).alias(f"{k}_norm"))
        return _checkpointed(n.join(norm, [*block, k]))

    l, r = bag(left, "key_l"), bag(right, "key_r")
    rarity = l.select(*block, "_w").unionByName(r.select(*block, "_w")).groupBy(*block, "_w").agg(F.count(F.lit(1)).alias("_df"))

    def head(d: DataFrame, k: str) -> DataFrame:
        commonest = Window.partitionBy(*block, k).orderBy(F.desc("_df"), F.desc("_w"))
        ranked = d.join(rarity, [*block, "_w"]).withColumn("_rest", F.sqrt(F.sum(F.col(f"{k}_n") ** 2).over(commonest)))
        return ranked.filter(F.col("_rest") >= (threshold - 1e-6) * F.col(f"{k}_norm")).select(*block, k, "_w")

    met = head(l, "key_l").join(head(r, "key_r"), [*block, "_w"]).select(*block, "key_l", "key_r").distinct()
    both = met.join(l, [*block, "key_l"]).join(r, [*block, "key_r", "_w"])
    dot = both.groupBy(*block, "key_l", "key_r").agg((F.sum(F.col("key_l_n") * F.col("key_r_n")) / (F.first("key_l_norm") * F.first("key_r_norm"))).alias("cosine"))
    return dot.withColumn("cosine", F.round("cosine", 6)).filter(F.col("cosine") >= threshold)
