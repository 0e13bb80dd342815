"""Mixing sources to target weights, with DataFrame operations only.

Targets are filled like water: every source's share by weight, none above `most` times its size.  A
source's texts are dealt into random blocks anew for every pass over it; blocks are exchangeable, so
taking them by number draws a random sample without replacement.  The last pass stops inside one
block, whose texts are taken while they fit what is left of the source's quota.  A splitting tree then halves the shards again
and again, each time drawing by the multivariate hypergeometric law how many of every source's drawn
blocks go left, until every shard has its disjoint run of block numbers.  Every copy goes to the shard
that holds its block and gets a random place there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise

WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: Texts in a block, and blocks in a group of blocks; windows run over at most about so many rows.
BLOCK, FAN = 512, 4096
#: Sources whose quotas one row splits; shards; runs of places that a shard is written in.
GROUP, SHARDS, SLICES = 1024, 16, 256


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_GAP)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("int")).cast("long")


def _unit(*key: Column | str) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """rank, weight, target for rows of (source, source_size, n_docs); sources by code point, null last.

    Sources are sorted by range and numbered within each range.  What full sources leave over is shared
    anew, round by round, until no further one is full; a round is one sum over the sources.
    """
    order = F.col("source").asc_nulls_last()
    s = materialise(sources.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before, sizes = 0, {}
    for r in sorted(s.groupBy("_range").count().collect()):  # one row a range
        sizes[r["_range"]], before = before, before + r["count"]
    first = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("_range")) if sizes else F.lit(0)
    s = s.withColumn("rank", (first + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1).cast("int"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = materialise(s.drop("_range").withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total, level, known = float(s.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= F.col("cap") if known >= 0 else F.lit(False)
        n, caps, open_ = s.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == known or open_ is None:
            break
        known, level = n, (total - (caps or 0.0)) / open_
    target = F.col("cap") if open_ is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return s.withColumn("target", target).drop("cap")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: Spark computes a column anew wherever a lambda names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(u: Column, total: Column, good: Column, picks: Column) -> Column:
    """How many of `good` among `total` are hit by `picks` draws without replacement, from a uniform u.

    Inverse of the hypergeometric law within 12 deviations of its mode: weights relative to the mode's
    come from the ratio of neighbouring terms, upwards from the mode and then downwards, and are summed
    in that order until u's share of them all is met.  Two walks over the window, nothing stored.
    """
    all_ = F.greatest(total, F.lit(1))
    low, high = F.greatest(F.lit(0), picks - (total - good)), F.least(good, picks)
    mode = F.least(high, F.greatest(low, F.floor((picks + 1.0) * (good + 1.0) / (total + 2.0)).cast("long")))
    reach = F.ceil(12.0 * F.sqrt(picks * (good / all_) * (1.0 - good / all_) * ((total - picks) / F.greatest(total - 1.0, F.lit(1.0)))) + 3.0).cast("long")
    known = F.struct(*(c.cast("long").alias(n) for n, c in {"good": good, "picks": picks, "bad": total - good, "mode": mode, "a": F.greatest(low, mode - reach), "b": F.least(high, mode + reach)}.items()), u.alias("u"))

    def walk(v: Column, goal: Column | None) -> Column:
        def step(s: Column, x: Column) -> Column:
            up = (v["good"] - x + 1.0) * (v["picks"] - x + 1.0) / (x * (v["bad"] - v["picks"] + x))
            down = (x + 1.0) * (v["bad"] - v["picks"] + x + 1.0) / ((v["good"] - x) * (v["picks"] - x))
            w = F.when(x == v["mode"], F.lit(1.0)).when(x > v["mode"], s["w"] * up).when(x == v["mode"] - 1, down).otherwise(s["w"] * down)
            met = F.lit(None).cast("long") if goal is None else F.coalesce(s["met"], F.when(s["sum"] + w >= goal, x))
            return _let(F.struct(w.alias("w"), met.alias("met")), lambda n: F.struct(n["w"].alias("w"), (s["sum"] + n["w"]).alias("sum"), n["met"].alias("met")))

        none = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("met"))
        below = F.when(v["mode"] > v["a"], F.sequence(v["mode"] - 1, v["a"], F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(F.concat(F.sequence(v["mode"], v["b"], F.lit(1).cast("long")), below), none, step)

    found = lambda v: F.when(v["a"] >= v["b"], v["a"]).otherwise(_let(walk(v, None)["sum"] * v["u"], lambda goal: F.coalesce(walk(v, goal)["met"], v["mode"])))
    return _let(known, found)


def split_quotas(quotas: DataFrame, shards: int, seed: int, group: int = GROUP) -> DataFrame:
    """shard, rank, first, blocks: the run of drawn blocks of every source that each shard holds.

    quotas: one row a source (rank, blocks).  shards: a power of two.  The tree's state is one row a node
    and source.  Sources are summed in groups of `group`, these again, until one group is left; a node's
    draws then go down from sums to sources, so no row holds more than `group` of them.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.select(F.lit(0).cast("long").alias("node"), F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("first"), F.col("blocks").cast("long").alias("blocks"))
    most, levels = quotas.agg(F.max("rank")).first()[0] or 0, 1
    while group**levels <= most:
        levels += 1
    width = shards
    while width > 1:
        sums = [node.withColumnRenamed("rank", "at")]
        for _ in range(levels - 1):
            sums.append(sums[-1].groupBy("node", F.floor(F.col("at") / group).alias("at")).agg(F.min("first").alias("first"), F.sum("blocks").alias("blocks")))
        picks = None
        for level in reversed(range(levels)):
            parts = sums[level].groupBy("node", F.floor(F.col("at") / group).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "first", "blocks"))).alias("parts"))
            parts = parts.withColumn("total", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["blocks"]))
            odd = F.pmod(F.col("total"), F.lit(2)) * F.pmod(F.xxhash64(F.lit(seed), F.lit(width), F.col("node")), F.lit(2))
            parts = parts.withColumn("picks", F.expr("total div 2") + odd) if picks is None else parts.join(picks, ["node", "up"])
            start = F.struct(F.col("total").alias("left"), F.col("picks").alias("picks"), F.array().cast("array<bigint>").alias("taken"))

            def deal(s: Column, p: Column) -> Column:  # called within this round
                x = _draw(_unit(F.lit(seed), F.lit(width), F.lit(level), F.col("node"), p["at"]), s["left"], p["blocks"], s["picks"])
                return _let(x, lambda x: F.struct((s["left"] - p["blocks"]).alias("left"), (s["picks"] - x).alias("picks"), F.array_append(s["taken"], x).alias("taken")))

            dealt = parts.withColumn("taken", F.aggregate("parts", start, deal)["taken"])
            dealt = dealt.select("node", F.inline(F.zip_with("parts", "taken", lambda p, x: F.struct(p["at"].alias("at"), p["first"].alias("first"), p["blocks"].alias("blocks"), x.alias("taken")))))
            picks = dealt.select("node", F.col("at").alias("up"), F.col("taken").alias("picks"))
        half = lambda n, first, blocks: F.struct((F.col("node") * 2 + n).alias("node"), F.col("at").alias("rank"), first.alias("first"), blocks.alias("blocks"))
        node = dealt.select(F.inline(F.array(half(0, F.col("first"), F.col("taken")), half(1, F.col("first") + F.col("taken"), F.col("blocks") - F.col("taken")))))
        node = materialise(node) if levels > 1 else node
        width //= 2
    return node.select(F.col("node").cast("int").alias("shard"), "rank", "first", "blocks")


def plan(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(texts with their sizes and source's plan, plan of each source)."""
    sized = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, most)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    sources = sources.withColumn("passes", F.least(F.lit(most), F.floor(ratio)).cast("int")).withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    sources = materialise(sources)
    texts = _with_source(sized, sources).withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed), F.col("passes"))).withColumn("block", _block(seed, F.col("passes")))
    # Where the last pass stops: the block, by sums over blocks within groups of blocks, then the text in it.
    blocks = texts.groupBy("rank", "rest", "block").agg(F.sum("size").alias("words")).withColumn("many", F.floor(F.col("block") / FAN))
    many = blocks.groupBy("rank", "rest", "many").agg(F.sum("words").alias("words"))
    many = many.withColumn("before", F.sum("words").over(Window.partitionBy("rank").orderBy("many")) - F.col("words"))
    many = many.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("rank", "many", "before")
    stop = blocks.join(many, ["rank", "many"])
    stop = stop.withColumn("before", F.col("before") + F.sum("words").over(Window.partitionBy("rank").orderBy("block")) - F.col("words"))
    stop = stop.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select(F.col("rank"), F.col("block").alias("stop"), "before")
    inside = texts.join(stop.withColumn("block", F.col("stop")), ["rank", "block"])
    inside = inside.groupBy("rank", "stop").agg(F.array_sort(F.collect_list(F.struct("key", "size"))).alias("texts"), F.max(F.col("rest") - F.col("before")).alias("room"))
    ends = inside.withColumn("f", _fill(F.col("texts"), F.col("room"))).select("rank", "stop", F.col("f.last").alias("last_key"), F.when(F.col("f.miss.size") < 2 * F.col("f.room"), F.array_append("f.more", F.col("f.miss.key"))).otherwise(F.col("f.more")).alias("more"))
    sources = materialise(sources.join(ends, "rank", "left"))
    return sized, sources


def _fill(texts: Column, room: Column) -> Column:
    """Which of a block's texts (key, size), in their order, fill the room: all up to the key `last`, then
    those in `more` that still fit after the first that didn't; `miss` is the smallest left out."""
    none = F.struct(room.cast("double").alias("room"), F.lit(None).cast("long").alias("last"), F.lit(True).alias("open"), F.array().cast("array<bigint>").alias("more"), F.lit(None).cast("struct<size:bigint,key:bigint>").alias("miss"))

    def step(s: Column, x: Column) -> Column:
        fits, this = x["size"] <= s["room"], F.struct(x["size"].alias("size"), x["key"].alias("key"))
        return F.struct(
            F.when(fits, s["room"] - x["size"]).otherwise(s["room"]).alias("room"),
            F.when(fits & s["open"], x["key"]).otherwise(s["last"]).alias("last"),
            (s["open"] & fits).alias("open"),
            F.when(fits & ~s["open"] & (x["size"] > 0), F.array_append(s["more"], x["key"])).otherwise(s["more"]).alias("more"),
            F.when(fits, s["miss"]).otherwise(F.least(F.coalesce(s["miss"], this), this)).alias("miss"),
        )

    return F.aggregate(texts, none, step)


def _block(seed: int, number: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1), number), F.greatest(F.col("n_blocks"), F.lit(1)))


def _with_source(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The plan of its source beside every text: broadcast while the sources are few, else a join that AQE may split."""
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if sources.count() <= 10_000 else side
    return sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _copies(texts: DataFrame, seed: int) -> DataFrame:
    """How often each text is taken: once a full pass, and once more if the last pass reaches it."""
    block = _block(seed, F.col("passes"))
    key = F.xxhash64("doc_id", "size", F.lit(seed), F.col("passes"))
    more = F.col("stop").isNotNull() & ((block < F.col("stop")) | ((block == F.col("stop")) & (F.coalesce(key <= F.col("last_key"), F.lit(False)) | F.coalesce(F.array_contains("more", key), F.lit(False)))))
    return texts.withColumn("copies", F.col("passes") + more.cast("int"))


def _dealt(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds `ends` to sources: by shard, the number of the first drawn block after the shard's run."""
    drawn = sources.select("rank", (F.col("passes") * F.col("n_blocks") + F.coalesce(F.col("stop") + 1, F.lit(0))).alias("blocks"))
    ends = split_quotas(drawn, shards, seed).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", (F.col("first") + F.col("blocks")).alias("end")))).alias("ends"))
    return materialise(sources.join(ends.select("rank", F.col("ends.end").alias("ends")), "rank"))


def _placed(texts: DataFrame, seed: int) -> DataFrame:
    """Adds `placed`, (number, shard, place) of every copy: the shard whose run holds the copy's block, and a random place in it."""

    def put(number: Column) -> Column:
        at = number * F.col("n_blocks") + _block(seed, number)
        shard = F.when(at < F.element_at("ends", -1), F.size(F.filter("ends", lambda e: e <= at)))
        return F.struct(number.alias("number"), shard.alias("shard"), F.xxhash64(F.lit(seed), "doc_id", "size", number).alias("place"))

    none = F.array().cast("array<struct<number:int,shard:int,place:bigint>>")
    return texts.withColumn("placed", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), put)).otherwise(none))


def placed_mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words of the placed copies), placed for every row.

    Null and empty texts have size 0; a null source is a source of its own and comes last; sources of
    size 0 have target 0.  Whole texts are taken, so a source's taken words lie within one text of its
    target.  Equal rows share their fate; null ids are ids like others; an empty table gives no rows.
    """
    sized, sources = plan(docs, seed, weights, most, id_col, text_col, source_col)
    texts = _placed(_copies(_with_source(sized, _dealt(sources, shards, seed)), seed), seed)
    taken = F.aggregate("placed", F.lit(0).cast("long"), lambda s, p: s + F.when(p["shard"].isNotNull(), F.col("size")).otherwise(F.lit(0).cast("long")))
    return texts.select("doc_id", "source", "size", "source_size", "target", "copies", taken.alias("taken"), "placed")


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """placed_mix without the places."""
    return placed_mix(docs, SHARDS, seed, weights, most, id_col, text_col, source_col).drop("placed")


def shard_mix(docs: DataFrame, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, number (of the copy), shard, place for every taken copy; `place` orders a shard.

    The shards hold disjoint runs of every source's permuted blocks.
    """
    return placed_mix(docs, shards, seed, weights, most, id_col, text_col, source_col).select("doc_id", "source", "size", F.inline("placed")).select("doc_id", "source", "size", "number", "shard", "place")


def take(docs: DataFrame, shards: int = SHARDS, seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row with all its columns, shard and place, as often as it is taken, shuffled within its shard.

    A shard lies in SLICES runs of places, each whole and in order in one partition.  Where docs has
    columns of these names the new ones are called _shard and _place, with as many underscores as it takes.
    """
    _, sources = plan(docs, seed, weights, most, id_col, text_col, source_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    taken = _placed(_copies(_with_source(rows, _dealt(sources, shards, seed)), seed), seed).select("_row", F.inline("placed"))
    piece = F.shiftright("place", 64 - (SLICES - 1).bit_length())
    names = {c: c for c in ("shard", "place")}
    for c in names:
        while names[c].lower() in map(str.lower, docs.columns):
            names[c] = "_" + names[c]
    return taken.repartition("shard", piece).sortWithinPartitions("shard", "place").select("_row.*", *(F.col(c).alias(n) for c, n in names.items()))
