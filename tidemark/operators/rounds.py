"""Greedy choices, made one after the other by definition, in parallel rounds with the same outcome.

In each round everything is decided that no undecided predecessor can still change.  A round costs a few
shuffles of what is left, which is written and read again; the number of rounds is the longest chain of choices that
depend on one another, not the number of rows, and no block is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import spread_join
from .store import written


def first_stays(holds: DataFrame, looks: DataFrame, rank: str = "rank") -> DataFrame:
    """key of every row that stays when rows are taken by `rank` and one goes if it sees a row that stayed.

    holds (key, rank, token): the tokens by which a row is seen.  looks (key, rank, token): the tokens that a
    row looks at, its own among them.  Seeing has to be mutual: of two rows, each looks at a token of
    the other or neither does.  Every key has a row in both, and `rank` is unique and may be of any ordered type.
    A token may be held by any share of the rows.
    """
    holds, looks, stayed = written(holds.distinct()), written(looks.distinct()), None
    while True:
        heads = holds.groupBy("token").agg(F.min(rank).alias("_head"), F.count(F.lit(1)).alias("_n"))
        seen = spread_join(looks, heads, "token", "_n").groupBy("key").agg(F.max(F.coalesce(F.col("_head") < F.col(rank), F.lit(False))).alias("_behind"))
        won = written(seen.filter(~F.col("_behind")).select("key"))
        if won.isEmpty():
            return stayed if stayed is not None else won
        stayed = won if stayed is None else written(stayed.union(won))
        taken = holds.join(won, "key", "left_semi").select("token").distinct()
        gone = written(looks.join(taken, "token", "left_semi").select("key").union(won).distinct())
        holds, looks = (written(x.join(gone, "key", "left_anti")) for x in (holds, looks))


def dominant_pairs(pairs: DataFrame, block: str, left: str, right: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Greedy one-to-one matching in each block: best pair first, each side used once.

    order: numeric columns with True for ascending; nulls come last, ties go to the smaller ids.  A pair that
    is the best one of both its sides would be taken before anything that touches it, so in each round
    all such pairs are taken at once and those of their sides go.

    With each such pair goes a run of pairs that tie with it: the lefts whose best pair is one with its right, and the
    rights whose best one is with its left, are matched in order of their ids.  The run holds up to the first
    pair that isn't there, or one side of which has an equally good pair with a smaller id outside the run; of a
    pair before that, all that would come first is used up by the run, so it is what the loop would take.
    So rows that all tie with one another take one round, not one a row.
    """
    keys = [x for c, up in order for x in (F.col(c).isNull(), F.coalesce(F.col(c) if up else -F.col(c), F.lit(0)))]
    at = ["_block", "_l", "_r"]
    # In a struct, blocks that are null are equal.
    hidden = [F.struct(F.col(block).alias("b")).alias("_block"), F.col(left).alias("_l"), F.col(right).alias("_r"), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))).alias("_key")]
    rest, taken = written(pairs.select(*pairs.columns, *hidden)), None
    while True:
        runs = written(_tied_runs(rest))
        longest = runs.agg(F.max("_i")).first()[0]
        if not longest:
            return (taken if taken is not None else rest).select(*pairs.columns)
        won = rest.join(runs.withColumnRenamed("_key", "_best"), at)
        if longest > 1:
            gaps = runs.join(won.filter("_key = _best").select(*at), at, "left_anti").select("_block", "_head", "_i")
            stops = gaps.union(_outside(rest, runs, "_l", "_r")).union(_outside(rest, runs, "_r", "_l")).groupBy("_block", "_head").agg(F.min("_i").alias("_stop"))
            won = won.join(stops, ["_block", "_head"], "left").filter("_stop is null or _i < _stop")
        won = won.select(*rest.columns)
        taken = written(won if taken is None else taken.union(won))
        rest = rest.join(taken.select("_block", "_l"), ["_block", "_l"], "left_anti")
        rest = written(rest.join(taken.select("_block", "_r"), ["_block", "_r"], "left_anti").select(*taken.columns))


def _tied_runs(rest: DataFrame) -> DataFrame:
    """_block, _head, _i, _l, _r, _key: for each pair that is the best of both its sides, i = 1, what may go along with it."""
    a = rest.groupBy("_block", "_l").agg(F.min(F.struct("_key", "_r")).alias("_e")).select("_block", "_l", "_e.*")
    b = rest.groupBy("_block", "_r").agg(F.min(F.struct("_key", "_l")).alias("_e")).select("_block", "_r", "_e.*")
    # The best pair of a left's right, and of a right's left; only if that is one and the same pair do both sides meet.
    place = lambda c: F.row_number().over(Window.partitionBy("_block", "_head", "_mate").orderBy(c)).alias("_i")
    lefts = a.join(b.withColumnRenamed("_l", "_head"), ["_block", "_key", "_r"]).withColumn("_mate", F.col("_r")).select("_block", "_head", "_mate", place("_l"), "_l", "_key")
    rights = b.join(a.withColumnRenamed("_r", "_mate"), ["_block", "_key", "_l"]).withColumn("_head", F.col("_l")).select("_block", "_head", "_mate", place("_r"), "_r")
    return lefts.join(rights, ["_block", "_head", "_mate", "_i"]).select("_block", "_head", "_i", "_l", "_r", "_key")


def _outside(rest: DataFrame, runs: DataFrame, one: str, other: str) -> DataFrame:
    """_block, _head, _i of pairs whose side `one` ties with a smaller `other` that isn't of their run."""
    mine = runs.select("_block", one, F.col(other).alias("_mate"), F.col("_key").alias("_best"), "_head", "_i")
    before = rest.select("_block", one, other, "_key").join(mine, ["_block", one]).filter((F.col("_key") == F.col("_best")) & (F.col(other) < F.col("_mate")))
    return before.join(runs.select("_block", other, "_head"), ["_block", other, "_head"], "left_anti").select("_block", "_head", "_i")


def fold_groups(items: DataFrame, rank: str = "rank") -> DataFrame:
    """key, founder: the group that each item joins when items are taken by `rank`.

    items: key, rank (unique, of any ordered type), en, ko (names), en_key, ko_key (what they compare by), alias_en,
    alias_ko (an identity that a key stands for, if any), ids (array).  An item joins the first founded
    group whose identity equals its own or that holds one of its ids; with none it founds one.  A group keeps
    the longest names of its members (the first of equal length), and its identity follows from these.

    An item is decided once it is the first undecided one at each of its names, ids and groups that hold
    any of these.  Items that touch a single group, all of whose members bear their very names, don't wait
    for one another, so a name that many items bear takes two rounds.
    """
    token = lambda kind, c: F.concat(F.lit(kind), c)
    names = F.array(*(F.when(F.col(c) != "", token(k, F.col(c))) for k, c in (("n", "en_key"), ("n", "ko_key"), ("a", "alias_en"), ("a", "alias_ko"))))
    own = F.array_compact(F.concat(names, F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda i: token("i", i.cast("string")))))
    items = written(items.withColumn("identity", _identity("en_key", "ko_key", "alias_en", "alias_ko")).withColumn("_own", F.array_distinct(own)))
    keys = written(items.select("key", F.col(rank).alias("rank"), F.explode("_own").alias("token")))
    # Items without any name or id touch nothing: each is a group.
    done = written(items.filter(F.size("_own") == 0).select("key", F.col("key").alias("founder"), F.col(rank).alias("rank")))
    open_ = items.filter(F.size("_own") > 0).select("key", F.col(rank).alias("rank"), "identity", F.concat_ws("\u0001", F.coalesce("en_key", F.lit("")), F.coalesce("ko_key", F.lit(""))).alias("names"))
    open_ = written(open_)
    while not open_.isEmpty():
        mine = keys.join(open_.select("key"), "key", "left_semi")
        held = done.join(keys.drop("rank"), "key").groupBy("token").agg(F.collect_set("founder").alias("founders"))
        held = held.join(mine.groupBy("token").agg(F.count(F.lit(1)).alias("_n")), "token")
        groups = _group_names(done, items, rank)
        met = spread_join(mine, held, "token", "_n", "inner").select("key", "token", F.explode("founders").alias("founder"))
        touch = met.groupBy("key", "founder").agg(F.max(F.substring("token", 1, 1) == "i").alias("by_id")).join(groups, "founder").join(open_.drop("rank"), "key")
        touch = touch.withColumn("match", F.col("by_id") | (F.coalesce(F.col("identity") == F.col("group_identity"), F.lit(False)) & (F.col("identity") != "")))
        # simple: touches one group, and bears the very names that the group goes by.
        near = touch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("match"), F.struct("founded", "founder"))).alias("joins"), F.min("founder").alias("of"), F.min(F.col("match") & (F.col("names") == F.col("group_names")) & F.col("pure")).alias("like"))
        near = written(open_.join(near, "key", "left").select("key", "rank", F.col("joins.founder").alias("joins"), F.when((F.col("n") == 1) & F.col("like"), F.col("of")).alias("simple")))
        tokens = mine.select("key", "token").union(touch.select("key", token("g", F.col("founder").cast("string"))))
        tokens = written(tokens.join(near, "key"))
        # At each token: the first undecided item, and the first that isn't simple.
        at = tokens.groupBy("token").agg(F.min("rank").alias("_first"), F.min(F.when(F.col("simple").isNull(), F.col("rank"))).alias("_hard"), F.min("simple").alias("_lo"), F.max("simple").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        clean = F.coalesce((F.col("_lo") == F.col("_hi")) & (F.col("_hard").isNull() | (F.col("_hard") > F.col("rank"))), F.lit(False))
        of = spread_join(tokens, at, "token", "_n").groupBy("key", "rank", "simple").agg(F.min(F.col("rank") == F.col("_first")).alias("first"), F.min(clean).alias("clean"))
        # A simple item goes with all before it in its group, if nothing stands in the way of any of them.
        stop = of.filter("simple is not null").groupBy("simple").agg(F.min(F.when(~F.col("clean"), F.col("rank"))).alias("_stop"), F.count(F.lit(1)).alias("_n"))
        able = spread_join(of, stop, "simple", "_n").filter(F.col("first") | (F.col("simple").isNotNull() & F.col("clean") & (F.col("_stop").isNull() | (F.col("_stop") > F.col("rank"))))).select("key")
        new = near.join(able, "key").select("key", F.coalesce("joins", "key").alias("founder"), "rank")
        done = written(done.union(new))
        open_ = written(open_.join(done, "key", "left_anti"))
    return done.select("key", "founder")


def _identity(en: str, ko: str, alias_en: str, alias_ko: str) -> Column:
    return F.coalesce(alias_en, alias_ko, F.when(F.col(en) != "", F.col(en)), F.when(F.col(ko) != "", F.col(ko)), F.lit(""))


def _group_names(done: DataFrame, items: DataFrame, rank: str) -> DataFrame:
    """founder, founded (its rank), group_identity, group_names, pure (all members bear the same names)."""
    m = done.join(items.drop(rank), "key")
    first = lambda n, *cols: F.min_by(F.struct(*cols), F.struct((-F.length(F.coalesce(n, F.lit("")))).alias("long"), "rank"))
    both = F.concat_ws("\u0001", F.coalesce("en_key", F.lit("")), F.coalesce("ko_key", F.lit("")))
    g = m.groupBy("founder").agg(F.min("rank").alias("founded"), first("en", "en_key", "alias_en").alias("e"), first("ko", "ko_key", "alias_ko").alias("k"), F.min(both).alias("lo"), F.max(both).alias("hi"))
    g = g.select("founder", "founded", F.col("e.en_key").alias("en_key"), F.col("e.alias_en").alias("alias_en"), F.col("k.ko_key").alias("ko_key"), F.col("k.alias_ko").alias("alias_ko"), F.col("lo").alias("group_names"), (F.col("lo") == F.col("hi")).alias("pure"))
    return g.select("founder", "founded", _identity("en_key", "ko_key", "alias_en", "alias_ko").alias("group_identity"), "group_names", "pure")
