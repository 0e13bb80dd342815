"""Connected components of a similarity graph by contraction in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") and not context.getConf().get("spark.checkpoint.dir"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (least node) for the edges (a, b), by contraction in rounds.

    Each round every node moves to the neighbour, or stays, that comes first in an order drawn anew; edges then join
    what their ends moved to, and those within one node go.  The graph shrinks by a constant share a round whatever
    its shape, so all rounds together move a small multiple of the edges.  The moves are then followed back.
    """
    rest = edges.select("a", "b").dropna()
    rest = written(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone = rest.filter("a = b").select(F.col("a").alias("node"))
    rest, moves = rest.filter("a <> b"), []
    while not rest.isEmpty():
        drawn = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("v"))
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        first = ends.groupBy("node").agg(F.min(drawn("other")).alias("first"))
        move = written(first.select("node", F.least("first", drawn("node"))["v"].alias("to")))
        moves.append(move)
        x = rest.join(move.toDF("a", "c"), "a").join(move.toDF("b", "d"), "b").filter("c <> d")
        rest = written(x.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
    if not moves:
        return alone.select("node", F.col("node").alias("component"))
    root = moves.pop()
    for move in reversed(moves):
        root = written(move.join(root.toDF("to", "top"), "to", "left").select("node", F.coalesce("top", "to").alias("to")))
    least = root.groupBy("to").agg(F.min("node").alias("component"))
    labels = root.join(least, "to").select("node", "component")
    alone = alone.join(root.select("node"), "node", "left_anti")
    return labels.union(alone.select("node", F.col("node").alias("component")))
