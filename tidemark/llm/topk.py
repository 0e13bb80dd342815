"""Exact top-k by inner product with a KD-tree for each shard of the candidates.

Candidates are dealt into shards; each shard becomes one row that holds its KD-tree: median splits on
the widest dimension and a tight bounding box for every node.  Queries travel in blocks.  A block meets
one shard first, whose kth scores it then takes along to all lanes of shards; within a lane the kth score
goes on rising from shard to shard.  In every shard each query keeps its open nodes with their
box-to-query bounds, opens the best one again and again, and stops when no bound reaches its kth score.
The best of all lanes are then merged by Spark.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialise
from .words import distinct

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS, LANE_SHARDS = 8192, 4096, 256, 16
TREE = "shard int, dim int, ids binary, vectors binary, nodes binary, low binary, high binary"
ASKED = "block int, dim int, query_ids binary, copies binary, queries binary"
#: One of the best of a query: the query is `slot` of its block.
FOUND = "block int, dim int, slot int, query_id long, copies long, own long, vec_id long, score long"


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component taken as double; null if the vector, a component or its value is null or not finite."""
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    # A cast or floor of NaN and infinities gives numbers, so these are asked about first.
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & fine, x)


def build_tree(vectors: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row order, nodes): halves at the median of the widest dimension until leaves are small.  A node is
    (first row, end row, left child, right child), children -1 in leaves; the root is node 0."""
    order, nodes, stack = np.arange(len(vectors)), [], [(0, len(vectors), -1, 0)]
    while stack:
        a, b, parent, side = stack.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([a, b, -1, -1])
        if b - a > leaf_rows:
            part = vectors[order[a:b]]
            d, m = int(np.argmax(part.max(0) - part.min(0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, d], m)]
            here = len(nodes) - 1
            stack += [(a + m, b, here, 1), (a, a + m, here, 0)]
    return order, np.array(nodes, dtype=np.int64).reshape(-1, 4)


NONE = np.iinfo(np.int64).min


def pack_ints(x: np.ndarray) -> bytes:
    """A leading byte that names the width, then the numbers in the narrowest of 2, 4 or 8 bytes."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpack_ints(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).reshape(-1, dim).astype(np.int64)


def search(queries: np.ndarray, tree: dict, k: int, best: tuple[np.ndarray, np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best (scores, ids) of every query after this shard; unfilled places have the score NONE.

    Best first: each query opens the node with the highest bound among its open ones; queries that open
    the same node do so together.  A query is done when no bound reaches its kth score or `least`, a
    score that k others are known to reach; ties are met too.
    """
    ids, nodes = np.frombuffer(tree["ids"], dtype=np.int64), np.frombuffer(tree["nodes"], dtype=np.int64).reshape(-1, 4)
    vectors, low, high = (unpack_ints(tree[x], tree["dim"]) for x in ("vectors", "low", "high"))
    most = float(tree["dim"]) * float(np.abs(queries).max(initial=1)) * float(max(np.abs(low).max(initial=1), np.abs(high).max(initial=1)))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # sums stay exact
    q, vectors, low, high = (x.astype(kind) for x in (queries, vectors, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    closed = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    bound = np.full((len(q), len(nodes)), closed, dtype=kind)
    bound[:, 0] = up @ high[0] + down @ low[0]
    scores, found = (x.copy() for x in best)
    active = np.arange(len(q))
    while len(active):
        node = bound[active].argmax(1)
        top = bound[active, node]
        kth = np.maximum(scores[active, -1], least[active])
        alive = (top > closed) & ((kth == NONE) | (top >= kth))
        active, node = active[alive], node[alive]
        bound[active, node] = closed
        for x in distinct(node):
            rows, (a, b, left, right) = active[node == x], nodes[x]
            if left >= 0:
                for child in (left, right):
                    bound[rows, child] = up[rows] @ high[child] + down[rows] @ low[child]
                continue
            new = (q[rows] @ vectors[a:b].T).astype(np.int64)
            hit = (new >= np.maximum(scores[rows, -1:], least[rows, None])).any(1)
            rows, new = rows[hit], new[hit]
            if not len(rows):
                continue
            s = np.hstack([scores[rows], new])
            i = np.hstack([found[rows], np.broadcast_to(ids[a:b], new.shape)])
            top = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s rises, without overflow
            scores[rows], found[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    return scores, found


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row whose id is divisible by `every`.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id; vectors meet only those of their own length.  Ties go to the smaller id.  Rows are told apart
    even where they repeat an id: each is a query with a list of its own, ranked from 1, and a candidate for
    all others.  Fewer candidates give fewer rows; an empty table gives none.  Negative ids are allowed.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v"))
    n, wanted = rows.count(), k + 1  # a query's own row is among the candidates and taken out at the end
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * BLOCK_ROWS)), min(cores, -(-n // (every * LEAF_ROWS))))
    lanes = -(-shards // LANE_SHARDS)

    def plant(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        ids = table.column("id").to_numpy()
        x = np.array(table.column("v").combine_chunks().values.to_numpy(zero_copy_only=False), dtype=np.int64).reshape(-1, dim)
        order, nodes = build_tree(x, LEAF_ROWS)
        x = x[order]
        boxes = [np.array([f(x[a:b], axis=0) for a, b in nodes[:, :2]]) for f in (np.min, np.max)]
        blobs = [ids[order].tobytes(), pack_ints(x), nodes.tobytes(), *map(pack_ints, boxes)]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), **{name: pa.array([b], pa.binary()) for name, b in zip(("ids", "vectors", "nodes", "low", "high"), blobs, strict=True)}})

    def gather(table: pa.Table) -> pa.Table:
        dim, ids, copies = table.column("dim")[0].as_py(), table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = np.array(table.column("v").combine_chunks().values.to_numpy(zero_copy_only=False), dtype=np.int64)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), **{c: pa.array([b], pa.binary()) for c, b in (("query_ids", ids.tobytes()), ("copies", copies.tobytes()), ("queries", pack_ints(x)))}})

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best in the right side's trees of the left side's queries, but for trees that `seen` tells were met before."""
        out: dict[str, list] = {c: [] for c in ("block", "dim", "slot", "query_id", "copies", "own", "vec_id", "score")}
        trees = right.to_pylist()
        for b in left.to_pylist() if trees else ():
            ids, copies = (np.frombuffer(b[c], dtype=np.int64) for c in ("query_ids", "copies"))
            q = unpack_ints(b["queries"], b["dim"])
            least = np.frombuffer(b["least"], dtype=np.int64) if b.get("least") else np.full(len(q), NONE)
            best = np.full((len(q), wanted), NONE, dtype=np.int64), np.zeros((len(q), wanted), dtype=np.int64)
            for t in trees:
                if t["shard"] != b.get("seen", -1):
                    best = search(q, t, wanted, best, least)
            keep = best[0] != NONE
            slot, many = np.repeat(np.arange(len(q)), keep.sum(1)), int(keep.sum())
            for c, x in (("block", np.full(many, b["block"])), ("dim", np.full(many, b["dim"])), ("slot", slot), ("query_id", ids[slot]), ("copies", copies[slot]), ("own", (q * q).sum(1)[slot]), ("vec_id", best[1][keep]), ("score", best[0][keep])):
                out[c].append(x)
        kinds = [pa.int32()] * 3 + [pa.int64()] * 5
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]), t) for (c, x), t in zip(out.items(), kinds, strict=True)})

    def floors(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block of queries with the shard it met first and the kth score of each query there."""
        got = visit(left, right)
        b = left.to_pylist()[0]
        least = np.full(len(b["query_ids"]) // 8, NONE)
        slot, score = got.column("slot").to_numpy(), got.column("score").to_numpy()
        full = np.flatnonzero(np.bincount(slot, minlength=len(least)) == wanted)
        low = np.full(len(least), np.iinfo(np.int64).max)
        np.minimum.at(low, slot, score)
        least[full] = low[full]
        return left.append_column("seen", pa.array([right.column("shard")[0].as_py() if len(right) else -1], pa.int32())).append_column("least", pa.array([least.tobytes()], pa.binary()))

    # Any deal of rows into shards gives the same results; this one is even whatever ids and vectors repeat.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    trees = rows.withColumn("shard", shard).groupBy("shard", "dim").applyInArrow(plant, TREE)
    asked = rows.filter(F.col("id") % every == 0).groupBy("id", "v", "dim").agg(F.count(F.lit(1)).alias("copies"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).groupBy("block", "dim").applyInArrow(gather, ASKED)
    if lanes > 1:
        trees, asked = materialise(trees), materialise(asked)
        home = asked.select(F.pmod("block", F.lit(shards)).alias("shard"), F.col("dim").alias("dim"), F.col("block").alias("block"))
        firsts = trees.join(home, ["shard", "dim"])
        met = [asked.groupBy("block", "dim").cogroup(firsts.groupBy("block", "dim")).applyInArrow(visit, FOUND)]
        asked = materialise(asked.groupBy("block", "dim").cogroup(firsts.groupBy("block", "dim")).applyInArrow(lambda a, b: floors(a, b) if len(a) else a.append_column("seen", pa.array([], pa.int32())).append_column("least", pa.array([], pa.binary())), ASKED + ", seen int, least binary"))
    else:
        met = []
    # A task holds one block of queries and one lane of shards, whatever the table's size.
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    trees = trees.withColumn("lane", F.floor(F.col("shard") / LANE_SHARDS).cast("int")).withColumn("block", each(blocks))
    met.append(asked.withColumn("lane", each(lanes)).groupBy("lane", "block", "dim").cogroup(trees.groupBy("lane", "block", "dim")).applyInArrow(visit, FOUND))
    # Among a query's best, one row of its own id and of its own vector's score is, or may stand for, itself.
    query = Window.partitionBy("block", "dim", "slot").orderBy(F.col("score").desc(), "vec_id")
    best = reduce(DataFrame.unionByName, met).withColumn("r", F.row_number().over(query)).filter(F.col("r") <= wanted)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("r"))).over(Window.partitionBy("block", "dim", "slot"))
    best = best.withColumn("itself", F.coalesce(own, F.lit(wanted))).filter("r <> itself")
    rank = (F.col("r") - (F.col("r") > F.col("itself")).cast("int")).cast("int").alias("rank")
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", rank, "vec_id", "score")
