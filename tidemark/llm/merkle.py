"""A Merkle manifest of a dataset, with an authentication path for every row.

Rows are leaves of one tree a group (a source), whose roots are the leaves of a tree over the groups.
Every inner node hashes FANOUT consecutive ones.  A tree is cut into aligned blocks of
FANOUT ** BLOCK_LEVELS leaves, each the work of one stretch of one task: a block's root first, which is
a leaf of the tree above, and, once the paths of that tree are known by the same two steps, the
paths of its own leaves, to which the block's path is appended.

Within a block paths come by fractal traversal: its levels are split into layers of LAYER levels; every
layer keeps the subtree that the present leaf is in and builds, a leaf a round, the one that comes next.
So a block holds its leaves and two small subtrees a layer, never the paths of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runs import whole_runs
from .runtime import materialise, numbered, salted_join

FANOUT, BLOCK_LEVELS, LAYER = 3, 7, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left string, right string>>"


def node(children: list[bytes]) -> bytes:
    """The digest, as hex text, of digests as hex text."""
    return sha256(b"".join(children)).hexdigest().encode()


def height(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while leaves > 1:
        leaves, h = -(-leaves // FANOUT), h + 1
    return h


class Subtree:
    """Takes leaves in order and keeps the nodes of the heights [low, high) of the tree over them."""

    def __init__(self, low: int, high: int, first: int) -> None:
        self.low, self.high = low, high
        self.base = [first // FANOUT**k for k in range(high)]  # the index of the first node of each height
        self.kept: list[list[bytes]] = [[] for _ in range(high)]
        self.open: list[list[bytes]] = [[] for _ in range(high)]  # of each height the run that isn't complete
        self.top: bytes | None = None

    def take(self, digest: bytes, last: bool) -> None:
        """One more leaf; with the last one of the tree runs end early."""
        k = 0
        while k < self.high:
            if k >= self.low:
                self.kept[k].append(digest)
            run = self.open[k]
            run.append(digest)
            if len(run) < FANOUT and not last:
                return
            digest, self.open[k] = node(run), []
            k += 1
        self.top = digest

    def siblings(self, k: int, index: int) -> tuple[bytes, bytes]:
        """The nodes before, and those after, the node of a height in its run."""
        at = index - self.base[k]
        begin = at - index % FANOUT
        nodes = self.kept[k]
        return b"".join(nodes[begin:at]), b"".join(nodes[at + 1 : begin + FANOUT])


def block_root(leaves: list[bytes], levels: int) -> bytes:
    tree = Subtree(levels, levels, 0)
    for i, x in enumerate(leaves):
        tree.take(x, i == len(leaves) - 1)
    return tree.top


def paths(leaves: list[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """The authentication path of every leaf of a block in turn: what stands left and right at each level.

    The existing subtrees of all layers are built for the first leaf.  In round i each layer's desired
    subtree takes the leaf that lies one subtree ahead, so it is complete when the existing one is left.
    """
    end = len(leaves) - 1
    layers = [(low, min(low + LAYER, levels)) for low in range(0, levels, LAYER)]
    spans = [FANOUT**high for _, high in layers]

    def fresh(layer: int, first: int) -> Subtree:
        return Subtree(*layers[layer], first)

    existing = [fresh(j, 0) for j in range(len(layers))]
    for j, tree in enumerate(existing):
        for i in range(min(spans[j], end + 1)):
            tree.take(leaves[i], i == end)
    desired = [fresh(j, spans[j]) for j in range(len(layers))]
    for i in range(end + 1):
        path = []
        for j, (low, high) in enumerate(layers):
            if i and i % spans[j] == 0:
                existing[j], desired[j] = desired[j], fresh(j, i + spans[j])
            for k in range(low, high):
                path.append(existing[j].siblings(k, i // FANOUT**k))
            ahead = i + spans[j]
            if ahead <= end:
                desired[j].take(leaves[ahead], ahead == end)
        yield path


def _levels(leaves: int, block: int, most: int) -> int:
    """Levels of a block's tree: all of them where the group has more than this one block."""
    return most if block else height(leaves)


def _dealt(nodes: DataFrame) -> DataFrame:
    """One partition a block, its rows in order (a row of position -1, if there is one, first)."""
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, pos (the block's number), node: the root of every block of (grp, pos, node)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_runs(batches, 2):
            first, block = bounds[:-1], b.column(1).to_numpy()
            digests = [x.hex().encode() for x in b.column(2).to_pylist()]
            tops = [bytes.fromhex(block_root(digests[i:j], _levels(j - i, block[i], levels)).decode()) for i, j in zip(first.tolist(), bounds[1:].tolist(), strict=True)]
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(tops, pa.binary())], ["grp", "pos", "node"])

    blocks = _dealt(nodes.select("grp", F.expr(f"pos div {FANOUT**levels}").alias("block"), "pos", "node"))
    return materialise(blocks.select("grp", "block", "node").mapInArrow(work, "grp string, pos long, node binary"))


def _path_array(found: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    flat = [x for path in found for x in path]
    sides = [pa.array([x[i] for x in flat], pa.binary()).cast(pa.string()) for i in (0, 1)]
    at = np.append(0, np.cumsum([len(p) for p in found])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(sides, ["left", "right"]))


def _authenticate(nodes: DataFrame, above: DataFrame, levels: int, kind: str = "int") -> DataFrame:
    """grp, pos, node, row, path, top, root of every node: its path within its block and that of its block.

    nodes: grp, pos, node, row (of type `kind`, carried along).  above: grp, pos, path, top, root of every
    block.  A block's row from above comes first in the block's own partition, so nothing is joined.
    """
    below = nodes.select("grp", F.expr(f"pos div {FANOUT**levels}").alias("block"), "pos", "node", "row", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("binary").alias("top"), F.lit(None).cast("binary").alias("root"))
    heads = above.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("node"), F.lit(None).cast(kind).alias("row"), "path", "top", "root")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_runs(batches, 2):
            digests, block, head = b.column(3).to_pylist(), b.column(1).to_numpy(), bounds[:-1]
            known = b.column(5).take(pa.array(head)).to_pylist()
            found = []
            for i, j, up in zip(head.tolist(), bounds[1:].tolist(), known, strict=True):
                up = [(x["left"].encode(), x["right"].encode()) for x in up]
                leaves = [x.hex().encode() for x in digests[i + 1 : j]]
                found += [p + up for p in paths(leaves, _levels(len(leaves), block[i], levels))]
            own = pa.array(np.delete(np.arange(b.num_rows), head))
            of = pa.array(np.repeat(head, np.diff(bounds) - 1))
            out = [*(b.column(i).take(own) for i in (0, 2, 3, 4)), _path_array(found), *(b.column(i).take(of) for i in (6, 7))]
            yield pa.RecordBatch.from_arrays(out, ["grp", "pos", "node", "row", "path", "top", "root"])

    return _dealt(below.unionByName(heads)).mapInArrow(work, f"grp string, pos long, node binary, row {kind}, path {PATH}, top binary, root binary")


def _above(nodes: DataFrame, levels: int) -> DataFrame:
    """grp, pos, path, top (root of the group), root (null) of every block of the nodes (grp, pos, node)."""
    tops = _roots(nodes, levels)
    if tops.agg(F.max("pos")).first()[0]:
        return materialise(_authenticate(tops.withColumn("row", F.lit(None).cast("int")), _above(tops, levels), levels).drop("row", "node"))
    return tops.select("grp", "pos", F.array().cast(PATH).alias("path"), F.col("node").alias("top"), F.lit(None).cast("binary").alias("root"))


def leaf_digest(columns: list[Column]) -> Column:
    """Hex digest of the columns: a dash for null, else length in bytes, colon, value."""
    value = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def path_digest(path: Column) -> Column:
    """Hex digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", also: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, group, leaf, subroot, root (hex), path, and the columns `also` names, of every row.

    A row's leaf is the digest of its fields.  Leaves of a group ascend by id (none first, equal ones by
    digest); groups ascend bytewise, the null one first.  A group of one row has its leaf for subroot, a
    table of one group its subroot for root.  path: from the leaf to the root, the siblings left
    and right at each level, both empty where a node has none.  `also`: further columns of docs, computed
    in the one reading of the texts.  Repeated rows are leaves of their own.  An empty table gives no rows.
    """
    also = also or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    row = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("group"), *(c.alias(k) for k, c in also.items()))
    leaves = materialise(docs.select(group.alias("grp"), F.unhex(leaf_digest([F.col(c) for c in fields])).alias("node"), row.alias("row")))
    kind = leaves.schema["row"].dataType.simpleString()
    placed, total = numbered(leaves, [F.col("grp"), F.col("row.doc_id").asc_nulls_first(), F.col("node")], "place")
    starts = placed.groupBy("grp").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    nodes = materialise(salted_join(placed, starts, "grp", "n", max(1, total)).select("grp", (F.col("place") - F.col("start")).alias("pos"), "node", "row"))
    above = materialise(_above(nodes, block_levels))
    subroots, groups = numbered(materialise(above.filter("pos = 0").select("grp", F.col("top").alias("node"))), [F.col("grp")], "pos")
    trunk = subroots.select(F.lit("all").alias("grp"), "pos", "node", F.struct("grp").alias("row"))
    trunk = _authenticate(trunk, _above(trunk, block_levels), block_levels, "struct<grp:string>").select(F.col("row.grp").alias("grp"), F.col("path").alias("up"), F.col("top").alias("whole"))
    blocks = above.groupBy("grp").agg(F.count(F.lit(1)).alias("blocks"))
    ends = materialise(trunk.join(blocks, "grp"))
    above = salted_join(above, ends, "grp", "blocks", max(1, above.count())).select("grp", "pos", F.concat("path", "up").alias("path"), "top", F.col("whole").alias("root"))
    hexed = {"leaf": "node", "subroot": "top", "root": "root"}
    return _authenticate(nodes, above, block_levels, kind).select("row.*", *(F.lower(F.hex(c)).alias(k) for k, c in hexed.items()), "path")


def tampered_check(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of a table of documents.

    Rows whose id's CRC-32 is even (rows without an id are not) are read again as if their line ends were
    gone; each row's leaf, so changed or not, is folded along its path and held against the root.
    """
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    odd = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    other = F.when(odd, F.unhex(leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])))
    told = merkle_manifest(docs, also={"other": other}, block_levels=block_levels)
    folded = fold(F.coalesce(F.lower(F.hex("other")), "leaf"), F.col("path"))
    shown = told.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
