"""Packing token sequences: first-fit decreasing on a tournament tree, in randomised groups.

Each text becomes its ids and one closing id.  Full pieces of `size` ids fill a sequence alone; the
remainder of each text is packed by first-fit decreasing, run on its own in each random group of
about GROUP_DOCS texts, so groups are bounded and any of them can be computed again after a loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SLICE_BYTES, encoder
from .words import slices, tidy

GROUP_DOCS = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEQUENCE_BITS = 32


class Tournament:
    """A max tree over bin capacities: the leftmost bin with room is found in log(bins) steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room left before placing) of the first bin with room for `need`."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        b, room = i - self.leaves, tree[i]
        tree[i] = room - need
        i //= 2
        while i:
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
        return b, room


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) for every length; ties go in the given order."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree = Tournament(max(1, len(lengths)), size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        b, room = tree.place(int(lengths[i]))
        bins[i], offsets[i] = b, size - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` ids of every text, with their checksum and, if asked for, their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for a, w in slices(b.column(1), SLICE_BYTES):
                ids, at = enc.ids(w)
                total = np.diff(at) + 1
                n = -(-total // size)
                row = np.repeat(np.arange(w.rows), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(size, total[row] - start)
                raw, end = ids.astype("<u4").tobytes(), np.array([end_id], dtype="<u4").tobytes()
                lo, last = at[row] + start, start + length == total[row]
                hi = lo + length - last
                body = [raw[4 * x : 4 * y] + (end if z else b"") for x, y, z in zip(lo.tolist(), hi.tolist(), last.tolist(), strict=True)]
                out = [b.column(0).take(pa.array(row + a)), *(pa.array(x, pa.int64()) for x in (start, length, [zlib.crc32(x) for x in body], total[row]))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(body, pa.binary())] * keep_ids, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + keep_ids])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(cut), PIECE + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; sequences are gapless from offset 0.

    A null or empty text is one piece of the closing id alone.  Each repeated row is packed as its
    own text; null ids are packed too.  Groups are hashed from what a piece is and where it lies in
    the input, and ties in length go by doc_id, start and checksum, so reruns over the same files agree.  An empty table gives no rows; other columns are not read.  With keep_ids the column
    `ids` holds the piece's ids as unsigned little-endian 32-bit integers, ready to be written.
    """
    groups = max(1, -(-docs.count() // group_docs))
    parts = pieces(docs, tokenizer, size, end_id, id_col, text_col, keep_ids)
    # A piece's own place is part of the hash, so that equal rows don't fill one group.
    place_of = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed))
    named = parts.withColumn("grp", F.pmod(place_of, F.lit(groups)).cast("long"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = table.column("grp")[0].as_py()
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), size)
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(bins + (group << SEQUENCE_BITS), pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return named.groupBy("grp").applyInArrow(place, PIECE + ", ids binary" * keep_ids + ", sequence_id long, offset long")
