"""SimHash near-duplicates: fingerprints cut into blocks, joined on the blocks that close pairs share.

A fingerprint has BLOCKS blocks of one byte.  Two that differ in at most two bits differ in at most two
blocks and so agree in the other six (the pigeonhole principle): each distinct fingerprint is dealt to
one bucket for every two blocks left out, keyed by the six that remain.  A bucket fixes all but two
bytes, so it holds at most 65,536 distinct fingerprints however many texts there are.  Within a bucket
the fingerprints at a distance of one or two bits are looked up rather than compared in pairs, each pair
in the one bucket that is its own, and only a spanning forest of a bucket's links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runs import whole_runs
from .runtime import materialise, salted_join
from .substring_dedup import kept_text
from .words import Words, slices_of, tidy

SHINGLE, SEED, BLOCKS = 3, 42, 8
#: A to Z in lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Shingles whose bits are counted at a time.
BITS_AT_ONCE = 1 << 16
FREE = list(combinations(range(BLOCKS), 2))


def shingle_hashes(w: Words, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64) of every run of `size` words joined by spaces; a text of fewer words is one run, one without has none."""
    raw, _ = kept_text(w, np.ones(len(w.starts), dtype=bool))
    n = w.ends - w.starts
    stop = np.cumsum(n + 1) - 1
    begin, count = stop - n, w.counts
    at = np.flatnonzero(w.row[: max(0, len(n) - size + 1)] == w.row[size - 1 :])
    short = np.flatnonzero((count > 0) & (count < size))
    row = np.concatenate([w.row[at], short])
    lo, hi = np.concatenate([begin[at], begin[w.first[short]]]), np.concatenate([stop[at + size - 1], stop[w.first[short + 1] - 1]])
    order = np.argsort(row, kind="stable")
    of = xxhash.xxh64_intdigest
    return row[order], np.fromiter((of(raw[a:b], seed) for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True)), dtype=np.uint64, count=len(row))


def majority(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """One fingerprint a row: the bits set in over half of its hashes (rows ascending)."""
    ones = np.zeros((rows, 64), dtype=np.int64)
    for i in range(0, len(row), BITS_AT_ONCE):
        r, h = row[i : i + BITS_AT_ONCE], hashes[i : i + BITS_AT_ONCE]
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        ones[r[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.bincount(row, minlength=rows)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (as a signed number) of every row; zero for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, w in slices_of(b.column(1), LOWER):
                prints = majority(*shingle_hashes(w, size, seed), w.rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, w.rows), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(sign), "doc_id long, fingerprint long")


def _probes(a: int, b: int) -> np.ndarray:
    """Differences (in the low byte those of block a, in the high one of block b) that belong to the bucket of a and b.

    A difference in two blocks has one bucket; one within a single block is looked for where its
    block is paired with the first of the others.
    """
    one = [1 << i for i in range(8)]
    within = one + [x | y for x, y in combinations(one, 2)]
    found = [x | y << 8 for x in one for y in one]
    if b == (1 if a == 0 else 0):
        found += within
    if a == (1 if b == 0 else 0):
        found += [x << 8 for x in within]
    return np.array(found, dtype=np.int64)


PROBES = [_probes(a, b) for a, b in FREE]


def bucket_links(which: int, bucket: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the least of their part, where that is another: parts are joined by links within `bits` bits.

    bucket: the number of each print's bucket; all buckets leave out the blocks FREE[which].
    """
    a, b = FREE[which]
    u = prints.view(np.uint64)
    low = (u >> np.uint64(8 * a) & np.uint64(255) | (u >> np.uint64(8 * b) & np.uint64(255)) << np.uint64(8)).astype(np.int64)
    key = bucket << 16 | low
    order = np.argsort(key)
    key, prints = key[order], prints[order]
    x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for p in PROBES[which].tolist():
        if p.bit_count() > bits:
            continue
        want = key ^ p
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = np.flatnonzero((key[at] == want) & (want > key))
        x.append(hit)
        y.append(at[hit])
    x, y = np.concatenate(x), np.concatenate(y)
    part = np.arange(len(key))
    while True:  # hook the larger part's head below the smaller one, then shorten paths
        px, py = part[x], part[y]
        apart = px != py
        if not apart.any():
            break
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(part, np.maximum(px, py), np.minimum(px, py))
        while (part[part] != part).any():
            part = part[part]
    on = np.flatnonzero(part != np.arange(len(part)))
    return prints[on], prints[part[on]]


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """u, v: fingerprints of which all at a distance of at most `bits` (two at most) lie in one component."""
    if not 0 < bits <= 2:
        raise ValueError("two left-out blocks find distances of one and two bits")
    key = [F.struct(F.lit(i).cast("byte").alias("which"), F.col("fingerprint").bitwiseAND(_signed(~(255 << 8 * a | 255 << 8 * b))).alias("rest"), "fingerprint") for i, (a, b) in enumerate(FREE)]
    dealt = distinct.select(F.explode(F.array(*key)).alias("k")).select("k.*").repartition("which", "rest").sortWithinPartitions("which", "rest")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in whole_runs(batches, 2):
            n = np.diff(bounds)
            which, prints = b.column(0).to_numpy(), b.column(2).to_numpy()
            shared = np.repeat(n > 1, n)
            bucket = np.repeat(np.arange(len(n)), n)[shared]
            which, prints = which[shared], prints[shared]
            for i in np.unique(which).tolist():
                u, v = bucket_links(i, bucket[which == i], prints[which == i], bits)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(link, "u long, v long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def simhash_components(docs: DataFrame, bits: int = 2, size: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) of every row.

    Rows are linked when their fingerprints differ in at most `bits` bits; components are those of the
    links.  Equal fingerprints are one node, so copies aren't compared with one another, and rows are
    spread over salts wherever many share a fingerprint or a component.

    Null and empty texts have fingerprint zero and are linked like any other.  Rows without an id take
    part; component_id is null only where no row reached has an id.  Repeated rows each get their row.
    An empty table gives no rows; other columns aren't read.
    """
    prints = materialise(fingerprints(docs, size, seed, id_col, text_col))
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    labels = components(links(nodes.select("fingerprint"), bits)).withColumnRenamed("node", "fingerprint")
    named = materialise(nodes.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    known = materialise(salted_join(named.drop("least"), least, "label", "n", named.count()).select("fingerprint", "copies", "component_id"))
    told = salted_join(prints, known, "fingerprint", "copies", prints.count())
    return told.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
