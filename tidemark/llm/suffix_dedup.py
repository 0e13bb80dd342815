"""Repeated passages across documents by a sparse suffix array.

Suffixes are kept only where a content-defined rule selects them: at the minimisers of SEED-word
windows, so that texts that share a passage keep the same suffixes of it.  Suffixes whose seed
repeats anywhere are sorted by what follows the seed; neighbours from different documents are
compared and each match is extended to the right and to the left.  An exact check follows where texts
part near a seed: every run of the wanted length around it is looked for in the other documents of
that seed.  Spans that reach the wanted length are merged within each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks as C
from .runtime import materialise
from .words import Words, distinct, mix64

#: A run of LENGTH words holds LENGTH - SEED + 1 seeds, the least of which is a minimiser.
LENGTH, SEED = 50, 30
SUFFIX = "key long, after binary, before binary, doc_id long, pos int"
#: Spans (without key), and for keys at a partition's ends the runs of LENGTH words that surround the seed (with key).
FOUND = "doc_id long, start int, stop int, other long, key long, window long, lo long, hi long"
NONE = -1


def minimisers(w: Words, hashes: np.ndarray, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the selected seeds and their hashes."""
    at, h = w.windows(hashes, seed)
    if len(at) < window:
        return at[:0], h[:0]
    inside = np.flatnonzero((w.row[at[: len(at) - window + 1]] == w.row[at[window - 1 :]]))
    least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1)[inside]
    chosen = distinct(inside + least)
    return at[chosen], h[chosen]


def contexts(w: Words, short: np.ndarray, at: np.ndarray, reach: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (never 0) of `reach` words after and before each seed, nearest first; 0 beyond the text."""
    step = np.arange(reach)
    out = []
    for place in (at[:, None] + seed + step, at[:, None] - 1 - step):
        there = (place >= w.first[w.row[at]][:, None]) & (place < w.first[w.row[at] + 1][:, None])
        out.append(np.where(there, short[np.clip(place, 0, len(short) - 1)], 0).astype(">u4"))
    return out[0], out[1]


def compare(key: np.ndarray, after: np.ndarray, before: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words to the left, words to the right, other document) of each sorted suffix's longest match with
    its nearest neighbours from other documents; -1 to the left where there is no match."""
    n = len(key)
    place = np.arange(n)
    new = np.append(True, doc[1:] != doc[:-1])[:n]
    first = np.maximum.accumulate(np.where(new, place, 0))
    last = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1] if n else place
    left, right, other = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for j in (first - 1, last):
        on = np.flatnonzero((j >= 0) & (j < n))
        on = on[key[on] == key[j[on]]]
        near = j[on]
        r, l = (np.cumprod((x[on] == x[near]) & (x[on] != 0), axis=1).sum(1) for x in (after, before))
        better = r + l > left[on] + right[on]
        on = on[better]
        left[on], right[on], other[on] = l[better], r[better], doc[near[better]]
    return left, right, other


def prefixes(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of `begin` and the first 0, 1, 2, ... words of each row."""
    out = np.empty((len(x), x.shape[1] + 1), dtype=np.uint64)
    out[:, 0] = begin
    for i in range(x.shape[1]):
        out[:, i + 1] = mix64(out[:, i] * np.uint64(0x9E3779B97F4A7C15) ^ x[:, i].astype(np.uint64))
    return out


def meetings(key: np.ndarray, after: np.ndarray, before: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every r, of each run of words that reaches r words to the right of a seed and the rest to the
    left: (r, suffixes, hash, least document, largest document with that run)."""
    reach = after.shape[1]
    right, left = prefixes(after, key.view(np.uint64)), prefixes(before, np.zeros(len(key), dtype=np.uint64))
    room = (after != 0).sum(1), (before != 0).sum(1)
    for r in range(reach + 1):
        on = np.flatnonzero((room[0] >= r) & (room[1] >= reach - r))
        h = mix64(right[on, r] ^ (left[on, reach - r] * np.uint64(0xD6E8FEB86659FD93)))
        order = np.lexsort((doc[on], h))
        on, h = on[order], h[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        yield r, on, h, doc[on[first]][group], doc[on[np.append(first[1:], len(on))[: len(first)] - 1]][group]


def suffixes(docs: DataFrame, length: int, seed: int, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(suffixes at minimisers whose seed occurs more than once, bytes of text)."""
    table, parts, size = C.build(docs, id_col, text_col, chunk_bytes)
    bits, window = C.hash_bits(size), length - seed + 1

    def begin(row: pa.Table, _: pa.Table | None) -> pa.Table:
        number, _, _, w = C.open_chunk(row)
        keys = minimisers(w, w.hashes(), seed, window)[1]
        return C.sent_table(C.send(number, 0, distinct(keys >> np.uint64(64 - bits) << np.uint64(64 - bits)), parts, bits))

    def repeated(row: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, _, w = C.open_chunk(row)
        h = w.hashes()
        at, keys = minimisers(w, h, seed, window)
        short, back, count = np.unique(keys >> np.uint64(64 - bits) << np.uint64(64 - bits), return_inverse=True, return_counts=True)
        on = ((count > 1) | C.read_answer(answers, short, parts, bits))[back]
        at, keys = at[on], keys[on]
        after, before = contexts(w, (h >> np.uint64(32)) | np.uint64(1), at, length - seed, seed)
        cell = 4 * (length - seed)
        binary = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(cell), len(at), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (after, before)]
        row_of = w.row[at]
        return pa.table({"key": pa.array(keys.view(np.int64)), "after": binary[0], "before": binary[1], "doc_id": pa.array(ids[row_of]), "pos": pa.array((at - w.first[row_of]).astype(np.int32))})

    answers = C.answer(C.pass_over(table, None, begin, C.SENT), parts)
    return C.pass_over(table, answers, repeated, SUFFIX), size


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, other_doc_id: passages that another document shares.

    All passages of at least `length` words are found; none that is shorter is told.  Ends reach at most
    length - seed words beyond the outermost selected suffix of a match, which covers the whole match.
    Words are compared by 32 bits beyond the 64-bit hash of the seed.  Rows of one id are one
    document; each row without an id (doc_id null) is one of its own.  Null, empty and short texts have
    no spans; an empty table gives no rows.  other_doc_id names one document that holds the passage
    (null if only rows without an id do).
    """
    spark = docs.sparkSession
    found, size = suffixes(docs, length, seed, id_col, text_col, chunk_bytes)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (16 << 20)))
    order, reach = ["key", "after", "before", "doc_id", "pos"], length - seed
    kinds = [(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in FOUND.split(", ")]

    def batch(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        m = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k, mask=cols[c] == NONE if c == "start" else None) if c in cols else pa.nulls(m, k) for c, k in kinds], [c for c, _ in kinds])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        m = len(t)
        after, before = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=">u4").reshape(m, -1) for c in ("after", "before"))
        key, doc, pos = (t.column(c).to_numpy() for c in ("key", "doc_id", "pos"))
        left, right, other = compare(key, after, before, doc)
        hit = np.flatnonzero((left >= 0) & (left + right + seed >= length))
        yield batch({"doc_id": doc[hit], "start": pos[hit] - left[hit], "stop": pos[hit] + seed + right[hit], "other": other[hit]})
        # A neighbour that shares most may hide one that shares another part of what surrounds the seed.
        whole = (left == reach) & (right == reach)
        edge = (key == key[0]) | (key == key[-1])
        at = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        on = np.flatnonzero((np.bincount(at[~whole], minlength=at[-1] + 1) > 0)[at] | edge)
        shared, with_ = np.zeros((len(on), reach + 2), dtype=bool), np.zeros((len(on), reach + 1), dtype=np.int64)
        for r, i, h, lo, hi in meetings(key[on], after[on], before[on], doc[on]):
            shared[i, r] = (lo != hi) & ~whole[on[i]]
            with_[i, r] = np.where(doc[on[i]] == lo, hi, lo)
            # The first and last keys may go on in the partitions beside this one.
            out = edge[on[i]]
            i, h, lo, hi = i[out], h[out], lo[out], hi[out]
            sent = (lo == hi) | np.append(True, h[1:] != h[:-1])[: len(h)]
            i, h, lo, hi = i[sent], h[sent], lo[sent], hi[sent]
            yield batch({"start": np.where(lo == hi, pos[on[i]].astype(np.int64) - (reach - r), NONE), "key": key[on[i]], "window": h.view(np.int64), "lo": lo, "hi": hi})
        a = np.argwhere(shared & ~np.roll(shared, 1, axis=1))
        b = np.argwhere(shared & ~np.roll(shared, -1, axis=1))[:, 1]
        i = on[a[:, 0]]
        yield batch({"doc_id": doc[i], "start": pos[i] - reach + a[:, 1], "stop": pos[i] + seed + b, "other": with_[a[:, 0], a[:, 1]]})

    ranged = materialise(found).repartitionByRange(n, *order).sortWithinPartitions(*order)
    told = materialise(ranged.mapInArrow(neighbours, FOUND))
    # A partition tells a run that several of its documents hold once, so none meets in great number.
    edges = told.filter("key is not null")
    met = edges.groupBy("key", "window").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least <> most")
    edges = edges.filter("start is not null").join(met, ["key", "window"])
    edges = edges.select(F.col("lo").alias("doc_id"), "start", (F.col("start") + length).alias("stop"), F.when(F.col("lo") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("other"))
    spans = told.filter("key is null").select("doc_id", "start", "stop", "other").unionByName(edges)
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum((F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int")).over(by)
    merged = spans.groupBy("doc_id", "start").agg(F.max("stop").alias("stop"), F.max("other").alias("other")).withColumn("part", part)
    out = merged.groupBy("doc_id", "part").agg(F.min("start").alias("a"), F.max("stop").alias("b"), F.max("other").alias("other"))
    named = lambda c: F.when(F.col(c) >= C.NAMELESS, F.col(c))
    return out.select(named("doc_id").alias("doc_id"), F.col("a").cast("long").alias("start_word"), F.col("b").cast("long").alias("end_word"), (F.col("b") - F.col("a")).cast("long").alias("n_words"), named("other").alias("other_doc_id"))
