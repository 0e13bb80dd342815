"""Texts in chunks of bounded bytes, and a compact exchange that tells which of their hashes repeat.

A chunk is one row of a table bucketed by chunk number, so that later passes meet the answers for a
chunk without moving its texts again.  In an exchange every chunk sends its distinct hashes, sorted,
as differences in byte planes, one row for each range of hash values; the reducer of a range answers
each chunk with one bit a hash.  A hash that a third of all texts hold is sent once a chunk, so no
reducer gets more than its even share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shared_dir
from .words import Words, buffers

CHUNK_BYTES, RANGE_BYTES = 4 << 20, 12 << 20
#: kind 0: hashes for the reducer of `part`; kind 1: bits that the chunk keeps for its next pass.
SENT = "chunk long, level int, kind int, part int, n int, base long, hashes binary, more binary, ids binary"
ANSWER = "chunk long, level int, part int, bits binary"


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that empty ones compress to nothing."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def build(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """(table of chunk, ids, texts; number of hash ranges; bytes of text).  Rows of a chunk are in order of id, nulls first."""
    spark = docs.sparkSession

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk(parts: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            nulls = t.column("doc_id").is_null()
            t = pa.concat_tables([t.filter(nulls), t.filter(pa.compute.invert(nulls))]).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks()) for c in ("doc_id", "text")]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([size], pa.int64())], ["chunk", "ids", "texts", "n_bytes"])

        for b in batches:
            offsets, _ = buffers(b.column(1))
            t = pa.table([b.column(0), b.column(1).cast(pa.string())], names=["doc_id", "text"])
            a = 0
            while a < len(t):
                e = min(len(t), max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk_bytes - size, side="right")) - 1))
                held.append(t.slice(a, e - a))
                size += int(offsets[e] - offsets[a])
                a = e
                if size >= chunk_bytes or a < len(t):
                    yield chunk(held)
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk(held)

    made = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(fill, "chunk long, ids array<long>, texts array<string>, n_bytes long")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tidemark_chunks_{uuid.uuid4().hex}"
    made.write.option("path", shared_dir(spark)).option("compression", "zstd").bucketBy(buckets, "chunk").sortBy("chunk").saveAsTable(name)
    table = spark.table(name)  # keeps its files and buckets when the catalogue forgets the name
    spark.sql(f"drop table {name}")
    size = table.agg(F.sum("n_bytes")).first()[0] or 0
    return table, max(1, -(-size // RANGE_BYTES)), size


#: Ids below this stand for rows without an id.
NAMELESS = -(1 << 62)


def open_chunk(table: pa.Table) -> tuple[int, np.ndarray, pa.Array, Words]:
    """(number, ids, ids as they are, words) of a chunk's only row.

    Each row without an id gets one of its own, less than any real one: 20 bits of the partition that
    made the chunk, 20 of the chunk within it, 22 of the row (rows without words may share one).
    """
    ids, texts = (table.column(c).combine_chunks().flatten() for c in ("ids", "texts"))
    number, w = table.column("chunk")[0].as_py(), Words(*buffers(texts))
    own = np.iinfo(np.int64).min + (((number >> 32) << 42) | ((number & 0xFFFFFFFF) << 22)) + (np.cumsum(w.counts > 0) & 0x3FFFFF)
    return number, np.where(ids.is_null().to_numpy(zero_copy_only=False), own, ids.fill_null(0).to_numpy()), ids, w


def send(chunk: int, level: int, hashes: np.ndarray, parts: int, bits: int, more: np.ndarray | None = None, ids: np.ndarray | None = None, keep: bytes = b"") -> list[tuple]:
    """Rows for the reducers: the sorted distinct hashes cut to their highest `bits`, and what goes with them."""
    short = hashes >> np.uint64(64 - bits)
    edges = np.searchsorted(short, range_edges(parts, bits))
    rows = []
    for p in range(parts):
        a, b = edges[p], edges[p + 1]
        if b > a:
            base = int(ids[a:b].min()) if ids is not None else 0
            rows.append((chunk, level, 0, p, int(b - a), base, planes(np.diff(short[a:b], prepend=np.uint64(0))), planes(more[a:b]) if more is not None else b"", planes((ids[a:b] - base).view(np.uint64)) if ids is not None else b""))
    return [*rows, (chunk, level, 1, -1, 0, 0, keep, b"", b"")]


def range_edges(parts: int, bits: int) -> np.ndarray:
    return np.array([(p << bits) // parts for p in range(parts)] + [(1 << bits) - 1], dtype=np.uint64) + np.array([0] * parts + [1], dtype=np.uint64) if bits < 64 else np.array([(p << 64) // parts for p in range(parts)] + [(1 << 64) - 1], dtype=np.uint64)


def sent_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SENT.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def answer(sent: DataFrame, parts: int, first: bool = False) -> DataFrame:
    """One bit for each hash sent: whether another chunk holds it too; with `first`, whether an earlier
    text does (a smaller id, or the same id in a smaller chunk).  Kept bits come back as part -1."""

    def reduce(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        h = np.concatenate([np.cumsum(unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("hashes")])
        chunk = np.repeat(table.column("chunk").to_numpy(), n)
        if first:
            more = np.concatenate([unplanes(x.as_py(), np.uint64) for x in table.column("more")])
            ids = np.concatenate([unplanes(x.as_py(), np.int64) for x in table.column("ids")]) + np.repeat(table.column("base").to_numpy(), n)
            order = np.lexsort((chunk, ids, more, h))
            same = np.append(False, (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1]))
        else:
            order = np.argsort(h)
            twin = h[order][1:] == h[order][:-1]
            same = np.append(False, twin) | np.append(twin, False)
        bit = np.zeros(len(h), dtype=bool)
        bit[order] = same[: len(order)]
        ends = np.cumsum(n)
        bits = [np.packbits(bit[e - m : e]).tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
        return pa.table({"chunk": table.column("chunk"), "level": table.column("level"), "part": table.column("part"), "bits": pa.chunked_array([pa.array(bits, pa.binary())])})

    # One task a range: hashing the few range numbers would put several into one.
    told = sent.filter("kind = 0").repartitionById(parts, "part").groupBy("part").applyInArrow(reduce, ANSWER)
    return told.unionByName(sent.filter("kind = 1").select("chunk", "level", F.lit(-1).alias("part"), F.col("hashes").alias("bits")))


def read_answer(answers: pa.Table, hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The bit of every hash of this chunk that was sent."""
    edges = np.searchsorted(hashes >> np.uint64(64 - bits), range_edges(parts, bits))
    out = np.zeros(len(hashes), dtype=bool)
    for p, raw in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if p >= 0:
            a, b = edges[p], edges[p + 1]
            out[a:b] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=int(b - a)).astype(bool)
    return out


def kept_bits(answers: pa.Table) -> bytes:
    return next((b for p, b in zip(answers.column("part").to_pylist(), answers.column("bits").to_pylist(), strict=True) if p < 0), b"")


def pass_over(table: DataFrame, answers: DataFrame | None, work: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """work(chunk's row, its answers) for every chunk; only answers are shuffled, by chunk."""
    if answers is not None:
        return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda a, b: work(a, b), schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from work(pa.Table.from_batches([b.slice(i, 1)]), None).to_batches()

    return table.mapInArrow(each, schema)


def hash_bits(size: int) -> int:
    """Bits that leave about one hash in thirty-two to chance among as many as there are words."""
    return min(64, max(32, (max(size, 1) // 4).bit_length() + 5))
