"""Substring deduplication by level-wise doubling of repeated word windows.

Windows of the first length that repeat anywhere survive; only where a survivor is followed by
another at its end can the window of twice the length repeat, so only those go to the next level,
until the wanted length is reached or nothing survives.  At the last level hashes have 96 bits and the
order of texts decides: every occurrence but the earliest marks the words it covers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import chunks as C
from .words import Words, distinct

LENGTH, DOUBLINGS = 20, 1
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _candidates(w: Words, hashes: np.ndarray, length: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of a length whose two halves survived, with their hashes."""
    at, h = w.windows(hashes, length)
    if alive is not None:
        on = alive[at] & alive[at + length // 2]
        at, h = at[on], h[on]
    return at, h


def _survivors(w: Words, hashes: np.ndarray, length: int, alive: np.ndarray | None, answers: pa.Table, parts: int, bits: int) -> np.ndarray:
    """Whether the window that starts at each word repeats, here or in another chunk."""
    at, h = _candidates(w, hashes, length, alive)
    out = np.zeros(len(w.starts), dtype=bool)
    short = h >> np.uint64(64 - bits) << np.uint64(64 - bits)
    keys, back, count = np.unique(short, return_inverse=True, return_counts=True)
    out[at] = ((count > 1) | C.read_answer(answers, keys, parts, bits))[back]
    return out


def kept_text(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words with one space after each, and where each row's part begins (rows + 1)."""
    s, n = w.starts[keep], (w.ends - w.starts)[keep]
    ends = np.cumsum(n + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    first = ends - n - 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(first, n) + step] = w.data[np.repeat(s, n) + step]
    at = np.append(0, ends)[np.searchsorted(np.flatnonzero(keep), w.first)]
    return out.tobytes(), at


def remove_repeats(docs: DataFrame, length: int = LENGTH, doublings: int = DOUBLINGS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, if asked for) for every row.

    A word goes if a window of `length` words over it also starts earlier: in a row of smaller id, or
    earlier in the same row.  Windows are judged on the input.  Rows without an id count as smallest;
    rows that repeat an id come in order of their chunk, then text.  Null texts have no words, texts
    of fewer words than `length` lose none; an empty table gives no rows.
    """
    table, parts, size = C.build(docs, id_col, text_col, chunk_bytes)
    bits = C.hash_bits(size)
    lengths = [length >> (doublings - i) for i in range(doublings + 1)]
    if any(a * 2 != b for a, b in zip(lengths, lengths[1:], strict=False)) or lengths[0] < 1:
        raise ValueError("length must be divisible by two once a doubling")

    def begin(level: int):  # noqa: ANN202
        last = level == len(lengths) - 1

        def work(row: pa.Table, answers: pa.Table | None) -> pa.Table:
            number, order_ids, _, w = C.open_chunk(row)
            h, alive = w.hashes(), None
            if level:
                before = C.kept_bits(answers)
                alive = np.unpackbits(np.frombuffer(before, dtype=np.uint8), count=len(w.starts)).astype(bool) if before else None
                alive = _survivors(w, h, lengths[level - 1], alive, answers, parts, bits)
            at, keys = _candidates(w, h, lengths[level], alive)
            keep = np.packbits(alive).tobytes() if alive is not None else b""
            if not last:
                return C.sent_table(C.send(number, level, distinct(keys >> np.uint64(64 - bits) << np.uint64(64 - bits)), parts, bits, keep=keep))
            second = _second(w, at, lengths[level])
            keys, second, first, _, _ = _distinct(keys, second)
            return C.sent_table(C.send(number, level, keys, parts, 64, second, order_ids[w.row[at[first]]], keep))

        return work

    def finish(row: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, ids, w = C.open_chunk(row)
        before = C.kept_bits(answers)
        alive = np.unpackbits(np.frombuffer(before, dtype=np.uint8), count=len(w.starts)).astype(bool) if before else None
        at, keys = _candidates(w, w.hashes(), length, alive)
        second = _second(w, at, length)
        keys, _, first, back, _ = _distinct(keys, second)
        later = C.read_answer(answers, keys, parts, 64)[back] | (first[back] != np.arange(len(at)))
        edge = np.zeros(len(w.starts) + 1, dtype=np.int64)
        np.add.at(edge, at[later], 1)
        np.add.at(edge, at[later] + length, -1)
        keep = np.cumsum(edge)[:-1] == 0
        raw, part = kept_text(w, keep)
        texts = [raw[a : max(a, b - 1)] for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True)]
        removed = np.bincount(w.row[~keep], minlength=w.rows)
        out = {"doc_id": ids, "n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())}
        if with_text:
            out["kept_text"] = pa.array([x.decode("utf-8") for x in texts], pa.string())
        return pa.table(out)

    answers = None
    for level in range(len(lengths)):
        answers = C.answer(C.pass_over(table, answers, begin(level), C.SENT), parts, first=level == len(lengths) - 1)
    return C.pass_over(table, answers, finish, RESULT + ", kept_text string" * with_text)


def _second(w: Words, at: np.ndarray, length: int) -> np.ndarray:
    """32 more bits of the windows at these starts, from the other family."""
    every, h = w.windows(w.hashes(1), length, 1)
    return (h[np.searchsorted(every, at)] >> np.uint64(32)).astype(np.uint64)


def _distinct(keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, second) in order; the first place of each; the way back; counts."""
    order = np.lexsort((np.arange(len(keys)), second, keys))
    k, s = keys[order], second[order]
    new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))[: len(k)]
    group = np.cumsum(new) - 1
    back = np.zeros(len(keys), dtype=np.int64)
    back[order] = group
    return k[new], s[new], order[new], back, np.bincount(group, minlength=int(new.sum()))
