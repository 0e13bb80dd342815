"""Importance resampling of documents towards a target distribution over hashed word n-grams.

Every word's CRC-32 is computed once.  The CRC of an n-gram follows from those of its words by the
combination algebra of the code: appending `length` bytes multiplies the left CRC by a matrix over
GF(2), and the right CRC is added.  No n-gram is ever put together as a string.

Texts are read twice: once for the counts of all buckets, of which each task adds up its own and
FAN sums reach the driver (so their size doesn't depend on the input), and once for the weights.
The draw is a sort by range of score, in which each row's rank is its partition's offset plus its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, numbered
from .words import Words, slices_of, tidy

BUCKETS, ORDER, MIN_WORDS, PERCENT, SEED, FAN = 10_000, 3, 20, 5, 42, 32
#: Bytes of a word: letters in lower case, digits, and all beyond ASCII; the others separate words.
FOLD = np.full(256, 0x20, dtype=np.uint8)
FOLD[0x30:0x3A], FOLD[0x61:0x7B], FOLD[0x41:0x5B], FOLD[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
#: Words of more bytes than this go to zlib one by one; shorter ones are taken a byte of all words at a time.
COLUMNS = 48


def _byte_table() -> np.ndarray:
    """What one byte does to the register: the remainders of all bytes by the reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> np.uint32(1) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c.astype(np.uint32)


BYTE = _byte_table()


class Shift:
    """Multiplication of CRCs by the matrices that append zero bytes: matrix times vector by four table looks.

    A matrix is held as the images of all values of each of a vector's four bytes.  Lengths below 64
    have a matrix each; longer ones are composed from those of 64, 128, 256, ... bytes.
    """

    def __init__(self) -> None:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        step = self._spread(BYTE[unit & np.uint32(255)] ^ unit >> np.uint32(8))
        tables, images = [self._spread(unit)], unit
        for _ in range(63):
            images = self._times(step, images)
            tables.append(self._spread(images))
        self.short = np.stack(tables).reshape(-1)
        power = self._spread(self._times(step, images))
        self.long = []
        for _ in range(40):
            self.long.append(power)
            power = self._spread(self._times(power, self._times(power, unit)))

    @staticmethod
    def _spread(images: np.ndarray) -> np.ndarray:
        """The table of a matrix given by its columns, one a bit."""
        bits = np.arange(256)[:, None] >> np.arange(8) & 1
        return np.stack([np.bitwise_xor.reduce(np.where(bits, images[8 * k : 8 * k + 8], 0).astype(np.uint32), axis=1) for k in range(4)])

    @staticmethod
    def _times(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The CRCs of what they stand for, followed by `length` bytes of zeros (before the right CRC is added)."""
        low = (length & 63) << 10
        out = self.short[low + (crc & 255)] ^ self.short[low + 256 + (crc >> 8 & 255)] ^ self.short[low + 512 + (crc >> 16 & 255)] ^ self.short[low + 768 + (crc >> 24)]
        high = length >> 6
        for power in self.long:
            on = np.flatnonzero(high)
            if not len(on):
                break
            on = on[(high[on] & 1).astype(bool)]
            out[on] = self._times(power, out[on])
            high = high >> 1
        return out


SHIFT = Shift()
GAP = np.uint32(zlib.crc32(b" "))


def word_crcs(w: Words) -> np.ndarray:
    """The CRC-32 of every word: a byte of all words at a time, the longest ones by zlib."""
    size = w.ends - w.starts
    order = np.argsort(-size, kind="stable")
    starts, down = w.starts[order], -size[order]
    crc = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(min(COLUMNS, int(-down[0]) if len(down) else 0)):
        live = int(np.searchsorted(down, -j))  # words of more than j bytes come first
        crc[:live] = BYTE[crc[:live] & 255 ^ w.data[starts[:live] + j]] ^ crc[:live] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[: int(np.searchsorted(down, -COLUMNS))].tolist():
        out[i] = zlib.crc32(w.data[w.starts[i] : w.ends[i]])
    return out


def gram_crcs(w: Words, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, CRC-32) of all runs of 1, 2, ... `order` consecutive words of a row, joined by one space."""
    one, size = word_crcs(w), w.ends - w.starts
    at, crc, ones = np.arange(len(one)), one, np.ones(len(one), dtype=np.int64)
    yield w.row, crc
    for k in range(1, order):
        on = at + k < len(one)
        at, crc = at[on], crc[on]
        on = w.row[at] == w.row[at + k]
        at, crc = at[on], crc[on]
        crc = SHIFT(SHIFT(crc, ones[: len(at)]) ^ GAP, size[at + k]) ^ one[at + k]
        yield w.row[at], crc


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of the one text column fall into each bucket, over all rows."""
    column = "counts array<long>"

    def row_of(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, w in slices_of(b.column(0), FOLD):
                for _, crc in gram_crcs(w, order):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        if total.any():
            yield row_of(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(-1, buckets).sum(axis=0)
        if total.any():
            yield row_of(total)

    sums = texts.mapInArrow(tidy(count), column).repartition(FAN).mapInArrow(add, column)
    return sum((np.array(r["counts"], dtype=np.int64) for r in sums.collect()), np.zeros(buckets, dtype=np.int64))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """doc_id, n_words, n_features, weight (and text) of every row."""
    names = ["doc_id", "n_words", "n_features", "weight"] + ["text"] * with_text

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, w in slices_of(b.column(1), FOLD):
                weight, n = np.zeros(w.rows), np.zeros(w.rows, dtype=np.int64)
                for row, crc in gram_crcs(w, order):
                    weight += np.bincount(row, gain[crc % np.uint32(len(gain))], minlength=w.rows)
                    n += np.bincount(row, minlength=w.rows)
                out = [b.column(0).slice(a, w.rows), *(pa.array(x.astype(np.int64)) for x in (w.counts, n, weight))]
                yield pa.RecordBatch.from_arrays(out + [b.column(1).slice(a, w.rows)] * with_text, names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(weigh), "doc_id long, n_words long, n_features long, weight long" + ", text string" * with_text)


def importance_resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_features, weight, score, rank (and the text, if asked for) of every row of docs.

    Features are the runs of 1 to `order` words, hashed into buckets.  A row's weight is the sum of its
    features' gains, its score the weight with Gumbel noise drawn from `seed` and the id, so that the
    highest scores are a sample without replacement in proportion to exp(weight / 1000).  Of the rows
    with `min_words` words, `percent` in a hundred (rounded down) are drawn: rank 1, 2, ...; the others'
    rank is null.  Ties go to the smaller id; rows alike in score and id come in order of their place.

    Null and empty texts have no features and weight 0.  Rows without an id draw the noise of the seed
    alone and come last among equals; rows that repeat an id are drawn each on its own.  An empty
    target or table gives gains against nothing; an empty table of docs no rows.  Other columns aren't read.
    """
    gain = gains(bucket_counts(docs.select(F.col(text_col).cast("string")), buckets, order), bucket_counts(target.select(F.col(target_col).cast("string")), buckets, order))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialise(weights(docs, gain, order, id_col, text_col, with_text).withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= min_words)
    ranked, n = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < n * percent // 100, F.col("rank") + 1))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank", *["text"] * with_text)
