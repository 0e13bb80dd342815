"""Token ids and counts of whole texts through a per-worker cache of encoded words.

The word-level vocabulary drops white space and never forms a token across it, so a text's ids are
the ids of its white-space separated chunks in order.  That makes white space the safe boundary at
which long texts are split; each distinct chunk is encoded by the library once for a cache life.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices, tidy, worker_cache

#: Bytes of text encoded at a time, and distinct chunks kept by a worker before it starts anew.
SLICE_BYTES, CACHE_WORDS, JOINED = 1 << 20, 400_000, 200


class ChunkEncoder:
    """Ids of chunks, from `encode(list of str) -> (all ids, ids of each)`, cached by chunk hash.

    Every chunk that the cache answers for is compared with the cached one byte by byte; one that only shares
    its hash gets an entry of its own.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.starts, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)
        self.raw, self.begins, self.sizes = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _add(self, raw: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New entries for the chunks that lie in raw."""
        chunks = [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        ids, lengths = self.encode([c.decode("utf-8", "replace") for c in chunks])
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        sizes, n = ends - begins, len(self.starts)
        self.begins = np.append(self.begins, len(self.raw) + np.cumsum(sizes) - sizes)
        self.sizes, self.raw = np.append(self.sizes, sizes), np.append(self.raw, np.frombuffer(b"".join(chunks), dtype=np.uint8))
        self.starts, self.lengths = np.append(self.starts, starts), np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, ids)
        return np.arange(n, n + len(chunks))

    def _strangers(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Words that differ from what their cache entry holds."""
        size = words.ends - words.starts
        odd = size != self.sizes[at]
        like = np.flatnonzero(~odd)
        n = size[like]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = words.data[np.repeat(words.starts[like], n) + step] != self.raw[np.repeat(self.begins[at[like]], n) + step]
        if differs.any():
            odd[like[np.repeat(np.arange(len(like)), n)[differs]]] = True
        return np.flatnonzero(odd)

    def look(self, words: Words) -> np.ndarray:
        """The cache entry of each word."""
        if len(self.starts) > CACHE_WORDS:
            self.clear()
        keys, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        listed = keys.tolist()
        at = np.fromiter(map(self.index.get, listed, [-1] * len(listed)), dtype=np.int64, count=len(listed))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._add(words.data.tobytes(), words.starts[first[new]], words.ends[first[new]])
            self.index.update(zip(keys[new].tolist(), at[new].tolist(), strict=True))
        at = at[back]
        odd = self._strangers(words, at)
        if len(odd):
            at[odd] = self._add(words.data.tobytes(), words.starts[odd], words.ends[odd])
        return at

    def counts(self, words: Words) -> np.ndarray:
        """Tokens of each row."""
        at = self.look(words) if len(words.starts) else np.zeros(0, dtype=np.int64)
        sums = np.append(0, np.cumsum(self.lengths[at]))
        return (sums[words.first[1:]] - sums[words.first[:-1]]).astype(np.int64)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each row's begin (rows + 1)."""
        if not len(words.starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(words.rows + 1, dtype=np.int64)
        at = self.look(words)
        n = self.lengths[at]
        sums = np.append(0, np.cumsum(n))
        take = np.repeat(self.starts[at] - sums[:-1], n) + np.arange(sums[-1])
        return self.flat[take], sums[words.first]


#: Stands between chunks that are encoded in one call; chunks that hold it are encoded alone.
MARK = "\x01"


def library_encode(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    ids_of = lambda texts: [np.array(e.ids, dtype=np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    (mark,) = ids_of([MARK])[0].tolist()

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, x in enumerate(chunks) if MARK in x]
        plain = [x if MARK not in x else "" for x in chunks] if odd else chunks
        joined = [f" {MARK} ".join([*plain[i : i + JOINED], ""]) for i in range(0, len(plain), JOINED)]
        flat = np.concatenate([np.zeros(0, dtype=np.uint32), *ids_of(joined)])
        marks = np.flatnonzero(flat == mark)
        lengths = np.diff(np.append(-1, marks)) - 1
        flat = np.delete(flat, marks)
        if odd:
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            for i, x in zip(odd, ids_of([chunks[i] for i in odd]), strict=True):
                parts[i], lengths[i] = x, len(x)
            flat = np.concatenate(parts)
        return flat, lengths

    return encode


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file (white-space dropping vocabularies only)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(("encoder", path), lambda: ChunkEncoder(library_encode(path)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row.

    Arrow batches are cut into slices of equal bytes; texts of any length are encoded whole, chunk by
    chunk.  Null and empty texts have 0 bytes and tokens; repeated rows and null ids are counted as
    they are; an empty table gives no rows; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            got = [(np.diff(w.offsets), enc.counts(w)) for _, w in slices(b.column(1), SLICE_BYTES)]
            nbytes, n = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*got, strict=True) if got else ((), ())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nbytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
