"""Hashes of words and texts, and the encoder's cache, where a polynomial or a short hash would be fooled."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_dedup, packing, substring_dedup, suffix_dedup, tokens, words


def thue_morse(n, a="a", b="b"):
    return [b if i.bit_count() % 2 else a for i in range(n)]


def split(*texts):
    (w,) = (w for _, w in words.slices(pa.array(list(texts))))
    return w


@pytest.mark.parametrize("n", [64, 1024, 2048, 8192])
def test_words_of_a_regular_build(n):
    w = split("".join(thue_morse(n)) + " " + "".join(thue_morse(n, "b", "a")))
    for family in (0, 1):
        a, b = w.hashes(family)
        assert a != b


@pytest.mark.parametrize("n", [64, 1024, 2048, 8192])
def test_texts_of_a_regular_build(n):
    w = split(" ".join(thue_morse(n, "one", "two")), " ".join(thue_morse(n, "two", "one")))
    for family in (0, 1):
        a, b = near_dedup.whole_texts(w, w.hashes(family), family)
        assert a != b
    assert len(set(near_dedup.text_keys(w).to_pylist())) == 2


def test_hashes_depend_on_the_bytes_alone():
    some = ["x", "xx", "x" * 7, "x" * 8, "x" * 9, "y" * 16, "y" * 17, "\x00", "\x00\x00", "é" * 30, "z" * 5000]
    alone = [split(t).hashes()[0] for t in some]
    assert split(" ".join(some)).hashes().tolist() == alone and split(*some[::-1]).hashes().tolist() == alone[::-1]
    assert len(set(alone)) == len(some)
    assert len(split("").hashes()) == 0


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer()).encode(text, add_special_tokens=False).ids


def test_cache_of_colliding_chunks(monkeypatch):
    """With hashes of one bit nearly all chunks collide, and bytes must tell them apart."""
    monkeypatch.setattr(words.Words, "hashes", lambda self, family=0: (self.ends - self.starts).astype(np.uint64) % np.uint64(2))
    texts = ["the cat sat on the mat", "a dog and a cat", "mat cat the sat", "", "on on on"]
    enc = tokens.ChunkEncoder(tokens.library_encode(tokens.default_tokenizer()))
    for _ in range(2):
        ids, at = enc.ids(split(*texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library_ids(t) for t in texts]
        assert enc.counts(split(*texts)).tolist() == [len(library_ids(t)) for t in texts]


def test_operators_on_texts_of_a_regular_build(spark):
    a, b = "".join(thue_morse(2048)), "".join(thue_morse(2048, "b", "a"))
    long = [" ".join(thue_morse(2048, x, y)) for x, y in (("one", "two"), ("two", "one"))]
    docs = spark.createDataFrame(list(enumerate([a, b, *long])), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, tokens.default_tokenizer()).collect()}
    assert got == {i: len(library_ids(t)) for i, t in enumerate([a, b, *long])}
    ids = collections.defaultdict(list)
    for r in sorted(packing.pack(docs, tokens.default_tokenizer(), keep_ids=True).collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] += np.frombuffer(r["ids"], dtype="<u4").tolist()
    assert ids == {i: [*library_ids(t), 2] for i, t in enumerate([a, b, *long])}
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs.filter("doc_id < 2")).collect()} == {0: 0, 1: 1}
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs.filter("doc_id < 2")).collect()} == {0}
    assert suffix_dedup.repeated_spans(docs.filter("doc_id < 2")).count() == 0
