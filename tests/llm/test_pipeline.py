"""Each stage of the pipeline, and the whole, against brute force over awkward rows."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_operators import T, U, WORD, classes
from tidemark.llm import language_id, mixing, tokens

#: The columns of documents, and some whose names the stages use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, rank int, grp string, size string, mark long, kept boolean, shard int, place string, n long"
MORE = ("k", 1, "g", "s", 5, True, 9, "p", 4)


def rows():
    r = random.Random(11)
    words = {"aa": ["the", "thing", "other", "with", "weather", "again", "under"], "bb": ["queso", "perro", "gatito", "calle", "noche", "mesa"]}
    vocab = {x: sorted({"".join(r.choices("".join(w), k=r.randint(3, 7))) for _ in range(300)} | set(w)) for x, w in words.items()}
    made = [(i, " ".join(r.choices(vocab[x], k=r.randint(3, 120))), x, f"s{i % 3}", 0) for i in range(90) for x in [("aa", "bb")[i % 2]]]
    made[10] = (10, made[4][1].replace(" ", "\n\n"), "aa", None, 0)  # an exact copy, longer than what it copies
    made[13] = (13, made[15][1], "bb", "s9", 1)
    long = r.choices(vocab["aa"], k=9000)
    made[20] = (20, " ".join(long), "aa", "s0", 0)
    made[22] = (22, " ".join([*long[:-1], "under"]), "aa", "s1", 0)  # a near copy
    made += [(1, made[3][1], "bb", "s1", 0), (1, "c d with other thing weather", "aa", "s1", 0), (None, made[3][1], None, None, None), (None, made[3][1], None, None, None)]
    made += [(2, made[3][1].replace(" ", "  ", 3), None, "s2", 0), made[40], made[40], (None, "again under the weather", None, None, None), (None, "again under the weather", None, None, None)]
    made += [(95, None, "aa", "s1", 0), (96, "", "bb", None, 0), (97, " \t\n", None, "s2", 0), (98, "12 34 !!", None, "s2", 0), (99, "жук щука " * 30, None, "s2", 0)]
    made += [(100 if i is None else 100 + i, t, None, "s0", 0) for i, t in ((1, T), (5, T + " q"), (5, U), (7, U + " q"), (7, U + " q"))]
    return [(*x, *MORE) for x in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)



def unique(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        t = r[1] or ""
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), r[0] is None, r[0] or 0))
    best = {k: min(g) for k, g in groups.items()}
    left = {}
    for r in rows:  # which of several rows with the best key stays is left open by the contract; content decides
        t = r[1] or ""
        k = re.sub(r"[\x20\x09-\x0D]+", "", t)
        if (-len(t), r[0] is None, r[0] or 0) == best[k]:
            left.setdefault(k, set()).add(r)
    return left


def test_language_stage(spark, docs, empty):
    got = collections.Counter(map(tuple, pipeline.known_language(spark, docs, "").collect()))
    every = collections.Counter(rows())
    gone = every - got
    assert not got - every  # all columns, all repeats
    assert {r[0] for r in gone} >= {95, 96, 97, 98, 99}  # no letters, or of no language
    assert not any(r[2] and WORD.findall(r[1] or "") for r in gone)  # nothing clean goes
    assert pipeline.known_language(spark, empty, "").collect() == []
    plain = [r for r in rows() if r[2]]
    model = language_id.train(language_id.sample(docs))
    assert model.languages == ["aa", "bb"] and len(plain) > 80


def test_exact_stage(spark, docs, empty):
    got = [tuple(r) for r in pipeline.exact_copies(spark, docs.repartition(3), "").collect()]
    left = unique(rows())
    assert len(got) == len(left) and all(sum(g in x for g in got) == 1 for x in left.values())
    assert pipeline.exact_copies(spark, empty, "").collect() == []


def test_exact_stage_loses_no_text(spark):
    made = [(1, "a b"), (1, "c d"), (None, "a b"), (None, "a b"), (2, "a  b")]
    got = pipeline.exact_copies(spark, spark.createDataFrame(made, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == [(1, "c d"), (2, "a  b")]


def near(rows):
    """Brute force: of each class the row with the least id, none last."""
    label, _ = classes(rows)
    left = collections.defaultdict(set)
    for r, x in zip(rows, label, strict=True):
        left[x].add(r)
    return [{r for r in g if (r[0] is None, r[0] or 0) == min((q[0] is None, q[0] or 0) for q in g)} for g in left.values()]


def test_near_stage(spark, docs, empty):
    made = rows()
    got = collections.Counter(map(tuple, pipeline.near_copies(spark, docs, "").collect()))
    wordless = collections.Counter({r: 1 for r in made if not WORD.findall(r[1] or "")})
    assert {r: got[r] for r in wordless} == wordless
    want = near([r for r in made if r not in wordless])
    worded = [r for r in got if r not in wordless]
    assert all(got[r] == 1 for r in worded) and len(worded) == len(want)
    assert all(sum(r in g for r in worded) == 1 for g in want)
    assert pipeline.near_copies(spark, empty, "").collect() == []


def test_mixing_stage(spark, docs, empty):
    made = rows()
    got = pipeline.mixture(spark, docs, "").collect()
    assert got[0].__fields__[-2:] == ["_shard", "_place"]  # the table has columns of those names
    copies = collections.Counter(tuple(g)[: len(made[0])] for g in got)
    taken, size, most = collections.Counter(), collections.Counter(), collections.Counter()
    words = {r: len(WORD.findall(r[1] or "")) for r in made}
    for r, k in collections.Counter(made).items():
        taken[r[3]] += copies[r] * words[r]
        size[r[3]] += k * words[r]
        most[r[3]] = max(most[r[3]], k * words[r])
        assert copies[r] <= 3 * k
    assert not set(copies) - set(made)
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert all(abs(taken[s] - target[s]) <= most[s] for s in size)
    assert pipeline.mixture(spark, empty, "").collect() == []


def whole_texts(pieces, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    lengths = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in texts)
    got = collections.Counter()
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert got == collections.Counter({k: k[1] * n for k, n in lengths.items()})
    ends = collections.defaultdict(list)
    for p in pieces:
        ends[p["sequence_id"]].append((p["offset"], p["offset"] + p["length"]))
    for x in ends.values():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False))


def test_packing_stage(spark, docs, empty):
    whole_texts(pipeline.packed(spark, docs, "").collect(), [r[:2] for r in rows()])
    assert pipeline.packed(spark, empty, "").collect() == []


def test_whole_pipeline(spark, tmp_path):
    made = [r[:5] for r in rows()]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(made, plain).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    step = [r for r in made if r[0] not in {95, 96, 97, 98, 99}]
    ids = collections.Counter()
    for g in near([min(x, key=lambda r: (str(r[2:]))) for x in unique(step).values()]):
        ids[next(iter(g))[0]] += 1
    assert {p["doc_id"] for p in got} <= set(ids)
    assert len({p["doc_id"] for p in got}) > 0.5 * len(ids)
    spark.createDataFrame([], plain).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).collect() == []
    assert np.all([p["length"] > 0 for p in got])
