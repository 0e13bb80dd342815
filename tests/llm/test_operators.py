"""The ten operators against brute force on small fixtures with the awkward cases in them."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, language_id, mixing, near_dedup, packing, pii, substring_dedup, suffix_dedup, tokens, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, size string, rank string"


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choices(vocab, k=70))
    texts = [" ".join(r.choices(vocab, k=r.randint(1, 260))) for _ in range(n)]
    texts[5] = texts[4] + " " + passage
    texts[9] = passage + " " + texts[8]
    texts[12] = texts[11].replace(" ", "\n ")
    long = r.choices(vocab, k=300)
    texts[20] = " ".join(long)
    long[150] = "changed"
    texts[21] = " ".join(long)
    texts[30:33] = [None, "", " \t\n"]
    texts[33] = "x" * 30000
    texts[34] = "é " * 3000
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 17 == 0 else f"src{i % 4}", 0, "a", "b", "c") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[6], None, None, 0, "a", "b", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i if i is not None else 0))
    for bits in (256, 8):  # with 8 bits digests collide, and bytes must tell
        got = exact_dedup.exact_dedup(docs, digest_bits=bits).collect()
        assert len(got) == len(rows)
        text = {i: t for i, t, *_ in rows}
        for g in got:
            own = groups[norm(text[g["doc_id"]])]
            assert g["group_size"] == len(own) and g["keep_id"] == min(own)[2]
            assert g["text_sha256"] == hashlib.sha256(norm(text[g["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_moves_texts_of_hits_only(spark):
    rows = [(i, "".join(hashlib.sha256(f"{i % 1990}:{k}".encode()).hexdigest() for k in range(64))) for i in range(2000)]  # 8 MB, ten texts twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("text", F.when(F.col("doc_id") >= 1995, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    source = exact_dedup.materialise(exact_dedup.feed(docs, "doc_id", "text", 256))
    state = exact_dedup.run_state(source)

    def moved():
        of = spark.sparkContext
        stages = of._jsc.sc().statusStore().stageList(None, False, False, of._gateway.new_array(of._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        assert exact_dedup.differing(docs, state, 2000, "text", 256).count() == 0
        assert 0 < moved() - before < 400_000
        # Cut to one byte, the digest of each hit stands for unlike texts, and all of them are told.
        short = state.withColumn("digest", F.substring("digest", 1, 1))
        assert exact_dedup.differing(docs, short, 2000, "text", 8).count() == short.filter("group_size > 1").select("digest").distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_substring_dedup(docs, empty):
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), collections.Counter()
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(a for a, b in zip(w, gone, strict=True) if not b)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    for doublings, size in ((1, 4 << 20), (2, 3000)):
        got = substring_dedup.remove_repeats(docs, doublings=doublings, chunk_bytes=size).collect()
        assert collections.Counter(tuple(g) for g in got) == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup(docs, empty):
    held = collections.defaultdict(set)
    words = collections.defaultdict(list)
    rows = [*corpus(), (None, corpus()[20][1], None, None, 0, "a", "b", "c"), (None, "n " * 60, None, None, 0, "a", "b", "c"), (None, "m " * 60, None, None, 0, "a", "b", "c")]
    docs = docs.sparkSession.createDataFrame(rows, SCHEMA)
    for n, (i, t, *_) in enumerate(rows):
        i = ("row", n) if i is None else i  # each row without an id is a document of its own
        w = WORD.findall(t or "")
        words[i].append(w)
        for p in range(len(w) - 49):
            held[tuple(w[p : p + 50])].add(i)
    want = {(None if isinstance(i, tuple) else i, j) for i, ws in words.items() for w in ws for p in range(len(w) - 49) if len(held[tuple(w[p : p + 50])]) > 1 for j in range(p, p + 50)}
    for size in (4 << 20, 4000):
        got = suffix_dedup.repeated_spans(docs.repartition(3), chunk_bytes=size).collect()
        assert {(g["doc_id"], j) for g in got for j in range(g["start_word"], g["end_word"])} == want
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_suffix_dedup_of_overlapping_slices(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(150):
        a = r.randrange(100)
        texts.append([f"x{r.random()}" for _ in range(r.randint(0, 30))] + base[a : a + r.randint(35, 75)] + [f"y{r.random()}" for _ in range(r.randint(0, 30))])
    held = collections.defaultdict(set)
    for i, w in enumerate(texts):
        for p in range(len(w) - 49):
            held[tuple(w[p : p + 50])].add(i)
    want = {(i, j) for i, w in enumerate(texts) for p in range(len(w) - 49) if len(held[tuple(w[p : p + 50])]) > 1 for j in range(p, p + 50)}
    got = suffix_dedup.repeated_spans(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string"), chunk_bytes=4000).collect()
    assert {(g["doc_id"], j) for g in got for j in range(g["start_word"], g["end_word"])} == want


def classes(rows, weighted=False):
    """Least id (None if there is none) of the class of each row, by comparing all pairs of texts."""
    items, label = [], list(range(len(rows)))
    for _, t, *_ in rows:
        w = WORD.findall(t or "")
        c = collections.Counter(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else collections.Counter()
        items.append(c if weighted else collections.Counter(set(c)))
    for a in range(len(rows)):
        for b in range(a):
            if items[a] and sum((items[a] & items[b]).values()) >= 0.8 * sum((items[a] | items[b]).values()):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    ids = collections.defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        ids[x].append(r[0])
    return label, [min((i for i in ids[x] if i is not None), default=None) for x in label]


#: Texts that share an id, rows without an id, and repeated rows.
T, U = " ".join(f"t{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
REPEATED = [(1, T), (5, T + " q"), (5, U), (7, U + " q"), (None, T + " r"), (None, "alone " * 9), (None, "alone " * 9), (7, U + " q"), (9, "")]


@pytest.mark.parametrize("weighted", [False, True])
def test_near_dedup(spark, docs, empty, weighted):
    rows = [*corpus(), *((None if i is None else 100 + i, t, None, None, 0, "a", "b", "c") for i, t in REPEATED)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, SCHEMA), weighted=weighted).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r[0], c) for r, c in zip(rows, classes(rows, weighted)[1], strict=True))
    assert near_dedup.near_classes(empty).count() == 0


def test_near_dedup_of_a_hub(spark):
    """One class that holds most texts, among others; and its recall against all pairs, for ids divisible by 50."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(700):
        w = list(base) if i % 3 else [f"x{r.randrange(10**6)}" for _ in range(80)]
        if i % 3:
            w[r.randrange(80)] = f"y{i}"
        rows.append((i, " ".join(w)))
    got = {g["doc_id"]: g["class_id"] for g in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(w[p : p + 5]) for p in range(76)} for i, t in rows for w in [t.split()]}
    pairs = [(a, b) for a in range(0, 700, 50) for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 500 and all(got[a] == got[b] for a, b in pairs)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    common, rest = r.integers(1, 1 << 62, 800, dtype=np.uint64), r.integers(1, 1 << 62, 400, dtype=np.uint64)
    a, b = np.concatenate([common, rest[:200]]), np.concatenate([common, rest[200:]])
    row = np.repeat([0, 1], [1000, 1000])
    s = near_dedup.dart_signatures(row, np.concatenate([a, b]), 2, 1000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06
    w = np.ones(2000)
    w[:800] = w[1000:1800] = 2.5
    s = near_dedup.dart_signatures(row, np.concatenate([a, b]), 2, 1000, w)
    assert abs((s[0] == s[1]).mean() - 2000 / 2400) < 0.06


def test_mixing(docs, empty):
    rows = corpus()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for g in got:
        size[g["source"]] += g["size"]
        taken[g["source"]] += g["taken"]
        target[g["source"]] = g["target"]
        largest[g["source"]] = max(largest[g["source"]], g["size"])
        assert g["taken"] <= 3 * g["size"]
    assert sum(size.values()) == sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    want, open_, left = {}, set(order), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            break
        for s in full:
            want[s] = 3 * size[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= largest[s]  # whole texts are taken
    again = mixing.mix(docs.repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    shards = mixing.shard_mix(docs, shards=4).collect()
    assert len(shards) == sum(g["copies"] for g in got) and {s["shard"] for s in shards} <= {0, 1, 2, 3}
    assert mixing.mix(empty).count() == 0


def test_mixing_deals_shards(spark, docs, empty, tmp_path, monkeypatch):
    import corpus_pipeline
    from tidemark.llm import queries

    monkeypatch.setattr(mixing, "BLOCK", 2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(corpus()) and all(g["taken"] == g["size"] * len(g["shards"]) and len(g["places"]) == len(g["shards"]) for g in got)
    want = sorted((g["doc_id"] or -1, s, p) for g in got for s, p in zip(g["shards"], g["places"], strict=True))
    assert len({s for _, s, _ in want}) > 4 and {s for _, s, _ in want} <= set(range(16))
    mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    parts = [[tuple(r) for r in p] for p in mixed.select("doc_id", "shard", "place").rdd.glom().collect()]
    assert sorted((d or -1, s, p) for part in parts for d, s, p in part) == want
    assert all([r[1:] for r in part] == sorted(r[1:] for r in part) for part in parts)
    # All copies of a block lie in one shard, and runs follow each other in the order of blocks.
    _, sources = mixing.plan(docs)
    n = {r["source"]: r["n_blocks"] for r in sources.collect()}
    at = (F.col("number") * F.col("n_blocks") + mixing._block(7, F.col("number"))).alias("at")
    held = collections.defaultdict(set)
    for r in mixing._with_source(mixing.shard_mix(docs, shards=4), sources.select("source", "n_blocks")).select("source", "shard", at).collect():
        held[r["source"], r["at"]].add(r["shard"])
    assert max(n.values()) > 4 and all(len(x) == 1 for x in held.values())
    for source in n:
        run = [min(held[k]) for k in sorted(k for k in held if k[0] == source)]
        assert run == sorted(run)
    assert mixing.take(empty).count() == 0


@pytest.mark.parametrize("group", [2, 1024])
def test_split_quotas(spark, group):
    quotas = [(0, 40), (1, 0), (2, 7), (3, 1), (4, 300), (5, 12), (6, 33)]
    got = mixing.split_quotas(spark.createDataFrame(quotas, "rank int, blocks long"), 8, 7, group=group).collect()
    assert len(got) == 8 * len(quotas)
    for rank, blocks in quotas:
        end = 0
        for r in sorted((r for r in got if r["rank"] == rank), key=lambda r: r["shard"]):
            assert r["first"] == end and r["blocks"] >= 0
            end += r["blocks"]
        assert end == blocks
    held = [sum(r["blocks"] for r in got if r["shard"] == s) for s in range(8)]
    assert sum(held) == 393 and max(held) - min(held) <= 1


def test_tokens_and_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    t = Tokenizer.from_file(path)
    texts = [x or "" for _, x, *_ in corpus()]
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = tokens.token_counts(docs, path).collect()
    assert collections.Counter((g["doc_id"], g["n_bytes"], g["n_tokens"], g["over_limit"]) for g in got) == collections.Counter((r[0], len(x.encode()), len(i), len(i) > 2048) for r, x, i in zip(corpus(), texts, ids, strict=True))
    packed = packing.pack(docs, path, keep_ids=True).collect()
    at, whole = collections.defaultdict(list), collections.defaultdict(dict)
    for p in packed:
        at[p["sequence_id"]].append((p["offset"], p["length"]))
        whole[p["doc_id"], p["doc_tokens"]][p["start"]] = bytes(p["ids"])
        assert p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and len(p["ids"]) == 4 * p["length"]
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 4096
    for r, i in zip(corpus(), ids, strict=True):
        parts = whole[r[0], len(i) + 1]
        assert b"".join(parts[s] for s in sorted(parts)) == np.array([*i, 2], dtype="<u4").tobytes()
    assert tokens.token_counts(empty, path).count() == 0 and packing.pack(empty, path).count() == 0


def test_special_strings_and_marks():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    t = Tokenizer.from_file(path)
    chunks = ["a<|endoftext|>b", "\x01", "x\x01y", "don't", "İÉ", "12ab", "́e"]
    flat, n = tokens.library_encode(path)(chunks)
    assert flat.tolist() == [i for c in chunks for i in t.encode(c, add_special_tokens=False).ids]
    assert n.tolist() == [len(t.encode(c, add_special_tokens=False).ids) for c in chunks]


def test_language_id(spark, docs, empty):
    r = random.Random(5)
    words = {"aa": ["the", "thing", "other", "with", "weather"], "bb": ["queso", "perro", "gatito", "calle", "noche"]}
    rows = [(i, " ".join(r.choices(words[x], k=40)), x, "s", 0, "a", "b", "c") for i in range(200) for x in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa", None, 0, "a", "b", "c"), (501, "12 34 !!", "bb", None, 0, "a", "b", "c")]
    got = {g["doc_id"]: g for g in language_id.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(200)) and not any(got[i]["rejected"] for i in range(200))
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[501]["rejected"]
    assert all(0 <= g["score"] <= 1 and g["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    assert language_id.language_id(docs).count() == len(corpus()) and language_id.language_id(empty).count() == 0


def kneser_ney(texts):
    """log p of a letter after a context (a string, "#" for a word's bounds), by the definition of interpolated Kneser-Ney."""
    words = collections.Counter(w for t in texts for w in t.split())
    grams = {n: collections.Counter() for n in range(1, 6)}
    for w, k in words.items():
        x = f"#{w}#"
        for n in range(1, 6):
            for e in range(max(2, n), len(x) + 1):
                grams[n][x[e - n : e]] += k
    count = {5: grams[5]}
    for n in range(4, 0, -1):
        more = collections.Counter(g[1:] for g in grams[n + 1])
        count[n] = {g: (k if n > 1 and g[0] == "#" else max(1, more[g])) for g, k in grams[n].items()}
    discount = {}
    for n in count:
        one, two = (sum(1 for k in count[n].values() if k == m) for m in (1, 2))
        discount[n] = min(0.95, max(0.1, one / max(1, one + 2 * two)))
    letters = len(grams[1])

    def p(context, x):
        n = len(context) + 1
        lower = p(context[1:], x) if n > 1 else 1 / (letters + 1)
        seen = {g: k for g, k in count[n].items() if g[:-1] == context}
        if not seen:
            return lower
        return (max(seen.get(context + x, 0) - discount[n], 0) + discount[n] * len(seen) * lower) / sum(seen.values())

    return lambda word: sum(np.log(p(x[max(0, e - 4) : e], x[e])) for x in [f"#{word}#"] for e in range(1, len(x)))


def test_language_models_by_definition(spark):
    r = random.Random(6)
    texts = [" ".join("".join(r.choices("abcd", k=r.randint(1, 6))) for _ in range(12)) for _ in range(4)]
    model = language_id.train(spark.createDataFrame([("xx", False, t) for t in texts], "lang string, held boolean, text string"))
    want = kneser_ney(texts)
    words = sorted({w for t in texts for w in t.split()})[:25] + ["abcdabcd", "dd", "a"]
    assert model.words(words)[0][:, 0] == pytest.approx([want(w) for w in words], rel=1e-5, abs=1e-4)


def test_every_language_is_learnt(spark):
    """250 languages, words parted by what only some split at, whole long texts, and a wrong label."""
    r = random.Random(8)
    words = {f"l{n:03}": ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(12)] for n in range(250)}
    rows = [(i, "\u3000".join(r.choices(w, k=30)) if i % 2 else " ".join(r.choices(w, k=30)), x) for i, (x, w) in enumerate((x, w) for x, w in words.items() for _ in range(12))]
    rows += [(9000 + i, "щука " * 30, "l000") for i in range(1)] + [(9500, "жук " * 40, None)]
    got = {g["doc_id"]: g for g in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in rows[:3000]) >= 2990 and len({got[i]["lang_pred"] for i in range(3000)}) == 250
    assert got[9500]["rejected"] and sum(got[i]["rejected"] for i in range(3000)) <= 5


def test_pii_grows_with_matches(spark):
    import time

    def seconds(n):
        text = "mail a@b.co 1.2.3.4 " * n
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        got = pii.pii_digest(frame).collect()[0]
        assert got["n_email"] == got["n_ip"] == n and got["spans"].endswith(f"ip:{20 * n - 8}:{20 * n - 1}")
        return time.time() - began

    seconds(100)
    small = seconds(16_000)
    assert seconds(64_000) < 6 * small


def test_pii(spark, docs, empty):
    texts = ["", None, "a@b.com_x@c.org é mail me: é.f@g-h.co.uk", "1.2.3.4.5 300.1.1.1 0001.2.3.04", "card 4785 3805 9239 1139, 4111-1111-1111-1111 4111111111111112", "+49 (0)30 1234-567 and +1 2", "iban GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789 or 123-45-6789", "1 " * 5000, "9" * 20000, "a" * 20000 + "@b"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {g["doc_id"]: g for g in pii.pii_digest(frame).collect()}
    for i, t in enumerate(texts):
        spans = []
        for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
            for m in [] if i == 10 and k == 0 else re.finditer(pattern, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(x if n % 2 == 0 else x * 2 - 9 * (x > 4) for n, x in enumerate(map(int, reversed(d)))) % 10 == 0
                if (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[k]:
                    spans.append((m.start(), k, m.end()))
        text = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), (i, text, got[i]["spans"])
    assert "iban:5:32" in got[6]["spans"] and "ssn:4:15" in got[7]["spans"]
    assert pii.pii_digest(docs).count() == len(corpus()) and pii.pii_digest(empty).count() == 0


@pytest.mark.parametrize("shard_rows", [200, 40])
def test_top_k(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "LEAF_ROWS", 16)
    r = np.random.default_rng(2)
    x = r.normal(size=(903, 8)).round(2)
    x[7] = x[3]
    ids = np.arange(903) - 40
    ids[900:] = 20, 20, 21
    x[901] = x[60]  # the same id and vector as another row; x[900] has that id and a vector of its own
    rows = [(int(i), [float(v) for v in y], 1, 2, 3) for i, y in zip(ids, x, strict=True)]
    rows += [(2000, None, 1, 2, 3), (2020, [float("nan")] * 8, 1, 2, 3), (2040, [None] * 8, 1, 2, 3), (2060, [1.0, 2.0], 1, 2, 3), (None, [1.0] * 8, 1, 2, 3)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, block int, rank int"), k=5, shard_rows=shard_rows).collect()
    q = np.floor(64 * x).astype(int)
    want = collections.Counter()
    for i in np.flatnonzero(ids % 20 == 0):
        s = q @ q[i]
        for rank, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:5]):
            want[int(ids[i]), rank + 1, int(ids[j]), int(s[j])] += 1
    assert collections.Counter(tuple(g) for g in got) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
