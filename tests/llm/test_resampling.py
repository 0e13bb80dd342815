"""op11 and op13 against brute force that puts every n-gram together as a string."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import importance, simhash, words

SCHEMA = "doc_id long, text string, score string, rank string, fingerprint long, extra map<string,string>"


def texts(n=90, seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeXYZ09é語", k=r.randint(1, 9))) for _ in range(300)]
    out = [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(n)]
    out[3:7] = [None, "", " \t\n", "one"]
    out[7:10] = ["Two words", "x" * 5000 + "-" + "y" * 129, "\x0b".join(vocab[:40])]
    base = r.choices(vocab, k=400)
    for i in range(10, 40):  # a chain of edits: far ends are linked through the middle only
        base = list(base)
        base[r.randrange(400)] = r.choice(vocab)
        out[i] = " ".join(base)
    return out


def rows():
    t = texts()
    base = [(i, x, "s", "r", 0, {"a": "b"}) for i, x in enumerate(t)]
    return [*base, base[20], (None, t[50], None, None, None, None), (None, t[50], None, None, None, None), (None, None, None, None, None, None), (12, t[60], None, None, None, None)]


def brute_draw(docs, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(t):
        w = word.findall((t or "").translate(fold))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    scored = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    k = len(able) * 5 // 100
    drawn = collections.Counter((*x[::2], x[3], r) for r, x in enumerate(able[:k], 1))
    rest = collections.Counter((*x[::2], x[3], None) for x in able[k:] + [x for x in scored if x[1] < 20])
    return drawn + rest


def test_importance_resample(spark):
    docs, target = rows(), [x for x in texts(40, seed=8)] + [None]
    want = brute_draw([(r[0], r[1]) for r in docs], target)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    for parts in (1, 5):
        got = importance.importance_resample(spark.createDataFrame(docs, SCHEMA).repartition(parts), bench, with_text=True).collect()
        assert collections.Counter((g["doc_id"], g["n_features"], g["score"], g["weight"], g["rank"]) for g in got) == want
        assert sorted(str(g["text"]) for g in got) == sorted(str(r[1]) for r in docs)


def test_importance_resample_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(rows(), SCHEMA)
    assert importance.importance_resample(none, some).count() == 0
    assert importance.importance_resample(some, none).count() == len(rows())
    assert importance.importance_resample(some, some).agg({"weight": "max"}).first()[0] == 0


def test_draw_with_equal_rows(spark):
    """Many rows alike in score and id fill all ranks once, whatever the partitions."""
    t = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(7, t)] * 900 + [(i, t + " x") for i in range(100, 300)], "doc_id long, text string").repartition(6)
    got = importance.importance_resample(docs, docs).collect()
    assert sorted(g["rank"] for g in got if g["rank"]) == list(range(1, 56))


def test_crc_algebra():
    r = random.Random(1)
    raw = [bytes(r.choices(range(0x80, 0x100), k=n)) for n in [1, 2, 3, 47, 48, 49, 63, 64, 65, 4095, 4096, 70000]]
    crc = np.array([zlib.crc32(x) for x in raw], dtype=np.uint32)
    for n in (0, 1, 63, 64, 65, 1000, 123456):
        tail = bytes(r.choices(range(256), k=n))
        got = importance.SHIFT(crc, np.full(len(crc), n, dtype=np.int64)) ^ np.uint32(zlib.crc32(tail))
        assert got.tolist() == [zlib.crc32(x + tail) for x in raw]
    column = pa.array([" ".join("z" * n for n in (1, 47, 48, 49, 200))])
    for _, w in words.slices_of(column, importance.FOLD):
        assert importance.word_crcs(w).tolist() == [zlib.crc32(b"z" * n) for n in (1, 47, 48, 49, 200)]


def brute_prints(docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in docs:
        w = word.findall((t or "").translate(fold))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def brute_components(ids, prints, bits=2):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = collections.defaultdict(lambda: None)
    for i, n in zip(ids, label, strict=True):
        if i is not None and (least[n] is None or i < least[n]):
            least[n] = i
    return [least[n] for n in label]


def test_simhash(spark):
    docs = rows()
    prints = brute_prints([r[:2] for r in docs])
    want = collections.Counter(zip((r[0] for r in docs), (f"{p:016x}" for p in prints), brute_components([r[0] for r in docs], prints), strict=True))
    assert len({c for _, _, c in want}) < len({p for _, p, _ in want})
    for parts in (1, 5):
        got = simhash.simhash_components(spark.createDataFrame(docs, SCHEMA).repartition(parts)).collect()
        assert collections.Counter((g["doc_id"], g["fingerprint"], g["component_id"]) for g in got) == want
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bits_are_added_up_across_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BITS_AT_ONCE", 7)
    t = texts()
    (got,) = (simhash.majority(*simhash.shingle_hashes(w), w.rows) for _, w in words.slices_of(pa.array(t), simhash.LOWER))
    assert got.tolist() == brute_prints(enumerate(t))


@pytest.mark.parametrize("bits", [1, 2])
def test_links_find_every_close_pair(spark, bits):
    """Clusters around few centres, chains and random prints: the same components as comparing all pairs."""
    r = random.Random(11 + bits)
    prints = {0, (1 << 64) - 1, 1, 3, 7, 15, 1 << 63, 3 << 62}
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fingerprint long").repartition(3)
    pairs = [(int(x["u"]) & (1 << 64) - 1, int(x["v"]) & (1 << 64) - 1) for x in simhash.links(table, bits).collect()]
    label = {p: p for p in prints}
    for _ in prints:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    want = brute_components(prints, prints, bits)
    assert [label[p] for p in prints] == want


def test_a_full_bucket(spark):
    """All values of two bytes at once: one component, by no more links than fingerprints a bucket."""
    table = spark.range(0, 1 << 16).selectExpr("id as fingerprint")
    pairs = simhash.links(table, 2)
    assert simhash.components(pairs).agg({"label": "max"}).first()[0] == 0
