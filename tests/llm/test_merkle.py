"""op12 against a tree that is built whole, and its paths against what they must fold to."""

import collections
import hashlib
import random
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import compare  # noqa: E402

from tidemark.llm import merkle, queries  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, pos string, leaf map<string,int>"


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def levels_of(leaves):
    """All levels of one tree, the leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, i):
    found = []
    for nodes in levels[:-1]:
        run = i - i % 3
        found.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        i //= 3
    return found


def brute(rows):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels_of([leaf(r, r[4]) for r in groups[s]])
    trunk = levels_of([trees[s][-1][0] for s in names])
    out = collections.Counter()
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = path_of(trees[s], i) + path_of(trunk, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in path:
                folded = digest(left + folded + right)
            out[r[0], trees[s][0][i], trees[s][-1][0], trunk[-1][0], digest("".join(a + b for a, b in path)), folded, folded == trunk[-1][0]] += 1
    return out


def rows(n, seed=2):
    r = random.Random(seed)
    base = [(i, r.choice(["a", "b", "é", "zz", "", None]) if i % 3 else "hot", r.choice(["en", None]), r.choice([None, 5]), r.choice(["x\ny", "plain", "", None, "語\n\n" * 50]), "g", "p", {"k": i}) for i in range(n)]
    return [*base, base[0], base[0], (None, "a", None, None, "t\n", None, None, None), (None, None, None, None, None, None, None, None), (3, "hot", None, None, "other", None, None, None), (4, "lone", "en", 1, "only\none", None, None, None)]


def found(docs, levels=7):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.tampered_check(docs, levels).collect())


@pytest.mark.parametrize("levels", [7, 1, 2])
def test_manifest(spark, levels):
    """With blocks of three and nine leaves a tree has several levels of blocks, the one over the groups too."""
    table = rows(130)
    assert found(spark.createDataFrame(table, SCHEMA).repartition(3), levels) == brute(table)


def test_small_tables(spark):
    assert merkle.tampered_check(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, None, None, None, "a\nb", None, None, None)]
    got = merkle.tampered_check(spark.createDataFrame(one, SCHEMA)).first()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == digest("")
    assert found(spark.createDataFrame(one, SCHEMA)) == brute(one)


@pytest.mark.parametrize("layer", [1, 2, 3, 9])
def test_fractal_traversal(monkeypatch, layer):
    """Every path of every size of block, and no layer holding more than two subtrees."""
    monkeypatch.setattr(merkle, "LAYER", layer)
    for n in [*range(1, 30), 81, 82, 243, 700]:
        leaves = [digest(str(i)) for i in range(n)]
        tree = levels_of(leaves)
        raw = [x.encode() for x in leaves]
        got = [[(a.decode(), b.decode()) for a, b in p] for p in merkle.paths(raw, merkle.height(n))]
        assert got == [path_of(tree, i) for i in range(n)]
        assert merkle.block_root(raw, merkle.height(n)).decode() == tree[-1][0]


def test_lone_nodes_climb_where_the_group_goes_on():
    """A block of one leaf behind full ones is hashed at every level of the block."""
    up = digest(digest("x"))
    assert merkle.block_root([digest("x").encode()], 2).decode() == digest(up)
    assert list(merkle.paths([digest("x").encode()], 2)) == [[(b"", b"")] * 2]


def test_twin(spark):
    assert compare(spark, queries.op12_merkle_manifest, queries.SQL["op12_merkle_manifest"], "/root/testdata/sf0.01") == ""
