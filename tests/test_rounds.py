"""Choices in rounds against the loops that they stand for."""

import collections
import random

from pyspark.sql import functions as F

from tidemark.operators import rounds


def loop_stays(rows):
    """rows: (key, rank, held tokens, tokens looked at)."""
    kept = []
    for k, _, holds, looks in sorted(rows, key=lambda r: r[1]):
        if not any(holds2 & looks for _, holds2 in kept):
            kept.append((k, holds))
    return {k for k, _ in kept}


def test_first_stays(spark):
    """500 small sets at once, cliques by token and edges between tokens, and one token that all rows hold."""
    r, rows = random.Random(4), []
    for s in range(500):
        edges = {(f"{s}:e{a}", f"{s}:e{b}") for a, b in (r.sample(range(12), 2) for _ in range(r.randint(0, 10)))}
        ranks = r.sample(range(1000), 12)
        for i in range(12):
            holds = {f"{s}:t{x}" for x in r.sample(range(9), r.randint(0, 2))} | {f"{s}:e{i}"} | ({f"{s}:all"} if s % 100 == 0 else set())
            looks = holds | {b for a, b in edges if a == f"{s}:e{i}"} | {a for a, b in edges if b == f"{s}:e{i}"}
            rows.append((s * 100 + i, ranks[i] + s * 1000, holds, looks))
    side = lambda j: spark.createDataFrame([(x[0], x[1], t) for x in rows for t in sorted(x[j])], "key long, rank long, token string")
    assert {x["key"] for x in rounds.first_stays(side(2), side(3)).collect()} == loop_stays(rows)
    assert rounds.first_stays(side(2).limit(0), side(3).limit(0)).count() == 0


def test_first_stays_on_a_chain(spark):
    """Each row sees the one before it: every second one stays."""
    holds = spark.range(9).selectExpr("id as key", "id as rank", "cast(id as string) as token")
    looks = holds.union(spark.range(1, 9).selectExpr("id", "id", "cast(id - 1 as string)")).union(spark.range(8).selectExpr("id", "id", "cast(id + 1 as string)"))
    assert sorted(x["key"] for x in rounds.first_stays(holds, looks).collect()) == [0, 2, 4, 6, 8]


def loop_pairs(pairs):
    used, out = set(), set()
    for b, l, r, *_ in sorted(pairs, key=lambda p: (-p[3], p[4] is None, -(p[4] or 0), p[5], p[1], p[2])):
        if (b, "l", l) not in used and (b, "r", r) not in used:
            used |= {(b, "l", l), (b, "r", r)}
            out.add((b, l, r))
    return out


def test_dominant_pairs(spark):
    r = random.Random(8)
    pairs = {}
    for _ in range(3000):
        b, l, x = r.choice([None, "a", *(f"b{i}" for i in range(60))]), r.randint(0, 9), r.randint(0, 9)
        pairs[b, l, x] = (b, l, x, r.choice([0.5, 0.6, 0.7]), r.choice([None, 0.1, 0.2]), r.randint(0, 3))
    table = spark.createDataFrame(list(pairs.values()), "block string, l long, r long, score double, cosine double, lag long")
    got = rounds.dominant_pairs(table, "block", "l", "r", [("score", False), ("cosine", False), ("lag", True)])
    assert got.columns == table.columns
    assert {(x["block"], x["l"], x["r"]) for x in got.collect()} == loop_pairs(list(pairs.values()))
    assert got.count() == len(loop_pairs(list(pairs.values())))
    assert rounds.dominant_pairs(table.limit(0), "block", "l", "r", [("score", False)]).count() == 0


def test_dominant_pairs_that_tie(spark, monkeypatch):
    r = random.Random(4)
    # In "all", every pair ties; in "some" and None, many do, but each row lacks some; "days" has groups that tie only within.
    pairs = [("all", i, j, 1.0, None, 0) for i in range(40) for j in range(30)]
    pairs += [(b, i, j, r.choice([0.5, 0.6]), None, r.randint(0, 1)) for b in ("some", None) for i in range(14) for j in range(14) if r.random() < 0.6]
    pairs += [("days", i, 100 - j, 0.9, 0.5, abs(i % 3 - j % 4)) for i in range(24) for j in range(20)]
    table = spark.createDataFrame(pairs, "block string, l long, r long, score double, cosine double, lag long")
    order = [("score", False), ("cosine", False), ("lag", True)]
    got = rounds.dominant_pairs(table, "block", "l", "r", order)
    assert sorted((str(x["block"]), x["l"], x["r"]) for x in got.collect()) == sorted((str(b), l, x) for b, l, x in loop_pairs(pairs))
    calls, kept = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda *a: calls.append(1) or kept(*a))
    tied = rounds.dominant_pairs(table.filter("block in ('all', 'days')"), "block", "l", "r", order)
    assert tied.count() == 50 and len(calls) <= 20  # a loop in rounds of one pair each would write over 30 times


ALIAS = {"aa": "root", "root": "root"}


def loop_fold(items):
    """The fold as a loop: (key, rank, en, ko, ids)."""
    norm = lambda s: "".join(c for c in (s or "").lower() if c.isalnum())

    def identity(en, ko):
        return ALIAS.get(norm(en)) or ALIAS.get(norm(ko)) or norm(en) or norm(ko)

    longer = lambda a, b: b if not a else a if not b else b if len(b) > len(a) else a
    groups, out = [], {}
    for key, _, en, ko, ids in sorted(items, key=lambda x: x[1]):
        mine = identity(en, ko)
        for g in groups:
            if (mine and mine == identity(g["en"], g["ko"])) or g["ids"] & set(ids or []):
                g["en"], g["ko"], g["ids"] = longer(g["en"], en), longer(g["ko"], ko), g["ids"] | set(ids or [])
                out[key] = g["founder"]
                break
        else:
            groups.append({"founder": key, "en": en, "ko": ko, "ids": set(ids or [])})
            out[key] = key
    return out


def folded(spark, items):
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    alias = lambda c: F.element_at(F.create_map(*(F.lit(x) for kv in ALIAS.items() for x in kv)), c)
    t = spark.createDataFrame(items, "key long, rank long, en string, ko string, ids array<long>").repartition(3)
    t = t.withColumn("en_key", bare(F.col("en"))).withColumn("ko_key", bare(F.col("ko")))
    t = t.withColumn("alias_en", alias(F.col("en_key"))).withColumn("alias_ko", alias(F.col("ko_key")))
    return {x["key"]: x["founder"] for x in rounds.fold_groups(t).collect()}


def test_fold_groups(spark, seed=1):
    """Many small sets apart from one another: names by case and length, both languages, ids that chain."""
    r, items = random.Random(seed), []
    for s in range(150):
        ranks = r.sample(range(100), 7)
        for i in range(7):
            name = lambda: r.choice(["", None, f"s{s} x", f"S{s}-X", f"s{s} longer y", f"s{s} z", f"s{s}  X !"])  # noqa: B023, E731
            items.append((s * 100 + i, s * 100 + ranks[i], name(), name(), r.choice([None, [], [s * 50 + r.randint(0, 20)], [s * 50 + r.randint(0, 20), s * 50 + r.randint(0, 20)]])))
    assert folded(spark, items) == loop_fold(items)


def test_fold_groups_of_aliases_and_one_name(spark):
    """A name that most bear takes few rounds, though ids tie some of its items to others."""
    r = random.Random(6)
    items = [(i, i, r.choice(["Hot name", "hot NAME"]), None, [i] if i % 5 else [1000 + i % 7]) for i in range(300)]
    items += [(400 + i, 400 + i, f"other {i % 3}", None, [r.randint(0, 300)]) for i in range(20)]
    items += [(500, 3, "aa", None, None), (501, 900, None, "Root", None), (502, 901, "zzz", "AA", None), (503, 902, None, None, None), (504, 903, None, None, [])]
    assert len({x[1] for x in items}) < len(items)  # ranks repeat here ...
    items = [(k, n, *rest) for n, (k, _, *rest) in enumerate(sorted(items, key=lambda x: (x[1], x[0])))]
    got = folded(spark, items)
    assert got == loop_fold(items)
    assert collections.Counter(got.values()).most_common(1)[0][1] >= 300
