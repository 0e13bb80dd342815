"""Aliases of aliases, identities and merge keys on small tables."""

import random

from pyspark.sql import functions as F

from tidemark.operators import identity as I


def walk(pairs):
    """Root of every name by following names one at a time."""
    step = {}
    for name, alias in pairs:
        if name != alias:
            step[alias] = min(step.get(alias, name), name)
    out = {}
    for x in {y for p in pairs for y in p}:
        seen = [x]
        while seen[-1] in step and step[seen[-1]] not in seen:
            seen.append(step[seen[-1]])
        out[x] = min(seen[seen.index(step[seen[-1]]) :]) if seen[-1] in step else seen[-1]
    return out


def test_closure(spark):
    r = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    circle = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("r3", "tail"), ("tail", "tailtail"), ("aatail", "x"), ("x", "aatail")]
    loose = [(f"n{r.randint(0, 30)}", f"n{r.randint(0, 30)}") for _ in range(25)]
    pairs = chain + circle + loose + [("same", "same"), ("two", "one"), ("one", "two")]
    got = {x["alias"]: x["root"] for x in I.closure(spark.createDataFrame([*pairs, ("", "q"), ("!", "z"), (None, "w")], "name string, alias string")).collect()}
    assert got == walk(pairs)
    assert I.closure(spark.createDataFrame([], "name string, alias string")).count() == 0


def test_identity(spark):
    roots = I.closure(spark.createDataFrame(I.ALIASES, "name string, alias string"))
    cases = [(1, "Street-Fighter!", None, "streetfighter"), (2, "SF 6", "스트리트 파이터", "streetfighter"), (3, "Other", "x", "other"), (4, "", "한국 이름", "한국이름"), (5, None, None, None), (6, "Ｓｔｒｅｅｔ Ｆｉｇｈｔｅｒ", "", "streetfighter")]
    t = spark.createDataFrame(cases, "id int, name_en string, name_ko string, want string")
    got = I.with_identity(t, roots)
    assert {r["id"]: r["identity"] for r in got.collect()} == {c[0]: c[3] for c in cases} and got.columns[-1] == "identity"


def test_scope_identity(spark):
    cases = [("Harbour strike", None, None, "harbourstrike"), ("https://x.y", "Topic", "US tariff debate", "ustariffdebate"), ("abc", "", "submitted by me", None), ("GlobalTopic 12", "한국 파업 협상 결과", None, "한국파업협상결과"), (None, None, None, None)]
    t = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, a string, b string, want string")
    got = t.orderBy("i").select(I.scope_identity(F.col("c"), F.col("a"), F.col("b")), "want").collect()
    assert [r[0] for r in got] == [r["want"] for r in got]


def test_merge_key(spark):
    cases = [(7, "x", "kr", "N", 1.0, "id:7"), (None, " Some  Name ", "kr", "N", 1.0, "canonical:some name"), (None, "", "KR", "My  Name", 1.0, "composite:kr|my name"), (None, None, None, " ", 2.5, "generated:2.5")]
    t = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, id long, canonical string, region string, name string, heat double, want string")
    got = t.orderBy("i").select(I.merge_key(F.col("id"), F.col("canonical"), [F.col("region"), F.col("name")], [F.col("heat")]), "want").collect()
    assert [r[0] for r in got] == [r["want"] for r in got]
