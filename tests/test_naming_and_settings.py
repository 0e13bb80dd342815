"""Summaries, names and settings on small inputs."""

from pyspark.sql import functions as F

from tidemark.functions import naming
from tidemark.operators.settings import applied

KIND = "summary string, entities array<struct<text:string,type:string>>, titles array<string>, keywords array<string>, name string"


def test_summaries(spark):
    rows = [
        ("OpenAI pricing debate is drawing attention.", None, None, ["OpenAI"], None, "OpenAI pricing debate is being discussed."),
        ("Summary pending", [("OpenAI", "org"), ("GPT-5", "product"), ("noise", "other")], None, None, None, "OpenAI, GPT-5"),
        (None, [("noise", "other")], None, ["대선", "토론", "대선", "여론"], None, "대선 · 토론 · 여론"),
        ("", None, ['"A title in quotes"'], ["x"], None, "A title in quotes"),
        ("요약 준비 중", None, None, None, " a  name ", "a name"),
        ("Current posts mention the keywords a · b together.", None, ["B 'C' MV"], ["a"], None, "B 'C' MV"),
        (None, None, [None, " "], [], None, None),
    ]
    got = spark.createDataFrame([r[:5] for r in rows], KIND).select(naming.topic_summary(F.col("summary"), naming.TONE_EN, F.col("entities"), F.col("titles"), F.col("keywords"), F.col("name")).alias("s")).collect()
    assert [g["s"] for g in got] == [r[5] for r in rows]
    korean = spark.range(1).select(naming.toned(F.lit("OpenAI 관련 논의가 이어지고 있습니다."), naming.TONE_KO).alias("s")).first()["s"]
    assert korean == "OpenAI 관련 언급이 이어집니다."


def test_narrative(spark):
    rows = [("First one. Second.", None, None, None, None), ("? !", None, ["a title"], None, None), (None, None, None, ["a", "", "b"], None), (None, None, None, None, None), ("x" * 200, None, None, None, None)]
    got = [r["s"] for r in spark.createDataFrame(rows, KIND).select(naming.narrative(F.col("summary"), F.col("titles"), F.col("keywords"), "nothing yet").alias("s")).collect()]
    assert got == ["First one", "a title", "a · b", "nothing yet", "x" * 119 + "…"]


def test_display_name(spark):
    rows = [("A good name", True, [("e", "org")], ["k"], 1), ("x", False, [("noise", "other"), ("Real", "org")], ["k"], 2), ("x", False, [("noise", "other")], ["k"], 3), (None, True, None, ["k", "l", "m"], 4), ("x", None, None, None, 5)]
    frame = spark.createDataFrame(rows, "name string, ok boolean, entities array<struct<text:string,type:string>>, keywords array<string>, id long")
    got = [tuple(r["d"]) for r in frame.select(naming.display_name(F.col("name"), F.col("ok"), F.col("entities"), F.col("keywords"), F.lit("kr"), F.col("id")).alias("d")).collect()]
    assert got == [("A good name", False), ("Real", True), ("noise", True), ("k · l", True), ("kr topic #5", True)]


def test_settings(spark):
    settings = spark.createDataFrame([("cap", "5.0", 1), ("mode", "slow", 1)], "key string, value string, updated_at long")
    kinds = spark.createDataFrame([("cap", "number"), ("mode", "text"), ("on", "boolean")], "key string, kind string")
    changes = spark.createDataFrame([("cap", " 7 ", "ann", 2), ("cap", "9", " ", 3), ("cap", "many", "bob", 4), ("on", "YES", "bob", 2), ("off", "1", "bob", 2), ("on", "no", "bob", None)], "key string, value string, actor string, changed_at long")
    after, trail, refused = applied(settings, kinds, changes)
    assert {tuple(r) for r in after.collect()} == {("cap", "9.0", 3), ("mode", "slow", 1), ("on", "true", 2)}
    assert {tuple(r) for r in trail.collect()} == {("cap", "5.0", "7.0", "ann", 2), ("cap", "7.0", "9.0", "unknown", 3), ("on", None, "true", "bob", 2)}
    assert {(r["key"], r["value"], r["reason"]) for r in refused.collect()} == {("cap", "many", "invalid value"), ("off", "1", "unknown key"), ("on", "no", "no time")}
    assert all(x.isEmpty() for x in applied(settings.limit(0), kinds, changes.limit(0)))
