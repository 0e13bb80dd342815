"""Names from evidence: the cases that define them, and the whole table against the function row by row."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import topic_names as N

CASES = [
    (dict(name_ko="드래곤볼", name_en="Dragon Ball", summary_ko="드래곤볼 신작 게임 공개 이후 팬덤에서 복귀 기대와 캐릭터 라인업 추측이 언급된다.", summary_en="Conversation about a new Dragon Ball game reveal surged after the trailer landed. Fans are debating the roster and the scale of the comeback.", titles=["드래곤볼 신작 게임 공개 분석"], keywords=["dragon ball", "game reveal"], entities=[("Dragon Ball", "work")]), "드래곤볼 신작 게임 공개", "New Dragon Ball game reveal", True),
    (dict(name_ko="드래곤볼", name_en="Dragon Ball", keywords=["fandom", "returning cast"], entities=[("Dragon Ball", "work")]), "Dragon Ball returning cast", "Dragon Ball returning cast", True),
    (dict(name_ko="Nct wish 관련 이슈", name_en="Nct wish related issue", summary_ko="현재 게시글에서는 ode · nct · provided 키워드가 함께 언급된다.", summary_en="Current posts mention the keywords ode · nct · provided together.", titles=["NCT WISH 엔시티 위시 'Ode to Love' MV"], keywords=["ode", "nct", "provided"]), "NCT WISH Ode to Love MV", "NCT WISH Ode to Love MV", True),
    (dict(name_ko="드래곤볼", name_en="Dragon Ball", summary_ko="드래곤볼 신작 게임 공개 이후 팬덤에서 복귀 기대와 전투 시스템 분석이 언급되고 있습니다.", summary_en="Discussion around a new Dragon Ball game reveal accelerated after the first trailer dropped. Fans are focusing on the comeback angle and battle system changes.", keywords=["dragon ball", "game reveal", "bandai namco"]), "드래곤볼 신작 게임 공개", "New Dragon Ball game reveal", True),
    (dict(name_ko="닌텐도", name_en="Nintendo", keywords=["launch timing", "price debate", "supply outlook"], entities=[("Nintendo Switch 2 launch timing", "product")]), "Nintendo Switch 2 launch timing", "Nintendo Switch 2 launch timing", True),
    (dict(name_ko="미국 관세 인상 논의", name_en="US Tariff Increase Debate", summary_ko="추가 관세 인상 가능성이 제기되면서 수입 물가와 공급망 영향이 함께 언급됩니다.", keywords=["dragon ball", "game reveal", "bandai namco"]), "미국 관세 인상 논의", "US Tariff Increase Debate", False),
]
SCHEMA = "id long, " + ", ".join(f"{c} {k}" for c, k in N.INPUT.items())


def given(x):
    return {c: x.get(c) for c in N.INPUT}


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_cases(case):
    x = given(case[0])
    x["entities"] = [dict(text=a, type=b) for a, b in x["entities"] or []]
    got = N.names_of(x)
    assert got[:2] == case[1:3]
    assert got[6:] == (case[3], case[3])


def test_low_info(spark):
    cases = [("", True, True), (None, True, True), ("뉴스", True, True), ("Topic", True, True), ("Region kr topic 12", True, True), ("🌐 토픽 #3", True, True), ("요약 준비 중", True, True), ("삼성전자 파업 협상", False, True), ("US tariff debate", False, False), ("[단독] 속보: 뉴스", True, True), ("the of and to", False, True), ("ab", True, True)]
    got = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "i int, x string").select("i", N.is_low_info(F.col("x"), "ko").alias("ko"), N.is_low_info(F.col("x"), "en").alias("en")).orderBy("i").collect()
    assert [(r["ko"], r["en"]) for r in got] == [c[1:] for c in cases]


def test_with_names(spark):
    rows = [(i, *(given(c[0])[k] for k in N.INPUT)) for i, c in enumerate(CASES * 3)] + [(99, None, None, None, None, None, None, None), (100, "", "x", None, None, [], [None], [])]
    got = {r["id"]: r for r in N.with_names(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, c in enumerate(CASES * 3):
        assert (got[i]["name_ko"], got[i]["name_en"], got[i]["upgraded_en"]) == c[1:]
    assert got[99]["name_ko"] is None and got[99]["source_ko"] == "empty" and got[99]["low_en"]
    assert N.with_names(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.with_names(spark.createDataFrame([(1, "only")], "id long, name_en string")).first()["source_en"] == "existing"


def test_query_against_the_function(spark):
    """The registered query over its whole table, row by row."""
    from tidemark.plans import choices

    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    got = {r["id"]: r for r in choices.f16(table).collect()}
    rows = choices.pages(table).collect()
    assert len(got) == len(rows)
    for r in rows:
        x = dict(name_ko=r["name_ko"], name_en=r["name_en"], summary_ko=None, summary_en=None, titles=[r["name_ko"]], keywords=r["keywords"], entities=[dict(text=e, type="other") for e in r["entities"]])
        want = N.names_of(x)
        assert tuple(got[r["id"]])[1:] == (want[0] or r["name_ko"], want[1] or r["name_en"], *want[2:])
