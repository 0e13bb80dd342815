"""Summaries and display names of topics where no model has given good ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings that judge, and neutral ones for them, in order.
TONE_KO = [
    ("주목받고\\s+있습니다", "언급되고 있습니다"),
    ("주목받고\\s+있다", "언급되고 있다"),
    ("확산되고\\s+있습니다", "여러 반응에서 언급됩니다"),
    ("확산되고\\s+있다", "여러 반응에서 언급된다"),
    ("관련\\s+논의가\\s+이어지고\\s+있습니다", "관련 언급이 이어집니다"),
    ("관련\\s+논의가\\s+이어지고\\s+있다", "관련 언급이 이어진다"),
    ("논의가\\s+이어지고\\s+있습니다", "관련 언급이 이어집니다"),
    ("논의가\\s+이어지고\\s+있다", "관련 언급이 이어진다"),
    ("관심이\\s+유지되고\\s+있습니다", "언급이 이어집니다"),
    ("관심이\\s+유지되고\\s+있다", "언급이 이어진다"),
    ("큰\\s+반응을\\s+얻고\\s+있습니다", "반응이 확인됩니다"),
    ("큰\\s+반응을\\s+얻고\\s+있다", "반응이 확인된다"),
]
TONE_EN = [
    ("(?i)\\bis drawing attention\\b", "is being discussed"),
    ("(?i)\\bis continuing\\b", "remains under discussion"),
    ("(?i)\\bis surging\\b", "has increased in mentions"),
    ("(?i)\\bis spreading across regions\\b", "appears across multiple regional feeds"),
    ("(?i)\\bspread(?:ing)? quickly across communities\\b", "appeared across multiple communities"),
    ("(?i)\\bspreading across communities\\b", "appearing across multiple communities"),
    ("(?i)\\bgaining major attention\\b", "appearing more frequently in current coverage"),
    ("(?i)\\bdrawing strong reactions\\b", "producing visible reactions"),
]
#: Summaries that stand for none, and openings of summaries that only list keywords.
PENDING = ["요약 준비 중", "summary pending"]
META = ["현재 게시글에서는", "current posts mention"]


def tidy(x: Column) -> Column:
    """Single spaces, trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(x, "\\s+", " ")), F.lit(""))


def clipped(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…"))).otherwise(x)


def toned(x: Column, tone: list[tuple[str, str]]) -> Column:
    for pattern, neutral in tone:
        x = F.regexp_replace(x, pattern, neutral)
    return x


def told(x: Column) -> Column:
    """The summary if it says something, else null."""
    t = tidy(x)
    low = F.lower(t)
    empty = low.isin(PENDING)
    for opening in META:
        empty = empty | low.startswith(opening)
    return F.when(~empty, t)


def _listed(items: Column, most: int, between: str) -> Column:
    """The first different items, joined; null without any."""
    kept = F.filter(F.transform(items, tidy), lambda t: t.isNotNull())
    low = F.transform(kept, F.lower)
    kept = F.filter(kept, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return F.nullif(F.array_join(F.slice(kept, 1, most), between), F.lit(""))


def _first(items: Column) -> Column:
    return F.get(F.filter(F.transform(items, tidy), lambda t: t.isNotNull()), F.lit(0))


def topic_summary(summary: Column, tone: list[tuple[str, str]], entities: Column, titles: Column, keywords: Column, name: Column, most: int = 120) -> Column:
    """The toned summary, else named entities, else the first title, else keywords, else the name.

    entities: array of struct(text, type); those of type `other` don't count.
    """
    named = F.transform(F.filter(entities, lambda e: F.coalesce(e["type"], F.lit("other")) != "other"), lambda e: e["text"])
    title = F.nullif(F.regexp_replace(_first(titles), "^[\"'“”‘’]+(.*[^\"'“”‘’])[\"'“”‘’]+$", "$1"), F.lit(""))
    return F.coalesce(toned(told(summary), tone), *(clipped(x, most) for x in (_listed(named, 3, ", "), title, _listed(keywords, 3, " · "), tidy(name))))


def narrative(summary: Column, titles: Column, keywords: Column, otherwise: str, most: int = 120) -> Column:
    """The summary's first sentence, else the first title, else three keywords, else a fixed text."""
    sentence = _first(F.split(told(summary), "[.!?。！？]\\s*"))
    return clipped(F.coalesce(sentence, _first(titles), _listed(keywords, 3, " · "), F.lit(otherwise)), most)


def display_name(name: Column, telling: Column, entities: Column, keywords: Column, region: Column, key: Column) -> Column:
    """struct(name, fallback): the name if it is telling, else an entity, those of a known type first, else two keywords, else region and id."""
    known = F.filter(entities, lambda e: F.coalesce(e["type"], F.lit("other")) != "other")
    texts = F.transform(F.concat(F.coalesce(known, F.slice(entities, 1, 0)), entities), lambda e: e["text"])
    serial = F.concat_ws(" ", region, F.concat(F.lit("topic #"), F.coalesce(key.cast("string"), F.lit("?"))))
    keep = F.coalesce(telling, F.lit(False)) & tidy(name).isNotNull()
    instead = F.coalesce(_first(texts), _listed(keywords, 2, " · "), serial)
    return F.struct(F.when(keep, tidy(name)).otherwise(instead).alias("name"), (~keep).alias("fallback"))
