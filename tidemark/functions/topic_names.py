"""Names that say what a topic is about, put together from all that is known of it.

A name is judged by the share of its tokens that carry meaning; one that says little gives way to the first
better one among summary, entities with keywords, titles, and keywords.  The judgement is a small
function of one string, applied in Arrow batches to distinct inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .naming import TONE_EN, TONE_KO

# Words, openings, endings and patterns that names are judged and cut by.
PENDING = {"summary pending", "topic signal", "signals for", "요약 준비 중", "분석 중"}
SAYS_LITTLE = set(
    "issue issues topic topics update updates summary digest headline headlines news major related today breaking shocking exclusive viral controversy discussion discussions "
    "요약 토픽 소식 뉴스 속보 헤드라인 오늘 주요 관련 current posts post coverage mention mentions keyword keywords together submitted provided comments comment read reading please "
    "watch watching listen listening first going around days day month months old cost years year experience should back now weekend sub pro point two 현재 게시글 키워드 함께 언급".split()
)
ARTICLES = set("a an and as at by for from in into of on or the to with".split())
EVENTS_KO = "공개 발표 출시 인상 인하 계약 협상 조사 수사 선고 논의 논란 공방 우려 보도 발언 회담 선거 총선 시위 파업 판결 규제 제재 유출 복귀 업데이트 개편 폐지 반발 분쟁 매각 상장 승인 취소 소송 할인 강화 약세 강세".split()
EVENTS_EN = "announcement launch release reveal deal contract agreement debate dispute controversy policy tariff election report lawsuit investigation protest strike approval delay ban update leak merger acquisition recall outage boycott filing shutdown reform plan talks dealings pricing".split()
META_KO = ("현재 수집된 반응", "현재 수집된 게시글", "현재 게시글", "대표 제목", "핵심 키워드", "핵심 엔티티")
META_EN = ("current coverage mentions", "current posts mention", "a representative title references", "collected posts related to", "key entities mentioned", "recurring keywords include")
FLAGS = "🌐 🇰🇷 🇺🇸 🇯🇵 🇨🇳 🇪🇺 🇮🇳 🇧🇷 🇷🇺".split()
ENDING_KO = "(?:다|요|합니다|됩니다|있습니다|한다|된다|중이다|하고 있다|되고 있다|이어지고 있다|확산되고 있다|주목받고 있다|언급된다|언급되고 있다)$"
VERB_EN = r"\b(?:is|are|was|were|be|been|being|has|have|had|continues?|continued|continuing|draws?|drawing|surges?|surged|surging|spreads?|spread|spreading|accelerates?|accelerated|accelerating|rises?|rose|rising|falls?|fell|falling|faces?|facing|remains?|remaining|grows?|growing|builds?|building|expands?|expanding|prompts?|prompted|prompting|sparks?|sparked|sparking|fuels?|fueled|fueling)\b"
CUTS_KO = ("^(?:논의|보도|반응|언급) +", r" *(?:이후|후|가운데|속에|여파로)\b.*$", " *(?:이|가|은|는)? *(?:논의가 +이어지고 +있다|주목받고 +있다|확산되고 +있다|언급되고 +있다|언급된다).*$", ENDING_KO)
CUTS_EN = ("^(?:discussion|conversation|coverage|signals?|talk) +(?:around|about|on|of|for) +", "^(?:debate|questions?|concerns?) +(?:around|about|over) +", "^(?:a|an|the) +", r" +\b(?:after|amid|as|while|when|following|because|with)\b.*$", VERB_EN)

ASCII = re.ASCII | re.IGNORECASE
OPENING = re.compile(r"^[\[(][^\])]{1,18}[\])]\s*")
LABEL = re.compile(r"^(?:속보|라이브\s*업데이트|live|update)\s*[:\-|]\s*", re.IGNORECASE)
PLACEHOLDER = re.compile(rf"^region\s+[a-z]{{2}}\s+topic\s+\d+$|^(?:{'|'.join(FLAGS)})\s*(?:토픽|topic)\s*#?\d+", ASCII)
BETWEEN = re.compile(r"[\s/|,:;()\[\]{}'\"`~!@#$%^&*+=?.-]+")
SENTENCE = re.compile("(?<=[.!?。！？])\\s+")
STOP, QUOTES, HANGUL, LATIN = ".!?。！？", "\"'“”‘’", re.compile("[가-힣]"), re.compile("[A-Za-z]")
RELATED = re.compile(r"(.+?)\s+(?:관련\s+(?:이슈|논의)|related\s+(?:issue|discussion))$", re.IGNORECASE)
WINDOW = 8


def norm(x: str | None) -> str:
    return " ".join(normalize("NFKC", x or "").split())


def bare(x: str | None) -> str:
    """Without a bracketed opening and a label before it."""
    return norm(LABEL.sub("", OPENING.sub("", norm(x), 1), 1))


def tokens(x: str) -> list[str]:
    """Tokens without immediate repeats."""
    out: list[str] = []
    for t in BETWEEN.split(x):
        if t and (not out or out[-1].lower() != t.lower()):
            out.append(t)
    return out


def unstopped(x: str) -> str:
    return norm(norm(x).rstrip(STOP))


@dataclass(frozen=True)
class Tongue:
    """What a language asks of a name."""

    code: str
    events: list[str]
    meta: tuple[str, ...]
    cuts: tuple[re.Pattern, ...]
    sentence: re.Pattern
    least_words: int
    least_length: int

    def has_event(self, x: str) -> bool:
        x = norm(x)
        return any(e in (x if self.code == "ko" else x.lower()) for e in self.events)

    def is_event(self, token: str) -> bool:
        return any(e in token for e in self.events) if self.code == "ko" else token.lower() in self.events

    def is_sentence(self, x: str) -> bool:
        x = unstopped(x)
        return bool(x) and len(tokens(x)) >= self.least_words and bool(self.sentence.search(x))

    def is_low(self, x: str | None) -> bool:
        """Whether a name says too little."""
        x = one_script(bare(x))
        words = tokens(x)
        telling = [w for w in words if w.lower() not in SAYS_LITTLE and not (self.code == "en" and w.lower() in ARTICLES) and len(w) >= self.least_length]
        if not telling or x.lower() in PENDING or PLACEHOLDER.search(x):
            return True
        if self.code == "ko":
            return (len(words) == 1 and len(x) <= 8) or (len(words) == 2 and all(len(w) <= 2 for w in words) and not self.has_event(x))
        return (len(words) == 1 and len(words[0]) <= 10) or (len(telling) / len(words) < 0.5 and not self.has_event(x))

    def unrelated(self, x: str) -> str:
        """Without a closing 'related issue' of this language."""
        m = RELATED.search(x)
        return m[1].strip() if m and bool(HANGUL.search(x[m.end(1) :])) == (self.code == "ko") else x

    def clip(self, x: str) -> str:
        """Eight tokens at most, up to the first event among them where there is one."""
        words = tokens(norm(x))
        if len(words) <= WINDOW:
            return norm(x)
        end = next((i for i, w in enumerate(words) if self.is_event(w)), 0)
        return " ".join(words[: end + 1 if 1 <= end < WINDOW else WINDOW])

    def shown(self, x: str) -> str:
        return x[:1].upper() + x[1:] if self.code == "en" else x

    def general(self, x: str | None) -> str:
        return self.shown(norm(self.clip(unstopped(self.unrelated(one_script(bare(x)))))))

    def lead(self, x: str) -> str:
        """What a sentence is about: its first clause without openings, endings and verbs."""
        x = unstopped(re.split(r"\s*[|:;]\s*", norm(x).strip(QUOTES))[0])
        for cut in self.cuts:
            x = cut.sub("", x, 1)
        return unstopped(x)

    def label(self, x: str | None, base: str = "") -> str:
        """A neutral name from a name, sentence or title; from `base`, if there is one, where it says too little."""
        x = self.lead(self.unrelated(one_script(bare(x))))
        if x and bool(HANGUL.search(x)) != bool(LATIN.search(x)) and bool(HANGUL.search(x)) != (self.code == "ko"):
            return EN.label(x, base) if self.code == "ko" else self.general(base)
        x = "" if norm(x).lower().startswith(self.meta) else self.shown(norm(self.clip(x)))
        if not x:
            return self.general(base)
        if self.has_event(x) or (not self.is_low(x) and len(tokens(x)) > 2):
            return x
        return self.general(base or x)


KO = Tongue("ko", EVENTS_KO, META_KO, tuple(re.compile(c, re.ASCII) for c in CUTS_KO), re.compile(ENDING_KO), 2, 2)
EN = Tongue("en", EVENTS_EN, META_EN, tuple(re.compile(c, ASCII) for c in CUTS_EN), re.compile(VERB_EN, ASCII), 3, 3)
TONES = {"ko": [(re.compile(a), b) for a, b in TONE_KO], "en": [(re.compile(a, re.ASCII), b) for a, b in TONE_EN]}


def one_script(x: str) -> str:
    """Hangul or Latin alone where both occur, unless it is a sentence."""
    x = norm(x)
    hangul, latin = len(HANGUL.findall(x)), len(LATIN.findall(x))
    if not hangul or not latin or KO.is_sentence(x) or EN.is_sentence(x):
        return x
    return norm(re.sub("[^가-힣0-9 ]" if hangul >= latin * 0.5 else "[^A-Za-z0-9 ]", " ", x))


def _keywords(words: Iterable[str], t: Tongue) -> list[str]:
    """The first four different ones that say something."""
    out: dict[str, str] = {}
    for w in map(one_script, map(bare, words)):
        if w.lower() not in SAYS_LITTLE and not t.is_low(w):
            out.setdefault(w.lower(), norm(w))
    return list(out.values())[:4]


def primary_entity(entities: list[tuple[str, str]]) -> str:
    """The first entity of a kind, else the first."""
    named = [(one_script(bare(x)), kind or "other") for x, kind in entities]
    return next((x for x, kind in named if x and kind != "other"), next((x for x, _ in named if x), ""))


def _from_summary(x: str | None, t: Tongue) -> str:
    x = norm(x)
    first = "" if x.lower() in PENDING else SENTENCE.split(x)[0].strip()
    for pattern, neutral in TONES[t.code]:
        first = pattern.sub(neutral, first)
    first = norm(first)
    return "" if not first or first.lower() in PENDING or first.lower().startswith(t.meta) else t.label(first)


def _from_entity(entity: str, words: list[str], t: Tongue) -> str:
    if not entity:
        return ""
    words = [w for w in words if w.lower() not in entity.lower()]
    event = next((w for w in words if t.has_event(w)), next((w for w in words if len(tokens(w)) >= 2), None))
    return t.label(f"{entity} {event}", entity) if event else t.general(entity)


def _from_keywords(words: list[str], t: Tongue) -> str:
    event = next((w for w in words if t.has_event(w)), None)
    return t.label(event or " ".join(words[:2])) if words else ""


def better(old: str, new: str, t: Tongue) -> bool:
    """Whether a candidate says more than a name that isn't bad: an event, or more words for a short one."""
    old, new = norm(old), norm(new)
    if not old or not new or old.lower() == new.lower():
        return False
    if t.unrelated(old) != old and not t.is_low(new):
        return True
    if t.has_event(new) and not t.has_event(old):
        return True
    a, b = len(tokens(old)), len(tokens(new))
    return b > a and ((a <= 2 and b <= WINDOW) or (len(old) <= (10 if t.code == "ko" else 24) and len(new) > len(old)))


def resolved(t: Tongue, own: str | None, other: str | None, summary: str | None, entities: list[tuple[str, str]], titles: list[str], keywords: list[str]) -> tuple[str, str, bool, bool]:
    """name, source, whether the given name says little, whether another was put in its place."""
    raw, entity, words = one_script(bare(own)), primary_entity(entities), _keywords(keywords, t)
    labels = (t.label(x) for x in map(one_script, map(bare, titles)) if x)
    offers = [(_from_summary(summary, t), "summary"), (_from_entity(entity, words, t), "entities"), (next((x for x in labels if x and not t.is_low(x)), ""), "sample_title"), (_from_keywords(words, t), "keywords")]
    name = t.label(raw, entity)
    if name and not t.is_low(name):
        found = next(((bare(x), s) for x, s in offers if better(name, x, t)), (name, "existing"))
    else:
        u = EN if t.code == "ko" else KO
        there = u.label(one_script(bare(other)), entity)
        found = next(((bare(x), s) for x, s in offers if bare(x) and not t.is_low(bare(x))), None)
        found = found or ((bare(there), "existing") if bare(there) and not u.is_low(bare(there)) else (name or there, "existing" if name or there else "empty"))
    return (*found, t.is_low(raw), found[0] != raw)


RESULT = "name_ko string, name_en string, source_ko string, source_en string, low_ko boolean, low_en boolean, upgraded_ko boolean, upgraded_en boolean"


def names_of(row: dict) -> tuple:
    """Both names of one topic; each stands in where the other is empty."""
    entities = [(e["text"], e["type"]) for e in (row["entities"] if row["entities"] is not None else []) if e is not None]
    titles, keywords = ([x for x in (row[c] if row[c] is not None else [])] for c in ("titles", "keywords"))
    ko = resolved(KO, row["name_ko"], row["name_en"], row["summary_ko"], entities, titles, keywords)
    en = resolved(EN, row["name_en"], row["name_ko"], row["summary_en"], entities, titles, keywords)
    return (ko[0] or en[0], en[0] or ko[0], ko[1], en[1], ko[2], en[2], ko[3], en[3])


def is_low_info(x: Column, code: str = "ko") -> Column:
    """Whether a name says too little in a language ('ko' or 'en'); null and empty do."""
    t = KO if code == "ko" else EN

    def work(s: pd.Series) -> pd.Series:
        return s.map(lambda v: t.is_low(None if pd.isna(v) else v))

    return F.pandas_udf(work, BooleanType())(x.cast("string"))


INPUT = {"name_ko": "string", "name_en": "string", "summary_ko": "string", "summary_en": "string", "titles": "array<string>", "keywords": "array<string>", "entities": "array<struct<text string, type string>>"}


def with_names(topics: DataFrame, key: str = "id") -> DataFrame:
    """topics with name_ko and name_en resolved, and source, low and upgraded of each (for storage: a name
    that nothing could better or replace is kept as it was).

    topics: key and the columns of INPUT, of which all but the key may be missing or null.  What is resolved
    are the distinct inputs; their names are joined back by a digest of all of them.
    """
    given = {c: (F.col(c) if c in topics.columns else F.lit(None)).cast(kind.replace("<text string, type string>", "<text:string,type:string>")) for c, kind in INPUT.items()}
    sign = F.sha2(F.to_json(F.struct(*(c.alias(k) for k, c in given.items())), {"ignoreNullFields": "false"}), 256)
    x = topics.withColumn("_sign", sign)
    once = x.select("_sign", *(c.alias(k) for k, c in given.items())).dropDuplicates(["_sign"])

    def work(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [names_of(r) for r in b.to_dict("records")]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            out.insert(0, "_sign", b["_sign"].to_numpy())
            yield out

    names = once.mapInPandas(work, f"_sign string, {RESULT}")
    kept = {c: F.coalesce(F.nullif(F.col(f"_new.{c}"), F.lit("")), given[c]) for c in ("name_ko", "name_en")}
    names = names.select("_sign", F.struct(*(c.split()[0] for c in RESULT.split(", "))).alias("_new"))
    joined = x.join(names, "_sign").drop("_sign")
    more = {c: F.col(f"_new.{c}") for c in (c.split()[0] for c in RESULT.split(", ")) if not c.startswith("name")}
    return joined.withColumns(kept | more).drop("_new")
