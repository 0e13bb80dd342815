"""Titles into clean titles, tokens and phrases, by region and source, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import nfkc

# Words that are no terms, in every region and by region.
STOP = (
    "the and for with that this from have has was were will about into https http www com net org co amp news issue topic update video shorts live reddit "
    "youtube youtu thread post official breaking latest watch report says said new more today music mv trailer episode director producer production release "
    "released stream subscribe channel follow group final people you your what when where who why how not just lol lmao omg wow credit credits full clip "
    "album single title track preview teaser coming out version ver content contents related major headline highlights digest summary recap breakingnews "
    "clickbait shocking exclusive controversy viral legend 速報 話題 炎上 震惊 重磅 独家 热议 충격 섬뜩 미쳤다 미친 만행 레전드 논란 속보 단독 입수 폭로 주요 관련 콘텐츠 핫이슈"
).split()
REGIONAL = {
    "kr": "오늘 어제 내일 지금 이슈 반응 영상 사진 정리 요약 공식 공개 발매 진행 베스트 조회수 추천 댓글 실시간 주요 관련 콘텐츠 핫이슈 및 등".split(),
    "jp": "今日 昨日 明日 速報 話題 反応 動画 画像 写真 公式 公開 発売 感想 まとめ".split(),
    "cn": "今天 昨天 明天 热搜 话题 视频 图片 官方 发布 直播 网友 评论 整理 总结 热议".split(),
}
# Labels that open a title without saying anything, and endings of Korean words.
LABELS = "충격 섬뜩 미쳤다 미친 만행 레전드 논란 속보 단독 입수 공개 폭로 衝撃 速報 緊急 悲報 炎上 話題 徹底 震惊 重磅 独家 最新 热议".split()
ENDINGS = "에서 으로 에게 까지 부터 보다 처럼 하고 이나 나 은 는 이 가 을 를 에 의 로 와 과 도 만".split()
# Tokens that are noise, years, dates.
NOISE = "^(?:img|jpg|jpeg|png|gif|webp|fyp|lol+|lmao|haha+|www+)$|^[0-9]+$|^(?:19|20)[0-9]{2}$|^(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])$"
# Code points of emoji (first and last of each range), and how much a region's script weighs.
EMOJI = (
    "a9 a9 ae ae 203c 203c 2049 2049 2122 2122 2139 2139 2194 2199 21a9 21aa 231a 231b 2328 2328 2388 2388 23cf 23cf 23e9 23f3 23f8 23fa 24c2 24c2 25aa 25ab 25b6 25b6 25c0 25c0 25fb 25fe "
    "2600 2605 2607 2612 2614 2685 2690 2705 2708 2712 2714 2714 2716 2716 271d 271d 2721 2721 2728 2728 2733 2734 2744 2744 2747 2747 274c 274c 274e 274e 2753 2755 2757 2757 2763 2767 2795 2797 "
    "27a1 27a1 27b0 27b0 27bf 27bf 2934 2935 2b05 2b07 2b1b 2b1c 2b50 2b50 2b55 2b55 3030 3030 303d 303d 3297 3297 3299 3299 1f000 1f0ff 1f10d 1f10f 1f12f 1f12f 1f16c 1f171 1f17e 1f17f 1f18e 1f18e "
    "1f191 1f19a 1f1ad 1f1e5 1f201 1f20f 1f21a 1f21a 1f22f 1f22f 1f232 1f23a 1f23c 1f23f 1f249 1f3fa 1f400 1f53d 1f546 1f64f 1f680 1f6ff 1f774 1f77f 1f7d5 1f7ff 1f80c 1f80f 1f848 1f84f 1f85a 1f85f "
    "1f888 1f88f 1f8ae 1f8ff 1f90c 1f93a 1f93c 1f945 1f947 1faff 1fc00 1fffd"
).split()
SCRIPTS = {"kr": ("[\\p{IsHangul}]", 1.4, 0.7), "jp": ("[\\p{IsHiragana}\\p{IsKatakana}\\p{IsHan}]", 1.4, 0.72), "cn": ("[\\p{IsHan}]", 1.4, 0.72)}

#: What stands at the edges of titles without meaning.
EDGE = "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in zip(EMOJI[::2], EMOJI[1::2], strict=True)) + "\\s~!?.:,;|/\\-·•…]+"
ROUNDS, TAIL = 6, 64
#: Tokens that need no tidying, and parts of texts that are none.
SIMPLE, SHORT = "^(?!(?:img|jpg|jpeg|png|gif|webp|fyp|lol+|lmao|haha+|www+)\\z)[a-z]{3,40}\\z", "^[a-z]{0,2}\\z"


def clean_title(title: Column, source: Column | None = None) -> Column:
    """The title without bracketed parts, site suffixes, symbols at its edges, and labels that open it.

    Labels are taken off one by one, ROUNDS at most.  Titles of sources named youtube_... lose two suffixes more.
    """
    x = nfkc(title)
    for wrapped in ("【[^】]*】", "\\[[^\\]]*]", "(?iu)\\(\\s*(?:공식|official)\\s*\\)", "\\|\\s*공식(?=[A-Za-z0-9_])", "(?i)-\\s*YouTube(?![A-Za-z0-9_])", "(?i)#shorts(?![A-Za-z0-9_])"):
        x = F.regexp_replace(x, wrapped, " ")
    if source is not None:
        tube = F.lower(source).startswith("youtube_")
        x = F.when(tube, F.regexp_replace(F.regexp_replace(x, "(?i)\\|\\s*shorts?(?![A-Za-z0-9_])", " "), "(?i)-\\s*topic(?![A-Za-z0-9_])", " ")).otherwise(x)
    x = F.trim(_edges(x))
    label = f"(?iu)^\\s*(?:(?:\\[[^\\]]*\\]|\\([^)]+\\)|【[^】]+】)?\\s*)?(?:{'|'.join(LABELS)})[\\s:：\\-|·!！?？,，。.…~]+"
    for _ in range(ROUNDS):
        x = F.ltrim(F.regexp_replace(x, label, ""))
    return F.trim(F.regexp_replace(_edges(x), "\\s+", " "))


def _edges(x: Column) -> Column:
    def right(t: Column) -> Column:
        # Of a long text only the end is searched, if what is to go surely begins there (before the last line end, in which $ may match).
        cut = lambda c: F.regexp_replace(c, f"{EDGE}$", "")
        end = F.substring(t, -TAIL, TAIL)
        short = F.concat(F.substring(t, F.lit(1), F.length(t) - TAIL), cut(end))
        return F.when((F.length(t) > TAIL) & F.substring(end, 1, TAIL - 2).rlike("[A-Za-z0-9]"), short).otherwise(cut(t))

    # A one-element array binds what is used more than once.
    return F.get(F.transform(F.array(F.regexp_replace(x, f"^{EDGE}", "")), right), F.lit(0))


def stopped(token: Column, region: Column) -> Column:
    """Whether a token is a stop word of its region."""
    out = token.isin(STOP)
    for r, words in REGIONAL.items():
        out = out | ((region == r) & token.isin(words))
    return F.coalesce(out, F.lit(False))


def tokens(title: Column, region: Column, source: Column | None = None) -> Column:
    """The tokens of a title (cleaned if its source is given): runs of one script in lower case, Korean endings
    cut where two characters stay, without noise, numbers, years, stop words and what is too short or long."""
    x = F.lower(clean_title(title, source) if source is not None else nfkc(title))
    x = F.regexp_replace(x, "https?://\\S+|&[a-z0-9#]+;|[\u200b-\u200d\ufeff#@]", " ")
    parts = F.split(x, "[\\s,.;:!?()\\[\\]{}\"'`~…|\\\\/<>+=*_]+")
    runs = lambda p: F.regexp_extract_all(p, F.lit("[\\p{IsHangul}]+|[\\p{IsHan}]+|[\\p{IsHiragana}]+|[\\p{IsKatakana}]+|[a-z0-9][a-z0-9._-]*"), 0)
    tidy = lambda t: F.regexp_replace(F.regexp_replace(t, "[^\\p{L}\\p{N}]+$", ""), "-{2,}", "-")
    stem = lambda t: F.regexp_replace(t, f"^([\\p{{IsHangul}}]{{2,}}?)(?:{'|'.join(ENDINGS)})$", "$1")

    def keep(t: Column) -> Column:
        n = F.length(F.regexp_replace(t, "[^\\p{L}\\p{N}]", ""))
        return (n >= F.when(t.rlike("^[a-z]"), F.lit(3)).otherwise(F.lit(2))) & (n <= 40) & ~t.rlike(NOISE) & ~stopped(t, region)

    # Plain lower-case words, most of a text, take a short way (no region's own stop words are among them).
    none = F.array().cast("array<string>")
    words = lambda p: F.filter(F.transform(runs(p), lambda t: stem(tidy(t))), keep)
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(SIMPLE), F.when(p.isin(STOP), none).otherwise(F.array(p))).when(p.rlike(SHORT), none).otherwise(words(p))))


def phrases(words: Column, region: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of low to high words with two at least that aren't stop words, none of these a single
    character; 5 to 48 characters, joined by spaces."""

    def of(n: int) -> Column:
        last = F.size(words) - n + 1
        runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(words, i, n))
        return F.when(last >= 1, runs).otherwise(F.array().cast("array<array<string>>"))

    def telling(run: Column) -> Column:
        said = F.filter(run, lambda w: ~stopped(w, region))
        return (F.size(said) >= 2) & ~F.exists(said, lambda w: F.length(w) < 2)

    runs = F.filter(F.flatten(F.array(*(of(n) for n in range(low, high + 1)))), telling)
    return F.filter(F.transform(runs, lambda r: F.array_join(r, " ")), lambda p: F.length(p).between(5, 48))


def script_multiplier(token: Column, region: Column) -> Column:
    """How much a token weighs by its script: more in the region's own, less in Latin letters there."""
    out = F.lit(1.0)
    for r, (own, more, less) in SCRIPTS.items():
        out = F.when(region == r, F.when(token.rlike(own), F.lit(more)).when(token.rlike("[a-z]"), F.lit(less)).otherwise(F.lit(1.0))).otherwise(out)
    return out
