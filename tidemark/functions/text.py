"""Text normalisation, tokens, phrases and lexicon scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholder names once punctuation is gone.
PLACEHOLDER = "^(globaltopic|regiontopic|topic|issue)?[0-9]*$"


def key(x: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.lower(F.trim(F.regexp_replace(x, "\\s+", " ")))


def bare(x: Column) -> Column:
    """Lower case without punctuation, symbols and white space."""
    return F.regexp_replace(F.lower(x), "[\\p{P}\\p{S}\\s]+", "")


def is_placeholder(x: Column) -> Column:
    return bare(x).rlike(PLACEHOLDER) | F.lower(x).rlike("^https?://")


def clean_input(x: Column) -> Column:
    """Without addresses, entities and zero-width characters."""
    x = F.regexp_replace(x, "https?://\\S+|&[a-zA-Z]+;|&#[0-9]+;", " ")
    return F.regexp_replace(x, "[\\u200b-\\u200f\\ufeff]", "")


def clamp(x: Column, most: int, mark: str = "...") -> Column:
    """Trimmed, and cut with a mark where it is longer."""
    t = F.trim(x)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - len(mark)), F.lit(mark))).otherwise(t)


def lexicon_score(x: Column, positive: list[str], negative: list[str]) -> Column:
    """(hits - misses) / (hits + misses) by presence of each term; null without any."""
    hits = sum((F.lower(x).contains(t).cast("int") for t in positive), F.lit(0))
    misses = sum((F.lower(x).contains(t).cast("int") for t in negative), F.lit(0))
    s = (hits - misses) / F.greatest(hits + misses, F.lit(1))
    s = s + F.when(x.contains("!"), F.when(s > 0, 0.05).when(s < 0, -0.05).otherwise(0.0)).otherwise(0.0)
    return F.when(hits + misses > 0, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)), 3))


def error_code(message: Column) -> Column:
    """A short code for an error message."""
    m = F.lower(F.trim(message))
    status = F.regexp_extract(m, "(?:status(?: code)?[ :]*|http[ _]?)([1-5][0-9]{2})", 1)
    return F.when(m.isNull() | (m == ""), F.lit(None)).when(status != "", F.concat(F.lit("http_"), status)).when(m.contains("timeout") | m.contains("timed out"), "timeout").when(m.contains("robots"), "robots_disallow").when(m.contains("no items"), "no_items_parsed").otherwise(F.substring(F.split(m, "[\\s:]+")[0], 1, 40))


def first_sentence(x: Column, most: int = 200) -> Column:
    return F.substring(F.trim(F.split(x, "(?<=[.!?。])\\s*")[0]), 1, most)


def external_id(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 32)
