"""What makes two records one topic: names by which they are compared, aliases of these, keys they merge by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.topic_names import is_low_info
from ..functions.unicode import nfkc
from .store import written

#: Other names of a topic (name, alias).
ALIASES = [
    ("street fighter", "스트리트 파이터"), ("street fighter", "스트리트파이터"), ("street fighter", "스파"),
    ("olivia rodrigo", "올리비아 로드리고"), ("olivia rodrigo", "올리비아로드리고"),
    ("godzilla minus", "고질라 마이너스"), ("godzilla minus", "고질라마이너스"),
    ("bts hooligan", "bts 훌리건"), ("bts hooligan", "방탄 훌리건"), ("bts hooligan", "방탄소년단 훌리건"),
]
#: What isn't a name.
URL_LIKE, PLACEHOLDER, LEAST = "(?i)(https?://|www\\.|/r/|submitted by|please read)", "(?i)^globaltopic[0-9]+$", 5


def bare(x: Column) -> Column:
    """Normalised, in lower case, without punctuation, symbols and white space; null counts as empty."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(x, F.lit("")))), "[\\p{P}\\p{S}\\s]+", "")


def closure(aliases: DataFrame) -> DataFrame:
    """alias, root for every name of (name, alias): the name at the end of the chain of names of names.

    All pointers jump twice as far in each round, so chains of any length take their logarithm.  Names
    that stand for one another in a circle have the least of them for root.  An alias of several names stands for
    the least; a name that is nobody's alias is its own root.  Names are compared bare; empty ones are left out.
    """
    x = aliases.select(bare(F.col("name")).alias("name"), bare(F.col("alias")).alias("alias")).filter("name <> '' and alias <> ''")
    step = x.filter("name <> alias").groupBy("alias").agg(F.min("name").alias("root"))
    ends = x.select(F.col("name").alias("alias")).union(x.select("alias")).distinct().join(step.select("alias"), "alias", "left_anti")
    at = written(step.union(ends.select("alias", F.col("alias").alias("root"))).withColumn("low", F.least("alias", "root")))
    n, reach = at.count(), 1
    while reach < n:  # root: the name `reach` steps on; low: the least name of these steps
        on = at.select(F.col("alias").alias("root"), F.col("root").alias("next"), F.col("low").alias("ahead"))
        at = written(at.join(on, "root").select("alias", F.col("next").alias("root"), F.least("low", "ahead").alias("low")))
        reach *= 2
    # After so many steps each pointer is at an end or in a circle, whose least name is that of any round trip.
    last = at.select(F.col("alias").alias("root"), F.col("low").alias("_low"))
    done = last.join(step.select(F.col("alias").alias("root")).withColumn("_moves", F.lit(True)), "root", "left")
    return at.join(done.select("root", F.when(F.col("_moves"), F.col("_low")).otherwise(F.col("root")).alias("of")), "root").select("alias", F.col("of").alias("root"))


def with_identity(rows: DataFrame, roots: DataFrame, en: str = "name_en", ko: str = "name_ko", to: str = "identity") -> DataFrame:
    """Adds the identity of each row: what its English or its Korean name is an alias of, else the bare name."""
    x = rows.withColumns({"_en": bare(F.col(en)), "_ko": bare(F.col(ko))})
    for c in ("_en", "_ko"):
        x = x.join(roots.select(F.col("alias").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    first = F.coalesce("_en_root", "_ko_root", F.nullif(F.col("_en"), F.lit("")), F.nullif(F.col("_ko"), F.lit("")))
    return x.withColumn(to, first).drop("_en", "_ko", "_en_root", "_ko_root")


def telling(x: Column) -> Column:
    """The bare form of a name that can tell topics apart; null for addresses, placeholders and short ones."""
    b = bare(x)
    return F.when(x.isNotNull() & ~x.rlike(URL_LIKE) & (F.length(b) >= LEAST) & ~b.rlike(PLACEHOLDER), b)


def scope_identity(canonical: Column, *candidates: Column) -> Column:
    """What a topic is compared by across scopes: its canonical name if that tells, else the first candidate that
    says something in either language and tells."""
    says = [F.when(~(is_low_info(c, "ko") & is_low_info(c, "en")), telling(c)) for c in candidates]
    return F.coalesce(telling(canonical), *says)


def merge_key(id_: Column, canonical: Column, parts: list[Column], rest: list[Column]) -> Column:
    """The key that rows of one topic share: id, else canonical name, else region, names and period, else numbers."""
    key = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(c.cast("string"), F.lit("")))), "\\s+", " ")), F.lit(""))
    composite = F.nullif(F.concat_ws("|", *(key(p) for p in parts)), F.lit(""))
    numbers = F.concat_ws("|", *(F.coalesce(key(r), F.lit("")) for r in rest))
    return F.coalesce(F.concat(F.lit("id:"), id_.cast("string")), F.concat(F.lit("canonical:"), key(canonical)), F.concat(F.lit("composite:"), composite), F.concat(F.lit("generated:"), numbers))
