"""Heat, bursts, anomalies, propagation and match scores as column expressions.

Numbers in these formulas are fixed values: results must equal those users have today.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c.cast("double")), c).otherwise(F.lit(0)).cast("double")


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def heat(views: Column, likes: Column, comments: Column, dislikes: Column, hours: Column, weight: Column, baseline: Column) -> Column:
    """Heat of one post."""
    engagement = 3.5 * F.log1p(_count(views)) + 26 * F.log1p(_count(likes)) + 30 * F.log1p(_count(comments)) + 14 * F.log1p(_count(dislikes)) + 22 * baseline
    return engagement * F.exp(-0.1 * F.greatest(hours, F.lit(0.0))) * F.greatest(F.lit(0.1), weight)


def diversity_multiplier(n: Column) -> Column:
    return F.least(1 + F.log2(F.greatest(F.lit(1.0), n.cast("double"))), F.lit(2.2))


def news_fallback(base: Column, posts: Column, scope: Column) -> Column:
    return F.when((base <= 0) & (scope == "news"), F.least(F.greatest(120 * F.log1p(posts), F.lit(40.0)), F.lit(420.0))).otherwise(base)


def engagement_weight(views: Column, likes: Column, comments: Column, dislikes: Column) -> Column:
    return 1 + 0.0005 * views + 0.02 * likes + 0.015 * comments + 0.005 * dislikes


def burst_std(mean: Column, std: Column) -> Column:
    return F.greatest(std, F.sqrt(mean + 1))


def burst_boost(z: Column) -> Column:
    return 1 + F.least(z / 4, F.lit(1.5))


def portal_boost(weight: Column) -> Column:
    return F.least(1 + 0.08 * weight, F.lit(1.6))


def anomaly(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, F.round((value - mean) / std, 3) + 0.0)


def display_heat(value: Column, most: Column) -> Column:
    """Batch-relative heat, 0 to 1."""
    return F.when(most > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log10(1 + F.greatest(value, F.lit(0.0))) / F.log10(1 + most))), 4)).otherwise(F.lit(0.0))


def heat_band(ratio: Column) -> Column:
    return F.when(ratio >= 0.72, "high").when(ratio >= 0.35, "medium").otherwise("low")


def heat_level(value: Column) -> Column:
    return F.when(value >= 1000, 4).when(value >= 600, 3).when(value >= 300, 2).when(value >= 100, 1).otherwise(0)


def spread(regions: Column, velocity: Column, most: Column) -> Column:
    zero = F.lit(0.0)
    return F.round(regions * (1 + F.greatest(velocity, zero) / F.greatest(F.lit(1.0), most)), 4)


def lag_minutes(first: Column, second: Column) -> Column:
    """Minutes from first to second, halves towards plus infinity."""
    return F.floor((F.unix_micros(second.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 60e6 + 0.5).cast("long")


def leader(lag: Column, tie: int = 10) -> Column:
    return F.when(F.abs(lag) < tie, "tie").when(lag > 0, "community").when(lag < 0, "news")


def edge_confidence(lag: Column) -> Column:
    return 1 - F.least(lag / 1440, F.lit(1.0))


def lifecycle(hours_since_first: Column, heat0: Column, heat1: Column, heat2: Column, peak: Column) -> Column:
    """emerging within six hours; fading when the last three points fall and stand below the peak; else peaking."""
    falls = (heat0 < heat1) & (heat1 < heat2) & (heat0 < peak)
    return F.when(hours_since_first < 6, "emerging").when(falls, "fading").otherwise("peaking")


def narrative_stage(acceleration: Column, spread_: Column, velocity: Column) -> Column:
    return F.when(acceleration < -0.05, "fading").when((spread_ >= 8) | (velocity >= 80), "peaking").when((acceleration > 0.03) | (velocity >= 20), "spreading").otherwise("emerging")


def region_status(current: Column, most: Column, velocity: Column) -> Column:
    return F.when((most > 0) & (current / most < 0.3), "fading").when((velocity > 0) & (current >= most), "accelerating").otherwise("steady")


def source_status(core: Column, last: Column, rate: Column) -> Column:
    """Health of a source from its last run and its success rate (percent)."""
    return F.when(last.isNull(), F.when(core, "missing").otherwise("optional")).when(last != "success", F.when(core, "failing").otherwise("optional_failing")).when(rate < 70, "degraded").otherwise("healthy")


def sentiment_distribution(score: Column) -> Column:
    """Struct of shares that sum to one, from a score in -1 to 1; mixed evidence counts as controversial."""
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))
    p, n = F.greatest(s, F.lit(0.0)) * 0.55 + 0.2, F.greatest(-s, F.lit(0.0)) * 0.55 + 0.2
    u = F.greatest(F.lit(0.05), 1 - p - n)
    c = F.least(F.lit(0.35), 0.9 * F.sqrt(p * n))
    total = p + n + u + c
    return F.struct((p / total).alias("positive"), (n / total).alias("negative"), (u / total).alias("neutral"), (c / total).alias("controversial"))


def lexical_score(shared: Column, name: Column, entity: Column, keyword_jaccard: Column, phrase: Column) -> Column:
    return F.least(F.lit(1.0), 0.08 * shared + 0.16 * name + 0.18 * entity + 0.42 * keyword_jaccard + 0.2 * phrase)


def excerpt_score(views: Column, likes: Column, comments: Column) -> Column:
    return 0.3 * F.log1p(views) + 0.4 * F.log1p(likes) + 0.3 * F.log1p(comments)


def sankey_value(cosine: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(100 * F.coalesce(cosine, F.lit(0.5)) + 0.5)).cast("long")


def coverage(part: Column, whole: Column) -> Column:
    """Percent, one decimal, 0 to 100; 0 of nothing."""
    return F.when(whole > 0, F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * part / whole)), 1)).otherwise(F.lit(0.0))
