"""Set and vector likeness of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays share an element; false, never null, where either is null."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both > 0, 2 * F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; null if a norm is zero; -1 to 1, six decimals."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0)))
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / norm)), 6))


def merge_sentiment(score: str, heat: str) -> Column:
    """Heat-weighted mean of an aggregate; rows without heat weigh one."""
    w = F.when(F.col(heat) > 0, F.col(heat)).otherwise(F.lit(1.0))
    return F.round(F.sum(F.col(score) * w) / F.sum(w), 3)


def counted(words: Column) -> Column:
    """The words of an array, once each in order, with how often they are there: array of (term, n)."""
    def runs(s: Column) -> Column:
        size = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(ends, lambda e, i: F.struct(F.get(s, e - 1).alias("term"), e.alias("_end"), i.alias("_i")))

    def lengths(r: Column) -> Column:
        return F.transform(r, lambda x: F.struct(x["term"].alias("term"), (x["_end"] - F.when(x["_i"] > 0, F.get(r, x["_i"] - 1)["_end"]).otherwise(0)).alias("n")))

    # One-element arrays bind what is used more than once.
    sorted_ = F.filter(F.array(F.sort_array(F.filter(words, lambda w: w.isNotNull()))), lambda s: F.size(s) > 0)
    return F.flatten(F.transform(F.transform(sorted_, runs), lengths))
