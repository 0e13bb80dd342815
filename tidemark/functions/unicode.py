"""Compatibility normalisation, which Spark has no built-in function for, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def nfkc(x: Column) -> Column:
    """NFKC of a string; null stays null."""

    def work(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.pandas_udf(work, StringType())(x.cast("string"))


def nfkc_each(x: Column) -> Column:
    """NFKC of every string of an array; nulls in it are left out."""

    def work(s: pd.Series) -> pd.Series:
        return s.map(lambda a: [unicodedata.normalize("NFKC", v) for v in a if v is not None], na_action="ignore")

    return F.pandas_udf(work, ArrayType(StringType()))(x)


def plain(x: Column) -> Column:
    """Lower case; letters, digits and single spaces only (of a normalised string)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}\\s]+", " "), "\\s+", " "))
