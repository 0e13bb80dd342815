"""Places where outside models plug in: embeddings and summaries, by batches, with a fallback where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, first_sentence


def embedding_text(name: Column, keywords: Column, summary: Column) -> Column:
    """What is embedded of a topic: name, keywords, summary, 500 characters at most."""
    return F.substring(F.concat_ws(" ", name, F.array_join(keywords, " "), summary), 1, 500)


def with_embeddings(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 100, name: str = "vector") -> DataFrame:
    """Adds a vector to every row by calling `embed` with lists of at most `batch` texts; null where the text is null or empty."""
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    kind = StructType([*df.schema.fields, StructField(name, ArrayType(DoubleType()))])

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[list[float] | None] = [None] * len(frame)
            some = [i for i, s in enumerate(frame[text]) if s]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                for i, v in zip(part, embed([frame[text].iloc[i] for i in part]), strict=True):
                    found[i] = [float(x) for x in v]
            frame[name] = pd.Series(found, index=frame.index, dtype=object)
            yield frame

    return df.mapInPandas(call, kind)


def fallback_summary(excerpt: Column, title: Column, keywords: Column, name: Column, most: int = 120) -> Column:
    """A summary without a model: the first sentence, else a title, else keywords, else the name."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return clamp(F.coalesce(text(first_sentence(excerpt)), text(title), text(F.array_join(F.slice(keywords, 1, 3), ", ")), name), most)


def parsed_topics(answer: Column) -> Column:
    """Topics of a model's answer: fences cut, a JSON array or its `topics`; null where it is neither."""
    bare = F.trim(F.regexp_replace(answer, "(?s)^\\s*```(?:json)?|```\\s*$", ""))
    kind = "array<struct<name:string,summary:string,sentiment:double,keywords:array<string>>>"
    return F.coalesce(F.from_json(F.get_json_object(bare, "$.topics"), kind), F.when(bare.startswith("["), F.from_json(bare, kind)))


def entities(found: Column, most: int = 12) -> Column:
    """Entities (text, type) with a text, types outside the list taken as `other`, 12 at most.  Fixed values."""
    types = ["person", "organization", "location", "event", "product", "other"]
    kept = F.filter(found, lambda e: F.trim(e["text"]) != "")
    return F.slice(F.transform(kept, lambda e: F.struct(F.trim(e["text"]).alias("text"), F.when(F.lower(e["type"]).isin(types), F.lower(e["type"])).otherwise("other").alias("type"))), 1, most)
