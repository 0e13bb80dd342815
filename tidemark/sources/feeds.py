"""Items of XML, JSON and HTML feeds from columns of raw text, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp, external_id
from ..functions.titles import clean_title


def xml_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """title, link, guid, pubDate of every item; malformed items are kept out, not fatal."""
    schema = "title string, link string, guid string, pubDate string, description string"
    return spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path)


def normalised(items: DataFrame, source_id: str, cap: int = 50) -> DataFrame:
    """Posts of a feed: id from guid, link or a hash; one row an id; title and body cleaned; at most `cap` items."""
    made = external_id(F.concat_ws("|", F.lit(source_id), "title", "link"))
    ids = F.coalesce(F.nullif(F.trim("guid"), F.lit("")), F.nullif(F.trim("link"), F.lit("")), made)
    posts = items.filter("title is not null").select(F.lit(source_id).alias("source_id"), ids.alias("external_id"), clean_title(F.col("title")).alias("title"), "link", clamp(F.col("description"), 280).alias("body_preview"), "pubDate")
    return posts.dropDuplicates(["source_id", "external_id"]).orderBy(F.desc_nulls_last("pubDate"), "external_id").limit(cap)


def json_records(raw: Column) -> Column:
    """title and url of the records of a JSON array, or of its `items`."""
    kind = "array<struct<title:string,headline:string,url:string>>"
    listed = F.coalesce(F.from_json(F.get_json_object(raw, "$.items"), kind), F.from_json(raw, kind))
    named = F.transform(listed, lambda r: F.struct(F.coalesce(r["title"], r["headline"]).alias("title"), r["url"].alias("url")))
    return F.filter(named, lambda r: r["title"].isNotNull())


def html_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, rank, url, headline of the links of a page in their order; links without text are dropped."""
    found = F.regexp_extract_all(F.col(html), F.lit("(?is)<a\\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(?:(?!</a>).)*+</a>"), 0)
    one = pages.select(key, F.posexplode(found).alias("place", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a", "(?s)<[^>]*>", " "), "\\s+", " "))
    out = one.select(key, "place", F.regexp_extract("a", "(?i)href=[\"']([^\"']*)[\"']", 1).alias("url"), text.alias("headline")).filter("headline <> ''")
    return out.select(key, (F.col("place") + 1).alias("rank"), "url", "headline")


def due(sources: DataFrame, as_of: Column) -> DataFrame:
    """Sources whose interval has passed since the last visit, never visited ones first."""
    next_at = F.col("last_scraped_at") + F.make_interval(mins=F.col("scrape_interval_minutes"))
    return sources.filter(F.col("last_scraped_at").isNull() | (next_at <= as_of)).orderBy(F.asc_nulls_first("last_scraped_at"), "id")
