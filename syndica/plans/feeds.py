"""Items of feed XML and of JSON list documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syndica.functions.bind import computed
from syndica.functions.strings import empty_to_null, first_non_empty, guid, is_blank, text_or_empty
from syndica.functions.times import drop_sentinel_year, feed_ts
from syndica.functions.urls import resolve_url, url_origin
from syndica.operators.items import finish_items
from syndica.plans.listing import PAGE_KEYS
from syndica.sources.feedxml import child_href, child_text, feed_records, nested_text
from syndica.sources.jsonlist import json_elements, member


def extract_feed_items(docs: DataFrame, max_items: int | None = None, prefix: str = "rss"
                       ) -> DataFrame:
    """Items of RSS or Atom documents; each field is the first non-empty of its fallbacks."""
    if max_items is not None and max_items <= 0:
        docs = docs.limit(0)
    return items_of_records(feed_records(docs.filter(~is_blank(F.col("html"))), keep=PAGE_KEYS), max_items, prefix)


def items_of_records(records: DataFrame, max_items: int | None = None, prefix: str = "rss") -> DataFrame:
    """The same from records that were parsed before, with the columns ``PAGE_KEYS``."""
    if max_items is not None and max_items <= 0:
        records = records.limit(0)
    fields = computed(records, [*PAGE_KEYS, "pos"], {
        "title": child_text("title"),
        "href": first_non_empty(child_text("link"), child_href("link")),
        "own_guid": child_text("guid"),
        "own_id": child_text("id"),
        "date_text": first_non_empty(
            child_text("pubDate"), child_text("published"), child_text("updated")
        ),
        "author": first_non_empty(
            child_text("creator"), child_text("name"), nested_text("author", "name"),
            child_text("author"),
        ),
    })
    key = first_non_empty(F.col("own_guid"), F.col("own_id"), F.col("href"))
    items = fields.filter((F.col("title") != "") & (key != "")).select(
        *PAGE_KEYS,
        guid(prefix, key).alias("guid"),
        "title",
        resolve_url(F.col("url"), F.col("href")).alias("link"),
        empty_to_null(F.col("author")).alias("author"),
        feed_ts(F.col("date_text")).alias("published_at"),
        "pos",
    )
    return finish_items(items, max_items)


def extract_json_items(docs: DataFrame, max_items: int | None = None, prefix: str = "mzt",
                       default_origin: str | None = None) -> DataFrame:
    """Items of JSON list documents ``{"items": [{id, title, created_at, updated_at}]}``."""
    if max_items is not None and max_items <= 0:
        docs = docs.limit(0)
    rows = json_elements(docs.filter(~is_blank(F.col("html"))), "items", "html", PAGE_KEYS)
    fields = computed(rows, [*PAGE_KEYS, "pos"], {
        "id": text_or_empty(member("id")),
        "title": text_or_empty(member("title")),
        "date_text": text_or_empty(
            first_non_empty(member("created_at"), member("updated_at"))
        ),
    })
    base = F.concat(url_origin(F.col("url"), default_origin), F.lit("/"))
    items = fields.filter((F.col("id") != "") & (F.col("title") != "")).select(
        *PAGE_KEYS,
        guid(prefix, F.col("id")).alias("guid"),
        "title",
        resolve_url(base, F.concat(F.lit("view/"), F.col("id"))).alias("link"),
        F.lit(None).cast("string").alias("author"),
        drop_sentinel_year(feed_ts(F.col("date_text"))).alias("published_at"),
        "pos",
    )
    return finish_items(items, max_items)
