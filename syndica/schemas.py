"""Schemas of the tables that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_STR, _INT, _LONG, _BOOL, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType(),
)

# One landed listing page. page_id is the key of a capture; (feed_key, page_seq)
# places it in the paging order of its source.
PAGES = _struct(
    ("page_id", _LONG, False), ("feed_key", _STR, False), ("page_seq", _INT, False),
    ("url", _STR, False), ("html", _STR, True),
)

# Extracted items; (page_seq, pos) is the listing order, which Spark rows lack.
ITEMS = _struct(
    ("feed_key", _STR, False), ("guid", _STR, False), ("title", _STR, False),
    ("link", _STR, False), ("author", _STR, True), ("published_at", _TS, True),
    ("page_seq", _INT, False), ("pos", _INT, False),
)
ITEM_COLUMNS = ITEMS.fieldNames()

SOURCES = _struct(
    ("source_ord", _LONG, False), ("key", _STR, False), ("source_url", _STR, False),
    ("feed_title", _STR, False), ("route", _STR, False), ("public_feed_url", _STR, False),
    ("parser_kind", _STR, False), ("link_pattern", _STR, False),
    ("link_selector", _STR, False), ("parent_selector", _STR, False),
)
SOURCE_COLUMNS = SOURCES.fieldNames()

PUBLISHED = _struct(
    ("feed_key", _STR, False), ("content", _STR, True), ("is_stale", _BOOL, False),
    ("generated_at", _TS, True), ("n_items", _LONG, False),
)

REFRESH_LOG = _struct(
    ("feed_key", _STR, False), ("at", _TS, False), ("ok", _BOOL, False),
    ("error_type", _STR, True), ("n_items", _LONG, True),
)

RESPONSES = _struct(
    ("input_ord", _LONG, False), ("url", _STR, False), ("status", _INT, True),
    ("final_url", _STR, True), ("content_type", _STR, True),
    ("body", T.BinaryType(), True), ("error", _STR, True),
)
