"""Items of forum listings: two listing dialects and the highlights blocks.

Input is a table of landed pages ``(page_id, feed_key, page_seq, url, html)``. All three
plans parse a page once, keep the few element rows their selectors name, shuffle those by
page, and do the rest on that one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syndica.functions.strings import (
    block_name, block_title, empty_to_null, guid, has_media_count, is_blank,
)
from syndica.functions.times import PINNED_PREFIX, civil_date_utc, epoch_ts
from syndica.functions.urls import has_single_param, path_parts, query_param, resolve_url
from syndica.operators.htmltree import (
    attr, attr_contains, attr_starts, enclosing, first_inside, has_attr, html_nodes, inside,
    is_tag, parent_is, raw_attr, whole_page,
)
from syndica.operators.items import finish_items

PAGE_KEYS = ["page_id", "feed_key", "page_seq", "url"]
_KEYS = [*PAGE_KEYS, "images_only"]

# Id patterns of listing rows.
THREAD_ANCHOR = r"^t(\d+)$"
THREAD_ROW = r"^normalthread_(\d+)$"
THREAD_LINK = "viewthread.php?tid="


def _pages_with(pages: DataFrame, marker: str) -> DataFrame:
    """Pages that can match at all; decided before any page reaches Python (F1)."""
    return pages.filter(~is_blank(F.col("html")) & F.contains("html", F.lit(marker)))


def _with_image_rule(pages: DataFrame, images_only: bool) -> DataFrame:
    """The image-posts filter as a column; a source's own rule goes before the default."""
    if "images_only" not in pages.columns:
        return pages.withColumn("images_only", F.lit(images_only))
    return pages.withColumn("images_only", F.coalesce("images_only", F.lit(images_only)))


def in_section(href: Column, section: Column) -> Column:
    """The link's path names the expected section; any link passes without one."""
    parts = path_parts(href)
    expected = (
        (F.size(parts) >= 4)
        & (F.get(parts, F.lit(0)) == "htm_data")
        & (F.get(parts, F.lit(2)) == section)
    )
    return section.isNull() | F.coalesce(expected, F.lit(False))


def extract_listing_a(pages: DataFrame, max_items: int | None = None,
                      images_only: bool = False) -> DataFrame:
    """Rows ``tr.tr3.t_one.tac``: anchor, author and time of the third cell."""
    if max_items is not None and max_items <= 0:
        pages = pages.limit(0)
    pages = _with_image_rule(pages, images_only)
    nodes = html_nodes(
        _pages_with(pages, "tr3"),
        tags=("tr", "td", "h3", "a", "div"), attr_names=("data-timestamp", "title"),
        text_tags=("a",), kept_attrs=("id", "href", "data-timestamp", "title"),
        keep=_KEYS, ups=0, only={"tr": "tr3 t_one tac", "div": "f12"},
    )
    kinds = nodes.select(
        *_KEYS, "node_id", "last_id", "parent_id", "attrs", "text",
        is_tag("tr", "tr3", "t_one", "tac").alias("is_row"),
        is_tag("td", "tal").alias("is_tal"),
        is_tag("h3").alias("is_h3"),
        (is_tag("td") & (F.col("tag_ord") == 2)).alias("is_cell"),
        (is_tag("a") & attr_starts("id", "t")).alias("is_link"),
        is_tag("a", "bl").alias("is_author"),
        is_tag("div", "f12").alias("is_f12"),
        (has_attr("data-timestamp") | attr_starts("title", PINNED_PREFIX)).alias("is_time"),
    )
    flags = [c for c in kinds.columns if c.startswith("is_")]
    kept = kinds.filter(F.greatest(*flags))
    # expressions added together share one window; rows without a part are dropped early
    marked = (
        kept.withColumns({
            "is_h3": F.col("is_h3") & inside(F.col("is_tal")),
            "is_time": F.col("is_time") & inside(F.col("is_f12")),
        })
        .withColumn("is_link", F.col("is_link") & inside(F.col("is_h3")))
        .filter("is_row OR is_cell OR is_link OR is_author OR is_time")
    )
    anchor = F.struct(raw_attr("id").alias("id"), attr("href").alias("href"),
                      F.col("text").alias("title"))
    stamp = epoch_ts(raw_attr("data-timestamp"), raw_attr("title"))
    scoped = marked.withColumns({
        "anchor": first_inside(F.col("is_link"), anchor),
        "author": first_inside(F.col("is_author"), F.col("text")),
        "stamp": first_inside(F.col("is_time"), F.struct(stamp.alias("at"))),
    }).filter(F.col("is_row") | F.col("is_cell"))
    # a row and its third cell meet under the row's number
    row_id = F.when(F.col("is_row"), F.col("node_id")).otherwise(F.col("parent_id"))
    rows = (
        scoped.groupBy(*_KEYS, row_id.alias("row_id"))
        .agg(
            F.bool_or("is_row").alias("is_row"),
            F.first(F.when(F.col("is_row"), F.col("anchor")), True).alias("anchor"),
            F.first(F.when(F.col("is_cell"), F.col("author")), True).alias("author"),
            F.first(F.when(F.col("is_cell"), F.col("stamp")), True).alias("stamp"),
        )
        .filter("is_row AND anchor IS NOT NULL")
    )
    thread = F.regexp_extract(F.col("anchor.id"), THREAD_ANCHOR, 1)
    href, title = F.col("anchor.href"), F.col("anchor.title")
    keep = (
        (thread != "") & (href != "") & (title != "")
        & in_section(href, query_param(F.col("url"), "fid"))
        & (~F.col("images_only") | has_media_count(title))
    )
    items = rows.filter(keep).select(
        *PAGE_KEYS,
        guid("", thread).alias("guid"),
        title.alias("title"),
        resolve_url(F.col("url"), href).alias("link"),
        empty_to_null(F.col("author")).alias("author"),
        F.col("stamp.at").alias("published_at"),
        F.col("row_id").alias("pos"),
    )
    return finish_items(items, max_items)


def extract_listing_b(pages: DataFrame, max_items: int | None = None, images_only: bool = False,
                      prefix: str = "forum-b") -> DataFrame:
    """Rows ``tbody[id^=normalthread_]`` of a section page, sticky rows excluded."""
    if max_items is not None and max_items <= 0:
        pages = pages.limit(0)
    pages = _with_image_rule(pages, images_only)
    section = query_param(F.col("url"), "fid")
    nodes = html_nodes(
        _pages_with(pages, "normalthread_").filter(section.isNotNull()),
        tags=("tbody", "td", "cite", "a", "em", "img"), text_tags=("a", "em"),
        kept_attrs=("id", "href", "src"), keep=_KEYS, only={"td": "author", "img": "attach"}, up_tags=("a",),
    )
    kinds = nodes.select(
        *_KEYS, "node_id", "last_id", "attrs", "text",
        (is_tag("tbody") & attr_starts("id", "normalthread_")).alias("is_row"),
        (is_tag("a") & attr_contains("href", THREAD_LINK)
         & parent_is(1, "span", id_prefix="thread_") & parent_is(2, "th", "subject")
         ).alias("is_link"),
        is_tag("td", "author").alias("is_by"),
        is_tag("cite").alias("is_cite"),
        is_tag("a").alias("is_anchor"),
        is_tag("em").alias("is_date"),
        (is_tag("img", "attach") & attr_contains("src", "attachicons")).alias("is_icon"),
    )
    flags = [c for c in kinds.columns if c.startswith("is_")]
    marked = (
        kinds.filter(F.greatest(*flags))
        .withColumn("in_by", inside(F.col("is_by")))
        .withColumns({"is_cite": F.col("is_cite") & F.col("in_by"),
                      "is_date": F.col("is_date") & F.col("in_by")})
        .withColumn("is_author", F.col("is_anchor") & inside(F.col("is_cite")))
        .filter("is_row OR is_link OR is_author OR is_date OR is_icon")
    )
    anchor = F.struct(attr("href").alias("href"), F.col("text").alias("title"))
    rows = (
        marked.withColumns({
            "anchor": first_inside(F.col("is_link"), anchor),
            "author": first_inside(F.col("is_author"), F.col("text")),
            "date_text": first_inside(F.col("is_date"), F.col("text")),
            "has_icon": first_inside(F.col("is_icon"), F.lit(True)).isNotNull(),
        }).filter("is_row AND anchor IS NOT NULL")
    )
    thread = F.regexp_extract(raw_attr("id"), THREAD_ROW, 1)
    href, title = F.col("anchor.href"), F.col("anchor.title")
    keep = (
        (thread != "") & (href != "") & (title != "") & has_single_param(href, "tid", thread)
        & (~F.col("images_only") | F.col("has_icon"))
    )
    items = rows.filter(keep).select(
        *PAGE_KEYS,
        guid(prefix, section, thread).alias("guid"),
        title.alias("title"),
        resolve_url(F.col("url"), F.concat(F.lit(THREAD_LINK), thread)).alias("link"),
        empty_to_null(F.col("author")).alias("author"),
        civil_date_utc(F.col("date_text")).alias("published_at"),
        F.col("node_id").alias("pos"),
    )
    return finish_items(items, max_items)


def extract_highlights(pages: DataFrame, max_items: int | None = None,
                       prefix: str = "forum-b:home") -> DataFrame:
    """Links of the titled blocks of a home page, first block first.

    The header cells of the first ``thead.category`` pair by position with the cells of the
    row that follows it (H9-H11).
    """
    if max_items is not None and max_items <= 0:
        pages = pages.limit(0)
    nodes = html_nodes(
        _pages_with(pages, "category"),
        tags=("thead", "td", "tr", "a"), text_tags=("td", "a"), kept_attrs=("href",),
        keep=PAGE_KEYS, ups=0,
    )
    # the text of a cell is only needed where it can be a header
    base = nodes.select(
        *PAGE_KEYS, "node_id", "last_id", "parent_id", "sib_ord", "tag_ord", "tag", "attrs",
        F.when((F.col("tag") == "a") | F.startswith("text", F.lit("≡")), F.col("text"))
        .alias("text"),
        is_tag("thead", "category").alias("is_head"),
        (is_tag("a") & attr_contains("href", THREAD_LINK)).alias("is_link"),
    ).filter("is_head OR is_link OR tag IN ('td', 'tr')")

    place = F.struct("node_id", "last_id", "parent_id", "sib_ord")
    page = whole_page()
    with_head = base.withColumn(
        "head", F.min(F.when(F.col("is_head"), place)).over(page)
    ).filter("head IS NOT NULL")
    is_data_row = (
        (F.col("tag") == "tr")
        & (F.col("parent_id") == F.col("head.parent_id"))
        & (F.col("sib_ord") == F.col("head.sib_ord") + 1)
    )
    is_header = (
        (F.col("tag") == "td")
        & (F.col("node_id") > F.col("head.node_id"))
        & (F.col("node_id") <= F.col("head.last_id"))
    )
    placed = (
        with_head.withColumn("data_row", F.min(F.when(is_data_row, place)).over(page))
        .filter("data_row IS NOT NULL")
        .withColumn("is_header", is_header)
        .withColumn(
            "is_column",
            (F.col("tag") == "td") & (F.col("parent_id") == F.col("data_row.node_id")),
        )
        .withColumn(
            "header_ord",
            F.sum(F.col("is_header").cast("int")).over(
                Window.partitionBy("page_id").orderBy("node_id")
                .rowsBetween(Window.unboundedPreceding, 0)
            ) - 1,
        )
        .withColumn("column_ord", enclosing(F.col("is_column"), F.col("tag_ord")))
        .withColumn(
            "block_ord",
            F.when(F.col("is_header"), F.col("header_ord"))
            .when(F.col("is_link"), F.col("column_ord")),
        )
        .filter("block_ord IS NOT NULL")
        # header and links of one position meet: the positional pairing
        .withColumn(
            "block",
            F.max(F.when(F.col("is_header"), block_name(F.col("text"))))
            .over(Window.partitionBy("page_id", "block_ord")),
        )
    )
    thread = query_param(attr("href"), "tid")
    items = placed.filter(
        F.col("is_link") & F.col("block").isNotNull() & thread.isNotNull()
        & (F.col("text") != "")
    ).select(
        *PAGE_KEYS,
        guid(prefix, thread).alias("guid"),
        block_title(F.col("block"), F.col("text")).alias("title"),
        resolve_url(F.col("url"), F.concat(F.lit(THREAD_LINK), thread)).alias("link"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("timestamp").alias("published_at"),
        # blocks follow one another in the document, so the number orders both
        F.col("node_id").alias("pos"),
    )
    return finish_items(items, max_items)
