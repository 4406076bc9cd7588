"""Items of link galleries: anchors chosen by per-source rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syndica.functions.bind import let
from syndica.functions.strings import guid, is_blank
from syndica.functions.times import embedded_date, first_embedded_date, is_plain_date
from syndica.functions.urls import resolve_url, url_path
from syndica.operators.htmltree import (
    TEXT_TAG, attr, first_inside, has_attr, html_nodes, inside, matches_selector, raw_attr,
)
from syndica.operators.items import finish_items
from syndica.plans.listing import PAGE_KEYS

# Elements that form a card, and the shortest title of an entry.
CARD_TAGS = ("article", "li", "section")
MIN_TITLE = 4

OPTIONS = ["link_pattern", "link_selector", "parent_selector"]


def selector_tags(selector: Column) -> Column:
    """Tag names a selector list can match; ``*`` when a part names none."""
    return let(
        {"selector": selector}, [],
        r"""transform(split(trim(v.selector), r'\s*,\s*'),
            one -> coalesce(nullif(split(one, '[.]')[0], ''), '*'))""",
    )


def supported_selector(selector: Column) -> Column:
    """Selectors are comma lists of ``tag.class...``; nothing else is offered."""
    return selector.rlike(r"^\s*$|^[\w\-]*(\.[\w\-]+)*(\s*,\s*[\w\-]*(\.[\w\-]+)*)*$")


def extract_links(pages: DataFrame, max_items: int | None = None, prefix: str = "gallery"
                  ) -> DataFrame:
    """Titled anchors of each page, keep-first by absolute link.

    The rules are columns of ``pages`` (absent or empty means no rule), so one plan serves
    any number of sources: ``link_pattern`` is searched in the path of the raw href,
    ``link_selector`` picks the elements, ``parent_selector`` demands an ancestor.
    """
    if max_items is not None and max_items <= 0:
        pages = pages.limit(0)
    for name in OPTIONS:
        value = F.coalesce(F.col(name), F.lit("")) if name in pages.columns else F.lit("")
        pages = pages.withColumn(name, value)
    checked = pages.filter(~is_blank(F.col("html"))).withColumn(
        "link_selector",
        F.when(supported_selector(F.col("link_selector")), F.col("link_selector")).otherwise(
            F.raise_error(F.concat(F.lit("unsupported selector: "), F.col("link_selector")))
        ),
    )
    no_tags = F.array().cast("array<string>")
    picked = F.when(
        F.col("link_selector") != "", selector_tags(F.col("link_selector"))
    ).otherwise(no_tags)
    above = F.when(
        F.col("parent_selector") != "",
        F.array(F.split_part(F.col("parent_selector"), F.lit("."), F.lit(1))),
    ).otherwise(no_tags)
    nodes = html_nodes(
        checked.withColumn("_picked", picked).withColumn("_tags", F.concat(picked, above)),
        tags=("a", *CARD_TAGS), text_tags=("a",), near_tags=CARD_TAGS,
        tags_col="_tags", text_tags_col="_picked", strings_like=r"\d{4}-\d{1,2}-\d{1,2}",
        kept_attrs=("href", "datetime"), keep=PAGE_KEYS + OPTIONS, ups=0,
    )
    is_card = F.col("tag").isin(*CARD_TAGS)
    is_date_text = F.col("tag") == TEXT_TAG
    by_rule = (
        F.when(F.col("link_selector") != "", matches_selector(F.col("link_selector")))
        .otherwise((F.col("tag") == "a") & has_attr("href"))
    )
    parent_rule = F.col("parent_selector")
    kinds = nodes.select(
        *PAGE_KEYS, "link_pattern", "parent_selector", "node_id", "last_id", "near_id", "tag",
        by_rule.alias("is_link"),
        is_card.alias("is_card"),
        is_date_text.alias("is_date"),
        ((parent_rule != "") & matches_selector(parent_rule)).alias("is_parent"),
        F.when(by_rule, attr("href")).alias("href"),
        F.when(by_rule | is_date_text, F.col("text")).alias("text"),
        raw_attr("datetime").alias("own_date"),
    ).filter("is_link OR is_card OR is_date OR is_parent")

    # first date among the strings of a card, then handed to the anchors of that card
    card_date = F.when(
        F.col("is_card"),
        first_inside(F.col("is_date"), F.struct(embedded_date(F.col("text")).alias("at"))),
    )
    roles = F.array_compact(
        F.array(F.when(F.col("is_card"), "card"), F.when(F.col("is_link"), "link"))
    )
    related = (
        kinds.withColumn("card_date", card_date)
        .withColumn("in_parent", inside(F.col("is_parent")))
        .withColumn("role", F.explode(roles))
        .withColumn(
            "card_id",
            F.when(F.col("role") == "card", F.col("node_id")).otherwise(F.col("near_id")),
        )
        .withColumn(
            "card_date",
            F.max(F.when(F.col("role") == "card", F.col("card_date")))
            .over(Window.partitionBy("page_id", "card_id")),
        )
    )
    href, title = F.col("href"), F.col("text")
    keep = (
        (F.col("role") == "link") & (href != "")
        & (F.length(title) >= MIN_TITLE) & ~is_plain_date(title)
        & ((F.col("link_pattern") == "") | F.rlike(url_path(href), F.col("link_pattern")))
        & ((parent_rule == "") | F.col("in_parent"))
    )
    link = resolve_url(F.col("url"), href)
    items = related.filter(keep).select(
        *PAGE_KEYS,
        guid(prefix, link).alias("guid"),
        title.alias("title"),
        link.alias("link"),
        F.lit(None).cast("string").alias("author"),
        F.coalesce(
            first_embedded_date(F.coalesce(F.col("own_date"), F.lit("")), title),
            F.col("card_date.at"),
        ).alias("published_at"),
        F.col("node_id").alias("pos"),
    )
    return finish_items(items, max_items)
