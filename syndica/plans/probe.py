"""Probing unknown sites from landed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.functions.bind import let
from syndica.functions.strings import collapse_space, strip_trailing_punctuation
from syndica.functions.urls import resolve_url, url_path
from syndica.operators.hosts import last_page_per_host
from syndica.operators.htmltree import attr, html_nodes, raw_attr
from syndica.sources.pages import decode_body

# The usual limits of a probe, for callers that want them, and the site
# generators it knows, in order.
LIMITS = {"body_bytes": 2 * 1024 * 1024, "title_chars": 120, "max_feeds": 8}
GENERATORS = ["wordpress", "xenforo", "discuz", "phpbb", "typecho"]
FEED_TYPE = r"(?i)application/(?:rss|atom)\+xml|text/xml"
_LINK_TARGET = r"(?U)\]\((https?://[^)\s]+)\)"
_BARE_URL = r"(?U)(?<!\]\()https?://[^\s)\]]+"


def extract_urls(docs: DataFrame, text_col: str = "text", keep: str = "doc_id") -> DataFrame:
    """URLs of Markdown texts: link targets, then bare URLs, distinct, in order.

    Trailing punctuation goes after the distinct, so equal URLs may appear again.
    """
    targets = F.regexp_extract_all(text_col, F.lit(_LINK_TARGET), F.lit(1))
    bare = F.regexp_extract_all(text_col, F.lit(_BARE_URL), F.lit(0))
    urls = F.transform(
        F.array_distinct(F.concat(targets, bare)), strip_trailing_punctuation
    )
    return docs.select(keep, F.posexplode(urls).alias("pos", "url"))


def page_title(html: Column, max_chars: int | None = None) -> Column:
    """First title element's raw text on one line, cut to ``max_chars`` if given."""
    raw = collapse_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return raw if max_chars is None else F.substring(raw, 1, max_chars)


def site_generator(html: Column, path: Column) -> Column:
    """First known generator named in the page or its path, else ``unknown``."""
    cases = " ".join(
        f"WHEN contains(low.page, '{g}') OR contains(low.path, '{g}') THEN '{g}'"
        for g in GENERATORS
    )
    return let(
        {"page": html, "path": path},
        [("low", {"page": "lower(v.page)", "path": "lower(v.path)"})],
        f"CASE {cases} ELSE 'unknown' END",
    )


def declared_feeds(pages: DataFrame, keep: list[str], max_feeds: int | None = None) -> DataFrame:
    """Every page with the feed URLs it declares: absolute, distinct, in order.

    ``keep`` holds the page's key and whatever else should survive; the base address is
    ``url``. The list is gathered per page, in the one pass that reads the bodies.
    """
    nodes = html_nodes(
        pages.withColumn(
            "html", F.when(F.contains("html", F.lit("alternate")), F.col("html"))
        ),
        tags=("link",), text_tags=(), kept_attrs=("rel", "type", "href"),
        keep=[*keep, "url"], ups=0, page_rows=True,
    )
    rel = F.split(F.coalesce(raw_attr("rel"), F.lit("")), r"\s+")
    declared = (
        F.array_contains(rel, "alternate")
        & F.coalesce(raw_attr("type"), F.lit("")).rlike(FEED_TYPE)
        & (attr("href") != "")
    )
    found = F.array_distinct(F.col("links.href"))
    link = F.struct("node_id", resolve_url(F.col("url"), attr("href")).alias("href"))
    return nodes.groupBy(*keep, "url").agg(
        F.array_sort(F.collect_list(F.when(declared, link))).alias("links")
    ).select(
        *keep, "url",
        (found if max_feeds is None else F.slice(found, 1, max_feeds)).alias("feeds"),
    )


def probe_pages(responses: DataFrame, body_bytes: int | None = None,
                title_chars: int | None = None, max_feeds: int | None = None) -> DataFrame:
    """Probe result per landed response.

    A response that is no HTML is fine but tells nothing; status 400 and above is an error.
    Nothing is cut unless a limit is given; ``LIMITS`` holds the usual ones.
    """
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    refused = ~failed & (F.col("status") >= 400)
    ok = ~failed & ~F.coalesce(F.col("status") >= 400, F.lit(False))
    is_html = ok & F.coalesce(F.contains("content_type", F.lit("html")), F.lit(False))
    base = responses.select(
        "input_ord",
        F.col("url").alias("asked_url"),
        F.coalesce("final_url", "url").alias("url"),
        "status",
        ok.alias("ok"),
        F.when(failed, F.col("error")).when(refused, "HTTPError").otherwise("").alias("error"),
        F.when(is_html, decode_body(F.col("body"), body_bytes)).alias("html"),
    )
    described = base.withColumn(
        "title", F.coalesce(page_title(F.col("html"), title_chars), F.lit(""))
    ).withColumn(
        "generator",
        F.when(
            F.col("html").isNotNull(), site_generator(F.col("html"), url_path(F.col("url")))
        ).otherwise("unknown"),
    )
    kept = ["input_ord", "asked_url", "ok", "status", "error", "title", "generator"]
    return declared_feeds(described, kept, max_feeds).withColumnRenamed("url", "final_url").withColumnRenamed(
        "asked_url", "url"
    )


def probe_lines(probes: DataFrame) -> DataFrame:
    """Progress lines ``status, generator, number of feeds, url`` (K7)."""
    status = F.coalesce(
        F.nullif(F.col("status"), F.lit(0)).cast("string"),
        F.nullif(F.col("error"), F.lit("")), F.lit("error"),
    )
    return probes.select(
        "input_ord",
        F.concat_ws("\t", status, "generator", F.size("feeds").cast("string"), "url")
        .alias("line"),
    )


def write_probe_report(probes: DataFrame, path: str) -> None:
    """JSON report in input order."""
    (
        probes.repartitionByRange("input_ord").sortWithinPartitions("input_ord")
        .write.mode("overwrite").json(path)
    )


def write_host_cache(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """Keep one page per host, the last one landed (K8).

    Hosts are spread over ``buckets`` folders by their hash, with ``host`` as a column: a reader
    of one host reads one folder, and millions of hosts make no millions of folders.
    """
    (
        last_page_per_host(pages)
        .withColumn("host_bucket", host_bucket(F.col("host"), buckets))
        .repartition(buckets, "host_bucket")
        .write.mode("overwrite").partitionBy("host_bucket").parquet(path)
    )


def host_bucket(host: Column, buckets: int = 64) -> Column:
    """The folder of a host in the cache."""
    return F.pmod(F.xxhash64(host), F.lit(buckets)).cast("int")
