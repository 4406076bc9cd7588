"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syndica.functions import strings, urls
from syndica.operators import freshness, hosts, htmltree, items
from syndica.operators.ranges import ordinals
from syndica.plans import build, dispatch, feeds, links, listing, probe, publish
from syndica.session import materialize, scratch_path
from syndica.sources import catalog, pages as page_source
from syndica.streaming import ingest, seen, state, transitions
from workload import render
from workload.tables import (
    event_items, event_log, landed_pages, order_items, table, time_text,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def _items(df: DataFrame) -> DataFrame:
    return df.select("page_seq", "guid", "title", "link", "author", time_text())


# --- links and URLs over the raw pages -----------------------------------------------------

_ANCHORS = """
  raw AS (
    SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a,
           generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS ord
    FROM pages),
  anchors AS (
    SELECT page_id, url, ord,
           replace(regexp_extract(a, '<a href="([^"]*)">', 1), '&amp;', '&') AS href,
           trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&')) AS title
    FROM raw)
"""
_ROOTED = "regexp_extract(url, '^(https?://[^/?#]*)', 1) || href"


@query("link_feed", f"""
WITH {_ANCHORS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY ord) AS rn
             FROM anchors WHERE href <> '' AND length(title) >= 4
               AND NOT regexp_full_match(title, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}')),
  kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rank
           FROM ranked WHERE rn = 1)
SELECT CAST(page_id AS INTEGER) AS page_seq, 'gallery:' || {_ROOTED} AS guid, title,
       {_ROOTED} AS link, CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS published_at
FROM kept WHERE rank <= 5
""")
def link_feed(spark, sf_dir):
    return _items(links.extract_links(landed_pages(spark, sf_dir), max_items=5))


@query("link_counts", f"""
WITH {_ANCHORS}
SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS feed_key, count(*) AS n_items
FROM (SELECT DISTINCT page_id, url, href FROM anchors WHERE length(title) >= 4 AND href <> '')
GROUP BY 1
""")
def link_counts(spark, sf_dir):
    found = links.extract_links(landed_pages(spark, sf_dir), max_items=None)
    return items.non_empty_feeds(found)


@query("html_nodes", """
SELECT page_id, tag, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(li|a|h1|article|nav|title)[ >]', 1)) AS tag
      FROM pages)
GROUP BY ALL
""")
def html_nodes(spark, sf_dir):
    wanted = ("li", "a", "h1", "article", "nav", "title")
    nodes = htmltree.html_nodes(table(spark, sf_dir, "pages"), tags=wanted, text_tags=())
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("html_nodes_sql", """
SELECT page_id, len(regexp_extract_all(html, '<li[ >]')) AS n_li,
       len(regexp_extract_all(html, '<li[ >]')) AS last_li
FROM pages
""")
def html_nodes_sql(spark, sf_dir):
    htmltree.register_html_nodes(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("raw_pages")
    return spark.sql("""
        SELECT page_id, count(*) AS n_li, CAST(max(n.sib_ord) + 1 AS BIGINT) AS last_li
        FROM raw_pages, LATERAL html_nodes(html) n WHERE n.tag = 'li' GROUP BY page_id
    """)


@query("selectors", """
WITH nav AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS body,
                    replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&') AS h1
             FROM pages)
SELECT page_id, len(regexp_extract_all(body, '<a ')) AS in_nav,
       trim(replace(regexp_extract(body, '<a href="[^"]*">([^<]*)</a>', 1), '&amp;', '&')) AS first_link,
       trim(h1) AS heading
FROM nav
""")
def selectors(spark, sf_dir):
    """Descendant and child combinators and scoped first matches."""
    nodes = htmltree.html_nodes(
        table(spark, sf_dir, "pages"), tags=("nav", "a", "article", "h1", "ul", "li"),
        text_tags=("a", "h1"),
    )
    marked = (
        nodes.withColumn("in_nav", (F.col("tag") == "a") & htmltree.has_attr("href")
                         & htmltree.parent_is(1, "li") & htmltree.parent_is(2, "ul")
                         & htmltree.inside(htmltree.is_tag("nav")))
        .withColumn("first_link", htmltree.first_inside(F.col("in_nav"), F.col("text")))
        .withColumn("heading", htmltree.first_inside(htmltree.is_tag("h1"), F.col("text")))
    )
    return marked.groupBy("page_id").agg(
        F.count_if("in_nav").alias("in_nav"),
        F.max(F.when(F.col("tag") == "nav", F.col("first_link"))).alias("first_link"),
        F.max(F.when(F.col("tag") == "article", F.col("heading"))).alias("heading"),
    )


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme,
       regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
       regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
       regexp_extract(url, '\?([^#]*)', 1) AS query,
       regexp_extract(url, '#(.*)$', 1) AS fragment,
       regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin,
       regexp_extract(url, '^https?://([^/?#]*)', 1) AS file_name,
       nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
       regexp_matches(url, '^[^?#]*\.html/*([?#]|$)') AS is_html
FROM pages
""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.url_scheme(u).alias("scheme"), urls.url_host(u).alias("host"),
        urls.url_path(u).alias("path"), urls.url_query(u).alias("query"),
        urls.url_fragment(u).alias("fragment"), urls.url_origin(u).alias("origin"),
        urls.host_file_name(u).alias("file_name"),
        urls.query_param(u, "ref").alias("ref"), urls.path_ends_with(u, ".html").alias("is_html"),
    )


_SHAPES = ["x/y?k=1", "../up", "./same#f", "/root//a/../b", "//other.example.net/p", "?only=q",
           "#top", "", "mailto:a@b.c", "https://abs.example.org/../z"]


@query("resolve_links", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+:)', 1) AS s,
             regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o,
             regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
     b AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM p),
     c AS (SELECT *, regexp_replace(rtrim(dir, '/'), '[^/]*$', '') AS up FROM b)
SELECT page_id, 'x/y?k=1' AS href, o || dir || 'x/y?k=1' AS link FROM c
UNION ALL SELECT page_id, '../up', o || up || 'up' FROM c
UNION ALL SELECT page_id, './same#f', o || dir || 'same#f' FROM c
UNION ALL SELECT page_id, '/root//a/../b', o || '/root//b' FROM c
UNION ALL SELECT page_id, '//other.example.net/p', s || '//other.example.net/p' FROM c
UNION ALL SELECT page_id, '?only=q', o || path || '?only=q' FROM c
UNION ALL SELECT page_id, '#top', o || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END || '#top' FROM c
UNION ALL SELECT page_id, '', url FROM c
UNION ALL SELECT page_id, 'mailto:a@b.c', 'mailto:a@b.c' FROM c
UNION ALL SELECT page_id, 'https://abs.example.org/../z',
  CASE WHEN s = 'https:' THEN 'https://abs.example.org/../z' ELSE 'https://abs.example.org/../z' END FROM c
""")
def resolve_links(spark, sf_dir):
    shapes = F.array(*[F.lit(s) for s in _SHAPES])
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode(shapes).alias("href")
    ).select("page_id", "href", urls.resolve_url(F.col("url"), F.col("href")).alias("link"))


@query("host_groups", """
SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
       count(*) OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]*)', 1)) AS n_sources
FROM pages
""")
def host_groups(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return hosts.host_groups(pages, "url").select("page_id", "host", "n_sources")


# --- listings rendered from tables ---------------------------------------------------------

_LISTING_A = """
SELECT CAST(o_orderkey // 50 + 1 AS INTEGER) AS page_seq, CAST(o_orderkey AS VARCHAR) AS guid, title,
       'http://a.example.com/htm_data/2608/16/' || o_orderkey || '.html' AS link,
       CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 8 = 0 THEN NULL ELSE 'c' || o_custkey END AS author,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS published_at
FROM (SELECT *, o_orderpriority || ' & ' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN ' [36P]'
               WHEN 2 THEN ' ［10p + 1V］' WHEN 1 THEN ' [22P,3V-214MB]' ELSE '' END AS title,
             row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS rank
      FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 17 <> 0 {where})
WHERE rank <= {limit}
"""


@query("listing_a", _LISTING_A.format(where="", limit=30))
def listing_a(spark, sf_dir):
    return _items(listing.extract_listing_a(render.listing_a_pages(spark, sf_dir), max_items=30))


@query("listing_a_images", _LISTING_A.format(where="AND o_orderkey % 2 = 0", limit=100))
def listing_a_images(spark, sf_dir):
    pages = render.listing_a_pages(spark, sf_dir)
    return _items(listing.extract_listing_a(pages, images_only=True))


_LISTING_B = """
SELECT CAST(o_orderkey // 50 + 1 AS INTEGER) AS page_seq,
       'forum-b:' || (19 + 2 * ((o_orderkey // 50) % 2)) || ':' || o_orderkey AS guid,
       o_orderstatus || ' ' || o_orderpriority AS title,
       'http://b.example.com/forum/viewthread.php?tid=' || o_orderkey AS link,
       'c' || o_custkey AS author,
       CASE WHEN o_orderkey % 11 <> 0
            THEN strftime(date_trunc('day', o_orderdate) - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS published_at
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) AS rank
      FROM orders WHERE o_orderkey % 12 <> 0 AND (o_orderkey % 14 <> 0 OR o_orderkey = 5) {where})
WHERE rank <= {limit}
"""


@query("listing_b", _LISTING_B.format(where="", limit=25))
def listing_b(spark, sf_dir):
    return _items(listing.extract_listing_b(render.listing_b_pages(spark, sf_dir), max_items=25))


@query("listing_b_images", _LISTING_B.format(where="AND o_orderkey % 3 = 0", limit=100))
def listing_b_images(spark, sf_dir):
    pages = render.listing_b_pages(spark, sf_dir)
    return _items(listing.extract_listing_b(pages, images_only=True))


@query("highlights", """
WITH all_links AS (
    SELECT p_partkey AS k, p_partkey // 30 AS pg, p_name AS name, p_size % 3 AS block FROM part
    UNION ALL
    SELECT p_partkey, p_partkey // 30, p_name || ' again', (p_size + 1) % 3 FROM part WHERE p_partkey % 5 = 0),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY pg, k ORDER BY block) AS rn FROM all_links),
  kept AS (SELECT *, row_number() OVER (PARTITION BY pg ORDER BY block, k) AS rank FROM firsts WHERE rn = 1)
SELECT CAST(pg + 1 AS INTEGER) AS page_seq, 'forum-b:home:' || k AS guid,
       '[' || CASE block WHEN 0 THEN 'new' WHEN 1 THEN 'liked' ELSE 'hot' END || '] ' || name AS title,
       'https://b.example.com/forum/viewthread.php?tid=' || k AS link,
       CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS published_at
FROM kept WHERE rank <= 20
""")
def highlights(spark, sf_dir):
    pages = render.highlights_pages(spark, sf_dir)
    return _items(listing.extract_highlights(pages, max_items=20))


_GALLERY = """
WITH cards AS (
    SELECT p_partkey AS k, p_partkey // 40 AS pg, p_name || ' ' || p_partkey AS title,
           'https://g.example.com/album/' || p_partkey AS link,
           CAST(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER) AS TIMESTAMP) - INTERVAL 8 HOUR AS card,
           p_partkey % 5 AS kind FROM part),
  chosen AS (
    SELECT pg, 2 * k + 1 AS ord, title, link, card AS pub
    FROM cards WHERE length(title) >= 4
    UNION ALL
    SELECT pg, 2 * k, 'navigation', 'https://g.example.com/album/9' || k, NULL
    FROM cards WHERE pg % 2 = 1 AND k % 4 = 0),
  kept AS (SELECT *, row_number() OVER (PARTITION BY pg ORDER BY ord) AS rank FROM chosen)
SELECT CAST(pg + 1 AS INTEGER) AS page_seq, 'gallery:' || link AS guid, title, link,
       CAST(NULL AS VARCHAR) AS author, strftime(pub, '%Y-%m-%d %H:%M:%S') AS published_at
FROM kept WHERE rank <= 35
"""


@query("gallery_links", _GALLERY)
def gallery_links(spark, sf_dir):
    return _items(links.extract_links(render.gallery_pages(spark, sf_dir), max_items=35))


# --- the same extractions without a limit --------------------------------------------------

def _uncut(name: str, limit: int, make: Query) -> None:
    query(f"{name}_uncut", ORACLES[name].replace(f"rank <= {limit}", "rank > 0"))(make)


_uncut("link_feed", 5, lambda spark, sf_dir: _items(links.extract_links(landed_pages(spark, sf_dir))))
_uncut("listing_a", 30, lambda spark, sf_dir: _items(
    listing.extract_listing_a(render.listing_a_pages(spark, sf_dir))))
_uncut("listing_b", 25, lambda spark, sf_dir: _items(
    listing.extract_listing_b(render.listing_b_pages(spark, sf_dir))))
_uncut("highlights", 20, lambda spark, sf_dir: _items(
    listing.extract_highlights(render.highlights_pages(spark, sf_dir))))
_uncut("gallery_links", 35, lambda spark, sf_dir: _items(
    links.extract_links(render.gallery_pages(spark, sf_dir))))


# --- feed documents ------------------------------------------------------------------------

@query("feed_xml_rss", """
WITH fields AS (
    SELECT o_orderkey AS k, o_orderkey // 100 AS pg, o_orderpriority || ' & <b>' AS title,
           'https://r.example.com/o/' || o_orderkey AS link,
           CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS author,
           CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS published_at,
           CASE WHEN o_orderkey % 4 = 0 THEN '/o/' || o_orderkey
                ELSE CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS VARCHAR) END AS id
    FROM orders WHERE o_orderkey % 19 <> 0 AND (o_orderkey // 100) % 4 <> 3),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY pg, id ORDER BY k) AS rn FROM fields),
  kept AS (SELECT *, row_number() OVER (PARTITION BY pg ORDER BY k) AS rank FROM firsts WHERE rn = 1)
SELECT CAST(pg + 1 AS INTEGER) AS page_seq, 'rss:' || id AS guid, title, link, author, published_at
FROM kept WHERE rank <= 60
""")
def feed_xml_rss(spark, sf_dir):
    return _items(feeds.extract_feed_items(render.rss_pages(spark, sf_dir), max_items=60))


_uncut("feed_xml_rss", 60, lambda spark, sf_dir: _items(
    feeds.extract_feed_items(render.rss_pages(spark, sf_dir))))


@query("feed_xml_atom", """
SELECT CAST(o_orderkey // 100 + 1 AS INTEGER) AS page_seq, 'rss:tag:' || o_orderkey AS guid,
       o_orderpriority AS title,
       CASE WHEN o_orderkey % 2 = 0 THEN 'https://s.example.com/feed/e/' ELSE 'https://s.example.com/' END
         || o_orderkey AS link,
       'c' || o_custkey AS author,
       CASE WHEN o_orderkey % 3 = 2 THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S')
            ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS published_at
FROM orders
""")
def feed_xml_atom(spark, sf_dir):
    return _items(feeds.extract_feed_items(render.atom_pages(spark, sf_dir)))


@query("feed_xml_counts", """
SELECT page_id, count(k) AS n_items
FROM (SELECT DISTINCT o_orderkey // 100 AS page_id FROM orders) p
LEFT JOIN (SELECT DISTINCT o_orderkey // 100 AS pg,
                  CASE WHEN o_orderkey % 4 = 0 THEN '/o/' || o_orderkey
                       ELSE CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS VARCHAR) END AS k
           FROM orders WHERE o_orderkey % 19 <> 0 AND (o_orderkey // 100) % 4 <> 3) i
  ON i.pg = p.page_id
GROUP BY 1
""")
def feed_xml_counts(spark, sf_dir):
    """Malformed documents count zero."""
    docs = render.rss_pages(spark, sf_dir).filter("page_id < 1000000000")
    found = feeds.extract_feed_items(docs, max_items=None).groupBy(
        (F.col("page_seq") - 1).cast("bigint").alias("page_id")
    ).agg(F.count(F.lit(1)).alias("n"))
    return docs.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).alias("n_items")
    )


@query("json_items", """
SELECT CAST(event_id // 100 + 1 AS INTEGER) AS page_seq, 'mzt:' || event_id AS guid,
       CASE WHEN event_id % 23 = 0 THEN 'copy' ELSE event_type END AS title,
       'https://j.example.com:8443/view/' || event_id AS link, CAST(NULL AS VARCHAR) AS author,
       CASE WHEN event_id % 23 = 0 OR event_id % 13 = 0 THEN NULL
            WHEN event_id % 3 = 0 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published_at
FROM events
WHERE (event_id // 100) % 7 <> 5 AND (event_id % 23 <> 0 OR event_id % 10 = 0)
""")
def json_items(spark, sf_dir):
    return _items(feeds.extract_json_items(render.json_pages(spark, sf_dir), max_items=None))


@query("json_items_repeated_names", """
SELECT CAST(event_id // 100 + 1 AS INTEGER) AS page_seq, 'mzt:' || event_id AS guid,
       CASE WHEN event_id % 23 = 0 THEN 'copy' WHEN (event_id // 100) % 3 = 0 AND event_id % 10 <> 0 THEN 'last'
            ELSE event_type END AS title,
       CAST(count(*) OVER (PARTITION BY event_id // 100) AS BIGINT) AS n_items
FROM events
WHERE (event_id // 100) % 7 <> 5 AND (event_id % 23 <> 0 OR event_id % 10 = 0)
""")
def json_items_repeated_names(spark, sf_dir):
    """Every third document has members of equal names, in itself and in its elements."""
    docs = render.json_pages(spark, sf_dir)
    body = F.regexp_replace("html", '","created_at"', '","title":"last","created_at"')
    # blank titles and the copies of every tenth event stay as they are
    body = F.regexp_replace(body, '"title":" ","title":"last"', '"title":" "')
    body = F.regexp_replace(body, r'(\{"id":"?\d*0"?,"title":"[a-z_]*"),"title":"last"', "$1")
    body = F.regexp_replace(body, "^\\{", '{"items":[{"id":1,"title":"first"}],')
    changed = docs.withColumn("html", F.when(F.col("page_seq") % 3 == 1, body).otherwise(F.col("html")))
    found = feeds.extract_json_items(changed, max_items=None)
    counts = found.groupBy("page_seq").agg(F.count(F.lit(1)).alias("n_items"))
    return found.join(counts, "page_seq").select("page_seq", "guid", "title", "n_items")


# --- sources -------------------------------------------------------------------------------

def _sources(spark, sf_dir, base="https://pub.example.com/"):
    docs = render.catalog_documents(spark, sf_dir)
    return catalog.catalog_sources(catalog.catalog_entries(docs), base)


_VALID_SOURCE = "s_suppkey % 9 <> 4 AND s_suppkey % 5 IN (0, 1, 2)"


@query("catalog", f"""
SELECT ((s_suppkey // 50) << 32) + s_suppkey % 50 AS source_ord, 's' || s_suppkey AS key,
       s_name AS feed_title,
       'https://h' || s_nationkey || '.example.com/' || CASE WHEN s_suppkey % 4 = 0 THEN 'rss.xml' ELSE 'list' END AS source_url,
       '/gallery/s' || s_suppkey || '.xml' AS route,
       'https://pub.example.com/gallery/s' || s_suppkey || '.xml' AS public_feed_url,
       CASE s_suppkey % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'links' ELSE 'mzt' END AS parser_kind,
       CASE s_suppkey % 5 WHEN 1 THEN '^/a/' ELSE '' END AS link_pattern
FROM supplier WHERE {_VALID_SOURCE}
""")
def catalog_query(spark, sf_dir):
    return _sources(spark, sf_dir).drop("link_selector", "parent_selector")


@query("catalog_rejects", f"""
SELECT ((s_suppkey // 50) << 32) + s_suppkey % 50 AS source_ord, 's' || s_suppkey AS key,
       CASE WHEN s_suppkey % 9 = 4 THEN 'missing key, title or url' ELSE 'unknown parser' END AS problem
FROM supplier WHERE NOT ({_VALID_SOURCE})
""")
def catalog_rejects(spark, sf_dir):
    docs = render.catalog_documents(spark, sf_dir)
    return catalog.catalog_rejects(catalog.catalog_entries(docs))


@query("dialects", """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'feed_xml' WHEN page_id % 5 = 1 THEN 'links'
    WHEN page_id % 5 = 2 THEN 'json_api' WHEN url LIKE '%/fr/%' THEN 'listing_b'
    WHEN url LIKE '%/de/%' THEN 'highlights' ELSE 'listing_a' END AS dialect
FROM pages
""")
def dialects(spark, sf_dir):
    kinds = F.expr("CASE page_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'links' WHEN 2 THEN 'mzt' ELSE 'auto' END")
    page = F.expr("CASE WHEN url LIKE '%/fr/%' THEN 'https://x.example/forumdisplay.php?fid=1' "
                  "WHEN url LIKE '%/de/%' THEN 'https://x.example/a/index.php/' ELSE url END")
    return table(spark, sf_dir, "pages").select(
        "page_id", catalog.dialect_of(kinds, page).alias("dialect")
    )


@query("dispatch_extract", f"""
WITH a AS ({_LISTING_A.format(where="", limit=100)}), b AS ({_LISTING_B.format(where="", limit=100)})
SELECT 'forum-a' AS feed_key, count(*) AS n_items, count(published_at) AS n_timed FROM a
UNION ALL SELECT 'forum-b', count(*), count(published_at) FROM b
UNION ALL SELECT 'home', count(*), 0 FROM part
UNION ALL SELECT 'gallery', count(*) + count(CASE WHEN (p_partkey // 40) % 2 = 1 AND p_partkey % 4 = 0 THEN 1 END), count(*) FROM part
UNION ALL SELECT 'atom', count(*), count(*) FROM orders
UNION ALL SELECT 'api', count(*), count(CASE WHEN event_id % 23 <> 0 AND event_id % 13 <> 0 THEN 1 END)
FROM events WHERE (event_id // 100) % 7 <> 5 AND (event_id % 23 <> 0 OR event_id % 10 = 0)
""")
def dispatch_extract(spark, sf_dir):
    """All dialects in one job, each page read by the rules of its source."""
    rendered = [render.listing_a_pages, render.listing_b_pages, render.highlights_pages,
                render.gallery_pages, render.atom_pages, render.json_pages]
    pages = None
    for make in rendered:
        part = make(spark, sf_dir).select("page_id", "feed_key", "page_seq", "url", "html")
        if make is render.gallery_pages:
            # the two rule sets of the gallery pages are two sources
            part = part.withColumn("feed_key", F.expr("if(page_id % 2 = 1, 'gallery-1', 'gallery-0')"))
        pages = part if pages is None else pages.unionByName(part)
    kinds = {"atom": "rss", "api": "mzt", "gallery-0": "links", "gallery-1": "links"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    # page numbers are unique per rendered set only
    pages = pages.withColumn("page_id", F.xxhash64("feed_key", "page_id"))
    sources = pages.groupBy(F.col("feed_key").alias("key")).agg(
        F.min("url").alias("source_url")
    ).select(
        "key", "source_url",
        F.coalesce(F.try_element_at(kind, F.col("key")), F.lit("auto")).alias("parser_kind"),
        F.when(F.col("key") == "gallery-0", r"^(?:\.\.)?/album/\d+$").otherwise("").alias("link_pattern"),
        F.when(F.col("key") == "gallery-1", "a.item-link").otherwise("").alias("link_selector"),
        F.when(F.col("key") == "gallery-0", "article.post").otherwise("").alias("parent_selector"),
    )
    found = dispatch.dispatch_extract(pages, sources, max_items=None)
    # per-page limits do not apply; every page of a set is whole
    return found.groupBy(F.regexp_replace("feed_key", "-[01]$", "").alias("feed_key")).agg(
        F.count(F.lit(1)).alias("n_items"), F.count("published_at").alias("n_timed")
    )


@query("all_sources", f"""
SELECT 0 AS source_ord, 'forum-a-fid-16' AS key, '/rss.xml' AS route, 'listing_a' AS dialect
UNION ALL SELECT 1, 'forum-b-fid-19', '/rss/forum-b-fid-19.xml', 'listing_b'
UNION ALL SELECT 2, 'forum-b-highlights', '/rss/forum-b-highlights.xml', 'highlights'
UNION ALL SELECT ((s_suppkey // 50) << 32) + s_suppkey % 50 + 3, 's' || s_suppkey, '/gallery/s' || s_suppkey || '.xml',
  CASE s_suppkey % 5 WHEN 0 THEN 'feed_xml' WHEN 1 THEN 'links' ELSE 'json_api' END
FROM supplier WHERE {_VALID_SOURCE}
""")
def all_sources(spark, sf_dir):
    built = catalog.builtin_sources(
        spark, "https://pub.example.com", "https://a.example.com/thread0806.php?fid=16", "A",
        "https://b.example.com", [("19", "one")], "https://b.example.com/index.php", "home",
    )
    every = catalog.all_sources(built, _sources(spark, sf_dir), 3)
    return every.select(
        "source_ord", "key", "route",
        catalog.dialect_of(F.col("parser_kind"), F.col("source_url")).alias("dialect"),
    )


@query("members_by_route", f"""
SELECT agg AS aggregate_key, 's' || s_suppkey AS child_key,
       row_number() OVER (PARTITION BY agg ORDER BY '/gallery/s' || s_suppkey || '.xml') AS rank
FROM supplier, (SELECT 'gallery' AS agg, '/gallery/' AS prefix UNION ALL SELECT 'ones', '/gallery/s1') a
WHERE {_VALID_SOURCE} AND starts_with('/gallery/s' || s_suppkey || '.xml', prefix)
""")
def members_by_route(spark, sf_dir):
    members = items.members_by_route(
        _sources(spark, sf_dir), {"gallery": "/gallery/", "ones": "/gallery/s1"}
    )
    ranked = ordinals(members, ["aggregate_key"], [F.col("child_ord").asc()], "rank")
    return ranked.select("aggregate_key", "child_key", "rank")


@query("static_opml", f"""
WITH e AS (SELECT s_suppkey, '<outline text="' || replace(s_name, '&', '&amp;') || '" title="' || replace(s_name, '&', '&amp;')
             || '" type="rss" xmlUrl="https://pub.example.com/gallery/s' || s_suppkey || '.xml" />' AS line
           FROM supplier WHERE {_VALID_SOURCE}
           UNION ALL SELECT 9223372036854775807,
             '<outline text="All" title="All" type="rss" xmlUrl="https://pub.example.com/gallery.xml" />'),
     r AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rank FROM e),
     p AS (SELECT (rank - 1) // 25 AS part_no, string_agg(line, '' ORDER BY rank) AS body, count(*) AS n_items FROM r GROUP BY 1)
SELECT part_no, CASE WHEN part_no = 0 THEN '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10)
         || '<opml version="2.0"><head><title>RSS Feeds</title></head><body>' ELSE '' END || body
       || CASE WHEN part_no = (SELECT max(part_no) FROM p) THEN '</body></opml>' ELSE '' END AS content, n_items
FROM p
""")
def static_opml(spark, sf_dir):
    entries = publish.static_opml_entries(
        _sources(spark, sf_dir), "All", "https://pub.example.com/gallery.xml"
    )
    return publish.opml_document_parts(entries, part_size=25)


@query("served_routes", """
SELECT 'c' || o_custkey AS feed_key, count(*) AS n_items, route
FROM orders JOIN customer ON c_custkey = o_custkey,
     LATERAL (SELECT '/c' || c_custkey || '.xml' AS route
              UNION ALL SELECT '/vip/' || c_custkey || '.xml' WHERE c_acctbal > 5000) r
GROUP BY ALL
""")
def served_routes(spark, sf_dir):
    """Some feeds are served under a second route; both share one result."""
    who = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("feed_key"), "c_custkey", "c_acctbal"
    )
    first = who.select("feed_key", F.expr("concat('/c', c_custkey, '.xml')").alias("route"))
    second = who.filter("c_acctbal > 5000").select(
        "feed_key", F.expr("concat('/vip/', c_custkey, '.xml')").alias("route")
    )
    counts = items.feed_counts(order_items(spark, sf_dir))
    return items.serve_aliases(counts, first.unionByName(second))


@query("enumerate_pages", f"""
SELECT 's' || s_suppkey AS key, CAST(n AS INTEGER) AS page_seq,
       'https://h' || s_nationkey || '.example.com/' || CASE WHEN s_suppkey % 4 = 0 THEN 'rss.xml' ELSE 'list' END
         || '?page=' || n AS page_url
FROM supplier, range(1, 6) t(n) WHERE {_VALID_SOURCE}
""")
def enumerate_pages(spark, sf_dir):
    sources = _sources(spark, sf_dir).withColumn(
        "template", F.concat("source_url", F.lit("?page={page}"))
    )
    return hosts.enumerate_pages(sources, "template", limit=5).select("key", "page_seq", "page_url")


@query("crawl_slots", f"""
SELECT 's' || s_suppkey AS key, 'h' || s_nationkey || '.example.com' AS host, slot, (slot - 1) * 10 AS offset_s
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 5 = 2 DESC, s_suppkey) AS slot
      FROM supplier WHERE {_VALID_SOURCE})
""")
def crawl_slots(spark, sf_dir):
    ranked = hosts.crawl_slots(_sources(spark, sf_dir), F.col("parser_kind") == "mzt")
    return ranked.select("key", "host", "slot", "offset_s")


@query("crawl_schedule", f"""
WITH s AS (SELECT *, CAST((1 + s_suppkey % 4) * CASE WHEN s_suppkey % 5 = 2 THEN 5 ELSE 3 END AS BIGINT) AS requests
           FROM supplier WHERE {_VALID_SOURCE}),
     w AS (SELECT *, CAST(coalesce(sum(requests) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 5 = 2 DESC, s_suppkey
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot FROM s)
SELECT 's' || s_suppkey AS key, requests, first_slot, first_slot * 10 AS offset_s, (first_slot + requests) * 10 AS end_s FROM w
""")
def crawl_schedule(spark, sf_dir):
    """Sources of one to four pages; critical ones may try each five times, others three times."""
    critical = F.col("parser_kind") == "mzt"
    pages = 1 + F.regexp_extract("key", "[0-9]+", 0).cast("bigint") % 4
    placed = hosts.crawl_schedule(
        _sources(spark, sf_dir), critical, hosts.request_budget(pages, F.when(critical, 5).otherwise(3)))
    return placed.select("key", "requests", "first_slot", "offset_s", "end_s")


@query("request_spacing", """
WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, 'u' || user_id AS host, (epoch_us(ts) - epoch_us(p)) / 1000000.0 AS gap_s,
       coalesce(epoch_us(ts) - epoch_us(p) < 10000000, false) AS too_close
FROM g
""")
def request_spacing(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumnRenamed("feed_key", "host")
    return hosts.request_spacing(log, ties=("event_id",)).select(
        "event_id", "host", "gap_s", "too_close"
    )


# --- item operators ------------------------------------------------------------------------

@query("keep_first", """
SELECT event_type AS feed_key, 'u' || user_id AS guid, 'event ' || event_id AS title
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM events)
WHERE rn = 1
""")
def keep_first(spark, sf_dir):
    firsts = items.keep_first(
        event_items(spark, sf_dir), ["feed_key", "guid"], ["page_seq", "pos"]
    )
    return firsts.select("feed_key", "guid", "title")


@query("keep_first_turns", """
SELECT conv_id, role, turn, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations)
WHERE rn = 1
""")
def keep_first_turns(spark, sf_dir):
    return items.keep_first(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"])


@query("top_n_per_feed", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rn FROM events),
     r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank FROM f WHERE rn = 1)
SELECT event_type AS feed_key, 'u' || user_id AS guid, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100
""")
def top_n_per_feed(spark, sf_dir):
    firsts = items.keep_first(
        event_items(spark, sf_dir), ["feed_key", "guid"], ["page_seq", "pos"]
    )
    order = [F.col("page_seq").asc(), F.col("pos").asc()]
    return items.top_n(firsts, ["feed_key"], order, 100, rank="rank").select(
        "feed_key", "guid", "rank"
    )


_CUTOFF = """
WITH p AS (SELECT l_returnflag || l_linestatus AS feed_key, l_orderkey // 100 + 1 AS page FROM lineitem),
     e AS (SELECT feed_key, page, CASE WHEN page % 16 IN (1, 2, 4, 7, 11) THEN page ELSE 1 END AS guid FROM p),
     r AS (SELECT DISTINCT feed_key, {k} AS k, {cap} AS cap FROM p),
     firsts AS (SELECT feed_key, guid, min(page) AS page FROM e JOIN r USING (feed_key)
                WHERE cap IS NULL OR page <= cap GROUP BY ALL),
     fresh AS (SELECT DISTINCT feed_key, page FROM firsts),
     gaps AS (SELECT feed_key, page, page - lag(page, 1, 0) OVER (PARTITION BY feed_key ORDER BY page) AS step FROM fresh),
     stops AS (SELECT feed_key, min(page) AS stop FROM gaps JOIN r USING (feed_key) WHERE step > k GROUP BY 1)
SELECT f.feed_key, 'g' || f.guid AS guid, CAST(f.page AS INTEGER) AS page_seq
FROM firsts f LEFT JOIN stops s USING (feed_key) WHERE s.stop IS NULL OR f.page < s.stop
"""
# every rule that a source may have, and a page bound for one of them
_RULES = "CASE feed_key WHEN 'AF' THEN 1 WHEN 'NF' THEN 2 WHEN 'RF' THEN 3 END"
_BOUND = "CASE feed_key WHEN 'NO' THEN 9 WHEN 'RF' THEN 0 END"


def _paged_items(spark, sf_dir):
    """Pages that bring something new with gaps of one, two, three and more pages between them."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) AS feed_key",
        "cast(l_orderkey div 100 + 1 AS int) AS page_seq",
        "cast(l_orderkey % 100 * 10 + l_linenumber AS int) AS pos",
    ).withColumn("guid", F.expr(
        "concat('g', if(page_seq % 16 IN (1, 2, 4, 7, 11), page_seq, 1))"))


def _cutoff(spark, sf_dir, empty_pages, max_pages=None):
    found = items.page_cutoff(_paged_items(spark, sf_dir), empty_pages, max_pages)
    return found.select("feed_key", "guid", "page_seq")


@query("page_cutoff_k1", _CUTOFF.format(k=1, cap="NULL"))
def page_cutoff_k1(spark, sf_dir):
    return _cutoff(spark, sf_dir, 1)


@query("page_cutoff_k2", _CUTOFF.format(k=2, cap=200))
def page_cutoff_k2(spark, sf_dir):
    return _cutoff(spark, sf_dir, 2, 200)


@query("page_cutoff_k3", _CUTOFF.format(k=3, cap="NULL"))
def page_cutoff_k3(spark, sf_dir):
    return _cutoff(spark, sf_dir, 3)


@query("page_cutoff_none", _CUTOFF.format(k="CAST(NULL AS INTEGER)", cap="NULL"))
def page_cutoff_none(spark, sf_dir):
    return _cutoff(spark, sf_dir, None)


@query("page_cutoff_rules", _CUTOFF.format(k=_RULES, cap=f"NULLIF({_BOUND}, 0)"))
def page_cutoff_rules(spark, sf_dir):
    """Sources with different rules in one pass."""
    return _cutoff(spark, sf_dir, F.expr(_RULES), F.expr(_BOUND))


@query("missing_pages", """
WITH p AS (SELECT DISTINCT l_returnflag || l_linestatus AS feed_key, l_orderkey // 100 + 1 AS page FROM lineitem),
     landed AS (SELECT * FROM p WHERE page % 16 <> 4 AND page % 16 <> 6),
     f AS (SELECT DISTINCT feed_key, CASE feed_key WHEN 'AF' THEN 1 WHEN 'NF' THEN 2 WHEN 'RF' THEN 3 END AS k FROM landed),
     n AS (SELECT feed_key, min(g) AS page FROM f, LATERAL (SELECT unnest(generate_series(1, 100)) AS g) WHERE NOT EXISTS
             (SELECT 1 FROM landed l WHERE l.feed_key = f.feed_key AND l.page = g) GROUP BY 1),
     fresh AS (SELECT feed_key, page, page - lag(page, 1, 0) OVER (PARTITION BY feed_key ORDER BY page) AS step
               FROM landed WHERE page % 16 IN (1, 2, 7, 11)),
     stop AS (SELECT feed_key, min(page) FILTER (WHERE step > k) AS stop, max(page) AS most FROM fresh JOIN f USING (feed_key) GROUP BY 1),
     last AS (SELECT s.feed_key, CASE WHEN s.stop IS NULL THEN s.most
                ELSE (SELECT max(page) FROM fresh x WHERE x.feed_key = s.feed_key AND x.page < s.stop) END AS last FROM stop s)
SELECT n.feed_key, CAST(n.page AS INTEGER) AS page_seq FROM n JOIN f USING (feed_key) JOIN last USING (feed_key)
WHERE k IS NULL OR n.page <= last + k
""")
def missing_pages(spark, sf_dir):
    """Sources that would have gone on through a page that never landed."""
    found = _paged_items(spark, sf_dir).filter("page_seq % 16 NOT IN (4, 6)")
    return items.missing_pages(found, found.select("feed_key", "page_seq"), F.expr(_RULES))


_MERGED = """
WITH m AS (SELECT DISTINCT 'all' AS agg, event_type AS child FROM events
           UNION SELECT DISTINCT 'short', event_type FROM events WHERE length(event_type) <= 5),
     i AS (SELECT agg, event_type, user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS pub
           FROM events JOIN m ON m.child = event_type),
     f AS (SELECT *, row_number() OVER (PARTITION BY agg, user_id ORDER BY event_type, event_id) AS rn FROM i),
     r AS (SELECT *, row_number() OVER (PARTITION BY agg ORDER BY pub DESC NULLS LAST, event_type, event_id) AS rank
           FROM f WHERE rn = 1)
SELECT agg AS feed_key, 'u' || user_id AS guid, 'event ' || event_id AS title, rank,
       strftime(pub, '%Y-%m-%d %H:%M:%S.%f') AS published_at
FROM r WHERE rank <= {limit}
"""


def _merged(spark, sf_dir, max_items):
    found = event_items(spark, sf_dir)
    kinds = found.select("feed_key").distinct()
    members = kinds.select(
        F.lit("all").alias("aggregate_key"), F.col("feed_key").alias("child_key"),
        F.col("feed_key").alias("child_ord"),
    )
    short = members.filter("length(child_key) <= 5").withColumn("aggregate_key", F.lit("short"))
    merged = items.merge_feeds(found, members.unionByName(short), max_items)
    order = items.newest_first("child_ord", "page_seq", "pos")
    return ordinals(merged, ["feed_key"], order, "rank").select(
        "feed_key", "guid", "title", "rank", time_text(micros=True)
    )


@query("merge_feeds", _MERGED.format(limit=10**9))
def merge_feeds(spark, sf_dir):
    return _merged(spark, sf_dir, None)


@query("merge_feeds_capped", _MERGED.format(limit=100))
def merge_feeds_capped(spark, sf_dir):
    return _merged(spark, sf_dir, 100)


@query("new_items", """
SELECT event_type AS feed_key, 'u' || user_id AS guid, 'event ' || min(event_id) AS title
FROM events e WHERE ts >= TIMESTAMP '2024-01-02'
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = e.event_type AND p.user_id = e.user_id
                  AND p.ts < TIMESTAMP '2024-01-02')
GROUP BY event_type, user_id
""")
def new_items(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed_key"), F.concat(F.lit("u"), "user_id").alias("guid"),
        F.concat(F.lit("event "), "event_id").alias("title"), "ts",
        F.col("event_id").alias("page_seq"), F.lit(0).alias("pos"),
    )
    later = log.filter("ts >= timestamp_ntz'2024-01-02'")
    earlier = log.filter("ts < timestamp_ntz'2024-01-02'")
    return items.new_items(later, earlier).select("feed_key", "guid", "title")


@query("left_biased_routes", """
SELECT CAST(c_custkey AS BIGINT) AS route, c_name AS target FROM customer WHERE c_acctbal > 5000
UNION ALL
SELECT o_custkey, 'default' FROM (SELECT DISTINCT o_custkey FROM orders)
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
""")
def left_biased_routes(spark, sf_dir):
    given = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(
        F.col("c_custkey").alias("route"), F.col("c_name").alias("target")
    )
    default = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("route"), F.lit("default").alias("target")
    ).distinct()
    return items.left_biased(given, default, "route")


# --- publishing ----------------------------------------------------------------------------

_ITEM = """'<item><title>R&amp;D &lt;' || o_orderpriority || '&gt;</title><link>https://o.example.com/?a=1&amp;id='
    || o_orderkey || '</link><guid isPermaLink="false">order:' || o_orderkey || '</guid>'
    || CASE WHEN o_orderstatus <> 'F' THEN '<dc:creator>clerk ' || o_orderstatus || '</dc:creator>' ELSE '' END
    || CASE WHEN o_orderkey % 11 <> 0 THEN '<pubDate>' || strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000')
         || '</pubDate>' ELSE '' END || '</item>'"""
_HEAD = """'<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10) || '<rss'
    || CASE WHEN creator THEN ' xmlns:dc="http://purl.org/dc/elements/1.1/"' ELSE '' END
    || ' version="2.0"><channel><title>Feed ' || feed || '</title><link>https://o.example.com/' || feed
    || '</link><description>Metadata-only feed: https://pub.example.com/' || feed
    || '.xml</description><lastBuildDate>Sat, 22 Aug 2026 17:19:19 +0000</lastBuildDate>'"""
_BUILT = "timestamp'2026-08-22 17:19:19'"


def _feed_table(spark, sf_dir, rows: DataFrame) -> DataFrame:
    key = F.col("feed_key")
    return rows.select("feed_key").distinct().select(
        "feed_key", F.concat(F.lit("Feed "), key).alias("feed_title"),
        F.concat(F.lit("https://o.example.com/"), key).alias("source_url"),
        F.concat(F.lit("https://pub.example.com/"), key, F.lit(".xml")).alias("public_feed_url"),
    )


def _order_documents(spark, sf_dir, max_items=10):
    rows = order_items(spark, sf_dir)
    return publish.rss_documents(
        rows, _feed_table(spark, sf_dir, rows), items.newest_first("pos"), F.expr(_BUILT), max_items
    )


_DOCUMENTS = f"""
WITH r AS (SELECT *, 'c' || o_custkey AS feed, row_number() OVER (PARTITION BY o_custkey ORDER BY
             CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS rank FROM orders),
     d AS (SELECT feed, string_agg({_ITEM}, '' ORDER BY rank) AS body, count(*) AS n_items,
                  bool_or(o_orderstatus <> 'F') AS creator FROM r WHERE rank <= 10 GROUP BY feed)
SELECT feed AS feed_key, {_HEAD} || body || '</channel></rss>' AS content, n_items FROM d
"""


@query("rss_documents", _DOCUMENTS)
def rss_documents(spark, sf_dir):
    return _order_documents(spark, sf_dir)


@query("rss_document_parts", f"""
WITH r AS (SELECT *, o_orderstatus AS feed, row_number() OVER (PARTITION BY o_orderstatus ORDER BY
             CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS rank FROM orders),
     p AS (SELECT feed, (rank - 1) // 500 AS part_no, string_agg({_ITEM}, '' ORDER BY rank) AS body,
                  count(*) AS n_items, feed <> 'F' AS creator FROM r GROUP BY feed, part_no),
     w AS (SELECT *, max(part_no) OVER (PARTITION BY feed) AS last_part FROM p)
SELECT feed AS feed_key, part_no, CASE WHEN part_no = 0 THEN {_HEAD} ELSE '' END || body
       || CASE WHEN part_no = last_part THEN '</channel></rss>' ELSE '' END AS content, n_items
FROM w
""")
def rss_document_parts(spark, sf_dir):
    rows = order_items(spark, sf_dir)
    status = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("guid"), "o_orderstatus"
    )
    by_status = rows.join(status, "guid").withColumn("feed_key", F.col("o_orderstatus"))
    return publish.rss_document_parts(
        by_status, _feed_table(spark, sf_dir, by_status), items.newest_first("pos"),
        F.expr(_BUILT), part_size=500,
    )


@query("rss_round_trip", """
SELECT 'c' || o_custkey AS feed_key, 'rss:order:' || o_orderkey AS guid,
       'R&D <' || o_orderpriority || '>' AS title, 'https://o.example.com/?a=1&id=' || o_orderkey AS link,
       CASE WHEN o_orderstatus <> 'F' THEN 'clerk ' || o_orderstatus END AS author,
       CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS published_at
FROM orders
""")
def rss_round_trip(spark, sf_dir):
    """Publish every order, read the documents again."""
    docs = _order_documents(spark, sf_dir, 2**31 - 1).select(
        F.xxhash64("feed_key").alias("page_id"), "feed_key", F.lit(1).alias("page_seq"),
        F.lit("https://o.example.com/").alias("url"), F.col("content").alias("html"),
    )
    found = feeds.extract_feed_items(docs, max_items=None)
    return found.select("feed_key", "guid", "title", "link", "author", time_text())


@query("opml_document", """
WITH e AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rank,
                  '<outline text="' || t || '" title="' || t || '" type="rss" xmlUrl="https://p.example.com/?a=1&amp;s='
                    || s_suppkey || '" />' AS line
           FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'RSS Feed'
                   ELSE replace(s_name, '#', '&quot;') END AS t FROM supplier WHERE s_suppkey % 10 <> 9)),
     p AS (SELECT (rank - 1) // 40 AS part_no, string_agg(line, '' ORDER BY rank) AS body, count(*) AS n_items
           FROM e GROUP BY 1)
SELECT part_no, CASE WHEN part_no = 0 THEN '<?xml version=''1.0'' encoding=''utf-8''?>' || chr(10)
         || '<opml version="2.0"><head><title>RSS Feeds</title></head><body>' ELSE '' END || body
       || CASE WHEN part_no = (SELECT max(part_no) FROM p) THEN '</body></opml>' ELSE '' END AS content, n_items
FROM p
""")
def opml_document(spark, sf_dir):
    url = F.expr("concat('https://p.example.com/?a=1&s=', s_suppkey)")
    registry = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entry_ord"),
        F.expr("if(s_suppkey % 6 = 0, '', replace(s_name, '#', '\"'))").alias("source_title"),
        F.lit(None).cast("string").alias("aggregate_title"),
        F.when(F.expr("s_suppkey % 10 NOT IN (8, 9)"), url).alias("source_url"),
        F.when(F.expr("s_suppkey % 10 <> 9"), url).alias("aggregate_url"),
    )
    # the same feeds registered once more under other titles change nothing
    again = registry.withColumn("entry_ord", F.col("entry_ord") + 1000000000).withColumn(
        "source_title", F.lit("again")
    )
    entries = publish.opml_entries(registry.unionByName(again))
    return publish.opml_document_parts(entries, part_size=40)


@query("feed_counts", "SELECT event_type AS feed_key, count(*) AS n_items FROM events GROUP BY 1")
def feed_counts(spark, sf_dir):
    return items.feed_counts(event_items(spark, sf_dir))


def _failures(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_custkey").alias("source_ord")
    )
    errors = event_log(spark, sf_dir).filter("NOT ok").select(
        F.expr("concat('c', substring(feed_key, 2))").alias("feed_key"), "at",
        F.concat(F.lit("Error"), "event_id").alias("error_type"),
    )
    return items.failed_sources(
        sources, order_items(spark, sf_dir).filter("author IS NOT NULL"), errors
    )


_FAILED = """
  failed AS (SELECT c_custkey AS k, 'c' || c_custkey AS feed_key, coalesce(
               (SELECT 'Error' || arg_max(event_id, ts) FROM events
                WHERE event_type = 'error' AND user_id = c_custkey), 'EmptyListing') AS error_type
             FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F'))
"""


@query("failed_sources", f"WITH {_FAILED} SELECT feed_key, error_type FROM failed")
def failed_sources(spark, sf_dir):
    return _failures(spark, sf_dir).select("feed_key", "error_type")


@query("failure_lines", f"""
WITH {_FAILED}, r AS (SELECT *, row_number() OVER (ORDER BY k) AS rank FROM failed)
SELECT (rank - 1) // 20 AS part_no, string_agg(feed_key || ': ' || error_type, '; ' ORDER BY rank) AS warnings,
       count(*) AS n_failures
FROM r GROUP BY 1
""")
def failure_lines(spark, sf_dir):
    return publish.failure_lines(_failures(spark, sf_dir), part_size=20)


@query("run_summary", """
SELECT 'c' || o_custkey AS feed_key, count(*) AS n_items,
       'wrote c' || o_custkey || '.xml: ' || count(*) || ' items' AS line
FROM orders GROUP BY o_custkey
""")
def run_summary(spark, sf_dir):
    return publish.run_summary(items.feed_counts(order_items(spark, sf_dir)))


@query("write_feeds", """
SELECT o_orderpriority || '/' || o_orderstatus AS feed_key, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS version,
       count(*) AS n_items
FROM orders GROUP BY 1, 2
""")
def write_feeds(spark, sf_dir):
    """Two runs; feeds that the second run lacks keep their first documents."""
    path = scratch_path(spark, "feeds")
    status = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order:"), "o_orderkey").alias("guid"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("status"),
    )
    rows = order_items(spark, sf_dir).join(status, "guid").withColumn("feed_key", F.col("status"))
    docs = publish.rss_document_parts(
        rows, _feed_table(spark, sf_dir, rows), items.newest_first("pos"), F.expr(_BUILT), 500
    )
    publish.write_feeds(docs.withColumn("version", F.lit(1)), path)
    publish.write_feeds(
        docs.filter(F.endswith("feed_key", F.lit("P"))).withColumn("version", F.lit(2)), path
    )
    return spark.read.parquet(path).groupBy("feed_key", "version").agg(
        F.sum("n_items").alias("n_items")
    )


@query("feed_runs", """
SELECT 'c' || o_custkey AS feed_key, CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS run,
       least(count(*), 10) AS n_items
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2
""")
def feed_runs(spark, sf_dir):
    """One feed per customer, kept as runs; the second run brings only some feeds."""
    path = scratch_path(spark, "runs")
    docs = _order_documents(spark, sf_dir)
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(
        F.concat(F.lit("c"), "c_custkey").alias("feed_key")
    )
    publish.append_feed_run(docs, path, 1)
    publish.append_feed_run(docs.join(rich, "feed_key", "left_semi"), path, 2)
    return publish.current_feeds(spark, path).select("feed_key", "run", "n_items")


@query("feed_runs_compacted", """
WITH c AS (SELECT o_custkey, count(*) AS n_items FROM orders GROUP BY 1)
SELECT a.as_of, 'c' || o_custkey AS feed_key, CAST(least(a.as_of, 1 + o_custkey % 5) AS INTEGER) AS run,
       CAST(n_items AS BIGINT) AS n_items
FROM c, (SELECT 3 AS as_of UNION ALL SELECT 4 UNION ALL SELECT 5) a
""")
def feed_runs_compacted(spark, sf_dir):
    """Five runs of whole documents, each of fewer feeds, folded after the second, third and fifth;
    read as of the last three."""
    path = scratch_path(spark, "runs")
    rows = order_items(spark, sf_dir)
    parts = publish.rss_document_parts(rows, _feed_table(spark, sf_dir, rows), items.newest_first("pos"), F.expr(_BUILT))
    parts = materialize(parts, "parts")
    for run in range(1, 6):
        own = parts.filter(F.regexp_extract("feed_key", "[0-9]+", 0).cast("bigint") % 5 >= run - 1)
        publish.append_feed_run(own, path, run)
        if run in (2, 3, 5):
            publish.compact_feed_runs(spark, path, run)
    found = None
    for run in (3, 4, 5):
        then = publish.current_feeds(spark, path, as_of=run).groupBy("feed_key", "run").agg(F.sum("n_items").alias("n_items"))
        then = then.select(F.lit(run).alias("as_of"), "feed_key", "run", "n_items")
        found = then if found is None else found.unionByName(then)
    return found


@query("publish_snapshot", """
SELECT o_orderpriority AS title, count(*) AS n FROM orders GROUP BY 1
""")
def publish_snapshot(spark, sf_dir):
    """The second version replaces the first as a whole."""
    path = scratch_path(spark, "snapshot")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    publish.publish_snapshot(rows.withColumn("o_orderpriority", F.lit("old")), path, 1)
    publish.publish_snapshot(rows, path, 2)
    current = publish.read_snapshot(spark, path, rows.schema)
    return current.groupBy(F.col("o_orderpriority").alias("title")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _build_input(spark, sf_dir):
    """Pages of three dialects and their sources, one of which gave nothing, and a merged feed."""
    pages = None
    for make in (render.listing_b_pages, render.gallery_pages, render.atom_pages):
        part = make(spark, sf_dir).filter("page_id < 1000000000").select(
            F.xxhash64("feed_key", "page_id").alias("page_id"), "feed_key", "page_seq", "url", "html"
        )
        if make is render.gallery_pages:
            part = part.withColumn("feed_key", F.expr("if(page_seq % 2 = 0, 'gallery-1', 'gallery-0')"))
        pages = part if pages is None else pages.unionByName(part)
    known = pages.groupBy(F.col("feed_key").alias("key")).agg(F.min("url").alias("source_url"))
    # a few rows that every step of a build reads; not rendered again for each
    known = materialize(known, "known-sources")
    known = known.unionByName(spark.range(1).selectExpr("'silent' AS key", "'https://s.example/' AS source_url"))
    k = F.col("key")
    sources = known.select(
        F.xxhash64("key").alias("source_ord"), "key", "source_url", F.concat(F.lit("Feed "), k).alias("feed_title"),
        F.when(k == "forum-b", "/rss/b.xml").otherwise(F.concat(F.lit("/gallery/"), k)).alias("route"),
        F.concat(F.lit("https://p.example/"), k).alias("public_feed_url"),
        F.when(k == "forum-b", "auto").when(k == "atom", "rss").otherwise("links").alias("parser_kind"),
        F.when(k == "gallery-0", r"^(?:\.\.)?/album/\d+$").otherwise("").alias("link_pattern"),
        F.when(k == "gallery-1", "a.item-link").otherwise("").alias("link_selector"),
        F.when(k == "gallery-0", "article.post").otherwise("").alias("parent_selector"),
        (k == "forum-b").alias("images_only"), F.when(k == "forum-b", 1).alias("empty_pages"),
    )
    merged = {"all": {"prefix": "/gallery/", "title": "All", "source_url": "https://p.example/", "url": "https://p.example/all"}}
    return pages, sources, merged


@query("build_feeds", f"""
WITH b AS ({_LISTING_B.format(where="AND o_orderkey % 3 = 0", limit=100)}),
     shown AS (SELECT guid FROM b),
     g AS (SELECT (p_partkey // 40) % 2 AS feed, CAST(p_partkey AS VARCHAR) AS album FROM part
           UNION SELECT 1, '9' || p_partkey FROM part WHERE (p_partkey // 40) % 2 = 1 AND p_partkey % 4 = 0)
SELECT 'forum-b' AS feed_key, CAST(count(*) AS BIGINT) AS n_items FROM shown
UNION ALL SELECT 'gallery', count(*) FROM g
UNION ALL SELECT 'atom', count(*) FROM orders
UNION ALL SELECT 'all', (SELECT count(DISTINCT album) FROM g) + (SELECT count(*) FROM orders)
UNION ALL SELECT 'failed', 1
UNION ALL SELECT 'opml', 6
""")
def build_feeds(spark, sf_dir):
    """One run from landed pages to documents; counts of what it publishes."""
    pages, sources, merged = _build_input(spark, sf_dir)
    run = build.build_feeds(pages, sources, merged, F.expr(_BUILT), page_items=None)
    path = scratch_path(spark, "build")
    build.write_build(run, path)
    written = spark.read.parquet(f"{path}/feeds").groupBy(
        F.regexp_replace("feed_key", "-[01]$", "").alias("feed_key")
    ).agg(F.sum("n_items").alias("n_items"))
    failed = spark.read.json(f"{path}/warnings").select(
        F.lit("failed").alias("feed_key"), F.col("n_failures").alias("n_items")
    )
    opml = spark.read.text(f"{path}/opml", wholetext=True).select(
        F.lit("opml").alias("feed_key"),
        (F.size(F.split("value", "<outline ")) - 1).cast("bigint").alias("n_items"),
    ).groupBy("feed_key").agg(F.sum("n_items").alias("n_items"))
    return written.unionByName(failed).unionByName(opml)


@query("build_landed", f"""
WITH b AS ({_LISTING_B.format(where="AND o_orderkey % 3 = 0", limit=100)}), g AS ({_GALLERY.replace("rank <= 35", "rank > 0")})
SELECT 'forum-b' AS feed_key, guid FROM b
UNION ALL SELECT DISTINCT CASE WHEN page_seq % 2 = 0 THEN 'gallery-1' ELSE 'gallery-0' END, guid FROM g
UNION ALL SELECT 'atom', 'rss:tag:' || o_orderkey FROM orders
""")
def build_landed(spark, sf_dir):
    """Pages land by dialect in three batches of a stream, and a build reads them where they lie."""
    pages, sources, merged = _build_input(spark, sf_dir)
    arrived, landed = scratch_path(spark, "arrived"), scratch_path(spark, "landed")
    # three batches, each of as many files as the session writes at once
    files = max(1, spark.sparkContext.defaultParallelism)
    pages.repartition(3 * files, "page_id").write.parquet(arrived)
    stream = page_source.stream_pages(spark, arrived, files_per_trigger=files)
    dispatch.start_landing(stream, sources, landed, scratch_path(spark, "landing-checkpoint")).awaitTermination()
    run = build.build_feeds(page_source.read_pages(spark, landed), sources, merged, F.expr(_BUILT), landed=True)
    return run.items.select("feed_key", "guid")


@query("page_failures", """
SELECT 'h' AS feed_key, page_id, 'UnreadableHtml' AS error_type FROM pages WHERE page_id % 5 = 1
UNION ALL SELECT 'x', page_id, 'UnreadableXml' FROM pages WHERE page_id % 5 = 2
UNION ALL SELECT 'j', page_id, 'UnreadableJson' FROM pages WHERE page_id % 5 = 4
""")
def page_failures(spark, sf_dir):
    """Every page as each kind of document, broken in most; blank ones among them."""
    kinds = table(spark, sf_dir, "pages").select(
        "page_id", F.explode(F.expr("""array(
            struct('h' AS feed_key, 'links' AS dialect, if(page_id % 5 = 1, concat(html, '<![x[ y]]>'), html) AS html),
            struct('x' AS feed_key, 'feed_xml' AS dialect,
                   if(page_id % 5 = 2, '<rss><a></rss>', if(page_id % 5 = 0, ' ', '<rss/>')) AS html),
            struct('j' AS feed_key, 'json_api' AS dialect, CASE page_id % 5 WHEN 3 THEN '{"a": 1, "a": 2}'
                   WHEN 4 THEN '{"items": [' WHEN 0 THEN '' ELSE '{"items": []}' END AS html))""")).alias("d"))
    return dispatch.page_failures(kinds.select("page_id", "d.*"))


# --- probing -------------------------------------------------------------------------------

@query("extract_urls", r"""
WITH m AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') || '/more' AS more FROM pages)
SELECT page_id AS doc_id, CAST(0 AS INTEGER) AS pos, url FROM m
UNION ALL SELECT page_id, 1, url FROM m
UNION ALL SELECT page_id, 2, more FROM m WHERE page_id % 3 = 0
""")
def extract_urls(spark, sf_dir):
    return probe.extract_urls(render.markdown(spark, sf_dir))


def _responses(spark, sf_dir):
    """Pages as landed responses; some declare feeds, some failed, some are no HTML."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS input_ord", "url",
        "CASE WHEN page_id % 10 = 9 THEN CAST(NULL AS int) WHEN page_id % 10 = 8 THEN 404 ELSE 200 END AS status",
        "if(page_id % 10 = 9, CAST(NULL AS string), concat(url, '')) AS final_url",
        "if(page_id % 10 = 7, 'application/pdf', 'text/html; charset=utf-8') AS content_type",
        """cast(if(page_id % 3 = 0, concat(
            '<link rel="alternate nofollow" type="application/RSS+xml" href="/feed.xml">',
            '<link rel="alternate" type="text/css" href="/x.css">',
            '<link rel="alternate" type="application/atom+xml" href="atom/"/>',
            '<link href="/feed.xml" type="text/xml" rel="alternate">',
            if(page_id % 6 = 0, '<!-- Powered by WordPress -->', '<i>phpBB</i>'), html), html) AS binary) AS body""",
        "if(page_id % 10 = 9, 'ConnectTimeout', '') AS error",
    )


_PROBED = r"""
WITH p AS (SELECT *, page_id % 10 AS r, page_id % 10 < 7 AS is_html,
             regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o,
             regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS dir FROM pages)
SELECT page_id AS input_ord, url, r < 8 AS ok,
       CASE WHEN r = 9 THEN NULL WHEN r = 8 THEN 404 ELSE 200 END AS status, url AS final_url,
       CASE r WHEN 9 THEN 'ConnectTimeout' WHEN 8 THEN 'HTTPError' ELSE '' END AS error,
       CASE WHEN is_html THEN substr(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
         '\s+', ' ', 'g')), 1, 120) ELSE '' END AS title,
       CASE WHEN is_html AND page_id % 6 = 0 THEN 'wordpress' WHEN is_html AND page_id % 3 = 0 THEN 'phpbb'
            ELSE 'unknown' END AS generator,
       CASE WHEN is_html AND page_id % 3 = 0 THEN o || '/feed.xml ' || o || dir || 'atom/' ELSE '' END AS feeds
FROM p
"""


@query("probe_pages", _PROBED)
def probe_pages(spark, sf_dir):
    return probe.probe_pages(_responses(spark, sf_dir), **probe.LIMITS).withColumn(
        "feeds", F.array_join("feeds", " ")
    )


@query("probe_lines", f"""
SELECT input_ord, coalesce(CAST(status AS VARCHAR), nullif(error, ''), 'error') || chr(9) || generator || chr(9)
       || CASE WHEN feeds = '' THEN 0 ELSE 2 END || chr(9) || url AS line
FROM ({_PROBED})
""")
def probe_lines(spark, sf_dir):
    return probe.probe_lines(probe.probe_pages(_responses(spark, sf_dir), **probe.LIMITS))


@query("decode_body", """
SELECT page_id, octet_length(encode(html)) + 3 AS n_bytes, true AS same FROM pages
""")
def decode_body(spark, sf_dir):
    """A malformed byte becomes the replacement character, the rest stays."""
    broken = F.concat(F.col("html").cast("binary"), F.unhex(F.lit("FF")))
    text = page_source.decode_body(broken)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.octet_length(text).cast("bigint").alias("n_bytes"),
        (text == F.concat("html", F.lit("�"))).alias("same"),
    )


@query("cache_by_host", """
SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, max(page_id) AS page_id,
       arg_max(length(html), page_id) AS n_chars
FROM pages GROUP BY 1
""")
def cache_by_host(spark, sf_dir):
    path = scratch_path(spark, "host-cache")
    probe.write_host_cache(table(spark, sf_dir, "pages"), path)
    return spark.read.parquet(path).select(
        "host", "page_id", F.length("html").cast("bigint").alias("n_chars")
    )


@query("probe_report", _PROBED)
def probe_report(spark, sf_dir):
    """The JSON report, written and read again."""
    path = scratch_path(spark, "probe-report")
    found = probe.probe_pages(_responses(spark, sf_dir), **probe.LIMITS)
    probe.write_probe_report(found, path)
    return spark.read.schema(found.schema).json(path).withColumn("feeds", F.array_join("feeds", " "))


@query("raw_pages", """
SELECT page_id, left(html, 20) AS head, length(html) AS n_chars FROM pages
""")
def raw_pages(spark, sf_dir):
    """Pages as raw files, read back; the head is what a reader with a cap of 20 bytes sees."""
    path = scratch_path(spark, "raw-pages")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    # listing takes a task for each folder below the path, so that some pages' folders share one; whoever lists files
    # holds what it found, so that shelves form sets and the files of one set only are there to the driver at once
    shelves = max(1, -(-pages.count() // 64))
    sets = -(-shelves // (page_source.FILES_AT_ONCE // 64))
    shelf = F.pmod(F.xxhash64("page_id"), F.lit(shelves))
    pages = pages.select((shelf % sets).cast("int").alias("set"), shelf.alias("shelf"), "page_id", "html")
    if sets > 1:
        pages = materialize(pages.repartition("set"), "pages-by-set", partition_by="set")
    # a file costs far more than its bytes, so pages are dealt by number and not by size; one page stays in one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for one in range(sets):
        page_source.write_files(pages.where(F.col("set") == one).drop("set").repartition(tasks, "page_id"),
                                f"{path}/{one}", "shelf", "page_id")
    # the writer ends every file with a line's end
    whole = F.regexp_replace(page_source.decode_body(F.col("body")), "\\n\\z", "")
    return page_source.read_file_sets(spark, [f"{path}/{one}" for one in range(sets)], [
        F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("bigint").alias("page_id"),
        page_source.decode_body(F.col("body"), 20).alias("head"), F.length(whole).cast("bigint").alias("n_chars"),
    ], "*.txt")


@query("section_names", """
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS first,
       CASE WHEN n_nationkey % 2 = 0 THEN 'r ' || n_regionkey END AS second, 'title' AS local, 'creator' AS prefixed
FROM nation
""")
def section_names(spark, sf_dir):
    """Names of a ``;`` list by their place, shorter or longer than the keys; names without namespace."""
    named = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", """concat(if(n_nationkey % 3 = 0, concat(' ', n_name, '  '), ''),
            if(n_nationkey % 2 = 0, concat('; r ', n_regionkey, ';extra'), '')) AS raw""",
        "concat('{urn:', n_name, '}title') AS uri", "concat(lower(left(n_name, 2)), ':creator') AS prefixed")
    names = strings.names_by_key(["19", "21"], F.col("raw"))
    return named.withColumn("names", names).select(
        "n_nationkey", F.nullif(F.col("names")["19"], F.lit("")).alias("first"),
        F.col("names")["21"].alias("second"), strings.local_name(F.col("uri")).alias("local"),
        strings.local_name(F.col("prefixed")).alias("prefixed"))


# --- freshness -----------------------------------------------------------------------------

_RULE = """CASE WHEN epoch_us({now}) < epoch_us(ok_at) + {ttl} * 1000000::BIGINT THEN 'fresh'
     WHEN fail_at IS NOT NULL AND (ok_at IS NULL OR fail_at > ok_at)
       AND epoch_us({now}) < epoch_us(fail_at) + {retry} * 1000000::BIGINT
     THEN CASE WHEN ok_at IS NULL THEN 'unavailable' ELSE 'stale' END ELSE 'due' END"""
_NOW = "2024-01-20 12:00:00"


@query("feed_state", f"""
WITH s AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok_at,
                  max(ts) FILTER (event_type = 'error') AS fail_at
           FROM events WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 1)
SELECT 'u' || user_id AS feed_key, {_RULE.format(now=f"TIMESTAMP '{_NOW}'", ttl=20000, retry=50000)} AS state
FROM s
""")
def feed_state(spark, sf_dir):
    now = F.expr(f"timestamp'{_NOW}'")
    return freshness.feed_state_at(event_log(spark, sf_dir), now, 20000, 50000).select(
        "feed_key", "state"
    )


@query("feed_state_asof", f"""
WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
     s AS (SELECT q.event_id, q.user_id, q.ts, max(e.ts) FILTER (e.event_type <> 'error') AS ok_at,
                  max(e.ts) FILTER (e.event_type = 'error') AS fail_at
           FROM q LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') e
             ON e.user_id = q.user_id AND e.ts <= q.ts GROUP BY ALL)
SELECT event_id AS request_id, 'u' || user_id AS feed_key, {_RULE.format(now="ts", ttl=9000, retry=30000)} AS state
FROM s
""")
def feed_state_asof(spark, sf_dir):
    """Purchases ask for their user's feed; the other events refresh it."""
    log = event_log(spark, sf_dir)
    requests = log.filter("event_type = 'purchase'").withColumnRenamed("event_id", "request_id")
    refreshes = log.filter("event_type <> 'purchase'")
    return freshness.feed_state_asof(refreshes, requests, 9000, 30000).select(
        "request_id", "feed_key", "state"
    )


@query("last_good", """
SELECT 'u' || user_id AS feed_key, arg_max(props, ts) FILTER (event_type <> 'error') AS content,
       strftime(max(ts) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M:%S.%f') AS generated_at,
       coalesce(max(ts) FILTER (event_type = 'error') > max(ts) FILTER (event_type <> 'error'), false) AS is_stale,
       CASE WHEN max(ts) FILTER (event_type = 'error') > max(ts) FILTER (event_type <> 'error') THEN 60 ELSE 600 END AS max_age_s
FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0
""")
def last_good(spark, sf_dir):
    results = event_log(spark, sf_dir).withColumnRenamed("props", "content")
    return freshness.with_max_age(freshness.last_good(results)).select(
        "feed_key", "content", time_text("generated_at", micros=True), "is_stale", "max_age_s"
    )


@query("last_good_ties", """
WITH e AS (SELECT *, date_trunc('day', ts) AS day FROM events)
SELECT 'u' || user_id AS feed_key, arg_max(props, (day, event_id)) FILTER (event_type <> 'error') AS content,
       strftime(max(day) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS generated_at,
       coalesce(max(day) FILTER (event_type = 'error') > max(day) FILTER (event_type <> 'error'), false) AS is_stale
FROM e GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0
""")
def last_good_ties(spark, sf_dir):
    """Results that are dated to the day, so that several stand at one instant."""
    results = event_log(spark, sf_dir).withColumn("at", F.date_trunc("day", "at"))
    return freshness.last_good(results, "props", "event_id").select(
        "feed_key", F.col("props").alias("content"), time_text("generated_at"), "is_stale")


@query("content_asof", f"""
WITH e AS (SELECT *, date_trunc('hour', ts) AS hour FROM events),
     q AS (SELECT event_id AS request_id, user_id, hour FROM e WHERE event_type = 'purchase'),
     s AS (SELECT q.request_id, q.user_id, q.hour, max(r.hour) FILTER (r.event_type <> 'error') AS ok_at,
                  max(r.hour) FILTER (r.event_type = 'error') AS fail_at,
                  arg_max(r.props, (r.hour, r.event_id)) FILTER (r.event_type <> 'error') AS content
           FROM q LEFT JOIN (SELECT * FROM e WHERE event_type <> 'purchase') r
             ON r.user_id = q.user_id AND r.hour <= q.hour GROUP BY ALL)
SELECT request_id, 'u' || user_id AS feed_key, content, {_RULE.format(now="hour", ttl=9000, retry=30000)} AS state FROM s
""")
def content_asof(spark, sf_dir):
    """Purchases ask for what their user's feed last gave; all are dated to the hour."""
    log = event_log(spark, sf_dir).withColumn("at", F.date_trunc("hour", "at"))
    requests = log.filter("event_type = 'purchase'").withColumnRenamed("event_id", "request_id")
    results = log.filter("event_type <> 'purchase'")
    return freshness.content_asof(results, requests, "event_id", "props", 9000, 30000).select(
        "request_id", "feed_key", F.col("props").alias("content"), "state")


@query("aggregate_state", """
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal > 0 AS up, c_mktsegment = 'BUILDING' AS old
           FROM customer WHERE c_custkey % 6 <> 0)
SELECT 'n' || k.c_nationkey AS aggregate_key, count(*) AS n_children, count(*) FILTER (up) AS n_available,
       coalesce(bool_or(up), false) AS available, coalesce(bool_or(old) FILTER (up), false) AS is_stale
FROM customer k LEFT JOIN c USING (c_custkey) GROUP BY 1
""")
def aggregate_state(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    members = customers.select(
        F.concat(F.lit("n"), "c_nationkey").alias("aggregate_key"),
        F.col("c_custkey").alias("child_key"),
    )
    child_state = customers.filter("c_custkey % 6 <> 0").select(
        F.col("c_custkey").alias("feed_key"), (F.col("c_acctbal") > 0).alias("available"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_stale"),
    )
    return freshness.aggregate_state(members, child_state)


@query("retry_outcome", """
WITH a AS (SELECT user_id, event_id, event_type <> 'error' AS ok, props,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events),
     b AS (SELECT * FROM a WHERE attempt <= CASE WHEN user_id IN (1, 2, 3, 4, 5) THEN 5 ELSE 3 END)
SELECT 'u' || user_id AS feed_key, bool_or(ok) AS ok,
       coalesce(min(attempt) FILTER (ok), max(attempt)) AS attempts_used,
       arg_min(props, attempt) FILTER (ok) AS body,
       CASE WHEN NOT bool_or(ok) THEN 'E' || arg_max(event_id, attempt) END AS last_error
FROM b GROUP BY user_id
""")
def retry_outcome(spark, sf_dir):
    numbered = ordinals(
        event_log(spark, sf_dir), ["feed_key"], [F.col("event_id").asc()], "attempt"
    )
    attempts = numbered.select(
        "feed_key", "attempt", "ok", F.col("props").alias("body"),
        F.concat(F.lit("E"), "event_id").alias("error_type"),
    )
    return items.retry_outcome(attempts, [f"u{i}" for i in range(1, 6)])


# --- streams -------------------------------------------------------------------------------

@query("stream_items", f"""
WITH {_ANCHORS}
SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS feed_key, 'gallery:' || {_ROOTED} AS guid
FROM anchors WHERE length(title) >= 4 AND href <> '' GROUP BY ALL
""")
def stream_items(spark, sf_dir):
    """Pages land in several files; each micro-batch publishes what is new."""
    landed = scratch_path(spark, "landing")
    landed_pages(spark, sf_dir).repartition(3, "page_id").write.parquet(landed)
    published = scratch_path(spark, "published")
    running = ingest.start_item_ingest(
        page_source.stream_pages(spark, landed, files_per_trigger=1),
        lambda batch: links.extract_links(batch, max_items=None),
        published, scratch_path(spark, "ingest-checkpoint"),
    )
    running.awaitTermination()
    return ingest.read_published(spark, published).select("feed_key", "guid")


@query("seen_batches", """
WITH e AS (SELECT event_type AS feed_key, 'u' || user_id AS guid,
                  event_id * 6 // (SELECT max(event_id) + 1 FROM events) AS batch_id FROM events)
SELECT feed_key, guid, CAST(min(batch_id) AS BIGINT) AS batch_id FROM e GROUP BY 1, 2
""")
def seen_batches(spark, sf_dir):
    """Six batches against the store of keys, folded twice; two of them run again afterwards."""
    path, out = scratch_path(spark, "seen"), scratch_path(spark, "seen-published")
    events = event_items(spark, sf_dir).select(
        "feed_key", "guid", F.regexp_extract("title", "[0-9]+", 0).cast("bigint").alias("event_id"))
    end = events.agg(F.max("event_id")).first()[0] + 1
    for batch in (0, 1, 2, 3, 2, 4, 5, 4):
        if batch in (2, 5):
            seen.compact(spark, path, batch, keys_per_bucket=64)
        keys = events.filter(F.expr(f"event_id * 6 div {end} = {batch}")).select("feed_key", "guid").distinct()
        seen.unseen(spark, path, keys, batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")
        seen.record(spark, path, spark.read.parquet(f"{out}/batch_id={batch}"), batch)
    return spark.read.schema("feed_key string, guid string, batch_id bigint").parquet(out)


@query("stream_dedup", """
SELECT DISTINCT event_type AS feed_key, 'u' || user_id AS guid FROM events
""")
def stream_dedup(spark, sf_dir):
    """Watermark delay longer than the log, so every repeat falls inside it."""
    landed = scratch_path(spark, "log")
    event_log(spark, sf_dir).select(
        F.col("event_type").alias("feed_key"), F.col("feed_key").alias("guid"),
        F.col("at").alias("fetched_at"),
    ).repartition(2, "fetched_at").write.parquet(landed)
    schema = "feed_key string, guid string, fetched_at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = scratch_path(spark, "distinct")
    running = (
        ingest.first_seen(stream, delay="3650 days").select("feed_key", "guid")
        .writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "dedup-checkpoint"))
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema("feed_key string, guid string").parquet(out)


@query("stream_feed_state", f"""
WITH s AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok_at,
                  max(ts) FILTER (event_type = 'error') AS fail_at FROM events GROUP BY 1)
SELECT 'u' || user_id AS feed_key,
       {_RULE.format(now="TIMESTAMP '2024-01-31 00:00:00'", ttl=20000, retry=50000)} AS state
FROM s
""")
def stream_feed_state(spark, sf_dir):
    landed = scratch_path(spark, "refresh-log")
    event_log(spark, sf_dir).select("feed_key", "at", "ok").repartition(2, "at").write.parquet(landed)
    schema = "feed_key string, at timestamp, ok boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = scratch_path(spark, "state-changes")
    state.start_feed_state(stream, out, scratch_path(spark, "state-checkpoint")).awaitTermination()
    now = F.expr("timestamp'2024-01-31 00:00:00'")
    return state.read_feed_state(spark, out, now, 20000, 50000).select("feed_key", "state")


@query("feed_transitions", f"""
WITH log AS (SELECT 'u' || user_id AS feed_key, ts, event_type <> 'error' AS ok FROM events),
     points AS (SELECT feed_key, ts AS moment FROM log
                UNION SELECT feed_key, ts + INTERVAL (CASE WHEN ok THEN 9000 ELSE 30000 END) SECOND FROM log),
     told AS (SELECT feed_key, ts AS moment, CASE WHEN ok THEN ts END AS ok_ts, CASE WHEN NOT ok THEN ts END AS fail_ts FROM log
              UNION ALL SELECT feed_key, moment, NULL, NULL FROM points),
     run AS (SELECT feed_key, moment, max(ok_ts) OVER w AS ok_at, max(fail_ts) OVER w AS fail_at FROM told
             WINDOW w AS (PARTITION BY feed_key ORDER BY moment RANGE UNBOUNDED PRECEDING)),
     states AS (SELECT DISTINCT feed_key, moment, {_RULE.format(now="moment", ttl=9000, retry=30000)} AS state FROM run),
     changes AS (SELECT *, lag(state, 1, 'due') OVER (PARTITION BY feed_key ORDER BY moment) AS previous FROM states)
SELECT feed_key, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS "at", state, previous FROM changes WHERE state <> previous
""")
def feed_transitions(spark, sf_dir):
    """Results in three files by time, then two ticks of the clock after all of them have expired."""
    landed, out = scratch_path(spark, "results"), scratch_path(spark, "transitions")
    log = event_log(spark, sf_dir).select("feed_key", "at", "ok")
    for part in (F.col("at") < F.lit("2024-01-11"), F.col("at").between("2024-01-11", "2024-01-21"),
                 F.col("at") > F.lit("2024-01-21")):  # files are read in the order in which they land
        log.filter(part).coalesce(1).write.mode("append").parquet(landed)
    end = log.agg(F.max("at").alias("end"))
    for days in (30, 31):
        tick = end.select(F.lit("").alias("feed_key"), F.expr(f"end + INTERVAL {days} DAYS").alias("at"),
                          F.lit(None).cast("boolean").alias("ok"))
        tick.coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, transitions.PROVIDER)
    try:
        transitions.feed_transitions(stream, 9000, 30000).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", scratch_path(spark, "transitions-checkpoint")).trigger(availableNow=True).start(
        ).awaitTermination()
    finally:
        spark.conf.set(setting, before)
    found = spark.read.schema(transitions.TRANSITIONS).parquet(out)
    return found.select("feed_key", time_text("at", micros=True), "state", "previous")
