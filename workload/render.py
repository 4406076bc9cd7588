"""Listing pages and feed documents rendered from the given tables, with Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.tables import table


def _documents(rows: DataFrame, feed: str, url: str, head: str, tail: str,
               broken: str = "false") -> DataFrame:
    """Concatenate ``frag`` per ``pg`` in ``k`` order; add blank copies, cut broken ones."""
    body = rows.groupBy("pg").agg(
        F.expr("listagg(frag, '') WITHIN GROUP (ORDER BY k)").alias("body")
    )
    whole = F.expr(f"concat('{head}', body, '{tail}')")
    docs = body.select(
        F.col("pg").alias("page_id"),
        F.lit(feed).alias("feed_key"),
        (F.col("pg") + 1).cast("int").alias("page_seq"),
        F.expr(url).alias("url"),
        F.when(F.expr(broken), F.substring(whole, 1, 60)).otherwise(whole).alias("html"),
    )
    blank = docs.filter("page_id % 20 = 0").select(
        (F.col("page_id") + 1000000000).alias("page_id"), "feed_key", "page_seq", "url",
        F.lit("  \n ").alias("html"),
    )
    return docs.unionByName(blank)


def listing_a_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 50 AS pg",
        """concat(
          '<tr class="tac tr3 t_one"><td>.</td><td class="tal"><h3><a id="t', o_orderkey,
          '" href="', if(o_orderkey % 6 = 0, '/', ''), 'htm_data/2608/',
          if(o_orderkey % 9 = 0, '7', '16'), '/', o_orderkey, '.html"> ',
          if(o_orderkey % 17 = 0, '<!--none-->', concat('<b>', o_orderpriority, '</b> &amp; ',
            o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' [36P]' WHEN 2 THEN ' ［10p + 1V］'
              WHEN 1 THEN ' [22P,3V-214MB]' ELSE '' END)),
          '</a></h3></td>') AS head""",
        """if(o_orderkey % 13 = 0, '', concat(
          '<td><a class="u bl">', if(o_orderkey % 8 = 0, '', concat('c', o_custkey)),
          '</a><div class="f12">',
          if(o_orderkey % 7 = 0,
             concat('<span title="置顶主题：', date_format(from_utc_timestamp(
                 cast(o_orderdate AS timestamp), 'Asia/Shanghai'), 'yyyy-MM-dd HH:mm:ss'), '">x'),
             concat('<span data-timestamp="', unix_seconds(cast(o_orderdate AS timestamp)),
                 's" title="n">x')),
          '</span></div></td>')) AS cell""",
        "if(o_orderkey % 5 = 0, '', '</tr>') AS tail",
    ).selectExpr(
        "k", "pg",
        "concat(head, cell, tail, if(k % 10 = 0, concat(replace(head, '<b>', '<b>again '), cell, '</tr>'), '')) AS frag",
    )
    return _documents(
        rows, "forum-a", "'http://a.example.com/thread0806.php?fid=16'",
        "<html><body><p><b>index<table>", "</table></body></html>",
    )


def listing_b_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 50 AS pg",
        """concat(
          '<tbody id="', if(o_orderkey % 12 = 0, 'stickthread_', 'normalthread_'), o_orderkey,
          '"><tr><th class="new subject"><em>[1]</em><span id="thread_', o_orderkey,
          '"><a href="viewthread.php?tid=', if(o_orderkey % 14 = 0, 5, o_orderkey),
          '&amp;extra=page%3D1">', o_orderstatus, ' ', o_orderpriority, '</a></span>',
          CASE o_orderkey % 3 WHEN 0 THEN '<img src="images/attachicons/image_s.gif" class="attach">'
            WHEN 1 THEN '<img class="attach" src="images/digest.gif" />' ELSE '' END,
          '</th><td class="author"><cite><a href="space.php">c', o_custkey, '</a></cite><em>',
          if(o_orderkey % 11 = 0, '2026-13-40', date_format(o_orderdate, 'yyyy-M-d')),
          '</em></td><td class="nums"><a href="x">9</a></td></tr></tbody>') AS frag""",
    )
    return _documents(
        rows, "forum-b",
        "concat('http://b.example.com/forum/forumdisplay.php?page=1&fid=', 19 + 2 * (pg % 2))",
        "<html><body><table>", "</table></body></html>",
    )


def highlights_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k", "p_partkey div 30 AS pg", "p_name", "p_size % 3 AS block"
    )
    again = parts.filter("k % 5 = 0").selectExpr(
        "k", "pg", "concat(p_name, ' again') AS p_name", "(block + 1) % 3 AS block"
    )
    extra = parts.filter("k % 8 = 0").selectExpr("k", "pg", "p_name", "3 AS block")
    links = parts.unionByName(again).unionByName(extra).selectExpr(
        "k", "pg", "block",
        "concat('<p><a href=\"viewthread.php?tid=', k, '\" title=\"x\">', p_name, '</a>') AS link",
    )
    cells = links.groupBy("pg", "block").agg(
        F.expr("listagg(link, '<br>') WITHIN GROUP (ORDER BY k)").alias("cell")
    )
    columns = cells.groupBy("pg").agg(*[
        F.max(F.when(F.col("block") == b, F.col("cell"))).alias(f"c{b}") for b in range(4)
    ])
    rows = columns.selectExpr(
        "pg", "0 AS k",
        """concat('<thead class="category"><tr><td>≡ new ≡</td><td> ≡  <b>liked</b> ≡ </td>',
          '<td>≡hot≡</td><td>links</td></tr></thead><tr><td>', coalesce(c0, ''), '</td><td>',
          coalesce(c1, ''), '</td><td>', coalesce(c2, ''), '</td><td>', coalesce(c3, ''),
          '</td></tr><thead class="category"><tr><td>≡ late ≡</td></tr></thead>') AS frag""",
    )
    return _documents(
        rows, "home", "'https://b.example.com/forum/index.php'",
        "<html><body><table>", "</table></body></html>",
    )


def gallery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages choose links by path and ancestor, odd ones by a selector."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS k", "p_partkey div 40 AS pg",
        "date_format(date_add(date'2020-01-01', cast(p_partkey % 1000 AS int)), 'yyyy-M-d') AS d",
        """CASE p_partkey % 3 WHEN 0 THEN concat('/album/', p_partkey)
          WHEN 1 THEN concat('../album/', p_partkey)
          ELSE concat('https://g.example.com/album/', p_partkey) END AS href""",
        "p_name",
    ).selectExpr(
        "k", "pg",
        """concat('<nav><a class="item-link', if(k % 4 = 0, ' menu', '-x'), '" href="/album/9', k,
          '">navigation</a></nav><article class="card post"><a class="date" href="', href, '">', d,
          '</a><h3><a class="big item-link" href="', href, '">', p_name, ' ', k, '</a></h3>',
          '<a href="/tag/', k, '">tag entry</a><p>',
          CASE k % 5 WHEN 0 THEN 'soon' WHEN 1 THEN '2024-99-99 late' ELSE concat('Published ', d) END,
          '</article>') AS frag""",
    )
    pages = _documents(
        rows, "gallery", "concat('https://g.example.com/list/p', pg, '.html')",
        "<html><body>", "</body></html>",
    )
    odd = F.col("page_id") % 2 == 1
    return pages.select(
        "*",
        F.when(odd, "").otherwise(r"^(?:\.\.)?/album/\d+$").alias("link_pattern"),
        F.when(odd, "a.item-link").otherwise("").alias("link_selector"),
        F.when(odd, "").otherwise("article.post").alias("parent_selector"),
    )


_STAMP = """CASE o_orderkey % 5
    WHEN 0 THEN date_format({t}, "EEE, dd MMM yyyy HH:mm:ss") || ' +0000'
    WHEN 1 THEN date_format({t} + INTERVAL 8 HOURS, "d MMM yyyy HH:mm:ss") || ' +0800'
    WHEN 2 THEN 'Mon, ' || date_format({t}, "dd MMM yyyy HH:mm:ss") || ' GMT'
    WHEN 3 THEN date_format({t} - INTERVAL 5 HOURS, "EEE, dd MMM yyyy HH:mm") || ' EST'
    ELSE 'soon' END""".format(t="cast(o_orderdate AS timestamp)")


def rss_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents; every fourth one is cut off and so malformed."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 100 AS pg",
        f"""concat('<item><title>', if(o_orderkey % 19 = 0, '', concat(o_orderpriority, ' &amp; <![CDATA[<b>]]>')),
          '</title><link>/o/', o_orderkey, '</link>',
          if(o_orderkey % 4 = 0, '', concat('<guid isPermaLink="false">', o_orderkey - (o_orderkey % 10 = 3)::int, '</guid>')),
          if(o_orderkey % 3 = 0, concat('<dc:creator>c', o_custkey, '</dc:creator>'), ''),
          '<pubDate>', {_STAMP}, '</pubDate><description>&lt;p&gt;long text</description></item>') AS frag""",
    )
    return _documents(
        rows, "rss", "'https://r.example.com/feed/rss.xml'",
        '<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/">'
        "<channel><title>all orders</title>",
        "</channel></rss>", broken="pg % 4 = 3",
    )


def atom_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 100 AS pg",
        """concat('<entry><title type="html">', o_orderpriority, '</title><link rel="alternate" href="',
          if(o_orderkey % 2 = 0, 'e/', 'https://s.example.com/'), o_orderkey, '"/><id>tag:', o_orderkey,
          '</id><updated>', CASE o_orderkey % 3
            WHEN 0 THEN date_format(cast(o_orderdate AS timestamp), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            WHEN 1 THEN date_format(cast(o_orderdate AS timestamp) + INTERVAL 8 HOURS, "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
            ELSE date_format(o_orderdate, 'yyyy-MM-dd') END,
          '</updated><author><name>c', o_custkey, '</name></author></entry>') AS frag""",
    )
    return _documents(
        rows, "atom", "'https://s.example.com/feed/'",
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>all orders</title>', "</feed>",
    )


def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS k", "event_id div 100 AS pg",
        """concat(if(event_id % 100 = 0, '', ','), '{"id":', if(event_id % 2 = 0, string(event_id), concat('"', event_id, '"')),
          ',"title":"', if(event_id % 23 = 0, ' ', event_type), '","created_at":',
          CASE WHEN event_id % 13 = 0 THEN '"1970-01-01T00:00:00Z"' WHEN event_id % 3 = 0 THEN 'null'
            ELSE concat('"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"') END,
          ',"updated_at":"', date_format(ts, 'yyyy-MM-dd'), '"}',
          if(event_id % 10 = 0, concat(',7,{"id":"', event_id, '","title":"copy"},{"title":"no id"}'), '')) AS frag""",
    )
    return _documents(
        rows, "api", "'https://j.example.com:8443/urls?page=1&pageSize=100'",
        '{"total":1,"items":[', "]}", broken="pg % 7 = 5",
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that name each page's address once as a link and, for some, once more bare."""
    bare = "if(page_id % 3 = 0, concat(' or ', regexp_replace(url, '#.*$', ''), '/more; '), '')"
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS doc_id",
        f"concat('* [site ', page_id, '](', url, ') see ', url, '.', {bare}, ' end') AS text",
    )


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as catalogue documents of fifty sources."""
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS k", "s_suppkey div 50 AS pg",
        """concat(if(s_suppkey % 50 = 0, '', ','), '{"key":" s', s_suppkey, '","title":"',
          if(s_suppkey % 9 = 4, '', s_name), '","url":"https://h', s_nationkey,
          '.example.com/', CASE s_suppkey % 4 WHEN 0 THEN 'rss.xml' ELSE 'list' END, '"',
          CASE s_suppkey % 5 WHEN 0 THEN ',"parser":"rss"' WHEN 1 THEN ',"parser":"links","link_pattern":"^/a/"'
            WHEN 2 THEN ',"parser":"mzt"' WHEN 3 THEN ',"parser":"xls"' ELSE '' END, '}') AS frag""",
    )
    return rows.groupBy(F.col("pg").alias("doc_ord")).agg(
        F.expr("listagg(frag, '') WITHIN GROUP (ORDER BY k)").alias("body")
    ).select("doc_ord", F.expr("concat('{\"sources\": [', body, ']}')").alias("body"))
