from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rows import rows_of
from syndica.plans import dispatch, feeds, links

URL = "https://g.example/list/"
PAGE = """<nav><a href="/albums/0">navigation</a></nav>
<article class="card"><a href="/albums/1">2026-08-13</a><h3 class="entry-title"><a href="/albums/1">Album one</a></h3>
<p>Published 2026-08-13</p></article>
<article class="card"><h3 class="entry-title"><a class="item-link" href="https://g.example/albums/2">Album two</a></h3></article>
<article><a href="/albums/3">abc</a><a href="">nothing</a><a>no href</a><a href="/tags/4">tag four</a></article>"""


def _with(df, **rules):
    for name, value in rules.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_links_by_path_and_ancestor(pages):
    df = _with(pages((URL, PAGE)), link_pattern=r"/albums/\d+$", parent_selector="h3.entry-title")
    got = rows_of(links.extract_links(df), "guid", "title", "link", "published_at")
    assert got == [
        ("gallery:https://g.example/albums/1", "Album one", "https://g.example/albums/1", datetime(2026, 8, 12, 16)),
        ("gallery:https://g.example/albums/2", "Album two", "https://g.example/albums/2", None),
    ]


def test_links_by_selector_and_without_rules(pages):
    df = _with(pages((URL, PAGE)), link_selector="a.item-link, h2")
    assert rows_of(links.extract_links(df), "title") == [("Album two",)]
    assert rows_of(links.extract_links(pages((URL, PAGE))), "title") == [
        ("navigation",), ("Album one",), ("Album two",), ("tag four",)]
    assert rows_of(links.extract_links(pages((URL, PAGE)), max_items=2), "title") == [("navigation",), ("Album one",)]
    assert rows_of(links.extract_links(pages((URL, "")), max_items=2), "title") == []


def test_rules_are_per_page_columns(pages):
    df = pages((URL, PAGE), (URL, PAGE)).withColumn(
        "link_selector", F.expr("if(page_id = 0, 'a.item-link', '')")
    ).withColumn("link_pattern", F.expr("if(page_id = 1, '^/tags/', '')"))
    assert rows_of(links.extract_links(df), "page_seq", "title") == [(1, "Album two"), (2, "tag four")]


def test_selected_cards_date_from_the_card_around_them(pages):
    html = '<li>2024-01-02 <article class="x" href="/p"> long 2024-99-99 title <a href="/q">inner link</a></article></li>'
    df = _with(pages((URL, html)), link_selector=".x, a")
    got = rows_of(links.extract_links(df), "link", "published_at")
    # the article's own text and card give: invalid own date, then the list item around it
    assert got == [("https://g.example/p", datetime(2024, 1, 1, 16)), ("https://g.example/q", None)]


def test_unsupported_selector_is_an_error(pages):
    with pytest.raises(Exception, match="unsupported selector"):
        links.extract_links(_with(pages((URL, PAGE)), link_selector="div > a")).collect()


RSS = """<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:m="urn:m"><channel><title>c</title>
<item><title> One <b>x</b></title><link>/1</link><guid>g1</guid><dc:creator>ann</dc:creator>
<pubDate>Mon, 15 Jul 2025 08:30:00 +0000</pubDate><description>body</description></item>
<item><m:title/><title>Two</title><link/><link>https://o.example/2</link><pubDate>bad</pubDate></item>
<item><title>Copy</title><guid>g1</guid></item><item><title></title><guid>g3</guid></item>
<item><title>Bare</title><guid>g4</guid><author>bob</author></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><x><entry><title type="html">A &amp; B</title>
<link rel="alternate" href="e/1"/><id>tag:1</id><updated>2025-07-15T08:30:00Z</updated>
<author><name>carl</name></author></entry></x></feed>"""


def test_feed_documents(pages):
    df = pages(("https://r.example/feed/", RSS), ("https://s.example/f/", ATOM), (URL, "<p>no feed"), (URL, "<html/>"))
    got = rows_of(feeds.extract_feed_items(df), "guid", "title", "link", "author", "published_at")
    assert got == [
        ("rss:g1", "One", "https://r.example/1", "ann", datetime(2025, 7, 15, 8, 30)),
        ("rss:https://o.example/2", "Two", "https://o.example/2", None, None),
        ("rss:g4", "Bare", "https://r.example/feed/", "bob", None),
        ("rss:tag:1", "A & B", "https://s.example/f/e/1", "carl", datetime(2025, 7, 15, 8, 30)),
    ]
    assert len(rows_of(feeds.extract_feed_items(df, max_items=1), "guid")) == 2
    assert rows_of(feeds.extract_feed_items(df, max_items=0), "guid") == []


def test_json_documents(pages):
    body = ('{"items":[{"id":5,"title":" Five ","created_at":null,"updated_at":"2025-07-15T08:30:00Z"},7,'
            '{"id":"5","title":"copy"},{"id":"6","title":"Six","created_at":"1970-01-01T00:00:00Z"},'
            '{"id":null,"title":"x"},{"title":"y"},{"id":8,"title":""},[1]]}')
    df = pages(("https://j.example:81/urls?page=1", body), (URL, "not json"), (URL, '{"items":{"id":1,"title":"t"}}'),
               (URL, '{"items":[]}'), (URL, "[1]"), (URL, ""))
    got = rows_of(feeds.extract_json_items(df), "guid", "title", "link", "published_at")
    assert got == [
        ("mzt:5", "Five", "https://j.example:81/view/5", datetime(2025, 7, 15, 8, 30)),
        ("mzt:6", "Six", "https://j.example:81/view/6", None),
    ]


def test_dispatch_reads_each_page_by_its_source(spark, pages):
    df = pages((URL, PAGE), feed="g").unionByName(
        pages(("https://r.example/feed/", RSS), feed="r").withColumn("page_id", F.lit(9).cast("bigint")))
    sources = spark.createDataFrame(
        [("g", URL, "links", r"/albums/", "", "article.card"), ("r", "https://r.example/feed/", "rss", "", "", ""),
         ("gone", URL, "links", "", "", "")],
        "key string, source_url string, parser_kind string, link_pattern string, link_selector string, parent_selector string")
    got = rows_of(dispatch.dispatch_extract(df, sources), "feed_key", "title", order=("feed_key", "pos"))
    assert got == [("g", "Album one"), ("g", "Album two"), ("r", "One"), ("r", "Two"), ("r", "Bare")]
