from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from syndica.operators import freshness
from syndica.plans import probe
from syndica.schemas import RESPONSES
from syndica.sources import catalog, pages as page_source
from syndica.streaming import ingest, state
from workload import queries

CATALOG = """{"sources": [
 {"key": " a ", "title": "A", "url": "https://a.example/rss", "parser": "rss"},
 {"key": "b", "title": "B", "url": "https://b.example/", "parser": "links", "link_pattern": "/p/\\\\d+"},
 {"key": "c", "title": "C", "url": "https://c.example/"},
 {"key": "d", "title": "", "url": "https://d.example/", "parser": "rss"},
 {"key": "e", "title": "E", "url": "https://e.example/", "parser": "xls"}, 7]}"""


def test_catalog_files(spark, tmp_path):
    (tmp_path / "sources.json").write_text(CATALOG)
    entries = catalog.catalog_entries(catalog.read_catalog_documents(spark, str(tmp_path / "sources.json")))
    got = catalog.catalog_sources(entries, "https://p.example/").orderBy("source_ord").collect()
    assert [(r.key, r.route, r.public_feed_url, r.parser_kind, r.link_pattern) for r in got] == [
        ("a", "/gallery/a.xml", "https://p.example/gallery/a.xml", "rss", ""),
        ("b", "/gallery/b.xml", "https://p.example/gallery/b.xml", "links", "/p/\\d+")]
    rejects = {r.key: r.problem for r in catalog.catalog_rejects(entries).collect()}
    assert rejects == {"c": "unknown parser", "d": "missing key, title or url", "e": "unknown parser"}
    with pytest.raises(Exception, match="bad source"):
        catalog.catalog_sources(entries, "https://p.example", strict=True).collect()
    missing = catalog.read_catalog_documents(spark, str(tmp_path / "none.json"))
    assert catalog.catalog_entries(missing).count() == 0


def test_builtin_sources_and_dialects(spark):
    built = catalog.builtin_sources(
        spark, "https://p.example/", "https://a.example/thread0806.php?fid=16", "A", "https://b.example/",
        [("19", "one"), ("21", "two")], "https://b.example/index.php", "home", "B - ")
    extra = spark.createDataFrame(
        [(0, "g", "https://g.example/feed", "G", "/gallery/g.xml", "x", "mzt", "", "", "")], built.schema)
    rows = catalog.all_sources(built, extra, 4).orderBy("source_ord").select(
        "key", "route", "feed_title", catalog.dialect_of(F.col("parser_kind"), F.col("source_url")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [
        ("forum-a-fid-16", "/rss.xml", "A", "listing_a"),
        ("forum-b-fid-19", "/rss/forum-b-fid-19.xml", "B - one", "listing_b"),
        ("forum-b-fid-21", "/rss/forum-b-fid-21.xml", "B - two", "listing_b"),
        ("forum-b-highlights", "/rss/forum-b-highlights.xml", "home", "highlights"),
        ("g", "/gallery/g.xml", "G", "json_api")]


def test_extract_urls_strips_after_distinct(spark):
    text = "see [a](https://a.example/x) and https://b.example/y, https://b.example/y; (https://a.example/x) http://c.example."
    got = probe.extract_urls(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    assert [r.url for r in got.orderBy("pos").collect()] == [
        "https://a.example/x", "https://b.example/y", "https://b.example/y", "http://c.example"]


def test_probe_pages(spark):
    html = ("<html><TITLE id=t> My \n &amp; site </TITLE><link rel='alternate' type='application/rss+xml' href='/f'>"
            "<link rel='x alternate' type='text/XML' href='g'><link rel=alternate type=text/xml href=' '>"
            "<link rel=alternate type=text/html href=h>xenForo</html>")
    many = "".join(f"<link rel=alternate type=text/xml href=/{i}>" for i in range(12))
    rows = [
        (0, "http://a.example/p/", 200, "http://a.example/q/", "text/html", bytearray(html.encode() + b"\xff"), ""),
        (1, "http://b.example/", 200, None, "application/json", bytearray(b"<title>no</title>"), ""),
        (2, "http://c.example/", 503, None, "text/html", bytearray(html.encode()), ""),
        (3, "http://d.example/", None, None, None, None, "ConnectTimeout"),
        (4, "http://e.example/Discuz/", 200, None, "text/html; x", bytearray(many.encode()), ""),
    ]
    probes = probe.probe_pages(spark.createDataFrame(rows, RESPONSES), **probe.LIMITS)
    uncut = probe.probe_pages(spark.createDataFrame(rows, RESPONSES)).filter("input_ord = 4").first()
    assert len(uncut.feeds) == 12
    got = {r.input_ord: r for r in probes.collect()}
    assert (got[0].title, got[0].feeds, got[0].generator, got[0].ok) == (
        "My &amp; site", ["http://a.example/f", "http://a.example/q/g"], "xenforo", True)
    assert (got[1].ok, got[1].title, got[1].feeds, got[1].generator) == (True, "", [], "unknown")
    assert (got[2].ok, got[2].error, got[2].title) == (False, "HTTPError", "")
    assert (got[3].ok, got[3].error, got[3].final_url) == (False, "ConnectTimeout", "http://d.example/")
    assert (len(got[4].feeds), got[4].generator) == (8, "discuz")
    lines = {r.input_ord: r.line for r in probe.probe_lines(probes).collect()}
    assert lines[0] == "200\txenforo\t2\thttp://a.example/p/" and lines[3].startswith("ConnectTimeout\tunknown\t0")


def test_probe_report_and_host_cache(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "input_ord int, url string")
    probe.write_probe_report(df, str(tmp_path / "report"))
    lines = "".join(f.read_text() for f in sorted((tmp_path / "report").glob("part-*.json"))).split()
    assert [line[-3] for line in lines] == ["a", "b", "c"]
    pages = spark.createDataFrame([(1, "http://h.example:81/a", "old"), (2, "http://h.example:81/b", "new"), (3, "http://o.example/", "o")],
                                  "page_id bigint, url string, html string")
    probe.write_host_cache(pages, str(tmp_path / "cache"))
    got = spark.read.parquet(str(tmp_path / "cache"))
    assert sorted((r.host, r.html) for r in got.collect()) == [("h.example_81", "new"), ("o.example", "o")]


def test_raw_files_and_decoding(spark, tmp_path):
    (tmp_path / "p.html").write_bytes(b"ab\xffc")
    df = page_source.read_files(spark, str(tmp_path), "*.html")
    assert df.select(page_source.decode_body(F.col("body")), page_source.decode_body(F.col("body"), 2)).first()[:] == ("ab�c", "ab")


NOW = datetime(2026, 1, 1, 12)
LOG = "feed_key string, at timestamp, ok boolean, error_type string, n_items bigint"


def _log(spark, *rows):
    return spark.createDataFrame([(f, NOW + timedelta(seconds=s), ok, None, None) for f, s, ok in rows], LOG)


def _states(df, key="feed_key"):
    return {r[key]: r.state for r in df.collect()}


def test_feed_states(spark):
    log = _log(spark, ("fresh", -599, True), ("old", -600, True), ("stale", -3600, True), ("stale", -10, False),
               ("never", -59, False), ("retry", -60, False), ("healed", -700, True), ("healed", -705, False),
               ("later", -5, False), ("later", 5, True))
    want = {"fresh": "fresh", "old": "due", "stale": "stale", "never": "unavailable", "retry": "due",
            "healed": "due", "later": "unavailable"}
    now = F.lit(NOW).cast("timestamp")
    assert _states(freshness.feed_state_at(log, now)) == want
    asked = spark.createDataFrame([(i, f, NOW) for i, f in enumerate([*want, "unseen"])],
                                  "request_id bigint, feed_key string, at timestamp")
    assert _states(freshness.feed_state_asof(log, asked)) == {**want, "unseen": "due"}


def test_last_good_and_aggregates(spark):
    rows = [("a", 1, True, "one"), ("a", 2, True, "two"), ("a", 3, False, None), ("b", 1, True, "b"), ("c", 1, False, None)]
    df = spark.createDataFrame([(f, NOW + timedelta(seconds=s), ok, c) for f, s, ok, c in rows],
                               "feed_key string, at timestamp, ok boolean, content string")
    got = {r.feed_key: (r.content, r.is_stale, r.max_age_s) for r in freshness.with_max_age(freshness.last_good(df)).collect()}
    assert got == {"a": ("two", True, 60), "b": ("b", False, 600)}
    members = spark.createDataFrame([("m", "a"), ("m", "c"), ("n", "c"), ("n", "x")], "aggregate_key string, child_key string")
    child = spark.createDataFrame([("a", True, True), ("c", False, True)], "feed_key string, available boolean, is_stale boolean")
    agg = {r.aggregate_key: (r.n_children, r.n_available, r.available, r.is_stale)
           for r in freshness.aggregate_state(members, child).collect()}
    assert agg == {"m": (2, 1, True, True), "n": (2, 0, False, False)}


def test_successes_of_one_instant_give_one_row(spark):
    rows = [("a", 5, True, 1, "one"), ("a", 5, True, 3, "three"), ("a", 5, True, 3, "three"), ("a", 5, True, 2, "two"),
            ("a", 5, False, 4, None), ("b", 1, True, 1, "b"), ("c", 1, False, 1, None)]
    df = spark.createDataFrame(rows, "feed_key string, s int, ok boolean, seq bigint, content string").select(
        "feed_key", F.timestamp_seconds("s").alias("at"), "ok", "seq", "content")
    got = sorted((r.feed_key, r.content, r.is_stale) for r in freshness.last_good(df, sequence="seq").collect())
    assert got == [("a", "three", False), ("b", "b", False)]
    assert sorted(r.feed_key for r in freshness.last_good(df).collect()) == ["a", "b"]


def test_ingest_publishes_only_new_items(spark, tmp_path, pages):
    from syndica.plans.links import extract_links

    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")

    def land(*hrefs):
        html = "".join(f"<a href='/{h}'>title {h}</a>" for h in hrefs)
        pages(("http://h.example/", html)).coalesce(1).write.mode("append").parquet(landed)

    def run():
        ingest.start_item_ingest(page_source.stream_pages(spark, landed), extract_links, out,
                                 str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.guid[-1], r.batch_id) for r in ingest.read_published(spark, out).collect())

    land("a", "b", "a")
    assert run() == [("a", 0), ("b", 0)]
    land("b", "c")
    assert run() == [("a", 0), ("b", 0), ("c", 1)]


def test_stream_state_and_dedup(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "state")
    for rows in ([("a", -100, True), ("b", -5, False)], [("a", -1, False), ("b", -700, True)]):
        _log(spark, *rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        state.start_feed_state(stream, out, str(tmp_path / "cp")).awaitTermination()
    now = F.lit(NOW).cast("timestamp")
    assert _states(state.read_feed_state(spark, out, now)) == {"a": "fresh", "b": "stale"}

    distinct = str(tmp_path / "distinct")
    keys = spark.readStream.schema(LOG).parquet(source).select("feed_key", F.lit("g").alias("guid"), F.col("at").alias("fetched_at"))
    ingest.first_seen(keys).writeStream.format("parquet").option("path", distinct).option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.feed_key for r in spark.read.parquet(distinct).collect()) == ["a", "b"]


def test_stream_dedup_thins_copies_first(spark):
    rows = spark.range(0, 5000, 1, 3).selectExpr(
        "'f' AS feed_key", "if(id % 3 = 0, 'hot', concat('g', id % 100)) AS guid", "timestamp_seconds(id) AS fetched_at")
    thinned = ingest._thin(rows, ["feed_key", "guid"])
    assert thinned.filter("guid = 'hot'").count() == 3
    assert thinned.select("guid").distinct().count() == rows.select("guid").distinct().count()
    assert thinned.filter("guid = 'hot'").agg(F.min("fetched_at")).first() == rows.agg(F.min("fetched_at")).first()


def test_raw_pages_are_written_by_many_tasks(spark, tmp_path):
    """A small table in one file is dealt to all tasks; rows of one page number stay in one raw file."""
    html = {i: f"<html><body><p>page number {i}" for i in range(200)}
    rows = [*html.items(), (7, html[7])]
    spark.createDataFrame(rows, "page_id bigint, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.QUERIES["raw_pages"](spark, str(tmp_path))
    files = found.inputFiles()
    assert len(files) == 200 and len({f.rpartition("/part-")[2][:5] for f in files}) == 4
    assert len({f.split("/page_id=")[0] for f in files}) == 4  # shelves of 64
    got = {r.page_id: (r["head"], r.n_chars) for r in found.collect()}
    whole = html | {7: html[7] + "\n" + html[7]}
    assert got == {i: (text[:20], len(text)) for i, text in whole.items()}


def test_raw_pages_are_listed_set_by_set(spark, tmp_path, monkeypatch):
    """The driver lists the files of one set at a time, and every page is in one set."""
    rows = [(i * 1000, f"the whole text of page {i}") for i in range(200)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    read, listed = page_source.read_files, []

    def spy(*args):
        found = read(*args)
        listed.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(page_source, "read_files", spy)
    monkeypatch.setattr(page_source, "FILES_AT_ONCE", 64)
    found = queries.QUERIES["raw_pages"](spark, str(tmp_path))
    assert len(listed) == 4 and sum(listed) == 200 and max(listed) < 100
    assert sorted((r["head"], r.n_chars) for r in found.collect()) == sorted((text[:20], len(text)) for _, text in rows)
    assert {r.page_id for r in found.collect()} == {i for i, _ in rows}
