from pyspark.sql import functions as F

from syndica.plans import build
from syndica.schemas import SOURCES


def _row(tid, icon=True):
    image = '<img class="attach" src="a/attachicons/i.gif">' if icon else ""
    return (f'<tbody id="normalthread_{tid}"><tr><th class="subject"><span id="thread_{tid}">'
            f'<a href="viewthread.php?tid={tid}">post {tid}</a></span>{image}</th></tr></tbody>')


def _link(n):
    return f'<a href="/p/{n}">entry {n} of 2026-01-0{n % 9 + 1}</a>'


def test_run_publishes_reports_and_keeps_failed_feeds(spark, pages, tmp_path):
    section = [("http://b.example/forumdisplay.php?fid=19", "".join(_row(t, t != 3) for t in page))
               for page in ([1, 2, 3], [2, 3], [3, 4], [])]
    landed = pages(*section, feed="s")
    for i, feed in enumerate(("g1", "g2")):
        more = pages((f"http://{feed}.example/", "".join(_link(n) for n in range(5))), feed=feed)
        landed = landed.unionByName(more.withColumn("page_id", F.lit(100 + i).cast("bigint")))
    rows = [(0, "s", "http://b.example/forumdisplay.php?fid=19", "Section", "/rss/forum-b-fid-19.xml", "https://p/s", "auto"),
            (1, "g1", "http://g1.example/", "One", "/gallery/g1.xml", "https://p/g1", "links"),
            (2, "g2", "http://g2.example/", "Two", "/gallery/g2.xml", "https://p/g2", "links"),
            (3, "gone", "http://x.example/", "Gone", "/gallery/gone.xml", "https://p/x", "links")]
    sources = spark.createDataFrame([(*r, "", "", "") for r in rows], SOURCES).withColumn(
        "images_only", F.col("key") == "s").withColumn("empty_pages", F.when(F.col("key") == "s", 1))
    merged = {"gallery": {"prefix": "/gallery/", "title": "All", "source_url": "https://p", "url": "https://p/all"}}
    run = build.build_feeds(landed, sources, merged, F.expr("timestamp'2026-01-01'"), part_size=4)

    # page 2 has nothing new with a picture, so the section ends there and post 4 is not reached
    assert sorted(r.guid for r in run.items.filter("feed_key = 's'").collect()) == ["forum-b:19:1", "forum-b:19:2"]
    assert [(r.feed_key, r.error_type) for r in run.failures.collect()] == [("gone", "EmptyListing")]
    path = str(tmp_path / "site")
    build.write_build(run, path)
    written = spark.read.parquet(f"{path}/feeds")
    counts = {r.feed_key: r.n for r in written.groupBy("feed_key").agg(F.sum("n_items").alias("n")).collect()}
    assert counts == {"s": 2, "g1": 5, "g2": 5, "gallery": 10}
    text = "".join(r.content for r in written.filter("feed_key = 'gallery'").orderBy("part_no").collect())
    assert text.count("<item>") == 10 and text.endswith("</channel></rss>")
    assert text.index("entry 4 of") < text.index("entry 0 of")

    later = build.build_feeds(landed.filter("feed_key = 'g1'"), sources, merged, F.expr("timestamp'2026-02-01'"))
    build.write_build(later, path)
    stamps = {r.feed_key: "01 Feb" in r.content for r in spark.read.parquet(f"{path}/feeds").filter("part_no = 0").collect()}
    assert stamps == {"s": False, "g1": True, "g2": False, "gallery": True}
    opml = "".join(f.read_text() for f in sorted((tmp_path / "site" / "opml").glob("part-*")))
    assert opml.count("<outline") == 5


def test_half_read_sources_keep_their_last_documents(spark, pages, tmp_path):
    rows = [(i, k, f"http://{k}.example/", k, f"/gallery/{k}.xml", f"https://p/{k}", "links") for i, k in enumerate(("g1", "g2"))]
    sources = spark.createDataFrame([(*r, "", "", "") for r in rows], SOURCES)
    good = [(f"http://{k}.example/", "".join(_link(n) for n in range(3))) for k in ("g1", "g2")]

    def landed(second_page):
        both = pages(good[0], feed="g1").unionByName(pages(good[1], feed="g2"))
        more = pages(("http://g1.example/2", second_page), feed="g1").withColumn("page_seq", F.lit(2))
        return both.unionByName(more).withColumn("page_id", F.monotonically_increasing_id())

    path = str(tmp_path / "site")
    build.write_build(build.build_feeds(landed(_link(9)), sources, {}, F.expr("timestamp'2026-01-01'")), path)
    run = build.build_feeds(landed(_link(8) + "<![foo[ bar]]>"), sources, {}, F.expr("timestamp'2026-02-01'"))
    assert [(r.feed_key, r.error_type) for r in run.failures.collect()] == [("g1", "UnreadableHtml")]
    build.write_build(run, path)
    written = {r.feed_key: r for r in spark.read.parquet(f"{path}/feeds").filter("part_no = 0").collect()}
    assert written["g1"].n_items == 4 and "01 Jan" in written["g1"].content
    assert written["g2"].n_items == 3 and "01 Feb" in written["g2"].content


def test_sources_of_the_build_are_written_once(spark, tmp_path):
    """Every step of a build reads the sources; none renders the pages again for them."""
    from workload import queries

    spark.range(120).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice",
        "timestamp'2024-01-01' AS o_orderdate", "'5-LOW' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(90).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "1 AS p_size").write.parquet(
        f"{tmp_path}/part.parquet")
    _, sources, _ = queries._build_input(spark, str(tmp_path))
    assert {r.key for r in sources.collect()} == {"atom", "forum-b", "gallery-0", "gallery-1", "silent"}
    assert sources.inputFiles() and not any(str(tmp_path / t) in f for f in sources.inputFiles() for t in ("orders", "part"))
