import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from syndica.operators import hosts, items, ranges

ITEM = ("feed_key string, guid string, title string, link string, author string, published_at timestamp, "
        "page_seq int, pos int")


def _items(spark, rows):
    return spark.createDataFrame(
        [(f, g, t, "l", None, at, p, i) for f, g, t, at, p, i in rows], ITEM)


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of which one key owns more than a third, with many equal order values."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        key = None if rng.random() < 0.05 else ("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}")
        rows.append((i, key, rng.randrange(30), rng.choice([None, rng.randrange(1000)])))
    return spark.createDataFrame(rows, "id int, k string, o int, v int").repartition(7)


def test_ordinals_equal_row_number(skewed):
    order = [F.col("o").desc(), F.col("id").asc()]
    got = ranges.ordinals(skewed, ["k"], order)
    want = skewed.withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("bigint"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    everything = ranges.ordinals(skewed, [], [F.col("id").asc()]).collect()
    assert all(r.ord == r.id + 1 for r in everything) and len(everything) == 6000


def test_ranges_split_a_hot_key(skewed):
    split = ranges.split_ranges(skewed.filter("k = 'hot'"), ["k"], [F.col("o").asc(), F.col("id").asc()])
    assert split.select("_range").distinct().count() > 1


def test_previous_equals_lag(skewed):
    order = [F.col("o").asc(), F.col("id").asc()]
    got = ranges.previous(skewed, ["k"], order, "v", "before")
    want = skewed.withColumn("before", F.lag("v").over(Window.partitionBy("k").orderBy(*order)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_max_equals_window(skewed):
    order = [F.col("o").asc(), F.col("id").asc()]
    got = ranges.running_max(skewed, ["k"], order, {"top": F.col("v")})
    frame = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumn("top", F.max("v").over(frame))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_keep_first_and_last(skewed):
    first = {r.k: r.id for r in items.keep_first(skewed, ["k"], ["o", "id"]).collect()}
    last = {r.k: r.id for r in items.keep_last(skewed, ["k"], ["o", "id"]).collect()}
    rows = skewed.collect()
    for key in {r.k for r in rows}:
        own = sorted((r.o, r.id) for r in rows if r.k == key)
        assert (first[key], last[key]) == (own[0][1], own[-1][1])


@pytest.mark.parametrize("n", [0, 1, 5, 2000])
def test_top_n_equals_row_number(skewed, n):
    order = [F.col("o").asc(), F.col("id").asc()]
    got = items.top_n(skewed, ["k"], order, n, rank="rank").collect()
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter(f"rank <= {n}")
    assert sorted(map(str, got)) == sorted(map(str, want.collect()))


def test_merge_keeps_first_and_puts_unknown_times_last(spark):
    month = lambda m: datetime(2026, m, 1)
    df = _items(spark, [("x", "a", "old", month(1), 1, 0), ("x", "a", "copy", month(3), 1, 1),
                        ("y", "b", "new", month(6), 1, 0), ("y", "c", "untimed", None, 1, 1),
                        ("y", "a", "later child", month(9), 1, 2), ("z", "d", "no member", month(1), 1, 0)])
    members = spark.createDataFrame([("m", "x", "1"), ("m", "y", "2"), ("m", "failed", "3")],
                                    "aggregate_key string, child_key string, child_ord string")
    ties = ("child_ord", "page_seq", "pos")
    merged = items.order_items(items.merge_feeds(df, members), *ties)
    assert [(r.feed_key, r.guid, r.title) for r in merged.collect()] == [
        ("m", "b", "new"), ("m", "a", "old"), ("m", "c", "untimed")]
    capped = items.order_items(items.merge_feeds(df, members, 2), *ties)
    assert [r.guid for r in capped.collect()] == ["b", "a"]


def _cutoff_by_loop(pages, k, cap):
    """The paging loop, page by page."""
    seen, kept, empty, page = set(), [], 0, 1
    while page <= cap:
        new = []
        for g in pages.get(page, []):
            if g not in seen and g not in new:
                new.append(g)
        if not new:
            empty += 1
            if empty >= k:
                break
        else:
            empty = 0
            seen.update(new)
            kept += [(g, page) for g in new]
        page += 1
    return sorted(kept)


@pytest.mark.parametrize("k,cap", [(1, 200), (2, 200), (2, 6), (3, 200)])
def test_page_cutoff_equals_paging_loop(spark, k, cap):
    rng = random.Random(k * 100 + cap)
    feeds, rows = {}, []
    for f in range(25):
        pages = {}
        for page in range(1, 25):
            if rng.random() < 0.7:
                pages[page] = [f"g{rng.randrange(60)}" for _ in range(rng.randrange(1, 4))]
                rows += [(f"f{f}", g, "t", None, page, i) for i, g in enumerate(pages[page])]
        feeds[f"f{f}"] = pages
    got = items.page_cutoff(_items(spark, rows), k, cap).select("feed_key", "guid", "page_seq").collect()
    for feed, pages in feeds.items():
        assert sorted((r.guid, r.page_seq) for r in got if r.feed_key == feed) == _cutoff_by_loop(pages, k, cap), feed


def test_new_items_and_counts(spark):
    old = _items(spark, [("x", "a", "t", None, 1, 0)])
    new = _items(spark, [("x", "a", "t", None, 2, 0), ("x", "b", "first", None, 2, 1),
                         ("x", "b", "again", None, 2, 2), ("y", "a", "t", None, 2, 0)])
    got = items.new_items(new, old)
    assert sorted((r.feed_key, r.guid, r.title) for r in got.collect()) == [("x", "b", "first"), ("y", "a", "t")]
    assert {r.feed_key: r.n_items for r in items.non_empty_feeds(new).collect()} == {"x": 3, "y": 1}


def test_members_by_route(spark):
    sources = spark.createDataFrame(
        [("b", "/gallery/b.xml"), ("a", "/gallery/a.xml"), ("s", "/rss/forum-b-fid-19.xml"), ("h", "/rss/forum-b-highlights.xml")],
        "key string, route string")
    got = items.members_by_route(sources, {"gallery": "/gallery/", "sections": "/rss/forum-b-fid-"})
    assert [(r.aggregate_key, r.child_key) for r in got.orderBy("aggregate_key", "child_ord").collect()] == [
        ("gallery", "a"), ("gallery", "b"), ("sections", "s")]


def test_retry_outcome(spark):
    rows = [("c", i, i == 5, f"body{i}", None if i == 5 else f"E{i}") for i in range(1, 6)]
    rows += [("d", i, i == 4, f"body{i}", f"E{i}") for i in range(1, 5)] + [("e", 2, True, "b2", None), ("e", 1, False, None, "E1")]
    df = spark.createDataFrame(rows, "feed_key string, attempt int, ok boolean, body string, error_type string")
    got = {r.feed_key: (r.ok, r.attempts_used, r.body, r.last_error) for r in items.retry_outcome(df, ["c"]).collect()}
    assert got == {"c": (True, 5, "body5", None), "d": (False, 3, None, "E3"), "e": (True, 2, "b2", None)}


def test_request_spacing_flags_short_gaps(spark):
    start = datetime(2026, 1, 1)
    rows = [("h", "u1", start, True), ("h", "u2", start + timedelta(seconds=9), False),
            ("h", "u3", start + timedelta(seconds=19), True), ("o", "u4", start + timedelta(seconds=1), True)]
    got = hosts.request_spacing(spark.createDataFrame(rows, "host string, url string, at timestamp, ok boolean"))
    assert {r.url: (r.gap_s, r.too_close) for r in got.collect()} == {
        "u1": (None, False), "u2": (9.0, True), "u3": (10.0, False), "u4": (None, False)}


def test_crawl_slots_put_critical_sources_first(spark):
    rows = [(0, "a", "http://H.example/1"), (1, "b", "http://h.example/2"), (2, "c", "http://h.example/3"), (3, "d", "http://o.example/")]
    df = spark.createDataFrame(rows, "source_ord int, key string, source_url string")
    got = {r.key: (r.host, r.offset_s) for r in hosts.crawl_slots(df, hosts.is_critical(F.col("key"), ["c"])).collect()}
    assert got == {"c": ("h.example", 0), "a": ("h.example", 10), "b": ("h.example", 20), "d": ("o.example", 0)}


def test_enumerate_pages(spark):
    df = spark.createDataFrame([("a", "http://h/?p={page}", 2), ("b", "http://o/?p={page}", 0)], "key string, source_url string, n int")
    got = hosts.enumerate_pages(df.filter("n > 0"), limit=F.col("n"))
    assert [(r.key, r.page_url) for r in got.orderBy("page_seq").collect()] == [("a", "http://h/?p=1"), ("a", "http://h/?p=2")]
    with pytest.raises(Exception, match="no page limit"):
        hosts.enumerate_pages(df, limit=F.col("n")).collect()


def test_rules_of_sources_and_pages_that_never_landed(spark):
    rows = [(f, g, "t", None, page, 0) for f in ("one", "two", "all") for g, page in (("a", 1), ("b", 3), ("c", 6))]
    rows.append(("two", "z", "t", None, 0, 0))
    found = _items(spark, rows)
    rule = F.expr("CASE feed_key WHEN 'one' THEN 1 WHEN 'two' THEN 2 END")
    got = sorted((r.feed_key, r.guid) for r in items.page_cutoff(found, rule).collect())
    assert got == [("all", "a"), ("all", "b"), ("all", "c"), ("one", "a"), ("two", "a"), ("two", "b"), ("two", "z")]
    landed = spark.createDataFrame([(f, p) for f in ("one", "two", "all") for p in (1, 3, 6)], "feed_key string, page_seq int")
    gone = {r.feed_key: r.page_seq for r in items.missing_pages(found, landed, rule).collect()}
    assert gone == {"one": 2, "two": 2, "all": 2}
    whole = landed.unionByName(spark.createDataFrame([(f, 2) for f in ("one", "two", "all")], "feed_key string, page_seq int"))
    gone = {r.feed_key: r.page_seq for r in items.missing_pages(found, whole, rule).collect()}
    assert gone == {"two": 4, "all": 4}


def test_an_attempt_logged_twice_counts_once(spark):
    rows = [("a", 1, False, None, "E1"), ("a", 2, True, "x", None), ("a", 2, True, "x", None), ("a", 2, True, "y", None),
            ("b", 1, True, "z", None), ("b", 1, False, None, "E"), ("c", 1, False, None, "E1"), ("c", 1, False, None, "E2")]
    df = spark.createDataFrame(rows, "feed_key string, attempt int, ok boolean, body string, error_type string")
    got = {r.feed_key: (r.ok, r.attempts_used, r.body, r.last_error) for r in items.retry_outcome(df).collect()}
    assert items.retry_outcome(df).count() == 3 and got["a"][2] in "xy"
    assert got == {"a": (True, 2, got["a"][2], None), "b": (True, 1, "z", None), "c": (False, 1, None, "E2")}
