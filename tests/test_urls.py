from urllib.parse import parse_qs, urljoin, urlsplit

from pyspark.sql import functions as F

from syndica.functions import urls

BASES = [
    "http://h.example/a/b/c?x=1#f", "https://h.example", "https://h.example/", "http://h.example/a",
    "http://h.example/a/b/", "http://h.example/a//b/./c", "http://user@h.example:8080/x/../y/z",
    "HTTP://H.Example/Up/per",
]
HREFS = [
    "x", "./x", "../x", "../../x", "../../../x", "/x", "/x/../y", "//o.example/p", "//o.example",
    "?q=1", "#top", "", ".", "..", "./", "../", "x/./y", "x/../y", "x//y", "/x//y", "g?y/./x",
    "g#s/../x", "http://o.example/p/../q", "https://o.example", "http:g", "mailto:a@b", "javascript:void(0)",
    "x y/z", " /lead", "a;p=1", ";p", "?", "x?", "x#", "täst/ü", "/x/.", "/x/..", "data:,x", "ftp://f.example/a",
]


def test_resolve_url_matches_standard_join(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(pairs, "base string, href string")
    got = {(r.base, r.href): r.link for r in df.withColumn(
        "link", urls.resolve_url(F.col("base"), F.col("href"))).collect()}
    wrong = {k: (v, urljoin(*k)) for k, v in got.items() if v != urljoin(*k)}
    assert not wrong


def test_parts_match_standard_split(spark):
    samples = [u for u in BASES + HREFS]
    df = spark.createDataFrame([(u,) for u in samples], "u string")
    u = F.col("u")
    for r in df.select(
        "u", urls.url_scheme(u).alias("s"), urls.url_authority(u).alias("a"),
        urls.url_path(u).alias("p"), urls.url_query(u).alias("q"), urls.url_fragment(u).alias("f"),
    ).collect():
        want = urlsplit(r.u)
        assert (r.s, r.a, r.p, r.q, r.f) == (
            want.scheme, want.netloc, want.path, want.query, want.fragment), r.u


def test_query_param_and_single_value(spark):
    samples = ["http://h/?fid=16", "?fid=&fid=7", "?a=1", "?fid=%E4%B8%80+x", "?fid=1&fid=2", "?xfid=3", "x#?fid=4"]
    df = spark.createDataFrame([(u,) for u in samples], "u string").select(
        "u", urls.query_param(F.col("u"), "fid").alias("v"),
        urls.has_single_param(F.col("u"), "fid", F.lit("16")).alias("one"))
    for r in df.collect():
        values = parse_qs(urlsplit(r.u).query).get("fid", [])
        assert r.v == (values[0] if values else None), r.u
        assert r.one == (values == ["16"]), r.u


def test_origin_suffix_and_names(spark):
    u = F.col("u")
    row = spark.createDataFrame([("https://H.example:81/a/index.php//",)], "u string").select(
        urls.url_origin(u), urls.url_origin(F.lit("/x")), urls.url_origin(F.lit("/x"), "https://d"),
        urls.path_ends_with(u, "index.php"), urls.host_file_name(u), urls.url_host(u),
        urls.append_route(F.lit("https://p//"), F.lit("/r.xml")),
    ).first()
    assert tuple(row) == ("https://H.example:81", None, "https://d", True, "H.example_81",
                          "h.example:81", "https://p/r.xml")
