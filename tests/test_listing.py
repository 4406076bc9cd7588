from datetime import datetime

import pytest

from rows import rows_of
from syndica.plans import listing

A_URL = "https://a.example/thread0806.php?fid=16"


def _row_a(key, title="post", href=None, cell="<td></td>", extra=""):
    href = href or f"htm_data/2607/16/{key}.html"
    return (f'<tr class="tr3 t_one tac"><td>.</td><td class="tal"><h3><a id="t{key}" href="{href}">{title}</a>'
            f'</h3>{extra}</td>{cell}</tr>')


def _cell(author, stamp):
    return f'<td><a class="bl">{author}</a><div class="f12"><span {stamp}>x</span></div></td>'


@pytest.fixture(scope="module")
def page_a():
    return "<table>" + "".join([
        _row_a("101", "first [36P]", cell=_cell("ann", 'data-timestamp="1710000000s"')),
        _row_a("101", "copy [36P]", cell=_cell("eve", 'data-timestamp="1"')),
        _row_a("102", "pinned ［22P+1V］", cell=_cell(" ", 'title="置顶主题：2026-07-10 12:00:00"')),
        _row_a("103", "elsewhere", href="htm_data/2607/7/103.html"),
        _row_a("104", "no author", cell=""),
        _row_a("10x", "odd id"),
        _row_a("105", ""),
        '<tr class="tr3 t_one"><td></td><td class="tal"><h3><a id="t106" href="htm_data/1/16/6.html">other</a></h3></td></tr>',
    ]) + "</table>"


def test_listing_a_fields_dedupe_and_links(pages, page_a):
    got = rows_of(listing.extract_listing_a(pages((A_URL, page_a))), "guid", "title", "link", "author", "published_at")
    base = "https://a.example/htm_data/2607/16/"
    assert got == [
        ("101", "first [36P]", base + "101.html", "ann", datetime(2024, 3, 9, 16, 0)),
        ("102", "pinned ［22P+1V］", base + "102.html", None, datetime(2026, 7, 10, 4, 0)),
        ("104", "no author", base + "104.html", None, None),
    ]


def test_listing_a_filter_comes_before_dedupe(pages):
    html = _row_a("1", "text only") + _row_a("1", "with pictures [9P]") + _row_a("2", "more [1V]")
    got = rows_of(listing.extract_listing_a(pages((A_URL, html)), images_only=True), "guid", "title")
    assert got == [("1", "with pictures [9P]"), ("2", "more [1V]")]


def test_listing_a_limit_section_and_blank(pages, page_a):
    assert rows_of(listing.extract_listing_a(pages((A_URL, page_a)), max_items=1), "guid") == [("101",)]
    assert rows_of(listing.extract_listing_a(pages((A_URL, page_a)), max_items=0), "guid") == []
    assert rows_of(listing.extract_listing_a(pages((A_URL, ""), (A_URL, "<p>tr3</p>"), (A_URL, None))), "guid") == []
    anywhere = listing.extract_listing_a(pages(("https://a.example/x.php", page_a)))
    assert ("103",) in rows_of(anywhere, "guid")


def test_listing_a_nested_rows_and_cells(pages):
    """Rows left open nest; each still reads its own anchor, and only its direct third cell."""
    inner = "<table><tr><td>1</td><td>2</td><td><a class='bl'>inner</a></td></tr></table>"
    html = (_row_a("1", "one", extra=inner, cell=_cell("outer", "")).replace("</tr>", "", 2)
            + _row_a("2", "two", cell=_cell("bob", "")))
    got = rows_of(listing.extract_listing_a(pages((A_URL, html))), "guid", "title", "author")
    assert got == [("1", "one", "outer"), ("2", "two", "bob")]


B_URL = "https://b.example/forum/forumdisplay.php?fid=19"


def _row_b(key, tid=None, date="2026-7-11", icon="", kind="normalthread_"):
    return (f'<tbody id="{kind}{key}"><tr><th class="subject new"><span id="thread_{key}">'
            f'<a href="viewthread.php?tid={tid or key}&amp;extra=x">post {key}</a></span>{icon}</th>'
            f'<td class="author"><cite><a>ann</a></cite><em>{date}</em></td></tr></tbody>')


def test_listing_b_rows(pages):
    html = "<table>" + "".join([
        _row_b("9", kind="stickthread_"), _row_b("201"), _row_b("201"), _row_b("202", date="2026-13-40"),
        _row_b("203", tid="999"), _row_b("204", tid="204&amp;tid=205"),
    ]) + "</table>"
    got = rows_of(listing.extract_listing_b(pages((B_URL, html))), "guid", "title", "link", "author", "published_at")
    link = "https://b.example/forum/viewthread.php?tid="
    assert got == [
        ("forum-b:19:201", "post 201", link + "201", "ann", datetime(2026, 7, 10, 16, 0)),
        ("forum-b:19:202", "post 202", link + "202", "ann", None),
    ]


def test_listing_b_icon_filter_and_missing_section(pages):
    html = (_row_b("1", icon='<img class="attach" src="a/attachicons/i.gif">') + _row_b("2")
            + _row_b("3", icon='<img class="attach" src="a/digest.gif">'))
    assert rows_of(listing.extract_listing_b(pages((B_URL, html)), images_only=True), "guid") == [("forum-b:19:1",)]
    assert rows_of(listing.extract_listing_b(pages(("https://b.example/x", html))), "guid") == []


H_URL = "https://b.example/index.php"


def _home(headers, columns, between=""):
    head = "".join(f"<td>{h}</td>" for h in headers)
    body = "".join(f"<td>{c}</td>" for c in columns)
    return f'<table><thead class="category"><tr>{head}</tr></thead>{between}<tr>{body}</tr></table>'


def _link(tid, title):
    return f'<p><a href="viewthread.php?tid={tid}">{title}</a></p>'


def test_highlights_blocks_in_order(pages):
    html = _home(
        ["≡ new ≡", "plain", "≡ hot ≡", "≡ void ≡"],
        [_link(1, "one") + _link(2, "two"), _link(7, "ignored"), _link(2, "again") + _link(3, "three"), ""],
    )
    got = rows_of(listing.extract_highlights(pages((H_URL, html))), "guid", "title", "link", "author")
    assert got == [
        ("forum-b:home:1", "[new] one", "https://b.example/viewthread.php?tid=1", None),
        ("forum-b:home:2", "[new] two", "https://b.example/viewthread.php?tid=2", None),
        ("forum-b:home:3", "[hot] three", "https://b.example/viewthread.php?tid=3", None),
    ]
    assert rows_of(listing.extract_highlights(pages((H_URL, html)), max_items=2), "guid") == [
        ("forum-b:home:1",), ("forum-b:home:2",)]


def test_highlights_need_the_row_right_after_the_header(pages):
    blocks = (["≡ new ≡"], [_link(1, "one")])
    assert rows_of(listing.extract_highlights(pages((H_URL, _home(*blocks, between="<div></div>")))), "guid") == []
    assert rows_of(listing.extract_highlights(pages((H_URL, "<p>category</p>"), (H_URL, " "))), "guid") == []
    shorter = _home(["≡ new ≡"], [_link(1, "one"), _link(2, "two")])
    assert rows_of(listing.extract_highlights(pages((H_URL, shorter))), "guid") == [("forum-b:home:1",)]
