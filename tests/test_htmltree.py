from pyspark.sql import functions as F

from syndica.operators import htmltree
from syndica.operators.htmltree import NODE_FIELDS, parse_page


def _by_tag(html, **options):
    return {r[6]: dict(zip(NODE_FIELDS, r)) for r in parse_page(html, **options)}


def test_unclosed_elements_nest_and_stray_ends_are_ignored():
    rows = parse_page("<div><p>a<p>b</i></div>c<em>d")
    named = [(r[6], r[0], r[1], r[9]) for r in rows]
    assert named == [("div", 1, 3, "a b"), ("p", 2, 3, "a b"), ("p", 3, 3, "b"), ("em", 4, 4, "d")]


def test_void_elements_hold_nothing():
    rows = parse_page("<p>x<br>y<img src=a>z<br/>w</p>")
    assert [(r[6], r[2]) for r in rows] == [("p", 0), ("br", 1), ("img", 1), ("br", 1)]
    assert rows[0][9] == "x y z w"


def test_text_leaves_out_comments_and_scripts():
    html = "<div> a <!-- no --> b<script>var t='</p>';</script><style>p{}</style><template><i>t</i></template></div>"
    assert _by_tag(html)["div"]["text"] == "a b"


def test_entities_attributes_and_classes():
    node = _by_tag("<a CLASS=' x  y ' href='?a=1&amp;b=2' href='/last' data-n>5 &lt; 6 &#65;&unknown;</a>")["a"]
    assert node["classes"] == ["x", "y"]
    assert dict(node["attrs"]) == {"class": " x  y ", "href": "/last", "data-n": ""}
    assert node["text"] == "5 < 6 A&unknown"


def test_ordinals_count_unwanted_siblings_too():
    rows = parse_page("<tr><th>h</th><td>0</td><b></b><td>1</td></tr>", tags=frozenset(["td"]))
    assert [(r[4], r[5]) for r in rows] == [(1, 0), (3, 1)]


def test_closest_container_and_date_strings():
    import re
    html = "<li>2024-1-2<li><a>x</a><section><a>y</a></section></li>"
    rows = parse_page(html, tags=frozenset(["a", "li", "section"]), near_tags=frozenset(["li", "section"]),
                      strings_like=re.compile(r"\d{4}-\d"))
    at = {r[0]: r[6] for r in rows}
    assert [(r[6], at.get(r[11])) for r in rows] == [
        ("li", None), ("#text", "li"), ("li", "li"), ("a", "li"), ("section", "li"), ("a", "section")]


def test_deep_nesting_is_linear():
    html = "<p><b>" * 20000 + "<a href=x>end</a>"
    rows = parse_page(html, tags=frozenset(["a"]), text_tags=frozenset(["a"]))
    assert rows[0][3] == 40001 and rows[0][9] == "end"


def test_regular_pages_do_not_take_the_standard_parser(monkeypatch):
    """The slow parser sees only what is left from the first irregular tag on, and gives the same rows."""
    fed = []
    feed = htmltree._Tokens.feed
    monkeypatch.setattr(htmltree._Tokens, "feed", lambda self, data: (fed.append(data), feed(self, data))[1])
    regular = ('<!DOCTYPE html><table><!--x--><tr CLASS="a b"><td id=\'i\'>1 &amp; 2 &#65;<img class="c" src="s" />'
               '<br><a href="?x=1&amp;y=2" data-n>t</a></td></tr></table>')
    rows = parse_page(regular + "<p>end</p>")
    assert fed == []
    odd = parse_page(regular + "<p >end</p><i a=b>")
    assert fed == ["<i a=b>"] and odd[:len(rows)] == rows
    for tag in ("script", "style"):
        fed.clear()
        page = f"<p>a<{tag}><p>no</{tag}>b</p>"
        assert [r[9] for r in parse_page(page, tags=frozenset(["p"]))] == ["a b"] and fed == [page[4:]]
    # references that are not closed, also in text that nobody wants, are the standard parser's
    fed.clear()
    parse_page("<p>a &lt b</p><a>c</a>", tags=frozenset(["a"]))
    assert fed == ["a &lt b</p><a>c</a>"]


def test_ended_void_elements_are_counted_not_searched():
    """Void elements whose end tag may still come are counted per name: work stays linear in them."""
    tokens = htmltree._Tokens(frozenset(), frozenset(), frozenset(), frozenset(), None, None, 0)
    tokens.read("<img>" * 5000 + "</img>" * 4999)
    assert tokens.ended_void == {"img": 1}


def test_rows_of_named_classes_only_and_parents_of_named_tags():
    html = '<tr><td class="x">1</td><td>2</td><td class="y x"><a>3</a></td></tr>'
    rows = parse_page(html, tags=frozenset(["td", "a"]), only={"td": frozenset(["x"])}, up_tags=frozenset(["a"]))
    assert [(r[6], r[5], r[9], r[10]) for r in rows] == [
        ("td", 0, "1", []), ("td", 2, "3", []), ("a", 0, "3", [("td", ["y", "x"], ""), ("tr", [], "")])]


def test_selectors_match_brute_force(spark, pages):
    """Window forms of ancestor and first-descendant tests against plain walks of the tree."""
    import random
    rng = random.Random(7)
    tags = ["tr", "td", "h3", "a", "div"]
    docs = []
    for _ in range(12):
        parts = []
        for _ in range(60):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag} class={rng.choice('uvw')}>", f"</{tag}>", "t "]))
        docs.append(("http://h/", "".join(parts)))
    nodes = htmltree.html_nodes(pages(*docs))
    got = nodes.select(
        "page_id", "node_id",
        htmltree.inside(htmltree.is_tag("td", "u")).alias("inside"),
        htmltree.first_inside(htmltree.is_tag("a"), F.col("node_id")).alias("first"),
    ).collect()
    assert got
    trees = {i: {r[0]: r for r in parse_page(html)} for i, (_, html) in enumerate(docs)}
    for r in got:
        tree = trees[r.page_id]
        above, up = [], tree[r.node_id][2]
        while up:
            above.append(tree[up])
            up = tree[up][2]
        assert r.inside == any(n[6] == "td" and "u" in n[7] for n in above)

        def under(n):
            while n:
                n = tree[n][2]
                if n == r.node_id:
                    return True
            return False
        links = [n for n, row in sorted(tree.items()) if row[6] == "a" and under(n)]
        assert r.first == (links[0] if links else None)


def test_sql_table_function(spark):
    htmltree.register_html_nodes(spark)
    rows = spark.sql(
        "SELECT n.tag, n.text, n.attrs['href'] AS h FROM VALUES ('<p>x<a href=q>y</a>') AS t(html), "
        "LATERAL html_nodes(html) n ORDER BY n.node_id").collect()
    assert [tuple(r) for r in rows] == [("p", "x y", None), ("a", "y", "q")]
