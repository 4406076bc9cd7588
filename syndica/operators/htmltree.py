"""HTML pages as element rows, and selectors as column predicates.

``html_nodes`` is the only step that runs in Python: it tokenizes a page and emits one row
per wanted element. Elements are numbered in document order, and each row knows the number
of its last descendant, so "inside" is ``outer.node_id < n <= outer.last_id``. Selectors are
then windows over the rows of one page, all on one partitioning by page.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syndica.functions.bind import let
from syndica.functions.strings import text_or_empty
from syndica.session import ship_package, spread

# Elements without content, attributes holding word lists, and elements whose
# strings are not part of the page text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
WORD_LISTS = frozenset(("class", "rel"))
SILENT = frozenset("rp rt script style template".split())

TEXT_TAG, PAGE_TAG = "#text", "#page"
NODE_FIELDS = ["node_id", "last_id", "parent_id", "depth", "sib_ord", "tag_ord", "tag",
               "classes", "attrs", "text", "parents", "near_id"]
_PARENT = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attr_id", T.StringType()),
])
_NODE_TYPES = [
    T.IntegerType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.IntegerType(),
    T.IntegerType(), T.StringType(), T.ArrayType(T.StringType()),
    T.MapType(T.StringType(), T.StringType()), T.StringType(), T.ArrayType(_PARENT),
    T.IntegerType(),
]
_ARROW_PARENT = pa.struct([
    ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attr_id", pa.string()),
])
_ARROW_TYPES = [
    pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(),
    pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string(),
    pa.list_(_ARROW_PARENT), pa.int32(),
]
# Rows per emitted batch: a page with very many elements leaves in several batches.
_BATCH_ROWS = 4096


# Regular markup: the text before a tag, then a start tag whose attributes are quoted or have no
# value, an end tag, or a comment or doctype that can end in one place only. Whatever does not match here is
# left to the standard parser, which gives the same for what does.
_TOKEN = re.compile(
    r"""([^<]*+)<(?:/([a-zA-Z][a-zA-Z0-9]*+)[ \t\n]*+>"""
    r"""|([a-zA-Z][a-zA-Z0-9]*+)((?:[ \t\n]++[a-zA-Z][a-zA-Z0-9_:\-]*+(?:=(?:"[^"]*+"|'[^']*+')|(?![ \t\n]*=)))*+)[ \t\n]*+(/?)>"""
    r"""|!--(?!>)[^\-]*+-->|![dD][oO][cC][tT][yY][pP][eE][^>]*+>)"""
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9_:\-]*+)(?:="([^"]*+)"|='([^']*+)')?""")
# A piece of text with an ampersand, as the standard parser takes it: names and numbers that
# end in a semicolon, or an ampersand that cannot begin either.
_REFERENCE = re.compile(r"&(?:([a-zA-Z][a-zA-Z0-9]*+);|#([0-9]++|[xX][0-9a-fA-F]++);|(?![a-zA-Z#]))")
# Elements whose content is not markup.
_RAW = frozenset(HTMLParser.CDATA_CONTENT_ELEMENTS) | frozenset(
    getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())) | {"plaintext"}


def _referred(found: re.Match) -> str:
    name, number = found.group(1, 2)
    if name:
        return html5.get(f"{name};", f"&{name}")
    return unescape(f"&#{number};") if number else "&"


def _plain(data: str) -> str | None:
    """Text with its references resolved; None if that takes the standard parser."""
    resolved, n = _REFERENCE.subn(_referred, data)
    return resolved if n == data.count("&") else None


def _attributes(raw: str) -> dict[str, str]:
    """The attributes of a regular start tag, the last of equal names counting."""
    return {name.lower(): unescape(value) if "&" in value else value
            for name, double, single in _ATTRIBUTE.findall(raw) for value in (double or single,)}


_NOTHING: dict[str, str] = {}


class _Open:
    """An element whose end has not been seen."""

    __slots__ = ("row", "tag", "found", "node_id", "text_from", "children", "per_tag", "near_id")

    def __init__(self, tag, found, node_id, near_id):
        self.row = self.text_from = self.per_tag = None
        self.tag, self.found, self.node_id, self.near_id = tag, found, node_id, near_id
        self.children = 0

    def attributes(self):
        """Attributes are kept as they were written until someone asks for them."""
        if type(self.found) is str:
            self.found = _attributes(self.found)
        return self.found

    def summary(self):
        found = self.attributes()
        return (self.tag, found.get("class", "").split(), found.get("id", "")) if found else (self.tag, [], "")


class _Tokens(HTMLParser):
    """Turns one page into rows. An end tag closes up to the nearest open element of its
    name and is ignored when there is none; nothing is closed by implication."""

    def __init__(self, tags, attr_names, text_tags, near_tags, strings_like, kept_attrs, ups,
                 only=None, up_tags=None):
        super().__init__(convert_charrefs=False)
        self.tags, self.attr_names, self.text_tags = tags, attr_names, text_tags
        self.near_tags, self.strings_like = near_tags, strings_like
        self.kept_attrs, self.ups, self.only, self.up_tags = kept_attrs, ups, only or {}, up_tags
        self.rows: list[list] = []
        self.chunks: list[str] = []
        self.pending: list[str] = []
        self.counter = 0
        self.silent = 0
        self.texts_open = 0
        self.kinds: dict[str, tuple] = {}
        self.root = _Open("", {}, 0, None)
        self.stack = [self.root]
        self.open_names: dict[str, int] = {}
        self.ended_void: dict[str, int] = {}

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def read(self, page: str) -> None:
        """The whole page: regular markup by one pattern, the rest by the standard parser."""
        match, at, stack = _TOKEN.match, 0, self.stack
        keeps_strings = self.strings_like is not None
        while (found := match(page, at)) is not None:
            data, ended, started, raw, closed = found.groups()
            if data:
                if "&" in data:  # also in text that is not kept: it may end the page for the standard parser
                    data = _plain(data)
                    if data is None:
                        break
                if self.texts_open or keeps_strings:
                    self.pending.append(data)
            if ended is not None:
                tag = ended.lower()
                if stack[-1].tag == tag and not self.ended_void.get(tag):
                    if self.pending:
                        self._end_text()
                    self._finish(stack.pop())
                else:
                    self.handle_endtag(tag)
            elif started is not None:
                tag = started.lower()
                if tag in _RAW:
                    # its text was taken, the tag itself is left
                    at = found.start(3) - 1
                    break
                self._start(tag, raw, bool(closed))
            else:
                self._end_text()
            at = found.end()
        if at < len(page):
            self.feed(page[at:])

    def _end_text(self):
        if not self.pending:
            return
        chunk = "".join(self.pending).strip()
        self.pending = []
        if not chunk or self.silent:
            return
        self.chunks.append(chunk)
        if self.strings_like is not None and self.strings_like.search(chunk):
            self.counter += 1
            top = self.stack[-1]
            self.rows.append([self.counter, self.counter, top.node_id, len(self.stack), None,
                              None, TEXT_TAG, None, None, chunk, None, top.near_id])

    def handle_starttag(self, tag, attrs, closes_itself=False):
        self._start(tag, {name: "" if value is None else value for name, value in attrs}, closes_itself)

    def _kind_of(self, tag):
        """What the options say about a tag: wanted, text wanted, near, silent, void, classes, parents."""
        kind = self.kinds[tag] = (
            self.tags is None or tag in self.tags, self.text_tags is None or tag in self.text_tags,
            tag in self.near_tags, tag in SILENT, tag in VOID, self.only.get(tag),
            self.ups if self.up_tags is None or tag in self.up_tags else 0)
        return kind

    def _start(self, tag, found, closes_itself):
        """``found``: the attributes, or their text in a regular tag."""
        if self.pending:
            self._end_text()
        wanted, texted, near, silent, void, only, ups = self.kinds.get(tag) or self._kind_of(tag)
        stack = self.stack
        top = stack[-1]
        self.counter = node_id = self.counter + 1
        node = _Open(tag, found, node_id, node_id if near else top.near_id)
        sib_ord = top.children
        top.children = sib_ord + 1
        if wanted or (self.attr_names and found and not self.attr_names.isdisjoint(node.attributes())):
            counts = top.per_tag
            if counts is None:
                counts = top.per_tag = {}
            # counts the wanted elements of the tag, so all of them for a tag in ``tags``
            tag_ord = counts.get(tag, 0)
            counts[tag] = tag_ord + 1
            own = node.attributes() if found else _NOTHING
            classes = own["class"].split() if "class" in own else []
            if only is None or only.issubset(classes):
                parents = [
                    p.summary() for p in stack[:-ups - 1:-1] if p is not self.root
                ] if ups else [] if self.ups else None
                kept = list(own.items()) if self.kept_attrs is None else [
                    pair for pair in own.items() if pair[0] in self.kept_attrs
                ] if own else []
                node.row = row = [node_id, None, top.node_id, len(stack), sib_ord, tag_ord, tag,
                                  classes, kept, None, parents, top.near_id]
                self.rows.append(row)
                if texted:
                    node.text_from = len(self.chunks)
                    self.texts_open += 1
        if silent:
            self.silent += 1
        if void and not closes_itself:  # opened and closed at once
            self._end(node)
            self.ended_void[tag] = self.ended_void.get(tag, 0) + 1
            return
        stack.append(node)
        self.open_names[tag] = self.open_names.get(tag, 0) + 1
        if closes_itself:
            self.handle_endtag(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closes_itself=True)

    def handle_endtag(self, tag):
        if self.ended_void.get(tag):
            self.ended_void[tag] -= 1
            return
        self._close(tag)

    def _close(self, tag):
        if self.pending:
            self._end_text()
        while self.open_names.get(tag):
            node = self.stack.pop()
            self._finish(node)
            if node.tag == tag:
                break

    def _finish(self, node):
        self.open_names[node.tag] -= 1
        self._end(node)

    def _end(self, node):
        if self.silent and node.tag in SILENT:
            self.silent -= 1
        if node.row is not None:
            node.row[1] = self.counter
            if node.text_from is not None:
                node.row[9] = " ".join(self.chunks[node.text_from:])
                self.texts_open -= 1

    def handle_data(self, data):
        # text outside every element whose text is wanted need not be kept
        if self.texts_open or self.strings_like is not None:
            self.pending.append(data)

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.handle_data(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self._end_text()

    def handle_decl(self, decl):
        self._end_text()

    def handle_pi(self, data):
        self._end_text()

    def unknown_decl(self, data):
        self._end_text()
        if data[:6].upper() == "CDATA[":
            self.handle_data(data[6:])
            self._end_text()

    def finish(self) -> list[list]:
        self.close()
        self._end_text()
        while len(self.stack) > 1:
            self._finish(self.stack.pop())
        return self.rows


def parse_page(page: str | None, tags=None, attr_names=frozenset(), text_tags=None,
               near_tags=frozenset(), strings_like=None, kept_attrs=None, ups: int = 2,
               only=None, up_tags=None) -> list[list]:
    """Rows of one page in document order (fields as in NODE_FIELDS); none if unreadable."""
    if not page or not page.strip():
        return []
    tokens = _Tokens(tags, attr_names, text_tags, near_tags, strings_like, kept_attrs, ups, only, up_tags)
    try:
        tokens.read(page)
        return tokens.finish()
    except AssertionError:
        return []


def _lists(values: list, kind: pa.DataType) -> pa.ListArray:
    """One list per row, from one flat array; None stays NULL."""
    offsets, end = [], 0
    for v in values:
        offsets.append(None if v is None else end)
        end += len(v or ())
    offsets.append(end)
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array([x for v in values if v for x in v], kind))


def _maps(values: list) -> pa.MapArray:
    offsets, end = [], 0
    for v in values:
        offsets.append(None if v is None else end)
        end += len(v or ())
    offsets.append(end)
    pairs = [pair for v in values if v for pair in v]
    return pa.MapArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array([k for k, _ in pairs], pa.string()),
        pa.array([v for _, v in pairs], pa.string()))


def _parent_lists(values: list) -> pa.ListArray:
    offsets, end = [], 0
    for v in values:
        offsets.append(None if v is None else end)
        end += len(v or ())
    offsets.append(end)
    flat = [p for v in values if v for p in v]
    parents = pa.StructArray.from_arrays(
        [pa.array([p[0] for p in flat], pa.string()), _lists([p[1] for p in flat], pa.string()),
         pa.array([p[2] for p in flat], pa.string())], fields=list(_ARROW_PARENT))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parents)


def _column(name: str, values: list, kind: pa.DataType) -> pa.Array:
    if name == "classes":
        return _lists(values, pa.string())
    if name == "attrs":
        return _maps(values)
    if name == "parents":
        return pa.nulls(len(values), kind) if not any(values) and None in values else _parent_lists(values)
    return pa.array(values, kind)


def unreadable_html(pages: DataFrame, keep: Iterable[str] = ("page_id",), html_col: str = "html"
                    ) -> DataFrame:
    """Pages that the tokenizer gives up on, ``(*keep, error_type)``: they give no rows at all.

    Only a marked section can do that, so other pages are not read again.
    """
    ship_package(pages.sparkSession)
    keep = list(keep)
    source = pages.filter(F.contains(html_col, F.lit("<!["))).select(*keep, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = pa.array([_breaks(page) for page in batch.column(len(keep)).to_pylist()], pa.bool_())
            yield batch.filter(bad).select(keep)

    found = source.mapInArrow(run, T.StructType([source.schema[c] for c in keep]))
    return found.withColumn("error_type", F.lit("UnreadableHtml"))


def _breaks(page: str) -> bool:
    tokens = _Tokens(frozenset(), frozenset(), frozenset(), frozenset(), None, None, 0)
    try:
        tokens.read(page)
        tokens.close()
    except AssertionError:
        return True
    return False


def html_nodes(
    pages: DataFrame,
    tags: Iterable[str] | None = None,
    attr_names: Iterable[str] = (),
    text_tags: Iterable[str] | None = None,
    near_tags: Iterable[str] = (),
    strings_like: str | None = None,
    kept_attrs: Iterable[str] | None = None,
    tags_col: str | None = None,
    text_tags_col: str | None = None,
    keep: Iterable[str] = ("page_id",),
    html_col: str = "html",
    ups: int = 2,
    page_rows: bool = False,
    only: dict[str, str] | None = None,
    up_tags: Iterable[str] | None = None,
) -> DataFrame:
    """One row per wanted element of each page, in document order (H1).

    An element is wanted when its tag is in ``tags`` or when it has an attribute of
    ``attr_names``; ``tags=None`` wants all. ``text`` is filled for ``text_tags`` (None: all).
    The array columns ``tags_col`` and ``text_tags_col`` add tags page by page, ``*`` standing
    for all. ``near_id`` is the closest ancestor among ``near_tags``; ``parents``
    holds the ``ups`` closest ancestors, nearest first. Text strings matching
    ``strings_like`` become rows tagged ``#text``; with ``page_rows`` every page, even one
    without a body, has a row tagged ``#page``. ``keep`` columns are repeated per row.
    ``only`` names classes that elements of a tag must have to be a row (``{"td": "author"}``);
    the others still count in ``tag_ord``. Only elements of ``up_tags`` (None: all) have ``parents``.
    """
    ship_package(pages.sparkSession)
    keep = list(keep)
    wanted = None if tags is None else frozenset(tags)
    attr_names, near_tags = frozenset(attr_names), frozenset(near_tags)
    text_tags = None if text_tags is None else frozenset(text_tags)
    kept_attrs = None if kept_attrs is None else frozenset(kept_attrs)
    only = {tag: frozenset(classes.split()) for tag, classes in (only or {}).items()}
    up_tags = None if up_tags is None else frozenset(up_tags)
    per_page = [c for c in (tags_col, text_tags_col) if c]
    source = spread(pages.select(*keep, html_col, *per_page))

    def widen(base, batch, column, i):
        if column is None or base is None:
            return base
        more = batch.column(len(keep) + 1 + per_page.index(column))[i].as_py() or ()
        return None if "*" in more else base.union(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(strings_like) if strings_like else None
        first = [[0, 0, None, 0, None, None, PAGE_TAG, *[None] * 5]] if page_rows else []
        for batch in batches:
            bodies = batch.column(len(keep))
            rows, owner = [], []

            def emit():
                index = pa.array(owner, pa.int32())
                columns = [batch.column(i).take(index) for i in range(len(keep))]
                for name, values, kind in zip(NODE_FIELDS, zip(*rows), _ARROW_TYPES):
                    columns.append(_column(name, values, kind))
                return pa.RecordBatch.from_arrays(columns, names=keep + NODE_FIELDS)

            for i in range(batch.num_rows):
                here = widen(wanted, batch, tags_col, i)
                texts = widen(text_tags, batch, text_tags_col, i)
                found = parse_page(bodies[i].as_py(), here, attr_names, texts, near_tags,
                                   pattern, kept_attrs, ups, only, up_tags)
                for row in chain(first, found):
                    rows.append(row)
                    owner.append(i)
                    if len(rows) >= _BATCH_ROWS:
                        yield emit()
                        rows, owner = [], []
            if rows:
                yield emit()

    schema = T.StructType(
        [source.schema[c] for c in keep]
        + [T.StructField(n, t) for n, t in zip(NODE_FIELDS, _NODE_TYPES)]
    )
    return source.mapInArrow(run, schema)


def register_html_nodes(spark: SparkSession, name: str = "html_nodes") -> None:
    """Make ``LATERAL html_nodes(html)`` available to SQL.

    Rows pass in Arrow batches. A table function of whole batches (``arrow_udtf``) would be no
    use here, as Spark does not allow those in a lateral join.
    """
    ship_package(spark)
    returns = T.StructType([T.StructField(n, t) for n, t in zip(NODE_FIELDS, _NODE_TYPES)])

    class HtmlNodes:
        def eval(self, page: str):
            for row in parse_page(page):
                row[8] = dict(row[8] or ())
                row[10] = row[10] or []
                yield tuple(row)

    spark.udtf.register(name, F.udtf(HtmlNodes, returnType=returns, useArrow=True))


# --- predicates on one row -------------------------------------------------------------
# Written as SQL text: plans hold hundreds of them, and one text is one call to the JVM.

def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _classes(column: str, classes: tuple[str, ...]) -> str:
    return "".join(f" AND array_contains({column}, {_text(c)})" for c in classes)


def is_tag(name: str, *classes: str) -> Column:
    """``name.class.class`` (H2)."""
    return F.expr(f"coalesce(tag = {_text(name)}{_classes('classes', classes)}, false)")


def raw_attr(name: str) -> Column:
    return F.expr(f"try_element_at(attrs, {_text(name)})")


def attr(name: str) -> Column:
    """Attribute text, trimmed, empty when absent."""
    return text_or_empty(raw_attr(name))


def has_attr(name: str) -> Column:
    return F.expr(f"try_element_at(attrs, {_text(name)}) IS NOT NULL")


def attr_starts(name: str, prefix: str) -> Column:
    return F.expr(
        f"coalesce(startswith(try_element_at(attrs, {_text(name)}), {_text(prefix)}), false)"
    )


def attr_contains(name: str, part: str) -> Column:
    return F.expr(
        f"coalesce(contains(try_element_at(attrs, {_text(name)}), {_text(part)}), false)"
    )


def parent_is(level: int, tag: str, *classes: str, id_prefix: str = "") -> Column:
    """The ancestor ``level`` steps up (1 = parent) matches: the child combinator (H5)."""
    up = f"get(parents, {level - 1})"
    starts = f" AND startswith({up}.attr_id, {_text(id_prefix)})" if id_prefix else ""
    return F.expr(
        f"coalesce({up}.tag = {_text(tag)}{_classes(up + '.classes', classes)}{starts}, false)"
    )


def matches_selector(selector: Column) -> Column:
    """A comma list of ``tag.class...`` selectors held in a column; the tag may be empty."""
    return let(
        {"selector": selector, "tag": F.col("tag"), "classes": F.col("classes")},
        [],
        r"""coalesce(exists(split(trim(v.selector), r'\s*,\s*'), one ->
            split(one, '[.]')[0] IN ('', v.tag) AND size(array_except(
                slice(split(one, '[.]'), 2, 1000000),
                coalesce(v.classes, cast(array() AS array<string>)))) = 0), false)""",
    )


# --- relations between rows of one page --------------------------------------------------

def _before():
    """Rows of the same page that start earlier."""
    return (
        Window.partitionBy("page_id").orderBy("node_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _after():
    """Rows of the same page that start later, nearest last (a running frame, so linear)."""
    return (
        Window.partitionBy("page_id").orderBy(F.col("node_id").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def inside(outer: Column) -> Column:
    """Has an ancestor for which ``outer`` holds.

    Elements nest, so it is enough that some earlier match has not ended yet.
    """
    reach = F.max(F.when(outer, F.col("last_id"))).over(_before())
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def first_inside(match: Column, value: Column) -> Column:
    """``value`` of the first descendant for which ``match`` holds, else NULL (H7).

    Descendants follow their ancestor directly, so the next match in document order is the
    first one inside if it starts before the ancestor ends.
    """
    found = F.last(
        F.when(match, F.struct(F.col("node_id").alias("id"), value.alias("value"))), True
    ).over(_after())
    return F.when(found["id"] <= F.col("last_id"), found["value"])


def enclosing(match: Column, value: Column) -> Column:
    """``value`` of the latest earlier match if this row lies inside it.

    For matches that do not nest, such as the cells of one table row.
    """
    found = F.last(
        F.when(match, F.struct(F.col("last_id").alias("end"), value.alias("value"))), True
    ).over(_before())
    return F.when(found["end"] >= F.col("node_id"), found["value"])


def whole_page() -> Window:
    return Window.partitionBy("page_id")
