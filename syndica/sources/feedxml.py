"""RSS and Atom documents as item records.

The reader needs every ``item`` or ``entry`` at any depth, the text before an element's
first child, and nothing at all from a malformed document. A fixed nested schema for
``from_xml`` cannot say these things, so documents pass once through the standard XML
parser in Arrow batches; choosing among the fields stays with Spark.
"""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syndica.functions.strings import text_or_empty
from syndica.session import ship_package, spread

# Record elements and the children that hold metadata.
RECORDS = frozenset(("item", "entry"))
FIELDS = frozenset(
    "title link guid id pubDate published updated creator name author".split()
)

_PART = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
_CHILD = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("href", T.StringType()), T.StructField("parts", T.ArrayType(_PART)),
])
_ARROW_CHILD = pa.struct([
    ("name", pa.string()), ("text", pa.string()), ("href", pa.string()),
    ("parts", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())]))),
])
_BATCH_ROWS = 2048
_FEED_CHARS = 1 << 16


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _children(node) -> list[dict]:
    return [
        {"name": name, "text": child.text, "href": child.get("href"),
         "parts": [{"name": _local(p.tag), "text": p.text} for p in child if _local(p.tag) in FIELDS]}
        for child in node if (name := _local(child.tag)) in FIELDS
    ]


def _records(body: str | None) -> list[list[dict]] | None:
    """Metadata children of every record, in document order; None if the document is malformed.

    Pulled piece by piece: elements are dropped once they end outside every open record, so
    memory holds the records' fields and not the document's tree.
    """
    if not body or not body.strip():
        return []
    found: list = []
    records: list[int] = []  # places in ``found`` of the records that are open
    path: list = []

    def consume(parser):
        for event, node in parser.read_events():
            if event == "start":
                path.append(node)
                if _local(node.tag) in RECORDS:
                    records.append(len(found))
                    found.append(None)
                continue
            path.pop()
            if _local(node.tag) in RECORDS:
                found[records.pop()] = _children(node)
            if not records:
                node.clear()
                if path:
                    path[-1].remove(node)

    parser = ElementTree.XMLPullParser(("start", "end"))
    try:
        for at in range(0, len(body), _FEED_CHARS):
            parser.feed(body[at:at + _FEED_CHARS])
            consume(parser)
        parser.close()
        consume(parser)
    except (ElementTree.ParseError, ValueError):
        return None
    return found


def feed_rows(docs: DataFrame, keep: Iterable[str] = ("page_id",), body_col: str = "html") -> DataFrame:
    """Records and failures of one parse: a row ``(*keep, pos, children, failed)`` per item or entry, in
    document order, or one with ``failed`` for a document that is no well-formed XML.

    Blank documents have neither.
    """
    ship_package(docs.sparkSession)
    keep = list(keep)
    source = spread(docs.select(*keep, body_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, position, children, failed = [], [], [], []

            def emit():
                index = pa.array(owner, pa.int32())
                columns = [batch.column(i).take(index) for i in range(len(keep))]
                columns += [pa.array(position, pa.int32()),
                            pa.array(children, pa.list_(_ARROW_CHILD)), pa.array(failed, pa.bool_())]
                return pa.RecordBatch.from_arrays(columns, names=keep + ["pos", "children", "failed"])

            bodies = batch.column(len(keep))
            for i in range(batch.num_rows):
                records = _records(bodies[i].as_py())
                for at, found in enumerate([None] if records is None else records):
                    owner.append(i)
                    position.append(at)
                    children.append(found)
                    failed.append(records is None)
                    if len(owner) >= _BATCH_ROWS:
                        yield emit()
                        owner, position, children, failed = [], [], [], []
            if owner:
                yield emit()

    schema = T.StructType(
        [source.schema[c] for c in keep]
        + [T.StructField("pos", T.IntegerType()), T.StructField("children", T.ArrayType(_CHILD)),
           T.StructField("failed", T.BooleanType())]
    )
    return source.mapInArrow(run, schema)


def feed_records(docs: DataFrame, keep: Iterable[str] = ("page_id",), body_col: str = "html"
                 ) -> DataFrame:
    """One row per item or entry, in document order, with its metadata children."""
    return records_of(feed_rows(docs, keep, body_col))


def records_of(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("failed")).drop("failed")


def unreadable_feeds(docs: DataFrame, keep: Iterable[str] = ("page_id",), body_col: str = "html"
                     ) -> DataFrame:
    """Documents that are no well-formed XML, ``(*keep, error_type)``; blank ones are not counted."""
    return failures_of(feed_rows(docs, keep, body_col), keep)


def failures_of(rows: DataFrame, keep: Iterable[str] = ("page_id",)) -> DataFrame:
    return rows.filter("failed").select(*keep, F.lit("UnreadableXml").alias("error_type"))


def child_text(name: str) -> Column:
    """Text of the first child of that name that has any; trimmed, else empty."""
    return text_or_empty(F.expr(
        f"get(filter(children, c -> c.name = '{name}' AND length(c.text) > 0), 0).text"
    ))


def child_href(name: str) -> Column:
    """First non-blank ``href`` of the children of that name."""
    return text_or_empty(F.expr(
        f"get(filter(children, c -> c.name = '{name}' AND trim(c.href) <> ''), 0).href"
    ))


def nested_text(outer: str, inner: str) -> Column:
    """First non-blank text of ``inner`` below the children named ``outer``."""
    return text_or_empty(F.expr(f"""get(filter(transform(
        filter(children, c -> c.name = '{outer}'),
        c -> get(filter(c.parts, p -> p.name = '{inner}' AND length(p.text) > 0), 0).text),
        t -> trim(t) <> ''), 0)"""))
