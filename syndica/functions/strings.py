"""String expressions (C9-C18) and simple text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space, as a regex class body.
SPACE_CLASS = r"\s\x1c-\x1f\x85   -     　"

# The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)

# Media-count marker in a title, e.g. [36P], [10P+1V] or the full-width form.
MEDIA_COUNT = r"(?iU)[\[［]\s*\d+\s*(?:P(?:\s*\+\s*\d+\s*V)?|V)\s*[\]］]"

# Header of a highlights block.
BLOCK_HEADER = r"(?U)^≡\s*(.+?)\s*≡$"


def trim_space(col: Column) -> Column:
    """Strip every kind of Unicode white space from both ends."""
    return F.btrim(col, F.lit(SPACES))


def text_or_empty(col: Column) -> Column:
    return trim_space(F.coalesce(col, F.lit("")))


def collapse_space(col: Column) -> Column:
    return trim_space(F.regexp_replace(col, f"[{SPACE_CLASS}]+", " "))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    """First non-empty text of a fallback chain, else the empty string."""
    return F.coalesce(F.get(F.filter(F.array(*cols), lambda c: c != ""), F.lit(0)), F.lit(""))


def is_blank(col: Column) -> Column:
    """Nothing but white space; the search ends at the first other character."""
    return F.coalesce(~col.rlike(f"[^{SPACE_CLASS}]"), F.lit(True))


def has_media_count(title: Column) -> Column:
    return title.rlike(MEDIA_COUNT)


def block_name(header: Column) -> Column:
    """Name between the block markers; NULL when the header has none."""
    return empty_to_null(trim_space(F.regexp_extract(header, BLOCK_HEADER, 1)))


def block_title(block: Column, title: Column) -> Column:
    return F.concat(F.lit("["), block, F.lit("] "), title)


def guid(prefix: str, *parts: Column) -> Column:
    """``prefix:part:part``; an empty prefix gives the bare key."""
    head = [F.lit(prefix)] if prefix else []
    return F.concat_ws(":", *head, *parts)


def strip_trailing_punctuation(col: Column) -> Column:
    return F.regexp_replace(col, "[.,;]+$", "")


def local_name(col: Column) -> Column:
    """Name without namespace: ``{uri}name`` and ``p:name`` both give ``name``."""
    return F.regexp_replace(col, "^.*[}:]", "")


def names_by_key(keys: list[str], raw_names: Column) -> Column:
    """Map of ``keys`` to the ``;``-separated names, cut to the shorter list."""
    names = F.transform(F.split(raw_names, ";"), trim_space)
    width = F.least(F.lit(len(keys)), F.size(names))
    return F.map_from_arrays(
        F.slice(F.array(*[F.lit(k) for k in keys]), F.lit(1), width),
        F.slice(names, F.lit(1), width),
    )
