"""URL expressions (C1-C8), all inside the JVM.

Parts are taken with tolerant patterns instead of ``parse_url``: raw hrefs hold blanks
and other characters a strict URI parser refuses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from syndica.functions.bind import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_SPLIT = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Schemes whose references resolve against a base.
RELATIVE_SCHEMES = [
    "file", "ftp", "gopher", "http", "https", "imap", "mms", "nntp", "prospero", "rtsp",
    "rtsps", "rtspu", "sftp", "shttp", "svn", "svn+ssh", "wais", "ws", "wss",
]


def _clean(url: Column) -> Column:
    """Drop leading control characters and blanks, and every tab or line break."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), _SCHEME, 1))


def url_authority(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 2)


def url_query(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 3)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, 4)


def url_host(url: Column) -> Column:
    """Key under which requests to one host are grouped: the lower-cased authority."""
    return F.lower(url_authority(url))


def url_origin(url: Column, default: str | None = None) -> Column:
    """``scheme://authority``; an incomplete URL gives ``default`` (or NULL)."""
    scheme, authority = url_scheme(url), url_authority(url)
    return F.when(
        (scheme != "") & (authority != ""), F.concat(scheme, F.lit("://"), authority)
    ).otherwise(F.lit(default))


def query_values(url: Column, name: str) -> Column:
    """Non-blank, still encoded values of a query parameter, in order."""
    return F.regexp_extract_all(url_query(url), F.lit(f"(?:^|&){name}=([^&]+)"), F.lit(1))


def _decode(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), F.replace(value, F.lit("+"), F.lit(" ")))


def query_param(url: Column, name: str) -> Column:
    """First non-blank value of a query parameter, decoded; NULL when there is none."""
    return _decode(F.get(query_values(url, name), F.lit(0)))


def has_single_param(url: Column, name: str, value: Column) -> Column:
    """The parameter occurs exactly once and equals ``value``."""
    found = query_values(url, name)
    return F.coalesce(
        (F.size(found) == 1) & (_decode(F.get(found, F.lit(0))) == value), F.lit(False)
    )


def path_parts(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda part: part != "")


def path_ends_with(url: Column, suffix: str) -> Column:
    return F.endswith(F.regexp_replace(url_path(url), "/+$", ""), F.lit(suffix))


def strip_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def append_route(base: Column, route: Column) -> Column:
    return F.concat(strip_trailing_slash(base), route)


def host_file_name(url: Column) -> Column:
    return F.replace(url_authority(url), F.lit(":"), F.lit("_"))


# The parts scheme, authority, path, query and fragment, one per line; line breaks are gone
# from the text before.
_PARTS = r"""split(regexp_replace(
    regexp_replace({url}, r'^[\x00-\x20]+|[\t\r\n]', ''),
    r'(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$',
    '$1\n$2\n$3\n$4\n$5'), '\n')"""


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as found on the page ``base`` (RFC 3986 reference join)."""
    relative = ", ".join(f"'{s}'" for s in ["", *RELATIVE_SCHEMES])
    return let(
        {"base": base, "href": href},
        [
            ("u", {"b": _PARTS.format(url="v.base"), "h": _PARTS.format(url="v.href")}),
            ("s", {
                "base": "lower(u.b[0])",
                "scheme": "lower(if(u.h[0] <> '', u.h[0], u.b[0]))",
                # a relative path continues the folder of the base path
                "path": """if(startswith(u.h[2], '/'), u.h[2], regexp_replace(concat(
                    coalesce(nullif(regexp_replace(u.b[2], '[^/]*$', ''), ''), '/'), u.h[2]),
                    '/{2,}', '/'))""",
            }),
            # dot segments are folded away where there are any
            ("d", {"path": r"""if(s.path RLIKE r'(^|/)\.\.?(/|$)', array_join(concat(
                aggregate(split(s.path, '/'), cast(array() AS array<string>), (kept, part) ->
                    CASE WHEN part = '..' THEN slice(kept, 1, greatest(size(kept) - 1, 0))
                         WHEN part = '.' THEN kept ELSE concat(kept, array(part)) END),
                if(s.path RLIKE r'(^|/)\.\.?$', array(''), cast(array() AS array<string>))),
                '/'), s.path)"""}),
            ("r", {
                "authority": "if(u.h[1] <> '', u.h[1], u.b[1])",
                "path": """CASE WHEN u.h[1] <> '' THEN u.h[2] WHEN u.h[2] = '' THEN u.b[2]
                    ELSE coalesce(nullif(d.path, ''), '/') END""",
                "query": "if(u.h[1] = '' AND u.h[2] = '' AND u.h[3] = '', u.b[3], u.h[3])",
            }),
        ],
        f"""CASE WHEN v.base = '' THEN v.href WHEN v.href = '' THEN v.base
            WHEN s.scheme <> s.base OR s.scheme NOT IN ({relative}) THEN v.href
            ELSE concat(
                if(s.scheme <> '', concat(s.scheme, ':'), ''),
                if(r.authority <> '', concat('//', r.authority), ''),
                if(r.authority <> '' AND r.path <> '' AND NOT startswith(r.path, '/'), '/', ''),
                r.path,
                if(r.query <> '', concat('?', r.query), ''),
                if(u.h[4] <> '', concat('#', u.h[4]), '')) END""",
    )
