"""Time expressions (C22-C29). Every result is an instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from syndica.functions.bind import let

# Zone of the civil times that listings print, and their formats.
SITE_ZONE = "Asia/Shanghai"
PINNED_PREFIX = "置顶主题："
_PINNED = r"(?U)^置顶主题：(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})$"
DATE_TEXT = r"\d{4}-\d{1,2}-\d{1,2}"

# Month and zone names of RFC 2822 dates; zone offsets are in hours.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ZONES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4,
    "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

# 9999-12-31 23:59:59, the last representable second.
_MAX_EPOCH = 253402300799


def _int(sql: str) -> str:
    """Digits as a number. A cast that fails costs an exception, so empty text is kept away."""
    return f"try_cast(nullif({sql}, '') AS int)"


def epoch_ts(stamp: Column, title: Column, zone: str = SITE_ZONE) -> Column:
    """Leading digits as epoch seconds; only without any, the pinned civil time in ``title``."""
    civil = ", ".join(_int(f"t.part[{i}]") for i in range(6))
    return let(
        {"stamp": stamp, "title": title},
        [("t", {
            "digits": r"regexp_extract(coalesce(v.stamp, ''), r'^0*(\d+)', 1)",
            "part": f"""if(v.title RLIKE r'{_PINNED}', split(regexp_replace(v.title, r'{_PINNED}',
                '$1\\n$2\\n$3\\n$4\\n$5\\n$6'), '\\n'), NULL)""",
        })],
        f"""CASE WHEN t.digits = '' THEN try_make_timestamp({civil}, '{zone}')
            WHEN length(t.digits) <= 18 AND cast(left(t.digits, 18) AS bigint) <= {_MAX_EPOCH}
            THEN timestamp_seconds(cast(left(t.digits, 18) AS bigint)) END""",
    )


def embedded_date(text: Column, zone: str = SITE_ZONE) -> Column:
    """First date inside a text as midnight of the site zone; an invalid one gives NULL."""
    day = ", ".join(_int(f"t.part[{i}]") for i in range(3))
    return let(
        {"text": text},
        [("t", {"part": f"split(regexp_substr(v.text, r'{DATE_TEXT}'), '-')"})],
        f"try_make_timestamp({day}, 0, 0, 0, '{zone}')",
    )


def is_plain_date(text: Column) -> Column:
    return text.rlike(f"^{DATE_TEXT}$")


def civil_date_utc(text: Column, zone: str = SITE_ZONE) -> Column:
    """``Y-m-d`` (padding optional) as midnight of the site zone."""
    return F.when(is_plain_date(text), embedded_date(text, zone))


def first_embedded_date(*texts: Column, zone: str = SITE_ZONE) -> Column:
    return F.coalesce(*[embedded_date(t, zone) for t in texts])


# Shapes of feed dates; each is cut into lines of day, month, year, hour, minute, second, zone.
_WEEKDAY = r"(?i)^(?:[a-z]+, ?|(?:mon|tue|wed|thu|fri|sat|sun) )?"
_CLOCK = r" (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?: (\S+).*)?$"
_SHAPES = [
    (r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2}(?:[.,]\d{1,6})?)\d*)?)?"
     r"(Z|[+\-]\d{2}:?\d{2}(?::?\d{2})?)?)?$", (3, 2, 1, 4, 5, 6, 7)),
    (_WEEKDAY + r"(\d{1,2})[ \-]([a-z]{3,9})[ \-](\d{2,4})" + _CLOCK, (1, 2, 3, 4, 5, 6, 7)),
    (_WEEKDAY + r"([a-z]{3,9}) (\d{1,2}),? (\d{2,4})" + _CLOCK, (2, 1, 3, 4, 5, 6, 7)),
]


def feed_ts(raw: Column) -> Column:
    """Time of a feed entry: RFC 2822 (weekday ignored) or ISO 8601; zoneless means UTC.

    A text matches one shape at most; the cheapest to refuse is tried first.
    """
    cut = "\n".join(
        f"WHEN t.text RLIKE r'{pattern}' THEN split(regexp_replace(t.text, r'{pattern}', "
        f"'{lines}'), '\\n')"
        for pattern, groups in _SHAPES
        for lines in [r"\n".join(f"${g}" for g in groups)]
    )
    months = ", ".join(f"'{m}'" for m in MONTHS)
    zones = ", ".join(f"'{z}', {hours}" for z, hours in ZONES.items())
    shift = r"^([+\-])(\d{1,2}):?(\d{2})?:?(\d{2})?$"
    units = " + ".join(
        f"coalesce({_int(f"regexp_extract(n.zone, r'{shift}', {i})")}, 0) * {seconds}"
        for i, seconds in ((2, 3600), (3, 60), (4, 1))
    )
    return let(
        {"raw": raw},
        [
            ("t", {"text": r"trim(regexp_replace(v.raw, r'\s+', ' '))"}),
            ("p", {"part": f"CASE {cut} END"}),
            ("n", {
                "year": _int("p.part[2]"),
                "month": f"""coalesce(
                    nullif(array_position(array({months}), lower(left(p.part[1], 3))), 0),
                    if(p.part[1] RLIKE '^[0-9]', {_int("p.part[1]")}, NULL))""",
                "day": _int("p.part[0]"),
                "hour": f"coalesce({_int('p.part[3]')}, 0)",
                "minute": f"coalesce({_int('p.part[4]')}, 0)",
                "second": """coalesce(
                    try_cast(nullif(replace(p.part[5], ',', '.'), '') AS decimal(8, 6)), 0)""",
                "zone": "upper(coalesce(p.part[6], ''))",
            }),
            ("z", {"shift": f"""if(n.zone = '', 0, coalesce(
                try_element_at(map({zones}), n.zone) * 3600,
                ({units}) * if(startswith(n.zone, '-'), -1, 1)))"""}),
        ],
        """try_make_timestamp(
                CASE WHEN n.year >= 100 THEN n.year WHEN n.year > 68 THEN n.year + 1900
                     ELSE n.year + 2000 END,
                cast(n.month AS int), n.day, n.hour, n.minute, n.second, 'UTC')
            - make_dt_interval(0, 0, 0, z.shift)""",
    )


def drop_sentinel_year(ts: Column, year: int = 1970) -> Column:
    """NULL for the placeholder year that stands for an unset time."""
    return let({"ts": ts}, [], f"if(year(v.ts) <> {year}, v.ts, NULL)")


def rfc2822(ts: Column) -> Column:
    """RFC 2822 text in the session zone (UTC gives ``+0000``)."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    zero = F.lit(0)
    return ts + F.make_dt_interval(zero, zero, zero, seconds)


def max_age(is_stale: Column, ttl_s: int, retry_s: int) -> Column:
    """Seconds a client may keep a document: short while the feed is stale."""
    return F.when(is_stale, F.lit(retry_s)).otherwise(F.lit(ttl_s))
