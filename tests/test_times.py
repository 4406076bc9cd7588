from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from syndica.functions import strings, times


def _utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def _epochs(spark, column, values, schema="v string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r[0] for r in df.select(F.unix_micros(column)).collect()]


def _micros(moment):
    return None if moment is None else round(moment.timestamp() * 1_000_000)


def test_feed_ts_rfc2822(spark):
    samples = [
        "Mon, 15 Jul 2025 08:30:00 +0000", "Tue, 1 Jul 2025 08:30:00 GMT", "15 Jul 2025 08:30 +0800",
        "Wed, 02 Oct 02 13:00:00 EST", "15 Jul 99 01:02:03 PDT", "Jul 15 2025 08:30:00 -0330",
        "Sunday, 06-Nov-94 08:49:37 GMT", "Fri,  21 Nov 1997 09:55:06 -0600", "15 July 2025 08:30:00 UT",
        "15 Jul 2025 08:30:00 +0800 (CST)",
    ]
    got = _epochs(spark, times.feed_ts(F.col("v")), samples)
    assert got == [_micros(parsedate_to_datetime(s)) for s in samples]


def test_feed_ts_iso_and_invalid(spark):
    samples = {
        "2025-07-15T08:30:00Z": _utc(2025, 7, 15, 8, 30), "2025-07-15 08:30": _utc(2025, 7, 15, 8, 30),
        "2025-07-15": _utc(2025, 7, 15), "2025-07-15T08:30:00.250+08:00": _utc(2025, 7, 15, 0, 30, 0, 250000),
        "20250715T083000-0130": _utc(2025, 7, 15, 10, 0), "2025-02-30": None, "soon": None, "": None,
        "32 Jul 2025 08:30:00 GMT": None, "15 Foo 2025 08:30:00 GMT": None,
        "2024-01-01T00:00:00.123456789Z": _utc(2024, 1, 1, 0, 0, 0, 123456),
    }
    got = _epochs(spark, times.feed_ts(F.col("v")), list(samples))
    assert got == [_micros(v) for v in samples.values()]


def test_epoch_and_pinned_time(spark):
    rows = [
        ("1710000000s", ""), ("", "置顶主题：2026-07-10 12:00:00"), (None, "置顶主题：2026-07-10 12:00:00"),
        ("99999999999999999999", "置顶主题：2026-07-10 12:00:00"), ("x", "2026-07-10 12:00:00"),
        ("9999999999999", None), ("-5", "置顶主题：2026-02-30 12:00:00"),
    ]
    got = _epochs(spark, times.epoch_ts(F.col("s"), F.col("t")), rows, "s string, t string")
    pinned = _micros(_utc(2026, 7, 10, 4))
    assert got == [1710000000 * 10**6, pinned, pinned, None, None, None, None]


def test_civil_and_embedded_dates(spark):
    got = _epochs(spark, times.civil_date_utc(F.col("v")), ["2026-7-11", "2026-13-1", "x 2026-7-11", "2026-02-30"])
    assert got == [_micros(_utc(2026, 7, 10, 16)), None, None, None]
    got = _epochs(spark, times.embedded_date(F.col("v")),
                  ["Published 2026-08-13.", "2026-99-99 then 2026-01-01", "none"])
    assert got == [_micros(_utc(2026, 8, 12, 16)), None, None]


def test_text_helpers(spark):
    row = spark.createDataFrame([("　 a ",)], "v string").select(
        strings.trim_space(F.col("v")),
        strings.has_media_count(F.lit("x [36P]")), strings.has_media_count(F.lit("［22p + 1V］")),
        strings.has_media_count(F.lit("[22P,3V-214MB]")), strings.has_media_count(F.lit("[3v]")),
        strings.block_name(F.lit("≡ new items ≡")), strings.block_name(F.lit("plain")),
        strings.first_non_empty(F.lit(""), F.lit(None).cast("string"), F.lit("b")),
        strings.local_name(F.lit("{urn:x}item")), strings.is_blank(F.lit(" \n　")),
    ).first()
    assert tuple(row) == ("a", True, True, False, True, "new items", None, "b", "item", True)
    names = spark.range(1).select(strings.names_by_key(["19", "21", "33"], F.lit("one; two"))).first()[0]
    assert names == {"19": "one", "21": "two"}


def test_formats(spark):
    row = spark.range(1).select(
        times.rfc2822(F.expr("timestamp'2026-08-22 17:19:19'")),
        times.max_age(F.lit(True), 600, 60), times.max_age(F.lit(False), 600, 60),
        times.drop_sentinel_year(F.expr("timestamp'1970-06-01'")),
    ).first()
    assert tuple(row) == ("Sat, 22 Aug 2026 17:19:19 +0000", 60, 600, None)
