"""Feed state from refresh logs: fresh, stale, due or unavailable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.functions.times import max_age, plus_seconds
from syndica.operators.ranges import running_max

# Cache lifetime and failure back-off, in seconds.
TTL_S = 600
RETRY_S = 60


def _ok_at() -> Column:
    return F.when(F.col("ok"), F.col("at"))


def _fail_at() -> Column:
    return F.when(~F.col("ok"), F.col("at"))


def classify(now: Column, last_ok: Column, last_fail: Column, ttl_s: int = TTL_S,
             retry_s: int = RETRY_S) -> Column:
    """State of a feed at ``now``.

    A success ends the back-off of earlier failures. All limits are exclusive.
    """
    fresh = last_ok.isNotNull() & (now < plus_seconds(last_ok, ttl_s))
    counts = last_fail.isNotNull() & (last_ok.isNull() | (last_fail > last_ok))
    delayed = counts & (now < plus_seconds(last_fail, retry_s))
    return (
        F.when(fresh, "fresh")
        .when(delayed & last_ok.isNotNull(), "stale")
        .when(delayed, "unavailable")
        .otherwise("due")
    )


def feed_state_at(log: DataFrame, now: Column, ttl_s: int = TTL_S, retry_s: int = RETRY_S
                  ) -> DataFrame:
    """State of every feed at one moment: two maxima per feed, then the rule."""
    seen = log.filter(F.col("at") <= now).groupBy("feed_key").agg(
        F.max(_ok_at()).alias("last_ok"), F.max(_fail_at()).alias("last_fail")
    )
    return seen.withColumn(
        "state", classify(now, F.col("last_ok"), F.col("last_fail"), ttl_s, retry_s)
    )


def feed_state_asof(log: DataFrame, requests: DataFrame, ttl_s: int = TTL_S,
                    retry_s: int = RETRY_S) -> DataFrame:
    """State of the requested feed at each request ``(request_id, feed_key, at)``.

    An as-of join written as a union and running maxima over ordered ranges.
    """
    no = F.lit(None)
    events = log.select(
        "feed_key", "at", "ok", F.lit(0).alias("_kind"), no.cast("bigint").alias("request_id")
    )
    asked = requests.select(
        "feed_key", "at", no.cast("boolean").alias("ok"), F.lit(1).alias("_kind"), "request_id"
    )
    order = [F.col("at").asc(), F.col("_kind").asc(), F.col("request_id").asc()]
    carried = running_max(
        events.unionByName(asked), ["feed_key"], order,
        {"last_ok": _ok_at(), "last_fail": _fail_at()},
    ).filter(F.col("_kind") == 1)
    return carried.select(
        "request_id", "feed_key", "at", "last_ok", "last_fail",
        classify(F.col("at"), F.col("last_ok"), F.col("last_fail"), ttl_s, retry_s).alias("state"),
    )


def content_asof(results: DataFrame, requests: DataFrame, sequence: str, content: str = "content",
                 ttl_s: int = TTL_S, retry_s: int = RETRY_S) -> DataFrame:
    """What each request ``(request_id, feed_key, at)`` is served: the last good content and its state.

    ``results(feed_key, at, ok, <sequence>, <content>)``; of several at one instant the highest
    sequence counts. What is carried over range borders is the time and sequence of a result; its
    content is fetched for results that are served, and for no other.
    """
    no = F.lit(None)
    told = results.select("feed_key", "at", "ok", F.col(sequence).cast("bigint").alias("_seq"),
                          F.lit(0).alias("_kind"), no.cast("bigint").alias("request_id"))
    asked = requests.select("feed_key", "at", no.cast("boolean").alias("ok"), no.cast("bigint").alias("_seq"),
                            F.lit(1).alias("_kind"), "request_id")
    order = [F.col(c).asc() for c in ("at", "_kind", "_seq", "request_id")]
    carried = running_max(told.unionByName(asked), ["feed_key"], order, {
        "_good": F.when(F.col("ok"), F.struct("at", "_seq")), "last_fail": _fail_at(),
    }).filter(F.col("_kind") == 1)
    served = carried.select("request_id", "feed_key", "at", F.col("_good.at").alias("generated_at"),
                            F.col("_good._seq").alias("_seq"), "last_fail")
    good = results.filter("ok").select(
        F.col("feed_key").alias("_feed"), F.col("at").alias("_at"), F.col(sequence).alias("_own"), content)
    same = (F.col("feed_key") == F.col("_feed")) & (F.col("generated_at") == F.col("_at")) & (F.col("_seq") == F.col("_own"))
    return served.join(good, same, "left").select(
        "request_id", "feed_key", "at", content, "generated_at",
        classify(F.col("at"), F.col("generated_at"), F.col("last_fail"), ttl_s, retry_s).alias("state"),
    )


def last_good(results: DataFrame, content: str = "content", sequence: str | None = None) -> DataFrame:
    """Last successful content per feed with its own time, stale after a later failure (T4).

    The winning result is found on narrow rows; content is joined to it and neither sorted nor
    aggregated. Of several successes at one instant the highest ``sequence`` counts, without one the
    content with the greatest hash; one row per feed in any case.
    """
    rank = F.col(sequence) if sequence else F.xxhash64(content)
    times = (
        results.groupBy("feed_key")
        .agg(F.max(F.when(F.col("ok"), F.struct(F.col("at"), rank.alias("rank")))).alias("_won"),
             F.max(_fail_at()).alias("_fail"))
        .filter(F.col("_won").isNotNull())
        .select("feed_key", F.col("_won.at").alias("generated_at"), F.col("_won.rank").alias("_rank"), "_fail")
    )
    good = results.filter("ok").select(
        F.col("feed_key").alias("_feed"), F.col("at").alias("_at"), rank.alias("_own"), content)
    same = (F.col("feed_key") == F.col("_feed")) & (F.col("generated_at") == F.col("_at")) & (
        F.col("_rank").eqNullSafe(F.col("_own")))
    return times.join(good, same).dropDuplicates(["feed_key"]).select(
        "feed_key", content, "generated_at",
        F.coalesce(F.col("_fail") > F.col("generated_at"), F.lit(False)).alias("is_stale"),
    )


def with_max_age(published: DataFrame, ttl_s: int = TTL_S, retry_s: int = RETRY_S) -> DataFrame:
    return published.withColumn("max_age_s", max_age(F.col("is_stale"), ttl_s, retry_s))


def aggregate_state(members: DataFrame, child_state: DataFrame) -> DataFrame:
    """Stale flag and availability of aggregates.

    ``child_state(feed_key, available, is_stale)``; an aggregate is unavailable only when
    none of its children is available, and stale when any available child is.
    """
    joined = members.join(
        child_state.withColumnRenamed("feed_key", "child_key"), "child_key", "left"
    )
    up = F.coalesce(F.col("available"), F.lit(False))
    return joined.groupBy("aggregate_key").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.count_if(up).alias("n_available"),
        F.bool_or(up).alias("available"),
        F.coalesce(F.bool_or(F.when(up, F.col("is_stale"))), F.lit(False)).alias("is_stale"),
    )
