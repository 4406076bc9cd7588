"""Per-host operators: grouping, crawl slots, spacing audit and page enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.functions.urls import host_file_name, url_host
from syndica.operators.items import keep_last
from syndica.operators.ranges import ordinals, previous, running_sum
from syndica.session import join_measured

# Lowest request spacing of one host, in seconds.
MIN_INTERVAL_S = 10


def with_host(df: DataFrame, url: str = "source_url") -> DataFrame:
    return df.withColumn("host", url_host(F.col(url)))


def sources_per_host(sources: DataFrame, url: str = "source_url") -> DataFrame:
    """How many sources share each host."""
    return with_host(sources, url).groupBy("host").agg(F.count(F.lit(1)).alias("n_sources"))


def host_groups(sources: DataFrame, url: str = "source_url") -> DataFrame:
    """Every source with its host and the size of the host's group.

    Rows, not one list per host: a host may own any share of the sources.
    """
    return with_host(sources, url).join(sources_per_host(sources, url), "host")


def is_critical(key: Column, critical_keys: list[str]) -> Column:
    return key.isin(critical_keys)


def critical_first(critical: Column, *ties: str) -> list[Column]:
    """Stable two-class priority order (O3)."""
    return [F.when(critical, 0).otherwise(1).asc(), *[F.col(t).asc() for t in ties]]


def crawl_slots(sources: DataFrame, critical: Column, interval_s: int = MIN_INTERVAL_S
                ) -> DataFrame:
    """Start offset of each source when a host serves one request per interval.

    Every source takes one request; ``crawl_schedule`` gives those with several their room.
    """
    placed = with_host(sources).withColumn("critical", critical)
    ranked = ordinals(
        placed, ["host"], critical_first(F.col("critical"), "source_ord"), "slot"
    )
    return ranked.withColumn("offset_s", (F.col("slot") - 1) * interval_s)


def request_budget(pages: Column, tries: Column) -> Column:
    """Requests that a source may take: every page of its listing, each as often as it may be tried (F16)."""
    return F.greatest(F.coalesce(pages, F.lit(1)), F.lit(1)) * F.greatest(F.coalesce(tries, F.lit(1)), F.lit(1))


def crawl_schedule(sources: DataFrame, critical: Column, requests: Column, interval_s: int = MIN_INTERVAL_S
                   ) -> DataFrame:
    """When each source may start and must be done, if a host serves one request per interval.

    A source holds its host for ``requests`` slots, so those after it start that much later:
    ``first_slot`` counts the requests that the host serves before, ``offset_s`` to ``end_s`` is the
    source's own time. A host with very many sources is no single task.
    """
    placed = with_host(sources).withColumns({
        "critical": critical, "requests": F.greatest(F.coalesce(requests, F.lit(1)), F.lit(1)).cast("bigint")})
    summed = running_sum(
        placed, ["host"], critical_first(F.col("critical"), "source_ord"), F.col("requests"), "first_slot")
    return summed.withColumns({
        "offset_s": F.col("first_slot") * interval_s,
        "end_s": (F.col("first_slot") + F.col("requests")) * interval_s})


def request_spacing(fetch_log: DataFrame, min_interval_s: int = MIN_INTERVAL_S,
                    ties: tuple[str, ...] = ("url",)) -> DataFrame:
    """Gap to the previous request of the same host, flagged when too short.

    Failed requests count as well.
    """
    order = [F.col("at").asc(), *[F.col(t).asc() for t in ties]]
    paired = previous(fetch_log, ["host"], order, "at", "previous_at")
    gap = (F.unix_micros("at") - F.unix_micros("previous_at")) / F.lit(1_000_000)
    return paired.withColumn("gap_s", gap).withColumn(
        "too_close", F.coalesce(F.col("gap_s") < min_interval_s, F.lit(False))
    )


def enumerate_pages(sources: DataFrame, template: str = "source_url",
                    *, limit: Column | int) -> DataFrame:
    """Page URLs ``1..limit`` of a template holding ``{page}``.

    Where no limit is meant (NULL, 0 or less) there is nothing to enumerate to, and the query
    fails instead of giving no page; bound such sources by what is known of them.
    """
    limit = (F.lit(limit) if isinstance(limit, int) else limit).cast("int")
    bounded = F.when(limit > 0, limit).otherwise(
        F.raise_error(F.lit("enumerate_pages: a source has no page limit")).cast("int"))
    numbered = sources.withColumn("_limit", bounded)
    return (
        numbered.withColumn("page_seq", F.explode(F.sequence(F.lit(1), F.col("_limit"))))
        .withColumn(
            "page_url",
            F.replace(F.col(template), F.lit("{page}"), F.col("page_seq").cast("string")),
        )
        .drop("_limit")
    )


def last_page_per_host(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """The page kept in a per-host cache: the last one landed (K8).

    The winners are found on narrow rows; page bodies are read only to pick those pages, and
    are neither sorted nor aggregated.
    """
    narrow = pages.select(
        host_file_name(F.col("url")).alias("host"), F.col(order).alias("_order"), "page_id"
    )
    winners = keep_last(narrow, ["host"], ["_order", "page_id"]).select("host", "page_id")
    return join_measured(pages, winners, "page_id")
