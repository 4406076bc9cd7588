"""Operators on item tables: distinct, top-N, merging, paging and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syndica.schemas import ITEM_COLUMNS
from syndica.session import materialize

LISTING_ORDER = ["page_seq", "pos"]


def listing_order(items: DataFrame) -> list[str]:
    """Listing order of a table: captures of one page follow each other by ``page_id``."""
    return [*LISTING_ORDER, *[c for c in ("page_id",) if c in items.columns]]


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key.

    An aggregate, not a window: each map task already reduces a key to one row, so the
    copies of a hot key never meet in one task.
    """
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key."""
    return _keep(df, keys, order, F.max_by)


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_kept"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c)
                         for c in df.columns])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int,
          rank: str | None = None, spread: int = 64) -> DataFrame:
    """First ``n`` rows of each key (W2); ``n <= 0`` gives none.

    Two steps: first within (key, slice of tasks), then within the key. Spark limits groups
    before each shuffle, so a task sends at most ``n`` rows of a key, and the last step sees
    at most ``n * spread``.
    """
    if n <= 0:
        df = df.limit(0)
        return df.withColumn(rank, F.lit(0)) if rank else df
    columns = df.columns
    sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(spread)))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    first = (
        sliced.withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= n)
        .select(*columns)
    )
    name = rank or "_rank"
    best = first.withColumn(name, F.row_number().over(overall)).filter(F.col(name) <= n)
    return best if rank else best.select(*columns)


def newest_first(*ties: str) -> list[Column]:
    """Time descending, missing times last, ties in merge order (O1)."""
    return [F.col("published_at").desc_nulls_last(), *[F.col(t).asc() for t in ties]]


def order_items(items: DataFrame, *ties: str) -> DataFrame:
    return items.orderBy(*newest_first(*ties))


def finish_items(extracted: DataFrame, max_items: int | None) -> DataFrame:
    """Keep-first, then limit, within each landed page: the order every dialect uses.

    Filtered rows must be gone already, as they may not claim a key. Groups are pages, so
    after an extraction that is partitioned by page neither step shuffles.
    """
    firsts = keep_first(extracted, ["page_id", "guid"], ["pos"])
    if max_items is not None:
        rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
        firsts = firsts.withColumn("_rank", rank).filter(F.col("_rank") <= max_items)
    return firsts.select(*ITEM_COLUMNS)


def merge_feeds(items: DataFrame, members: DataFrame, max_items: int | None = None) -> DataFrame:
    """Union of member feeds, keep-first by guid, newest first, optionally capped.

    ``members(aggregate_key, child_key, child_ord)``. The result's ``feed_key`` is the
    aggregate; ``child_ord, page_seq, pos`` stay as the merge order for ties.
    """
    joined = items.withColumnRenamed("feed_key", "child_key").join(
        members, "child_key"
    ).drop("child_key").withColumnRenamed("aggregate_key", "feed_key")
    ties = ["child_ord", *listing_order(items)]
    merged = keep_first(joined, ["feed_key", "guid"], ties)
    if max_items is None:
        return merged
    return top_n(merged, ["feed_key"], newest_first(*ties, "guid"), max_items)


def members_by_route(sources: DataFrame, prefixes: dict[str, str],
                     critical_keys: list[str] | None = None) -> DataFrame:
    """Members of each aggregate: the sources below a route prefix, in route order.

    ``child_ord`` is the route itself, which sorts as wanted and needs no numbering. With
    ``critical_keys`` (which may be empty) the order is that of a static build instead: critical
    sources first, then catalogue order; the copy of a guid that comes first is kept.
    """
    order = F.col("route")
    if critical_keys is not None:
        order = F.concat(
            F.when(F.col("key").isin(critical_keys), "0").otherwise("1"),
            F.lpad(F.col("source_ord").cast("string"), 20, "0"),
        )
    branches = [
        sources.filter(F.startswith("route", F.lit(prefix))).select(
            F.lit(aggregate).alias("aggregate_key"),
            F.col("key").alias("child_key"),
            order.alias("child_ord"),
        )
        for aggregate, prefix in prefixes.items()
    ]
    out = sources.limit(0).select(
        F.lit("").alias("aggregate_key"), F.col("key").alias("child_key"), order.alias("child_ord"))
    for branch in branches:
        out = out.unionByName(branch)
    return out


def new_items(items: DataFrame, published: DataFrame, keys: list[str] | None = None,
              published_once: bool = False) -> DataFrame:
    """Items whose key is not published yet (J5, U5), first occurrence only.

    Both sides are reduced to one row per key before the anti join, so that copies of a key
    cannot pile up in one task; ``published_once`` says that the history has no copies.
    """
    keys = keys or ["feed_key", "guid"]
    firsts = keep_first(items, keys, listing_order(items))
    known = published.select(*keys)
    return firsts.join(known if published_once else known.distinct(), keys, "left_anti")


def page_cutoff(items: DataFrame, empty_pages: Column | int | None,
                max_pages: Column | int | None = None) -> DataFrame:
    """Items up to the point where a paged listing stops giving unseen keys.

    Reading stops once ``empty_pages`` pages in a row add no new key, or after ``max_pages``.
    Both may be columns with one value per feed: NULL ``empty_pages`` reads all pages (0 counts
    as 1), NULL or 0 ``max_pages`` sets no bound. Each item appears once, on its first page;
    items whose page has no positive number stand before page 1 and are always read. Pages
    without items count as empty; ``missing_pages`` tells those that never landed.

    A page is the last one read when it brings something new (or is the start, page 0) and
    none of the next ``empty_pages`` pages does. That is an anti join on (feed, page) and a
    minimum per feed: no window over all pages of a feed.
    """
    firsts = materialize(_first_pages(items, empty_pages, max_pages), "first-seen")
    read = firsts.join(_last_pages(firsts), "feed_key").filter(
        F.col("_rule").isNull() | (F.col("_page") <= F.col("_last_page"))
    )
    return read.select(*items.columns)


def _first_pages(items: DataFrame, empty_pages: Column | int | None,
                 max_pages: Column | int | None) -> DataFrame:
    """Each item on its first page, with that page's number and the feed's rule."""
    rule, most = (v if isinstance(v, Column) else F.lit(v) for v in (empty_pages, max_pages))
    numbered = items.select(
        *items.columns,
        F.greatest(F.coalesce("page_seq", F.lit(0)), F.lit(0)).cast("int").alias("_page"),
        F.greatest(rule.cast("int"), F.when(rule.isNotNull(), 1)).alias("_rule"),
        F.nullif(most.cast("int"), F.lit(0)).alias("_most"),
    ).filter("_most IS NULL OR _page <= _most")
    return keep_first(numbered.drop("_most"), ["feed_key", "guid"], ["_page", *listing_order(items)])


def _last_pages(firsts: DataFrame) -> DataFrame:
    """The last page with something new that is read, per feed."""
    fresh = firsts.select("feed_key", F.col("_page").alias("page"), "_rule").distinct()
    begin = fresh.select("feed_key", F.lit(0).alias("page"), "_rule").distinct()
    followed = fresh.filter("_rule IS NOT NULL").select(
        "feed_key", F.explode(F.sequence(F.col("page") - F.col("_rule"), F.col("page") - 1)).alias("page")
    ).distinct()
    return (
        fresh.unionByName(begin)
        .join(followed, ["feed_key", "page"], "left_anti")
        .groupBy("feed_key")
        .agg(F.min("page").alias("_last_page"))
    )


def missing_pages(items: DataFrame, landed: DataFrame, empty_pages: Column | int | None,
                  max_pages: Column | int | None = None) -> DataFrame:
    """Feeds whose reading met a page that never landed: ``(feed_key, page_seq)``, the first one.

    ``landed(feed_key, page_seq)`` holds every page that was fetched, also those without items.
    A page counts as met if reading would not have stopped before it and a later one landed.
    """
    firsts = materialize(_first_pages(items, empty_pages, max_pages), "first-seen")
    pages = landed.filter("page_seq >= 1").select("feed_key", "page_seq").distinct()
    after = pages.select("feed_key", (F.col("page_seq") + 1).alias("page_seq"))
    ends = pages.groupBy("feed_key").agg(F.max("page_seq").alias("_end"))
    starts = pages.select("feed_key", F.lit(1).alias("page_seq")).distinct()
    gaps = after.unionByName(starts).join(pages, ["feed_key", "page_seq"], "left_anti").join(
        ends, "feed_key").filter("page_seq < _end")
    rules = firsts.groupBy("feed_key").agg(F.max("_rule").alias("_rule")).join(_last_pages(firsts), "feed_key")
    return gaps.join(rules, "feed_key").filter(
        "_rule IS NULL OR page_seq <= _last_page + _rule"
    ).groupBy("feed_key").agg(F.min("page_seq").alias("page_seq"))


def left_biased(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose key ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def serve_aliases(feeds: DataFrame, routes: DataFrame) -> DataFrame:
    """One row per (route, feed): a feed may be served under several routes."""
    return feeds.join(routes, "feed_key")


def feed_counts(items: DataFrame) -> DataFrame:
    """Items per feed (A3)."""
    return items.groupBy("feed_key").agg(F.count(F.lit(1)).alias("n_items"))


def non_empty_feeds(items: DataFrame) -> DataFrame:
    """Counts of the feeds that gave anything: an empty extraction is a failure."""
    return feed_counts(items).filter(F.col("n_items") > 0)


def failed_sources(sources: DataFrame, items: DataFrame, errors: DataFrame | None = None
                   ) -> DataFrame:
    """Sources without items, with the recorded error type or ``EmptyListing``."""
    failed = sources.select(F.col("key").alias("feed_key"), "source_ord").join(
        items.select("feed_key").distinct(), "feed_key", "left_anti"
    )
    if errors is None:
        return failed.withColumn("error_type", F.lit("EmptyListing"))
    latest = errors.groupBy("feed_key").agg(F.max_by("error_type", "at").alias("error_type"))
    return failed.join(latest, "feed_key", "left").withColumn(
        "error_type", F.coalesce("error_type", F.lit("EmptyListing"))
    )


def retry_outcome(attempts: DataFrame, critical_keys: list[str] | None = None,
                  critical_tries: int = 5, default_tries: int = 3) -> DataFrame:
    """Outcome per source of its first few attempts.

    ``attempts(feed_key, attempt, ok, body, error_type)``; sources named critical get more. An
    attempt that is logged twice counts once: a success before a failure, of several successes
    the body with the least hash.
    """
    allowed = F.when(
        F.col("feed_key").isin(critical_keys or []), F.lit(critical_tries)
    ).otherwise(F.lit(default_tries))
    good = F.col("ok")
    outcome = (
        attempts.filter(F.col("attempt") <= allowed)
        .groupBy("feed_key")
        .agg(
            F.bool_or("ok").alias("ok"),
            F.min(F.when(good, F.struct("attempt", F.xxhash64("body").alias("hash")))).alias("_won"),
            F.max("attempt").alias("_last"),
            F.max(F.when(~good, F.struct("attempt", "error_type"))).alias("_error"),
        )
    )
    bodies = attempts.filter("ok").select(
        F.col("feed_key").alias("_feed"), F.struct("attempt", F.xxhash64("body").alias("hash")).alias("_own"), "body")
    won = (F.col("feed_key") == F.col("_feed")) & (F.col("_won") == F.col("_own"))
    return outcome.join(bodies, won, "left").dropDuplicates(["feed_key"]).select(
        "feed_key", "ok", F.coalesce("_won.attempt", "_last").alias("attempts_used"), "body",
        F.when(~F.col("ok"), F.col("_error.error_type")).alias("last_error"),
    )
