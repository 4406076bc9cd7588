"""Changes of feed state as events: one row whenever a feed becomes fresh, stale, unavailable or due.

Results wait in the state of their feed until the watermark has passed them, so that they are
applied in the order of their times whatever the order they arrive in. Between them a timer stands
for the next moment at which the feed's state ends by itself: the end of its lifetime after
a success or of its back-off after a failure.

Before the shuffle, results that cannot change anything are dropped inside each Arrow batch: of
successes that follow each other within a lifetime only some need stay, and likewise failures within
the back-off. So a feed that owns most of the stream sends few rows to the task with its state.

Rows whose ``ok`` is NULL are ticks of the clock: they only move the watermark, which a silent
log would leave where it is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from syndica.operators.freshness import RETRY_S, TTL_S
from syndica.session import ship_package

TRANSITIONS = "feed_key string, at timestamp, state string, previous string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_SECOND = 1_000_000


def state_at(now: int, last_ok: int | None, last_fail: int | None, ttl: int, retry: int) -> str:
    """The rule of ``freshness.classify`` for one feed, in microseconds."""
    if last_ok is not None and now < last_ok + ttl:
        return "fresh"
    counts = last_fail is not None and (last_ok is None or last_fail > last_ok)
    if counts and now < last_fail + retry:
        return "unavailable" if last_ok is None else "stale"
    return "due"


def next_change(now: int, last_ok: int | None, last_fail: int | None, ttl: int, retry: int) -> int | None:
    """When the state may next change by itself after ``now``."""
    ends = [last + span for last, span in ((last_ok, ttl), (last_fail, retry)) if last is not None]
    return min((e for e in ends if e > now), default=None)


def needed(times: list[int], oks: list[bool], ttl: int, retry: int) -> list[bool]:
    """Which of a feed's results, in order of time, can matter to its transitions.

    Between two kept results of one kind that lie within ``ttl`` (failures: also within ``retry``)
    the state is the same with and without the ones in the middle, whatever else arrives.
    """
    keep, n = [True] * len(times), len(times)
    last = 0
    for i in range(1, n - 1):
        span = ttl if oks[i] else min(ttl, retry)
        same = oks[last] == oks[i] == oks[i + 1]  # and so is what was dropped between
        if same and times[i + 1] - times[last] < span:
            keep[i] = False
        else:
            last = i
    return keep


def _thin(log: DataFrame, ttl: int, retry: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feeds, oks = batch.column("feed_key").to_pylist(), batch.column("ok").to_pylist()
            times = batch.column("at").cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).to_pylist()
            own: dict[str, list[int]] = {}
            for i in sorted(range(batch.num_rows), key=times.__getitem__):
                if oks[i] is not None:
                    own.setdefault(feeds[i], []).append(i)
            kept = [i for i in range(batch.num_rows) if oks[i] is None]
            for rows in own.values():
                wanted = needed([times[i] for i in rows], [oks[i] for i in rows], ttl, retry)
                kept += [i for i, keep in zip(rows, wanted) if keep]
            yield batch.take(pa.array(sorted(kept), pa.int32()))

    ship_package(log.sparkSession)
    return log.mapInArrow(run, log.schema)


class _Feed(StatefulProcessor):
    """The results that wait, and both moments with the state last told."""

    def __init__(self, ttl: int, retry: int):
        self.ttl, self.retry = ttl, retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, ok boolean")
        self.now = handle.getValueState("now", "last_ok bigint, last_fail bigint, state string, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # one call to the store for all rows: a call costs more than the work on a row
        arrived = sorted({(row.at_us, row.ok) for row in rows if row.ok is not None})
        if arrived:
            self.waiting.appendList(arrived)
            self.handle.registerTimer(-(-arrived[0][0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        last_ok, last_fail, state, until = self.now.get() if self.now.exists() else (None, None, "due", 0)
        waiting = sorted({(row[0], row[1]) for row in self.waiting.get()})
        at_once: dict[int, tuple[bool, bool]] = {}
        for at, was_ok in waiting:
            if at <= limit:
                ok, fail = at_once.get(at, (False, False))
                at_once[at] = ok or was_ok, fail or not was_ok
        ready, later_rows = at_once.items(), [row for row in waiting if row[0] > limit]
        told: list[Row] = []

        def tell(at):
            nonlocal state
            new = state_at(at, last_ok, last_fail, self.ttl, self.retry)
            if new != state:
                told.append(Row(feed_key=key[0], at=_EPOCH + timedelta(microseconds=at), state=new, previous=state))
                state = new

        def expire(after, until):
            """Ends by itself after one moment and before another."""
            at = next_change(after, last_ok, last_fail, self.ttl, self.retry)
            while at is not None and at < until:
                tell(at)
                at = next_change(at, last_ok, last_fail, self.ttl, self.retry)
            return at

        known = until  # what ended by itself up to then has been told
        for at, (ok, fail) in ready:
            expire(known, at)
            last_ok = at if ok else last_ok
            last_fail = at if fail else last_fail
            tell(at)
            known = at
        if later_rows:
            self.waiting.put(later_rows)
        else:
            self.waiting.clear()
        following = expire(known, limit + 1)
        self.now.update((last_ok, last_fail, state, limit))
        later = [m for m in (following, later_rows[0][0] if later_rows else None) if m is not None]
        if later:
            self.handle.registerTimer(-(-min(later) // 1000))
        return iter(told)

    def close(self) -> None:
        pass


def feed_transitions(log: DataFrame, ttl_s: int = TTL_S, retry_s: int = RETRY_S, delay: str = "0 seconds"
                     ) -> DataFrame:
    """Stream of ``(feed_key, at, state, previous)`` from a stream ``(feed_key, at, ok)``.

    A feed begins as due. Results may be ``delay`` late. Needs the RocksDB state store:
    ``spark.sql.streaming.stateStore.providerClass`` set to ``PROVIDER``.
    """
    # a stateful query starts a worker beside the driver, which is not sent the package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ttl, retry = ttl_s * _SECOND, retry_s * _SECOND
    thinned = _thin(log.select("feed_key", "at", "ok"), ttl, retry)
    timed = thinned.withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay)
    return timed.groupBy("feed_key").transformWithState(
        _Feed(ttl, retry), TRANSITIONS, "Append", "EventTime")
