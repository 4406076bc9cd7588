"""Transitions of feed state, thinning, and folding of the change table."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from syndica.streaming import state, transitions


def _plain(results, ttl, retry):
    """Every moment at which the state may change, one after the other."""
    points = sorted({p for t, ok in results for p in (t, t + (ttl if ok else retry))})
    told, last = [], "due"
    for p in points:
        ok = max((t for t, good in results if good and t <= p), default=None)
        fail = max((t for t, good in results if not good and t <= p), default=None)
        now = transitions.state_at(p, ok, fail, ttl, retry)
        if now != last:
            told.append((p, now))
            last = now
    return told


def test_thinned_results_give_the_same_transitions():
    rng = random.Random(6)
    dropped = 0
    for _ in range(2_000):
        ttl, retry = rng.randint(1, 30), rng.randint(1, 30)
        results = sorted((rng.randrange(120), rng.random() < 0.6) for _ in range(rng.randrange(40)))
        parts = [results[0::2], results[1::2]]  # as they may stand in two batches
        kept = []
        for part in parts:
            wanted = transitions.needed([t for t, _ in part], [ok for _, ok in part], ttl, retry)
            kept += [r for r, keep in zip(part, wanted) if keep]
        dropped += len(results) - len(kept)
        assert _plain(kept, ttl, retry) == _plain(results, ttl, retry)
    assert dropped > 2_000


def test_changes_are_folded(spark, tmp_path):
    path, source = str(tmp_path / "state"), str(tmp_path / "log")
    rows = [(f"f{i % 4}", i, i % 3 > 0) for i in range(12)]
    for n in range(6):
        spark.createDataFrame(rows[2 * n: 2 * n + 2], "feed_key string, s int, ok boolean").select(
            "feed_key", F.timestamp_seconds("s").alias("at"), "ok").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("feed_key string, at timestamp, ok boolean").parquet(source)
        state.start_feed_state(stream, path, str(tmp_path / "cp"), compact_every=2).awaitTermination()
        if n in (2, 4):  # run again
            state.compact_feed_state(spark, path, n)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["batch_id=4", "batch_id=5"]
    assert [p.name for p in (tmp_path / "state_base").iterdir()] == ["upto=4"]
    now = F.timestamp_seconds(F.lit(12))
    got = {r.feed_key: (r.last_ok.second, r.last_fail.second) for r in state.read_feed_state(spark, path, now).collect()}
    assert got == {k: (max(s for f, s, ok in rows if f == k and ok), max(s for f, s, ok in rows if f == k and not ok))
                   for k in {r[0] for r in rows}}


class _Store:
    """A list state that counts the calls made to it."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.calls += 1
        self.rows = []

    def get(self):
        self.calls += 1
        return iter(self.rows)


class _Handle:
    def __init__(self):
        self.store, self.timers, self.value = _Store(), [], None

    def getListState(self, *_):
        return self.store

    def getValueState(self, *_):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_waiting_results_take_one_call_to_the_store():
    """However many results of a feed arrive or become due, the store is asked a fixed number of times."""
    from pyspark.sql import Row

    rng = random.Random(3)
    for n in (1, 400):
        handle = _Handle()
        feed = transitions._Feed(7_000_000, 5_000_000)
        feed.init(handle)
        results = [(1_000_000 * rng.randrange(900), rng.random() < 0.6) for _ in range(n)]
        rows = [Row(at_us=at, ok=ok) for at, ok in results] + [Row(at_us=0, ok=None)]
        assert list(feed.handleInputRows(("f",), iter(rows), None)) == [] and handle.store.calls == 1
        assert handle.timers == [min(at for at, _ in results) // 1000]
        told = []
        for handle.watermark in (400_000, 2_000_000):
            handle.store.calls = 0
            told += feed.handleExpiredTimer(("f",), handle, None)
            assert handle.store.calls == 2
        assert [(int(r.at.timestamp() * 1_000_000), r.state) for r in told] == _plain(results, 7_000_000, 5_000_000)
        assert handle.store.rows == []
