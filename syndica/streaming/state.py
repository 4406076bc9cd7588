"""Feed state kept by a stream of refresh results.

The state of a feed is two moments, its last success and its last failure. Both are maxima,
so Spark's own streaming aggregation keeps them: results are reduced before the shuffle,
which a custom per-key processor could not do for a feed that owns most of the stream. What each
batch changed goes to a change table, which is folded into one row per feed now and then.

Who must be told of a change of state reads ``transitions`` instead: one row whenever a feed
becomes fresh, stale, unavailable or due, also when it only expires.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from syndica.operators.freshness import RETRY_S, TTL_S, classify
from syndica.session import path_exists, remove_partitions

CHANGES = "feed_key string, last_ok timestamp, last_fail timestamp, batch_id bigint"


def feed_moments(log: DataFrame) -> DataFrame:
    ok = F.col("ok")
    return log.groupBy("feed_key").agg(
        F.max(F.when(ok, F.col("at"))).alias("last_ok"),
        F.max(F.when(~ok, F.col("at"))).alias("last_fail"),
    )


def start_feed_state(log: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                     compact_every: int = 64) -> StreamingQuery:
    """Write the feeds each micro-batch changed to a change table, one partition per batch."""
    def save(changed: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            compact_feed_state(changed.sparkSession, path, batch_id)
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        feed_moments(log).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _base(path: str) -> str:
    return f"{path.rstrip('/')}_base"


def _moments(spark: SparkSession, path: str) -> DataFrame:
    """Both moments of every feed. They only ever grow, so rows read twice change nothing."""
    found = []
    if path_exists(spark, path):
        found.append(spark.read.schema(CHANGES).parquet(path).drop("batch_id"))
    if path_exists(spark, _base(path)):
        found.append(spark.read.schema(CHANGES.replace("batch_id", "upto")).parquet(_base(path)).drop("upto"))
    changes = found[0] if found else spark.createDataFrame([], CHANGES).drop("batch_id")
    for more in found[1:]:
        changes = changes.unionByName(more)
    return changes.groupBy("feed_key").agg(
        F.max("last_ok").alias("last_ok"), F.max("last_fail").alias("last_fail"))


def compact_feed_state(spark: SparkSession, path: str, before: int) -> None:
    """Fold what batches before ``before`` changed into one row per feed.

    The new table is complete before anything is removed, and one that is there is not made
    again, so this may be run again at any point.
    """
    new = f"{_base(path)}/upto={before}"
    if not path_exists(spark, f"{new}/_SUCCESS"):
        _moments(spark, path).write.mode("overwrite").parquet(new)
    remove_partitions(spark, path, lambda batch: batch < before)
    remove_partitions(spark, _base(path), lambda upto: upto < before)


def read_feed_state(spark: SparkSession, path: str, now: Column, ttl_s: int = TTL_S,
                    retry_s: int = RETRY_S) -> DataFrame:
    """State of every feed at ``now`` from the change table."""
    return _moments(spark, path).withColumn(
        "state", classify(now, F.col("last_ok"), F.col("last_fail"), ttl_s, retry_s)
    )
