"""Incremental ingestion of newly landed pages (T1) and stream de-duplication (T5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from syndica.operators.items import keep_first, listing_order
from syndica.schemas import ITEM_COLUMNS, ITEMS
from syndica.session import ship_package
from syndica.streaming import seen


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Items published so far, with the batch that brought each; empty before the first."""
    schema = ITEMS.simpleString()[len("struct<"):-1].replace(":", " ")
    try:
        return spark.read.schema(f"{schema}, batch_id bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch_id bigint")


def start_item_ingest(pages: DataFrame, extract: Callable[[DataFrame], DataFrame],
                      published_path: str, checkpoint: str, trigger: dict | None = None,
                      keys_path: str | None = None, compact_every: int = 16) -> StreamingQuery:
    """Append the unseen items of each micro-batch of pages to the published table.

    What was published is looked up in a store of keys beside the table (``seen``), of which a
    batch reads only the part that may concern it. A batch writes its own partition and
    compares itself with earlier batches only, so one that is run again after a failure replaces
    what it wrote before. A table that has no store yet gets one.
    """
    keys_path = keys_path or f"{published_path.rstrip('/')}_keys"

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = f"{published_path}/batch_id={batch_id}"
        if batch_id and not seen.stored(spark, keys_path):
            seen.seed(spark, keys_path, read_published(spark, published_path).filter(F.col("batch_id") < batch_id))
        if batch_id and batch_id % compact_every == 0:
            seen.compact(spark, keys_path, batch_id)
        found = extract(batch)
        firsts = keep_first(found, list(seen.KEYS), listing_order(found))
        seen.unseen(spark, keys_path, firsts, batch_id).select(*ITEM_COLUMNS).write.mode("overwrite").parquet(out)
        seen.record(spark, keys_path, spark.read.schema(ITEMS).parquet(out), batch_id)

    return (
        pages.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _thin(items: DataFrame, keys: list[str]) -> DataFrame:
    """Drop repeats of a key inside each Arrow batch, before anything is shuffled.

    A stream cannot aggregate before its stateful step, so without this every copy of a hot
    key would travel to the one task that holds its state.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table([batch.column(k) for k in keys], names=keys).append_column(
                "_row", pa.array(range(batch.num_rows), pa.int32())
            )
            firsts = rows.group_by(keys).aggregate([("_row", "min")])["_row_min"]
            yield batch.take(firsts.combine_chunks().sort())

    ship_package(items.sparkSession)
    return items.mapInArrow(run, items.schema)


def first_seen(items: DataFrame, at: str = "fetched_at", keys: tuple[str, ...] =
               ("feed_key", "guid"), delay: str = "7 days") -> DataFrame:
    """Stream of items without repeats of a key inside the watermark delay (T5)."""
    thinned = _thin(items, list(keys))
    return thinned.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))
