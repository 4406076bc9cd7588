"""The given tables, as the operators want them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # times of the tables carry no zone and are read as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw pages, each a listing page of the host that served it."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("feed_key"),
        F.col("page_id").cast("int").alias("page_seq"),
        "url", "html",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a refresh log: one feed per user, ``error`` events are failed refreshes."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("u"), F.col("user_id")).alias("feed_key"),
        F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_type") != "error").alias("ok"),
        "event_type", "value", "props",
    )


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items: one feed per type, a user's events are copies of one item."""
    untimed = F.col("event_id") % 7 == 0
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed_key"),
        F.concat(F.lit("u"), F.col("user_id")).alias("guid"),
        F.concat(F.lit("event "), F.col("event_id")).alias("title"),
        F.concat(F.lit("https://e.example.com/"), F.col("event_id")).alias("link"),
        F.when(F.col("value") > 10, F.concat(F.lit("by "), F.col("user_id"))).alias("author"),
        F.when(~untimed, F.col("ts").cast("timestamp")).alias("published_at"),
        (F.expr("event_id div 100") + 1).cast("int").alias("page_seq"),
        (F.col("event_id") % 100).cast("int").alias("pos"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of one feed per customer."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("feed_key"),
        F.concat(F.lit("order:"), F.col("o_orderkey")).alias("guid"),
        F.concat(F.lit("R&D <"), F.col("o_orderpriority"), F.lit(">")).alias("title"),
        F.concat(F.lit("https://o.example.com/?a=1&id="), F.col("o_orderkey")).alias("link"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("clerk "), F.col("o_orderstatus")))
        .alias("author"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp"))
        .alias("published_at"),
        F.lit(1).alias("page_seq"),
        F.col("o_orderkey").cast("int").alias("pos"),
    )


def time_text(col: str = "published_at", micros: bool = False):
    form = "yyyy-MM-dd HH:mm:ss" + (".SSSSSS" if micros else "")
    return F.date_format(col, form).alias(col)
