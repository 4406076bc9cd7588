"""Ordered operators that never put a whole group into one task.

A plain window over ``PARTITION BY key ORDER BY ...`` sends every row of a key to one
task. Here rows are range-partitioned by ``key`` *and* order instead, so a hot key spreads
over many ranges; what crosses a range border is carried by a table of one row per
(key, range). The ranged rows are written to the shared scratch folder once, because the
borders that sampling picks must be the same for the rows and for the carried values.

``order`` should end in columns that make it unique: rows equal in all of it stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syndica.session import materialize

RANGE, ROW = "_range", "_row"


def split_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` sorted into ranges, with the range number and a row number rising inside it."""
    sort = [F.col(k) for k in keys] + list(order)
    ranged = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn(RANGE, F.spark_partition_id())
        .withColumn(ROW, F.monotonically_increasing_id())
    )
    return materialize(ranged, "ranges")


def _attach(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Join the per-(key, range) values back; NULL keys match themselves."""
    right = blocks
    condition = rows[RANGE] == right[f"_b{RANGE}"]
    for k in keys:
        condition = condition & rows[k].eqNullSafe(right[f"_b_{k}"])
    return rows.join(right, condition)


def _blocks(ranged: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return ranged.groupBy(
        *[F.col(k).alias(f"_b_{k}") for k in keys], F.col(RANGE).alias(f"_b{RANGE}")
    ).agg(*aggs)


def _earlier_ranges(keys: list[str]):
    return (
        Window.partitionBy(*[f"_b_{k}" for k in keys])
        .orderBy(f"_b{RANGE}")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def ordinals(df: DataFrame, keys: list[str], order: list[Column], name: str = "ord") -> DataFrame:
    """1-based position of each row within its key."""
    columns = df.columns
    ranged = split_ranges(df, keys, order)
    starts = _blocks(
        ranged, keys, F.count(F.lit(1)).alias("_n"), F.min(ROW).alias("_first")
    ).withColumn(
        "_shift",
        F.coalesce(F.sum("_n").over(_earlier_ranges(keys)), F.lit(0)) - F.col("_first") + 1,
    )
    return _attach(ranged, starts, keys).select(
        *columns, (F.col(ROW) + F.col("_shift")).alias(name)
    )


def previous(df: DataFrame, keys: list[str], order: list[Column], value: str,
             name: str) -> DataFrame:
    """Value of the preceding row of the same key (NULL on the first)."""
    columns = df.columns
    ranged = split_ranges(df, keys, order)
    borders = _blocks(ranged, keys, F.max_by(value, ROW).alias("_last")).withColumn(
        "_carry", F.last("_last").over(_earlier_ranges(keys))
    )
    inside = Window.partitionBy(RANGE, *keys).orderBy(ROW)
    return _attach(ranged, borders, keys).select(
        *columns,
        F.when(F.row_number().over(inside) == 1, F.col("_carry"))
        .otherwise(F.lag(value).over(inside))
        .alias(name),
    )


def running_max(df: DataFrame, keys: list[str], order: list[Column],
                values: dict[str, Column]) -> DataFrame:
    """Running maximum of each expression up to and including the row."""
    columns = df.columns
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    ranged = split_ranges(df, keys, order)
    borders = _blocks(ranged, keys, *[F.max(f"_v_{n}").alias(f"_m_{n}") for n in values])
    for n in values:
        borders = borders.withColumn(f"_carry_{n}", F.max(f"_m_{n}").over(_earlier_ranges(keys)))
    inside = (
        Window.partitionBy(RANGE, *keys)
        .orderBy(ROW)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return _attach(ranged, borders, keys).select(
        *columns,
        *[
            F.greatest(F.col(f"_carry_{n}"), F.max(f"_v_{n}").over(inside)).alias(n)
            for n in values
        ],
    )


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of the same key that stand before the row (0 for the first)."""
    columns = df.columns
    ranged = split_ranges(df.withColumn("_v", value), keys, order)
    starts = _blocks(ranged, keys, F.sum("_v").alias("_s")).withColumn(
        "_carry", F.coalesce(F.sum("_s").over(_earlier_ranges(keys)), F.lit(0)))
    inside = Window.partitionBy(RANGE, *keys).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    return _attach(ranged, starts, keys).select(
        *columns, (F.col("_carry") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).alias(name))
