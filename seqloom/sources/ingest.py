"""Turn raw ordered events into a sequence table, once, for all later queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import settle


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Consecutive number from 0 per key, following a unique order.

    A window over the key would sort a hot key in one task. Instead rows are range-partitioned on
    (key, order), so a hot key spreads over many partitions; the row number is the position inside
    the partition plus the rows of that key in earlier partitions. The partitioned rows are settled
    first because both branches must see the same partition bounds.
    """
    placed = (
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = settle(placed)
    # One row per (key, partition): a key contributes at most as many rows as there are partitions.
    runs = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = placed.join(runs.drop("_n"), [*keys, "_part"])
    number = F.col("_pos") - F.col("_first") + F.col("_offset")
    return joined.withColumn(out, number).drop("_part", "_pos", "_first", "_offset")


def dense_index(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Distinct keys numbered from 0, plus their total count `n`.

    Keys are ordered by (3 hex digits of their md5, key). Each of the 4,096 digit buckets is numbered
    on its own, so no task sorts all keys.
    """
    keys = df.select(key).distinct().withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    sizes = keys.groupBy("_bucket").agg(F.count("*").alias("_n"))
    order = Window.orderBy("_bucket")  # at most 4,096 rows
    sizes = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("n"),
    )
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    numbered = keys.withColumn("_rn", local).join(F.broadcast(sizes), "_bucket")
    return numbered.select(key, (F.col("_offset") + F.col("_rn") - 1).alias(out), "n")
