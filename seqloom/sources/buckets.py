"""Co-partitioned storage: tables whose rows already lie where a join by (sequence, step) needs them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.layout import KEY, STEP
from seqloom.session import shared_dir


def store_bucketed(df: DataFrame, name: str, buckets: int | None = None, keys: Sequence[str] = (KEY, STEP), path: str | None = None) -> DataFrame:
    """Write a table bucketed and sorted by `keys`, and return it.

    Tables with the same keys and number of buckets join, and group by these keys, without moving a row; the step in the keys keeps a hot sequence spread
    out. Rows are placed before they are written, so a bucket is one file. The files lie in `path`, or in a
    folder of their own in the shared folder. Choose the buckets for the table's size: their number is the number of tasks that read it.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    placed = df.repartition(buckets, *[F.col(k) for k in keys])
    placed.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(name, format="parquet")
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """How often the plan moves rows between partitions."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("BroadcastExchange")
