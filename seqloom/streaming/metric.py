"""Scores and ledgers kept up to date from streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.scoring import SUMS, Systems, moments, scored_rows, six, with_wp


def moment_sink(path: str, systems: Systems, targets: Sequence[str] = ("t0", "t1")):
    """`foreachBatch` function that stores the moments of each batch under its batch id.

    A repeated batch overwrites its own files, so a restart never counts rows twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        moments(scored_rows(batch), systems, targets).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_metric(stream: DataFrame, path: str, checkpoint: str, systems: Systems, targets: Sequence[str] = ("t0", "t1")) -> None:
    """Process everything available; the running score is `read_metric(path)`."""
    query = stream.writeStream.foreachBatch(moment_sink(path, systems, targets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_metric(spark: SparkSession, path: str) -> DataFrame:
    """Score so far, from the merged moments of all batches."""
    rows = spark.read.parquet(path)
    pooled = rows.groupBy("system", "target").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])
    return with_wp(pooled)


def running_moments(stream: DataFrame, y: str, p: str) -> DataFrame:
    """The same sums as a streaming aggregation, for complete or update mode."""
    rows = scored_rows(stream)
    return rows.groupBy().agg(F.count("*").alias("n"), *[F.sum(c).alias(m) for m, c in six(y, p).items()])


def stream_ledger(stream: DataFrame, key: str, order: str, kind: str, metric: str) -> DataFrame:
    """Last event and best metric per key of an append-only event stream (complete or update mode)."""
    return stream.groupBy(key).agg(
        F.max_by(kind, order).alias("status"), F.max(order).alias("last_event"), F.max(metric).alias("best"), F.count("*").alias("events"))
