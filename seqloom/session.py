"""Session defaults and the shared folder for derived tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local session without the setting gets a scratch folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = context.getCheckpointDir()
    return current


def settle(df: DataFrame) -> DataFrame:
    """Store a derived table reliably, so that later passes neither recompute nor re-sample it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on input that arrives in fewer partitions; larger input is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def place_for_python(df: DataFrame, *keys: str) -> DataFrame:
    """Hash placement for Python stages.

    Their cost is time per row rather than bytes, so the planned number of partitions is kept: partition
    coalescing, which goes by bytes, would leave cores idle.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


#: Rows of an aggregate by key that one task holds, about 0.3 KB to 1.2 KB each.
TASK_ROWS = 250_000


def place_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash placement of `rows` rows, at most about `TASK_ROWS` to a task however many there are.

    The planned number of partitions is fixed and coalescing goes by packed bytes, so without this a task's sorts and hash
    tables grow with the table. Aggregates by the same keys need no further exchange.
    """
    spark = df.sparkSession
    planned = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(planned, -(-rows // TASK_ROWS)), *keys)
