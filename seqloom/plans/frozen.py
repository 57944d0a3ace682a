"""Score frozen systems on a split; stored per-sequence moments make the job resumable and reusable."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.layout import KEY
from seqloom.operators import resampling, scoring


def store_moments(df: DataFrame, systems: scoring.Systems, path: str) -> DataFrame:
    """Append moments of sequences that are not stored yet and return all of them.

    A sequence's rows are written by one job, so it is stored whole or not at all.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(KEY).distinct()
        df = df.join(done, KEY, "left_anti")
    except AnalysisException:
        pass
    scoring.moments(scoring.scored_rows(df), systems, by=[KEY]).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def score_frozen(moments: DataFrame, contrasts: resampling.Contrasts, draws: int = 1_000, seed: int = 1) -> DataFrame:
    """Pooled scores with the paired interval of each contrast, from stored moments only."""
    pooled = scoring.with_wp(scoring.add_sums(moments, ["system", "target"]))
    rows = pooled.select(F.col("system").alias("name"), "target", F.col("wp").alias("value"))
    rows = rows.withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double")})
    bounds = resampling.paired_bootstrap(moments, contrasts, draws, seed)
    return rows.unionByName(bounds.select(F.col("contrast").alias("name"), "target", F.col("point").alias("value"), "lower", "upper"))
