"""Append-only event files: tolerant reading, hash chains, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.session import settle

EVENT_SCHEMA = "seqno bigint, kind string, id string, payload string, previous_sha256 string"


def read_ledger(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """JSON lines; broken lines and lines without a required key are left out. Globs read many runs."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)
    keep = F.col("_corrupt").isNull()
    for key in required:
        keep = keep & F.col(key).isNotNull()
    return df.filter(keep).drop("_corrupt")


def event_line(columns: Sequence) -> Column:
    """Canonical text of one event: the columns joined by '|' with 'null' for missing values."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) if isinstance(c, str) else c for c in columns])


def chain(df: DataFrame, order: str, line: Column, block: int = 65_536) -> DataFrame:
    """Add `line_sha256` and `previous_sha256`, the digest of the line before.

    `order` numbers the lines consecutively; blocks of it are the partition key and each block gets the
    last line of the previous block as a look-back row.
    """
    hashed = df.withColumn("line_sha256", F.sha2(line, 256))
    here = F.floor(F.col(order) / block).cast("bigint")
    last = F.pmod(F.col(order), F.lit(block)) == block - 1
    spread = hashed.withColumn("_b", F.explode(F.when(last, F.array(here, here + 1)).otherwise(F.array(here))))
    previous = F.lag("line_sha256").over(Window.partitionBy("_b").orderBy(order))
    return spread.withColumn("previous_sha256", previous).filter(F.col("_b") == here).drop("_b")


def append_event(events: DataFrame, path: str) -> None:
    """Append chained events as JSON lines."""
    events.write.mode("append").json(path)


def verify_hash_chain(df: DataFrame, order: str, line: Column, stored: str = "previous_sha256") -> DataFrame:
    """Events whose stored digest differs from the digest of the line before."""
    again = chain(df.withColumnRenamed(stored, "_stored"), order, line)
    return again.filter(~F.col("_stored").eqNullSafe(F.col("previous_sha256"))).drop("_stored", "line_sha256")


def manifest_hash(documents: DataFrame, columns: Sequence[str], per_bucket: int = 4_096) -> DataFrame:
    """Order-independent digest over (id, version, content digest).

    Equal rows are counted first, so that many copies make one entry. Entries are digested by the first digits of
    their own digest, as many as leave about `per_bucket` entries in one list but at least three, and the results
    again with three digits less, level by level.
    """
    copies = documents.groupBy(F.sha2(event_line(columns), 256).alias("_d")).agg(F.count("*").alias("_n"))
    copies = settle(copies)
    digits = 3
    while copies.count() > per_bucket * 16**digits and digits < 60:
        digits += 3
    rows = copies.select(F.col("_d").alias("_b"), F.concat_ws(":", "_d", F.col("_n").cast("string")).alias("_h"))
    some = rows.groupBy(F.substring("_b", 1, digits).alias("_b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_h")), ""), 256).alias("_h"))
    pair = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda p: p["_h"]), "")
    while digits > 3:
        digits -= 3
        some = some.groupBy(F.substring("_b", 1, digits).alias("_b")).agg(F.sha2(pair, 256).alias("_h"))
    return some.agg(F.sha2(pair, 256).alias("manifest_sha256"))
