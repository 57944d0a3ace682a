"""Prediction tables and table previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_predictions(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files: inference reads them once more."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def profile_table(df: DataFrame, few: int = 10, top: int = 4) -> DataFrame:
    """One row per column: counts, share of true values, range, few distinct values or most frequent ones.

    The scalar statistics are one aggregation without expansion. Values are counted only for text
    columns and for columns with few distinct values; a numeric column with many is described by its
    range and never shuffled.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    flags = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    aggs = [F.count("*").alias("_rows")]
    for f in df.schema:
        c = F.col(f.name)
        aggs += [F.count(c).alias(f"n|{f.name}"), F.approx_count_distinct(c, 0.02).alias(f"d|{f.name}")]
        if f.name in numeric:
            aggs += [F.min(c).cast("double").alias(f"lo|{f.name}"), F.max(c).cast("double").alias(f"hi|{f.name}")]
        if f.name in flags:
            aggs.append(F.avg(c.cast("double")).alias(f"t|{f.name}"))
    row = df.agg(*aggs).first().asDict()
    facts, counted = [], []
    for f in df.schema:
        kind = f.dataType.simpleString()
        facts.append((f.name, kind, row["_rows"], row["_rows"] - row[f"n|{f.name}"], row.get(f"lo|{f.name}"),
                      row.get(f"hi|{f.name}"), row.get(f"t|{f.name}")))
        if kind == "string" or row[f"d|{f.name}"] < 2 * few:
            counted.append(f.name)
    out = df.sparkSession.createDataFrame(
        facts, "column string, type string, rows bigint, nulls bigint, min double, max double, true_share double")
    if not counted:
        return out.withColumns({"distinct_values": F.lit(None).cast("bigint"), "examples": F.lit(None).cast("string")})
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in counted])
    long = df.select(F.explode(cells).alias("_c")).select("_c.*").filter(F.col("value").isNotNull())
    values = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    sizes = values.groupBy("column").agg(F.count("*").alias("distinct_values"))
    # The rank filter is applied before the exchange as well, so a task receives few rows per column.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    best = values.withColumn("_k", rank).filter(F.col("_k") <= max(few, top))
    lists = best.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("_k", "value"))).alias("_l"))
    joined = out.join(sizes, "column", "left").join(lists, "column", "left")
    listed = F.transform("_l", lambda p: p["value"])
    keep = F.when(F.col("distinct_values") < few, listed).when(F.col("type") == "string", F.slice(listed, 1, top))
    return joined.withColumn("examples", F.array_join(keep, ",")).drop("_l")


def infer_json_schema(df: DataFrame, column: str) -> DataFrame:
    """Union schema of a column of JSON texts, merged from partial schemas on the executors."""
    return df.agg(F.schema_of_variant_agg(F.parse_json(column)).alias("json_schema"))


def infer_file_schema(spark: SparkSession, path: str, multi_line: bool = False) -> str:
    """Union schema of JSON or JSON-lines files."""
    return spark.read.option("multiLine", multi_line).json(path).schema.simpleString()


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    if df.columns != list(expected):
        raise ValueError(f"unexpected columns: {df.columns}")
    return df
