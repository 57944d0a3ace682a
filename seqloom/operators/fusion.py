"""Fusing prediction tables of several models and checking their content."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds of format detection, weighting and quality rules.
ID_UNIQUE, LONG_TEXT, SUM_TOLERANCE, SUM_EPS, METRIC_EPS = 0.5, 200, 0.05, 1e-10, 1e-6
SIZES, MAX_CANDIDATES, SMALL = (1, 2, 3, 4, 6), 6, 4
CONSTANT, PLACEHOLDER_SHARE = 0.95, 0.5
PLACEHOLDERS = {
    "zeros": r"^0+$", "ones": r"^1+$", "spaced_zeros": r"^0(\s+0)+$", "spaced_ones": r"^1(\s+1)+$",
    "mixed": r"^\d+(\s+[01]\.0+)+(\s+[01])+$",
}

WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")


def detect_format(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row: id, prediction and passed-through columns, fusion strategy, whether rows sum to 1.

    `order` names the column that defines the first row; by default the first column.
    """
    names = df.columns
    first = order or names[0]
    n = F.count("*")
    facts = df.agg(n.alias("_n"), F.count_distinct(names[0]).alias("_u"), *[F.avg(F.length(F.col(c).cast("string"))).alias(f"l|{c}") for c in names]).first()
    ids = [names[0]] if facts["_u"] / max(facts["_n"], 1) > ID_UNIQUE else []
    rest = names[1:] if ids else names
    passed = [c for c in rest if facts[f"l|{c}"] is None or facts[f"l|{c}"] > LONG_TEXT]
    predicted = [c for c in rest if c not in passed] or [names[-1]]
    text = F.col(predicted[0]).cast("string")
    number = text.try_cast("double")
    counts = F.size(_words(text))
    total = sum((F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in predicted), F.lit(0.0))
    shape = df.agg(
        F.max(text.contains(" ")).alias("spaces"), F.min_by(text, F.when(text.isNotNull(), F.col(first))).alias("sample"),
        F.min(counts).alias("least"), F.max(counts).alias("most"),
        F.coalesce(F.min(F.when(text.isNotNull(), number.isNotNull())), F.lit(True)).alias("numeric"),
        F.coalesce(F.min(number == F.rint(number)), F.lit(True)).alias("whole"),
        F.max(F.when(F.abs(total) > SUM_EPS, F.abs(total - 1.0))).alias("gap"),
    ).first()
    if shape["spaces"]:
        cells = (shape["sample"] or "").split()
        numbers = all(_is_number(t) for t in cells)
        strategy = "cellwise" if numbers and shape["least"] == shape["most"] else "text_vote"
    else:
        strategy = "text_vote" if not shape["numeric"] else ("vote" if shape["whole"] else "average")
    gap = shape["gap"]
    normalize = len(predicted) > 1 and strategy == "average" and gap is not None and gap < SUM_TOLERANCE
    row = [(",".join(ids), ",".join(predicted), ",".join(passed), strategy, bool(normalize))]
    return df.sparkSession.createDataFrame(row, "id_columns string, prediction_columns string, passthrough_columns string, fusion string, normalize boolean")


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def usable_models(models: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """Drop placeholder metrics (negative, lower is better) and keep the best-placed candidates, re-ranked."""
    kept = models.filter(F.col("maximize") | ~F.col("metric").cast("string").startswith("-"))  # also drops -0.0
    place = F.row_number().over(Window.orderBy("rank")) - 1  # one row per model
    return kept.withColumn("rank", place).filter(F.col("rank") < most)


def fusion_weights(models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add `weight`: metric (or 1 / metric) times (n - rank), normalized; equal where the sum is 0.

    The table `(model, rank from 0, metric, maximize)` has one row per model.
    """
    everywhere = Window.partitionBy(*by)
    size = F.count("*").over(everywhere)
    score = F.when(F.col("maximize"), F.col("metric")).otherwise(F.lit(1.0) / (F.col("metric") + METRIC_EPS))
    raw = models.withColumn("_raw", score * (size - F.col("rank"))).withColumn("_n", size)
    total = F.sum("_raw").over(everywhere)
    return raw.withColumn("weight", F.when(total == 0, F.lit(1.0) / F.col("_n")).otherwise(F.col("_raw") / total)).drop("_raw", "_n")


def ensemble_members(models: DataFrame, sizes: Sequence[int] = SIZES, every_up_to: int = SMALL) -> DataFrame:
    """`(size, model, rank, ...)`: one group of members per ensemble size."""
    counted = models.withColumn("_n", F.count("*").over(Window.partitionBy()))  # one row per model
    chosen = F.when(F.col("_n") <= every_up_to, F.sequence(F.lit(1), F.col("_n").cast("int"))).otherwise(
        F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s <= F.col("_n").cast("int")))
    return counted.withColumn("size", F.explode(chosen)).filter(F.col("rank") < F.col("size")).drop("_n")


def _weighted(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights onto predictions; the table has at most a few rows per model."""
    return pred.join(F.broadcast(weights.drop("metric", "maximize")), "model")


def fuse_average(pred: DataFrame, weights: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Weighted mean per cell of `(model, by..., value)`."""
    w = _weighted(pred, weights)
    return w.groupBy(*by).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))


def fuse_vote(pred: DataFrame, weights: DataFrame, by: Sequence[str] = ("id",), text: bool = False) -> DataFrame:
    """Weighted majority per cell; ties go to the value of the best-ranked model.

    Weights are summed per cell and value inside the tasks before anything moves.
    """
    value = F.col("value").cast("string")
    value = F.trim(F.coalesce(value, F.lit(""))) if text else F.coalesce(value, F.lit("nan"))
    w = _weighted(pred.withColumn("value", value), weights)
    votes = w.groupBy(*by, "value").agg(F.sum("weight").alias("_v"), F.min("rank").alias("_r"))
    # Vote sums are compared at 12 digits: their last bit depends on the order of addition.
    best = F.max_by("value", F.struct(F.round("_v", 12), -F.col("_r")))
    return votes.groupBy(*by).agg(best.alias("value"))


def fuse_cellwise(pred: DataFrame, weights: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Vote per token position, then join the winners with spaces; unanimous texts are kept as they are.

    The predictions of a cell, at most one per model, meet in one aggregate; the votes of a batch of cells are then counted
    together, so no row per token is shuffled. Positions without any token do not occur. Ties go to the token of the
    best-ranked model.
    """
    text = F.coalesce(F.col("value").cast("string"), F.lit(""))
    w = _weighted(pred.withColumn("value", text), weights)
    vote = F.struct(F.col("rank").cast("long").alias("rank"), F.col("weight").cast("double").alias("weight"), "value")
    cells = w.groupBy(*by).agg(F.collect_list(vote).alias("_c"))
    schema = T.StructType([f for f in cells.schema if f.name != "_c"] + [T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = batch.column(len(by))
            flat = votes.flatten()
            owner = np.repeat(np.arange(batch.num_rows), votes.value_lengths().to_numpy())
            rank, weight, value = (flat.field(i) for i in range(3))
            fused = _cell_votes(owner, rank.to_numpy(), weight.to_numpy(), value, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(by))), pa.array(fused, pa.string())], names=[*by, "value"])

    return cells.select(*by, "_c").mapInArrow(run, schema)


def _cell_votes(owner: np.ndarray, rank: np.ndarray, weight: np.ndarray, value: pa.Array, cells: int) -> list[str]:
    """Fused text of each cell from its votes, which come in order of `owner`."""
    coded = value.dictionary_encode()
    texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if not len(code):
        return []
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    same = np.minimum.reduceat(code, first) == np.maximum.reduceat(code, first)
    out = [texts[c] if s else "" for c, s in zip(code[first].tolist(), same.tolist())]
    words = [WORD.findall(t) for t in texts]
    names = sorted({w for one in words for w in one})  # code points sort as the bytes do
    place = {w: i for i, w in enumerate(names)}
    tokens = np.array([place[w] for one in words for w in one], np.int64)
    size = np.array([len(one) for one in words])
    start = np.cumsum(size) - size
    row = np.flatnonzero(~same[owner])
    many = size[code[row]]
    if not many.sum():
        return out
    pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    token = tokens[np.repeat(start[code[row]], many) + pos]
    row = np.repeat(row, many)
    slot = owner[row] * int(many.max()) + pos
    order = np.lexsort((rank[row], token, slot))
    slot, token, row = slot[order], token[order], row[order]
    head = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (token[1:] != token[:-1]))))
    # Vote sums are compared at 12 digits: their last bit depends on the order of addition.
    total = np.round(np.add.reduceat(weight[row], head), 12)
    slot, token, best = slot[head], token[head], rank[row[head]]
    order = np.lexsort((-token, best, -total, slot))
    slot, token = slot[order], token[order]
    head = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    cell, won = slot[head] // int(many.max()), token[head].tolist()
    edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))).tolist()
    for a, b in zip(edges, edges[1:]):
        out[cell[a]] = " ".join([names[k] for k in won[a:b]])
    return out


def row_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Divide by the row sum; rows that sum to 0 stay."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return df.withColumns({c: F.when(F.abs(total) > SUM_EPS, F.col(c) / total).otherwise(F.col(c)) for c in columns})


def ensemble_sweep(pred: DataFrame, models: DataFrame, most: int = MAX_CANDIDATES, sizes: Sequence[int] = SIZES, every_up_to: int = SMALL) -> DataFrame:
    """Averages of all ensemble sizes from one shuffle: `(size, id, value)`."""
    weights = fusion_weights(ensemble_members(usable_models(models, most), sizes, every_up_to), ["size"])
    return fuse_average(pred, weights, ["size", "id"])


def content_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: shares of empty, most frequent and placeholder values, and the first broken rule.

    Values are counted per (column, value) with map-side combining; 0/1 columns are exempt.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    values = df.select(F.explode(cells).alias("_c")).select("_c.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    zero_one = F.col("value").isin("0", "1")
    stats = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.max("n").alias("_top"), F.sum(F.when(F.trim("value") == "", F.col("n")).otherwise(0)).alias("_empty"),
        ((F.count("*") == 2) & (F.sum(zero_one.cast("int")) == 2)).alias("binary"),
        *[F.sum(F.when(F.col("value").rlike(p), F.col("n")).otherwise(0)).alias(f"p_{name}") for name, p in PLACEHOLDERS.items()],
    )
    empty, top = F.col("_empty") / F.col("rows"), F.col("_top") / F.col("rows")
    worst = F.greatest(*[F.col(f"p_{name}") / F.col("rows") for name in PLACEHOLDERS])
    problem = (
        F.when(F.col("binary"), F.lit("")).when(empty > CONSTANT, F.lit("empty"))
        .when((F.col("rows") > 2) & (top > CONSTANT), F.lit("constant")).when(worst > PLACEHOLDER_SHARE, F.lit("placeholder")).otherwise(F.lit(""))
    )
    return stats.select("column", "rows", empty.alias("empty_share"), top.alias("top_share"), worst.alias("placeholder_share"), problem.alias("problem"))
