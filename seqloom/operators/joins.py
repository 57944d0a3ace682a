"""Joins of rows with masks, predictions, models and rate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import search_sorted
from seqloom.functions.vectors import linear_predict
from seqloom.layout import KEY, STEP


def join_mask(df: DataFrame, mask: DataFrame, how: str = "inner") -> DataFrame:
    """Mask columns onto rows by (sequence, step); the step in the key keeps a hot sequence spread out."""
    return df.join(mask, [KEY, STEP], how)


def paired_predictions(a: DataFrame, b: DataFrame, same: Sequence[str], predictions: Sequence[str]) -> DataFrame:
    """Predictions of two systems side by side; raises where keys or `same` columns differ."""
    left = a.select(KEY, STEP, *[F.col(c).alias(f"_a_{c}") for c in (*same, *predictions)], F.lit(1).alias("_ina"))
    right = b.select(KEY, STEP, *[F.col(c).alias(f"_b_{c}") for c in (*same, *predictions)], F.lit(1).alias("_inb"))
    both = left.join(right, [KEY, STEP], "full_outer")
    ok = F.col("_ina").isNotNull() & F.col("_inb").isNotNull()
    for c in same:
        ok = ok & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    stop = F.raise_error(F.concat(F.lit("systems differ at sequence "), F.col(KEY).cast("string"))).cast("bigint")
    checked = both.withColumn(KEY, F.when(ok, F.col(KEY)).otherwise(stop))
    return checked.select(
        KEY, STEP, *[F.col(f"_a_{c}").alias(c) for c in same],
        *[F.col(f"_{s}_{p}").alias(f"{s}_{p}") for s in "ab" for p in predictions],
    )


def pairing_mismatches(a: DataFrame, b: DataFrame, same: Sequence[str]) -> DataFrame:
    """One row: keys on one side only and rows whose shared columns differ."""
    left = a.select(KEY, STEP, F.struct(*same).alias("_a"))
    right = b.select(KEY, STEP, F.struct(*same).alias("_b"))
    both = left.join(right, [KEY, STEP], "full_outer")
    return both.agg(
        F.sum(F.col("_b").isNull().cast("bigint")).alias("only_a"), F.sum(F.col("_a").isNull().cast("bigint")).alias("only_b"),
        F.sum((F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).cast("bigint")).alias("different"),
    )


def apply_model(df: DataFrame, features: Sequence, coef: dict[str, Sequence[float]], strengths: dict[str, float],
                base: dict[str, str], out: str = "{target}_hat") -> DataFrame:
    """`base + strength * features . coef` per target; the fitted numbers become literals of the plan."""
    cols = {
        out.format(target=t): F.col(base[t]) + linear_predict(features, c) * strengths.get(t, 1.0) for t, c in coef.items()
    }
    return df.withColumns(cols)


def apply_models(df: DataFrame, models: DataFrame, on: str, features: Column, out: str) -> DataFrame:
    """Score rows with the coefficient array of their own group; Spark sizes the join by the model table."""
    joined = df.join(models, on, "left")
    terms = F.zip_with(features, F.col("coef"), lambda a, b: a * b)
    return joined.withColumn(out, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)).drop("coef")


def lookup_rates(df: DataFrame, rates: dict[tuple[int, int], float], position: Column, magnitude: Column, out: str) -> DataFrame:
    """Rate of a (position bin, magnitude bin) cell; the table is small by construction and becomes a map literal."""
    pairs = []
    for (i, j), rate in rates.items():
        pairs += [F.lit(f"{i}:{j}"), F.lit(float(rate))]
    key = F.concat_ws(":", position.cast("string"), magnitude.cast("string"))
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), key))


def bin_pair(step: str, predictions: Sequence[str], step_edges: Sequence[float], magnitude_edges: Sequence[float]) -> tuple[Column, Column]:
    """Position bin and bin of the largest absolute prediction, closed on the left."""
    size = F.greatest(*[F.abs(F.col(p)) for p in predictions], F.lit(0.0))
    return search_sorted(step, step_edges[1:-1], "right"), search_sorted(size, magnitude_edges[1:], "right")


def align_to_reference(pred: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Predictions in the id set of the reference; NULL where missing."""
    return reference.select(key).join(pred, key, "left")


def align_by_position(pred: DataFrame, reference: DataFrame, order: str) -> DataFrame:
    """Fallback: the i-th prediction goes to the i-th reference row; surplus rows are dropped, missing ones NULL.

    `order` numbers the rows of both tables from 0, so the match is an equi-join.
    """
    return reference.select(order).join(pred, order, "left")


def explode_candidates(df: DataFrame, candidates: dict[str, Sequence[Column]], names: Sequence[str] = ("c0", "c1")) -> DataFrame:
    """One row per candidate, so that a single scan and one aggregation score all of them."""
    cells = [F.struct(F.lit(n).alias("candidate"), *[c.alias(k) for c, k in zip(cs, names)]) for n, cs in candidates.items()]
    return df.select("*", F.explode(F.array(*cells)).alias("_c")).select(*df.columns, "_c.*")


