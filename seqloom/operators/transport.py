"""Do per-sequence gradients depend on what a sequence looks like at its start?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import standardize
from seqloom.functions.vectors import linear_predict
from seqloom.layout import KEY
from seqloom.operators.gradients import CROSS, gradient_moments
from seqloom.operators.populations import feature_scaler
from seqloom.operators.ridge import grams
from seqloom.operators.scoring import SUMS, moments
from seqloom.session import settle


def sequence_gradients(df: DataFrame, features: Sequence, base: Sequence, reference: DataFrame, scale: float, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Gradient contribution of each sequence, all measured against one pooled reference population."""
    cross = gradient_moments(df, features, base, targets, [KEY])
    facts = {r["target"]: r for r in reference.collect()}  # one row per target
    g = F.lit(None).cast("double")
    for t, m in facts.items():
        w, wy, wp, wyy, wpp, wyp = (m[c] for c in SUMS)
        my, mp = wy / w, wp / w
        vy, vp, cov = wyy - wy * my, wpp - wp * mp, wyp - wy * mp
        value = (F.col("fy") - F.col("f0") * my - (F.col("fp") - F.col("f0") * mp) * (cov / vp)) * (scale / np.sqrt(vy * vp))
        g = F.when(F.col("target") == t, value).otherwise(g)
    return cross.select(KEY, "target", "feature", g.alias("gradient")).drop(*CROSS)


def context_ridge(gradients: DataFrame, context: DataFrame, names: Sequence[str], penalty: float = 0.1) -> tuple[dict[tuple, np.ndarray], dict, dict]:
    """Ridge from standardized prefix context to the centered gradient, per target and feature."""
    stats = feature_scaler(context, names, 0.05)
    centers = {(r["target"], r["feature"]): r["m"] for r in gradients.groupBy("target", "feature").agg(F.avg("gradient").alias("m")).collect()}
    design = [F.lit(1.0), *[standardize(n, *stats[n]) for n in names]]
    joined = gradients.join(context, KEY)
    center = F.lit(0.0)
    for (t, f), m in centers.items():
        center = F.when((F.col("target") == t) & (F.col("feature") == f), F.lit(m)).otherwise(center)
    found = grams(joined, design, {"g": (F.col("gradient") - center, F.lit(1.0))}, ["target", "feature"])
    return {k[:2]: g.solve(penalty) for k, g in found.items()}, centers, stats


def gradient_predictability(fit: DataFrame, development: DataFrame, fit_context: DataFrame, development_context: DataFrame,
                            names: Sequence[str], penalty: float = 0.1) -> DataFrame:
    """Share of squared gradient error removed by the context model on held-out sequences, per target and half."""
    fit = settle(fit)
    coefs, centers, stats = context_ridge(fit, fit_context, names, penalty)
    design = [F.lit(1.0), *[standardize(n, *stats[n]) for n in names]]
    predicted, center = F.lit(0.0), F.lit(0.0)
    for (t, f), coef in coefs.items():
        here = (F.col("target") == t) & (F.col("feature") == f)
        predicted = F.when(here, linear_predict(design, coef)).otherwise(predicted)
        center = F.when(here, F.lit(centers[(t, f)])).otherwise(center)
    rows = development.join(development_context, KEY).select(
        KEY, "target", (F.col("gradient") - center).alias("_c"), (F.col("gradient") - center - predicted).alias("_e"))
    half = F.when(F.pmod(F.xxhash64(KEY), F.lit(2)) == 0, F.lit("a")).otherwise(F.lit("b"))
    spread = rows.withColumn("half", F.explode(F.array(F.lit("all"), half)))
    return spread.groupBy("target", "half").agg(
        ((F.sum(F.col("_c") * F.col("_c")) - F.sum(F.col("_e") * F.col("_e"))) / F.sum(F.col("_c") * F.col("_c"))).alias("error_reduction"),
        F.count_distinct(KEY).alias("sequences"))


def reference_moments(df: DataFrame, base: Sequence, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    return moments(df, {"base": base}, targets)


def gradient_reliability(even: DataFrame, odd: DataFrame) -> DataFrame:
    """Correlation of two interleaved halves of each sequence's gradient around their common mean."""
    both = even.withColumnRenamed("gradient", "_a").join(odd.withColumnRenamed("gradient", "_b"), [KEY, "target", "feature"])
    means = both.groupBy("target", "feature").agg(((F.avg("_a") + F.avg("_b")) / 2.0).alias("_m"))
    joined = both.join(means, ["target", "feature"])
    a, b = F.col("_a") - F.col("_m"), F.col("_b") - F.col("_m")
    return joined.groupBy("target").agg((F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("reliability"))
