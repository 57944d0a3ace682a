"""Populations, selection and their effect on scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, not_finite, search_sorted
from seqloom.functions.vectors import interpolation_basis
from seqloom.layout import KEY, NEED, SCORED
from seqloom.operators.quantiles import exact_quantiles, many_quantiles
from seqloom.operators.scoring import SUMS, Systems, moments, scored_rows, wp
from seqloom.operators.slices import by_target
from seqloom.session import settle

LOWEST, HIGHEST = 0.2, 5.0  # Fixed values: limits of a relative weight.


def normalize_weights(df: DataFrame, weight: str, out: str) -> DataFrame:
    """Weight divided by its mean; negative or non-finite weights and a zero mean are errors."""
    w = F.col(weight)
    stop = F.raise_error(F.lit("invalid population weights")).cast("double")
    mean = df.agg(F.avg(F.when(not_finite(weight) | (w < 0), stop).otherwise(w)).alias("_mean"))
    mean = mean.withColumn("_mean", F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(stop))
    return df.crossJoin(F.broadcast(mean)).withColumn(out, w / F.col("_mean")).drop("_mean")  # one row


def feature_scaler(df: DataFrame, features: Sequence[str], floor: float = 1e-3) -> dict[str, tuple[float, float]]:
    """Mean and floored deviation of each feature from one pass."""
    row = df.agg(*[F.avg(f).alias(f"m|{f}") for f in features], *[F.avg(F.col(f) * F.col(f)).alias(f"q|{f}") for f in features]).first()
    out = {}
    for f in features:
        mean = row[f"m|{f}"]
        out[f] = (mean, max(row[f"q|{f}"] - mean * mean, floor * floor) ** 0.5)
    return out


def scaler_table(df: DataFrame, features: Sequence[str], floor: float = 1e-3) -> DataFrame:
    """The scaler as rows `(feature, mean, scale)`."""
    wide = df.agg(*[F.avg(f).alias(f"m|{f}") for f in features], *[F.avg(F.col(f) * F.col(f)).alias(f"q|{f}") for f in features])
    cells = [
        F.struct(F.lit(f).alias("feature"), F.col(f"`m|{f}`").alias("mean"),
                 F.sqrt(F.greatest(F.col(f"`q|{f}`") - F.col(f"`m|{f}`") * F.col(f"`m|{f}`"), F.lit(floor * floor))).alias("scale"))
        for f in features
    ]
    return wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def covariate_shift(reference: DataFrame, other: DataFrame, features: Sequence[str], k: int = 10) -> DataFrame:
    """Largest standardized mean shifts `(mean_other - mean_ref) / std_ref`."""
    a = scaler_table(reference, features, 1e-6)
    b = scaler_table(other, features, 1e-6).select("feature", F.col("mean").alias("_other"))
    shift = a.join(b, "feature").select("feature", ((F.col("_other") - F.col("mean")) / F.col("scale")).alias("shift"))
    return shift.orderBy(F.abs("shift").desc(), "feature").limit(k)


def propensity_table(df: DataFrame, position: Column, magnitude: Column) -> DataFrame:
    """Required and scored counts per cell, smoothed rate and relative focus."""
    rows = df.filter(F.col(NEED))
    cells = rows.groupBy(position.alias("position"), magnitude.alias("magnitude")).agg(
        F.count("*").alias("required"), F.sum(F.col(SCORED).cast("bigint")).alias("scored"))
    total = cells.agg((F.sum("scored") / F.sum("required")).alias("_all"))
    rate = (F.col("scored") + 0.5) / (F.col("required") + 1.0)
    focus = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), rate / F.col("_all")))
    return cells.crossJoin(F.broadcast(total)).select("position", "magnitude", "required", "scored", rate.alias("rate"), focus.alias("focus"))


def log_loss(df: DataFrame, indicator: Column, probability: Column, prior: Column | None = None) -> DataFrame:
    """Mean log loss, and that of a prior probability (the base rate unless given)."""

    def loss(y, p):
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), p))
        return -y * F.log(p) - (F.lit(1.0) - y) * F.log1p(-p)

    rows = df.select(indicator.cast("double").alias("y"), probability.alias("p"), (prior if prior is not None else F.lit(None).cast("double")).alias("q"))
    if prior is None:
        rate = rows.agg(F.avg("y").alias("_q"))
        rows = rows.crossJoin(F.broadcast(rate)).withColumn("q", F.col("_q"))  # one row
    return rows.agg(F.avg(loss(F.col("y"), F.col("p"))).alias("log_loss"), F.avg(loss(F.col("y"), F.col("q"))).alias("prior_log_loss"))


def cumulative_by_value(df: DataFrame, value: str, sums: Sequence[str]) -> DataFrame:
    """Add `before_<c>`: sum of c over all smaller values; values are unique.

    Values are range-partitioned; a partition needs only the totals of earlier partitions. The placed
    rows are settled because both branches must see the same bounds.
    """
    placed = settle(df.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    local = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(totals), "_part")
    return joined.withColumns({
        f"before_{c}": F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"_o_{c}") for c in sums
    }).drop("_part", *[f"_o_{c}" for c in sums])


def roc_auc(df: DataFrame, indicator: Column, score: Column) -> DataFrame:
    """Area under the curve; equal scores count one half."""
    per = df.groupBy(score.alias("s")).agg(
        F.sum(indicator.cast("bigint")).alias("pos"), F.sum((~indicator).cast("bigint")).alias("neg"))
    ranked = cumulative_by_value(per, "s", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") * 0.5))
    return ranked.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def effective_mass(df: DataFrame, mass: str, by: Sequence[str] = ()) -> DataFrame:
    """`(sum m)^2 / sum m^2` of the per-sequence masses."""
    per = df.groupBy(*by, KEY).agg(F.sum(mass).alias("_m"))
    return per.groupBy(*by).agg((F.sum("_m") * F.sum("_m") / F.sum(F.col("_m") * F.col("_m"))).alias("effective_sequences"))


def weight_profile(df: DataFrame, weight: str, probs: Sequence[float] = (0.01, 0.5, 0.99), low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """Shares of weights at the caps and quantiles of the weights."""
    shares = df.agg(F.avg((F.col(weight) <= low).cast("double")).alias("low_share"), F.avg((F.col(weight) >= high).cast("double")).alias("high_share"))
    q = exact_quantiles(df, weight, probs)
    return shares.withColumns({f"q{int(round(p * 100)):02d}": F.lit(v) for p, v in zip(probs, q)})


def matched_contrast(df: DataFrame, systems: Systems, propensity: Column, position: Column, edges: Sequence[float],
                     minimum: int = 100, prediction_edges: Sequence[float] = (-1.0, 0.0, 1.0)) -> DataFrame:
    """Scored against unscored rows at common propensity, position and prediction.

    Moments per cell and population are re-weighted to the smaller row count of the cell; cells with
    fewer than `minimum` rows on a side are left out. One scan, then arithmetic on the cells.
    """
    name = next(iter(systems))
    rows = df.filter(F.col(NEED)).withColumns({"_pb": search_sorted(propensity, edges), "_pos": position})
    long = by_target(rows, {name: systems[name]}, keep=["_pb", "_pos", SCORED]).withColumnRenamed("target", "side")
    pred = search_sorted(clip(f"p_{name}"), prediction_edges)
    cells = moments(long, {name: (F.col(f"p_{name}"),)}, ("y",), ["side", "_pb", "_pos", pred.alias("_pp"), SCORED])
    keys = ["side", "_pb", "_pos", "_pp"]
    pair = cells.groupBy(*keys).agg(*[
        F.sum(F.when(F.col(SCORED) == flag, F.col(c))).alias(f"{c}{int(flag)}") for flag in (False, True) for c in ("n", *SUMS)
    ]).filter((F.col("n0") >= minimum) & (F.col("n1") >= minimum))
    common = F.least("n0", "n1")
    out = pair.groupBy("side").agg(
        F.sum(common).alias("matched_rows"), F.count("*").alias("cells"),
        *[F.sum(F.col(f"{c}{k}") * common / F.col(f"n{k}")).alias(f"{c}_{k}") for k in (0, 1) for c in SUMS],
    )

    def mse(k):
        return (F.col(f"wyy_{k}") + F.col(f"wpp_{k}") - F.col(f"wyp_{k}") * 2) / F.col(f"w_{k}")

    scores = {k: wp(sums={c: F.col(f"{c}_{k}") for c in SUMS}) for k in (0, 1)}
    return out.select(F.col("side").alias("target"), "matched_rows", "cells", scores[0].alias("unscored_wp"), scores[1].alias("scored_wp"),
                      mse(0).alias("unscored_mse"), mse(1).alias("scored_mse"), (mse(1) / mse(0)).alias("mse_ratio"))


def poor_row_threshold(df: DataFrame, target: str, prediction: str, q: float = 0.75) -> float:
    """Quantile of the absolute clipped error."""
    return exact_quantiles(df, F.abs(clip(target) - clip(prediction)), [q])[0]


def poor_row_thresholds(df: DataFrame, pairs: dict[str, str], q: float = 0.75) -> dict[str, float]:
    """The same for several targets `{target: prediction}` in one set of passes."""
    return {t: v[0] for t, v in many_quantiles(df, {t: F.abs(clip(t) - clip(p)) for t, p in pairs.items()}, [q])[()].items()}


def poor_row_gain(df: DataFrame, base: Sequence[str], candidate: Sequence[str], thresholds: dict[str, float], targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Weighted squared-error gain of the candidate, on rows where the base was poor and on all rows."""
    rows = by_target(scored_rows(df), {"a": base, "b": candidate})
    limit = F.lit(None).cast("double")
    for t, v in thresholds.items():
        limit = F.when(F.col("target") == t, F.lit(v)).otherwise(limit)
    y = clip("y")
    ea, eb = y - clip("p_a"), y - clip("p_b")
    poor = F.abs(ea) >= limit
    w = F.abs(y)
    gain = w * (ea * ea - eb * eb)
    return rows.groupBy("target").agg(
        F.sum(poor.cast("bigint")).alias("poor_rows"), (F.sum(F.when(poor, gain)) / F.sum(F.when(poor, w))).alias("poor_gain"),
        (F.sum(gain) / F.sum(w)).alias("gain"))


def amplitude_ratio(df: DataFrame, a: dict[str, Column], b: dict[str, Column], combine) -> DataFrame:
    """RMS of a combined correction against RMS of the mean, and the share of equal signs."""
    cells = [F.struct(F.lit(t).alias("target"), a[t].alias("a"), b[t].alias("b")) for t in a]
    rows = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    mean, guarded = (F.col("a") + F.col("b")) * 0.5, combine("a", "b")
    out = rows.groupBy("target").agg(F.sum(mean * mean).alias("_m"), F.sum(guarded * guarded).alias("_g"), F.avg((F.col("a") * F.col("b") > 0).cast("double")).alias("agreement"))
    return out.select("target", F.sqrt(F.col("_g") / F.greatest(F.col("_m"), F.lit(1e-30))).alias("ratio"), "agreement")


def knot_mass(df: DataFrame, target: str, prediction: str, knots: Sequence[float], focus: Column | None = None) -> DataFrame:
    """Weight that falls to each interpolation knot."""
    w = F.abs(clip(target)) * (focus if focus is not None else F.lit(1.0))
    wide = df.agg(*[F.sum(w * f).alias(f"k{i}") for i, f in enumerate(interpolation_basis(prediction, knots))])
    cells = [F.struct(F.lit(float(k)).alias("knot"), F.col(f"k{i}").alias("mass")) for i, k in enumerate(knots)]
    return wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def sequence_groups(fit: DataFrame, other: DataFrame, value: Column, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantile group of each sequence's mean; the edges come from the fit sequences only."""
    edges = exact_quantiles(settle(fit.groupBy(KEY).agg(F.avg(value).alias("_v"))), "_v", probs)
    means = other.groupBy(KEY).agg(F.avg(value).alias("mean"))
    return means.withColumn("group", search_sorted("mean", edges, "right"))


def counts_by(df: DataFrame, flags: dict[str, Column], by: Sequence = ()) -> DataFrame:
    """Rows under each flag: masks, experts or roles."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.sum(c.cast("bigint")).alias(n) for n, c in flags.items()])


def error_decomposition(df: DataFrame, base: Sequence[str], candidates: dict[str, Sequence], targets: Sequence[str] = ("t0", "t1"), by: Sequence[str] = ()) -> DataFrame:
    """Per candidate: correlation of its error with the base error and weighted squared-error gain."""
    rows = by_target(scored_rows(df), {"base": base, **candidates}, targets, keep=list(by))
    y = clip("y")
    w = F.abs(y)
    e = y - clip("p_base")
    aggs = [F.sum(w).alias("_w"), F.sum(w * e * e).alias("_ee")]
    for c in candidates:
        d = y - clip(f"p_{c}")
        aggs += [F.sum(w * d * d).alias(f"_dd_{c}"), F.sum(w * e * d).alias(f"_ed_{c}")]
    wide = rows.groupBy(*by, "target").agg(*aggs)
    cells = [F.struct(
        F.lit(c).alias("candidate"), (F.col(f"_ed_{c}") / F.sqrt(F.col("_ee") * F.col(f"_dd_{c}"))).alias("error_corr"),
        ((F.col("_ee") - F.col(f"_dd_{c}")) / F.col("_w")).alias("mse_gain")) for c in candidates]
    return wide.select(*by, "target", F.explode(F.array(*cells)).alias("_c")).select(*by, "target", "_c.*")


def selection_agreement(candidates: DataFrame, fit_gain: str, evaluation_gain: str) -> DataFrame:
    """Spearman correlation of the gains and the count of candidates better on fit but worse on evaluation.

    Rank windows need the whole list of candidates; it holds one row per model and strength. Average
    ranks for ties come from value counts.
    """

    def ranks(value: str, out: str) -> DataFrame:
        per = cumulative_by_value(candidates.groupBy(value).agg(F.count("*").alias("n")), value, ["n"])
        return per.select(value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(out))

    joined = candidates.join(ranks(fit_gain, "_rf"), fit_gain).join(ranks(evaluation_gain, "_re"), evaluation_gain)
    return joined.agg(
        F.count("*").alias("candidates"), F.corr("_rf", "_re").alias("spearman"),
        F.sum(((F.col(fit_gain) > 0) & (F.col(evaluation_gain) < 0)).cast("bigint")).alias("better_fit_worse_evaluation"))


