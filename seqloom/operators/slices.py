"""Error slices: scores by bucket, per sequence, by grid; residual and feature relations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, column, correlation, magnitude_bucket, position_bucket
from seqloom.layout import KEY, NEED, SCORED, STEP, SequenceSpec
from seqloom.operators.ordered import lags, previous_marked
from seqloom.operators.quantiles import many_quantiles
from seqloom.operators.scoring import SUMS, Systems, moments, scored_rows, six, with_wp
from seqloom.session import settle

STRENGTHS = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)


def by_target(df: DataFrame, systems: Systems, targets: Sequence[str] = ("t0", "t1"), keep: Sequence[str] = ()) -> DataFrame:
    """One row per target: `target, y, p_<system>...`."""
    cells = [
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                 *[column(p[i]).cast("double").alias(f"p_{s}") for s, p in systems.items()])
        for i, t in enumerate(targets)
    ]
    return df.select(*keep, F.explode(F.array(*cells)).alias("_r")).select(*keep, "_r.*")


def _pairs(df: DataFrame, by: Sequence, systems: Sequence[str]) -> DataFrame:
    """Moments of target-stacked rows, long over systems."""
    m = moments(df, {s: (F.col(f"p_{s}"),) for s in systems}, ("y",), by)
    return m.drop("target") if "target" not in by else m


def wp_by_bucket(df: DataFrame, systems: Systems, spec: SequenceSpec, reference: str = "base") -> DataFrame:
    """Scores overall and by position, target size and reference-prediction size, with deltas.

    The sums are collected once per (target, position, size, size) cell; the four groupings are
    grouping sets over those few cells.
    """
    names = list(systems)
    rows = by_target(scored_rows(df), systems, keep=[STEP])
    rows = rows.select(
        F.col("target").alias("side"), "y", *[f"p_{s}" for s in names],
        position_bucket(STEP, spec.position_edges).alias("position"),
        magnitude_bucket("y").alias("target_magnitude"),
        magnitude_bucket(f"p_{reference}").alias("prediction_magnitude"),
    )
    cells = _pairs(rows, ["side", "position", "target_magnitude", "prediction_magnitude"], names)
    dims = ["position", "target_magnitude", "prediction_magnitude"]
    sets = [["system", "side"], *[["system", "side", d] for d in dims]]
    out = cells.groupingSets(
        [[F.col(c) for c in s] for s in sets], "system", "side", *dims
    ).agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS],
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
    )
    kind = F.lit("all")
    name = F.lit("all")
    for d in dims:
        kind = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(kind)
        name = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(name)
    scored = with_wp(out).select("system", F.col("side").alias("target"), kind.alias("slice"), name.alias("bucket"), "n", "wp")
    wide = scored.filter(F.col("bucket").isNotNull()).groupBy("target", "slice", "bucket").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("system") == s, F.col("wp"))).alias(f"{s}_wp") for s in names]
    )
    for s in names:
        if s != reference:
            wide = wide.withColumn(f"{s}_delta", F.col(f"{s}_wp") - F.col(f"{reference}_wp"))
    return wide


def wp_per_sequence(df: DataFrame, systems: Systems) -> DataFrame:
    """Score of every sequence that has scored rows."""
    return with_wp(moments(scored_rows(df), systems, by=[KEY]))


def sequence_spread(df: DataFrame, systems: Systems, reference: str = "base", candidate: str = "candidate") -> DataFrame:
    """Deciles of the per-sequence score and the share of sequences where the candidate is better."""
    per = settle(wp_per_sequence(df, systems).groupBy(KEY, "target").agg(
        *[F.max(F.when(F.col("system") == s, F.col("wp"))).alias(s) for s in (reference, candidate)]
    ))
    share = per.groupBy("target").agg(
        F.count("*").alias("sequences"),
        F.avg((F.col(candidate) > F.col(reference)).cast("double")).alias("better_share"),
    )
    deciles = many_quantiles(per, {reference: reference, candidate: candidate}, (0.1, 0.5, 0.9), by=["target"])
    rows = [(t, *q[reference], *q[candidate]) for (t,), q in deciles.items()]
    names = [f"{s}_{q}" for s in (reference, candidate) for q in ("q10", "q50", "q90")]
    table = df.sparkSession.createDataFrame(rows, "target string, " + ", ".join(f"{n} double" for n in names))
    return share.join(table, "target")


def wp_populations(df: DataFrame, systems: Systems, populations: dict[str, Column]) -> DataFrame:
    """The same predictions under several row weights (0/1 masks or focus weights), one scan."""
    focus = F.array(*[F.struct(F.lit(n).alias("population"), c.cast("double").alias("_f")) for n, c in populations.items()])
    rows = df.filter(F.col(NEED)).select("*", F.explode(focus).alias("_p")).select("*", "_p.*").filter(F.col("_f") > 0)
    return with_wp(moments(rows, systems, by=["population"], focus=F.col("_f")))


def within_wp(per_sequence: DataFrame, by: Sequence[str] = ("system", "target")) -> DataFrame:
    """Correlation of moments centered inside each sequence, and the covariance share between them."""
    m = per_sequence.filter(F.col("w") > 0)
    cov = F.col("wyp") - F.col("wy") * F.col("wp") / F.col("w")
    vy = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    vp = F.col("wpp") - F.col("wp") * F.col("wp") / F.col("w")
    out = m.groupBy(*by).agg(
        F.sum(cov).alias("_c"), F.sum(vy).alias("_y"), F.sum(vp).alias("_p"), *[F.sum(c).alias(c) for c in SUMS]
    )
    pooled = F.col("wyp") - F.col("wy") * F.col("wp") / F.col("w")
    return out.select(
        *by,
        (F.col("_c") / F.sqrt(F.greatest(F.col("_y") * F.col("_p"), F.lit(1e-30)))).alias("within_wp"),
        ((pooled - F.col("_c")) / pooled).alias("between_fraction"),
    )


def clipping_contrast(df: DataFrame, systems: Systems) -> DataFrame:
    """Score with and without clipping the prediction, from one scan."""
    both = {}
    rows = df
    for s, predictions in systems.items():
        both[f"{s}|clipped"] = [clip(p) for p in predictions]
        both[f"{s}|raw"] = list(predictions)
    aggs = []
    for name, predictions in both.items():
        for t, p in zip(("t0", "t1"), predictions):
            aggs += [F.sum(c).alias(f"{name}|{t}|{m}") for m, c in six(t, p, clip_prediction=False).items()]
    wide = scored_rows(rows).agg(*aggs)
    cells = [
        F.struct(F.lit(n.split("|")[0]).alias("system"), F.lit(n.split("|")[1]).alias("form"), F.lit(t).alias("target"),
                 *[F.col(f"`{n}|{t}|{m}`").alias(m) for m in SUMS])
        for n in both for t in ("t0", "t1")
    ]
    return with_wp(wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*"))


def strength_grid(
    df: DataFrame, base: Sequence, correction: Sequence, strengths: Sequence[float] = STRENGTHS,
    targets: Sequence[str] = ("t0", "t1"), by: Sequence = (), focus=None,
) -> DataFrame:
    """Sums and score of `base + s * correction` for all strengths in one scan."""
    systems = {str(s): [column(b) + column(c) * s for b, c in zip(base, correction)] for s in strengths}
    m = moments(df, systems, targets, by, focus)
    return with_wp(m.withColumn("strength", F.col("system").cast("double")).drop("system"))


def pick_strength(grid: DataFrame, by: Sequence[str] = ("target",), score: str = "wp") -> DataFrame:
    """Best strength per group; ties go to the smallest."""
    best = F.min_by(F.struct("strength", score), F.struct(-F.col(score), F.col("strength")))
    return grid.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.strength").alias("strength"), F.col(f"_b.{score}").alias(score))


def pick_minmax_strength(grid: DataFrame, population: str = "population") -> DataFrame:
    """Strength with the largest gain in its worst population."""
    zero = grid.filter(F.col("strength") == 0.0).select(population, "target", F.col("wp").alias("_zero"))
    gains = grid.join(zero, [population, "target"]).withColumn("gain", F.col("wp") - F.col("_zero"))
    worst = gains.groupBy("target", "strength").agg(F.min("gain").alias("gain"))
    return pick_strength(worst, ["target"], "gain")


# The affine output grid.
AFFINE_SCALES = (0.75, 0.9, 1.0, 1.1, 1.25)
AFFINE_BIASES = (-0.1, 0.0, 0.1)


def affine_grid(df: DataFrame, predictions: Sequence[str] = ("p0", "p1"), targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Score of `p * scale + bias` over the fixed grid, all cells in one scan."""
    systems = {
        f"{s}/{b}": [F.col(p) * s + b for p in predictions] for s in AFFINE_SCALES for b in AFFINE_BIASES
    }
    m = with_wp(moments(scored_rows(df), systems, targets))
    halves = F.split("system", "/")
    return m.select(halves[0].cast("double").alias("scale"), halves[1].cast("double").alias("bias"), "target", "wp")


def best_affine(grid: DataFrame) -> DataFrame:
    """Best cell per target; ties go to the first in grid order."""
    order = F.struct(-F.col("wp"), F.col("scale"), F.col("bias"))
    best = F.min_by(F.struct("scale", "bias", "wp"), order)
    return grid.groupBy("target").agg(best.alias("_b")).select("target", "_b.*")


def weighted_mse(df: DataFrame, systems: Systems, by: Sequence[str] = ()) -> DataFrame:
    """Weighted squared error of raw and clipped predictions against the clipped target."""
    rows = by_target(scored_rows(df), systems, keep=list(by))
    y = clip("y")
    w = F.abs(y)
    aggs = [F.sum(w).alias("_w")]
    for s in systems:
        p = F.col(f"p_{s}")
        aggs += [F.sum(w * (y - p) * (y - p)).alias(f"_raw_{s}"), F.sum(w * (y - clip(p)) * (y - clip(p))).alias(f"_clip_{s}")]
    wide = rows.groupBy(*by, "target").agg(*aggs)
    cells = [F.struct(F.lit(s).alias("system"), (F.col(f"_raw_{s}") / F.col("_w")).alias("raw_mse"),
                      (F.col(f"_clip_{s}") / F.col("_w")).alias("clipped_mse")) for s in systems]
    return wide.select(*by, "target", F.explode(F.array(*cells)).alias("_c")).select(*by, "target", "_c.*")


def saturation(df: DataFrame, systems: Systems) -> DataFrame:
    """Shares of saturated predictions, weighted means and the tangent slope of the score."""
    rows = by_target(scored_rows(df), systems)
    y = clip("y")
    w = F.abs(y)
    names = list(systems)
    aggs = [F.count("*").alias("rows"), F.sum(w).alias("_w"), F.sum(w * y).alias("_wy")]
    for s in names:
        p, full = F.col(f"p_{s}"), (F.abs(F.col(f"p_{s}")) >= 2).cast("double")
        q = clip(p)
        aggs += [F.avg(full).alias(f"{s}|share"), F.sum(w * full).alias(f"{s}|wfull"), F.sum(w * p).alias(f"{s}|wraw"),
                 F.sum(w * q).alias(f"{s}|wp"), F.sum(w * q * q).alias(f"{s}|wpp"), F.sum(w * y * q).alias(f"{s}|wyp")]
    wide = rows.groupBy("target").agg(*aggs)
    cells = []
    for s in names:
        c = {k: F.col(f"`{s}|{k}`") for k in ("share", "wfull", "wraw", "wp", "wpp", "wyp")}
        slope = (c["wyp"] - F.col("_wy") * c["wp"] / F.col("_w")) / (c["wpp"] - c["wp"] * c["wp"] / F.col("_w"))
        cells.append(F.struct(
            F.lit(s).alias("system"), c["share"].alias("saturated_share"), (c["wfull"] / F.col("_w")).alias("saturated_weight_share"),
            (c["wp"] / F.col("_w")).alias("mean_clipped"), (c["wraw"] / F.col("_w")).alias("mean_raw"), slope.alias("tangent_slope"),
        ))
    out = wide.select("target", "rows", (F.col("_wy") / F.col("_w")).alias("mean_target"), F.explode(F.array(*cells)).alias("_c"))
    return out.select("target", "rows", "mean_target", "_c.*")


def residual(y, p, kind: str = "clipped") -> Column:
    """`clip(y) - clip(p)` or the raw difference."""
    return clip(y) - clip(p) if kind == "clipped" else column(y) - column(p)


def residual_summary(df: DataFrame, predictions: Sequence[str] = ("p0", "p1"), targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Mean and deviation of raw residuals, prediction quantiles, correlation across targets."""
    rows = scored_rows(df)
    res = [residual(t, p, "raw") for t, p in zip(targets, predictions)]
    stats = rows.agg(
        *[F.avg(e).alias(f"m{i}") for i, e in enumerate(res)], *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(res)],
        F.corr(res[0], res[1]).alias("c"),
    ).first()
    found = many_quantiles(rows, dict(zip(targets, predictions)), (0.0, 0.01, 0.5, 0.99, 1.0))[()]
    out = [(t, stats[f"m{i}"], stats[f"s{i}"], stats["c"], *found[t]) for i, t in enumerate(targets)]
    return df.sparkSession.createDataFrame(
        out, "target string, residual_mean double, residual_std double, cross_target_corr double, "
        "q00 double, q01 double, q50 double, q99 double, q100 double")


def residual_bias_scale(df: DataFrame, systems: Systems) -> DataFrame:
    """Weighted bias and scale of clipped residuals."""
    rows = by_target(scored_rows(df), systems)
    w = F.abs(clip("y"))
    aggs = [F.count("*").alias("n"), F.sum(w).alias("_w")]
    for s in systems:
        e = residual("y", f"p_{s}")
        aggs += [F.sum(w * e).alias(f"_e_{s}"), F.sum(w * e * e).alias(f"_ee_{s}")]
    wide = rows.groupBy("target").agg(*aggs)
    cells = []
    for s in systems:
        bias = F.col(f"_e_{s}") / F.col("_w")
        scale = F.sqrt(F.greatest(F.col(f"_ee_{s}") / F.col("_w") - bias * bias, F.lit(0.0)))
        ok = F.col("_w") > 1e-12
        cells.append(F.struct(F.lit(s).alias("system"), F.when(ok, bias).otherwise(F.lit(0.0)).alias("bias"),
                              F.when(ok, scale).otherwise(F.lit(0.0)).alias("scale")))
    return wide.select("target", "n", F.explode(F.array(*cells)).alias("_c")).select("target", "n", "_c.*")


def residual_persistence(df: DataFrame, systems: Systems, spec: SequenceSpec, distances: Sequence[int] = (1, 10, 100),
                         targets: Sequence[str] = ("t0", "t1"), kind: str = "clipped") -> DataFrame:
    """Correlation of residuals exactly `distance` rows apart, both scored, inside one sequence."""
    names = list(systems)
    value = F.struct((F.col(NEED) & F.col(SCORED)).alias("m"), *[
        residual(t, p, kind).alias(f"{s}_{t}") for s in names for t, p in zip(targets, systems[s])
    ])
    rows = df.select(KEY, STEP, value.alias("_r"))
    rows = lags(rows, {f"_l{d}": ("_r", d) for d in distances}, spec)
    pairs = F.array(*[F.struct(F.lit(d).alias("lag"), F.col(f"_l{d}").alias("b")) for d in distances])
    paired = rows.filter("_r.m").select(F.col("_r").alias("a"), F.explode(pairs).alias("_x")).select("a", "_x.*").filter("b.m")
    aggs = [F.count("*").alias("n")]
    for s in names:
        for t in targets:
            a, b = F.col(f"a.{s}_{t}"), F.col(f"b.{s}_{t}")
            for k, e in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b)):
                aggs.append(F.sum(e).alias(f"{s}|{t}|{k}"))
    wide = paired.groupBy("lag").agg(*aggs)
    cells = []
    for s in names:
        for t in targets:
            c = [F.col(f"`{s}|{t}|{k}`") for k in ("a", "b", "aa", "bb", "ab")]
            cells.append(F.struct(F.lit(s).alias("system"), F.lit(t).alias("target"), correlation(F.col("n"), *c).alias("corr")))
    return wide.select("lag", "n", F.explode(F.array(*cells)).alias("_c")).select("lag", "n", "_c.*")


def adjacent_scored_cosine(df: DataFrame, spec: SequenceSpec, predictions: Sequence[str] = ("p0", "p1"),
                           targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Uncentered cosine between consecutive scored rows, and across the two targets."""
    e = {t: residual(t, p, "raw") for t, p in zip(targets, predictions)}
    rows = df.select(KEY, STEP, NEED, SCORED, *[c.alias(t) for t, c in e.items()])
    paired = previous_marked(rows, F.col(NEED) & F.col(SCORED), {t: F.col(t) for t in targets}, spec)
    aggs = [F.sum(F.col(targets[0]) * F.col(targets[1])).alias("x"), *[F.sum(F.col(t) * F.col(t)).alias(f"s_{t}") for t in targets]]
    for t in targets:
        a, b = F.col(t), F.col(f"prev_{t}")
        aggs += [F.sum(a * b).alias(f"ab_{t}"), F.sum(F.when(b.isNotNull(), a * a)).alias(f"aa_{t}"), F.sum(b * b).alias(f"bb_{t}")]
    wide = paired.agg(*aggs)
    cross = F.col("x") / F.sqrt(F.col(f"s_{targets[0]}") * F.col(f"s_{targets[1]}"))
    return wide.select(
        *[(F.col(f"ab_{t}") / F.sqrt(F.col(f"aa_{t}") * F.col(f"bb_{t}"))).alias(f"adjacent_{t}") for t in targets],
        cross.alias("cross_target"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without NULL rows, as one matrix over the Arrow buffer."""
    full = column.drop_null() if column.null_count else column
    flat = full.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(full), -1) if len(full) else np.empty((0, 0))


def _relation_partials(distances: Sequence[int], systems: Sequence[str], targets: Sequence[str]):
    """Per-partition sums of w, wx, wxx, wr, wrr, wxr for every feature, as matrix products."""
    pairs = [(t, s) for t in targets for s in systems]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            w = np.column_stack([batch.column(f"w_{t}").to_numpy(zero_copy_only=False) for t, _ in pairs])
            e = np.column_stack([batch.column(f"r_{s}_{t}").to_numpy(zero_copy_only=False) for t, s in pairs])
            for d in distances:
                lagged = batch.column(f"x{d}")
                ok = lagged.is_valid().to_numpy(zero_copy_only=False)
                if not ok.any():
                    continue
                x, wd, ed = _matrix(lagged), w[ok], e[ok]
                we = wd * ed
                # Per (target, system): scalars n, w, wr, wrr, then vectors wx, wxx, wxr.
                facts = np.stack([np.full(len(pairs), float(len(x))), wd.sum(0), we.sum(0), (we * ed).sum(0)])
                new = [facts, wd.T @ x, wd.T @ (x * x), we.T @ x]
                old = total.get(d)
                total[d] = new if old is None else [p + q for p, q in zip(old, new)]
        for d, (facts, wx, wxx, wxr) in total.items():
            width = wx.shape[1]
            for i, (t, s) in enumerate(pairs):
                yield pa.RecordBatch.from_pydict({
                    "feature": pa.array(np.arange(width), pa.int32()), "lag": pa.array(np.full(width, d), pa.int32()),
                    "target": [t] * width, "system": [s] * width, "n": np.full(width, facts[0, i]), "w": np.full(width, facts[1, i]),
                    "wx": wx[i], "wxx": wxx[i], "wr": np.full(width, facts[2, i]), "wrr": np.full(width, facts[3, i]), "wxr": wxr[i]})

    return run


def feature_residual_corr(df: DataFrame, features: Sequence[str], systems: Systems, spec: SequenceSpec,
                          distances: Sequence[int] = (0, 1, 10, 100), targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Weighted correlation of each feature, `lag` rows back, with the clipped residual.

    Features travel as one array, so all lags are array lookups in one window; the sums over all
    features are matrix products per partition, and only (feature, lag, target, system) sums shuffle.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(
        KEY, STEP, (F.col(NEED) & F.col(SCORED)).alias("_m"), vector.alias("_x"),
        *[F.abs(clip(t)).cast("double").alias(f"w_{t}") for t in targets],
        *[residual(t, p).cast("double").alias(f"r_{s}_{t}") for s in systems for t, p in zip(targets, systems[s])],
    )
    rows = lags(rows, {f"x{d}": ("_x", d) for d in distances}, spec).filter("_m").drop("_m", "_x", KEY, STEP)
    schema = "feature int, lag int, target string, system string, n double, w double, wx double, wxx double, wr double, wrr double, wxr double"
    parts = rows.mapInArrow(_relation_partials(distances, list(systems), targets), schema)
    sums = parts.groupBy("feature", "lag", "target", "system").agg(*[F.sum(c).alias(c) for c in ("n", "w", "wx", "wxx", "wr", "wrr", "wxr")])
    w = F.col("w")
    vx = F.greatest(F.col("wxx") - F.col("wx") * F.col("wx") / w, F.lit(0.0))
    vr = F.greatest(F.col("wrr") - F.col("wr") * F.col("wr") / w, F.lit(0.0))
    value = clip((F.col("wxr") - F.col("wx") * F.col("wr") / w) / F.sqrt(vx * vr), -1.0, 1.0)
    ok = (w > 1e-12) & (vx > 1e-16) & (vr > 1e-16)
    return sums.select("feature", "lag", "target", "system", F.col("n").cast("bigint").alias("n"),
                       F.when(ok, value).otherwise(F.lit(0.0)).alias("corr"))


def feature_group_rms(relations: DataFrame, groups: dict[str, Sequence[int]]) -> DataFrame:
    """Root mean square of the correlations in each named feature group."""
    owner = F.lit(None).cast("string")
    for name, members in groups.items():
        owner = F.when(F.col("feature").isin([int(m) for m in members]), F.lit(name)).otherwise(owner)
    tagged = relations.withColumn("feature_group", owner).filter(F.col("feature_group").isNotNull())
    return tagged.groupBy("feature_group", "lag", "target", "system").agg(
        F.max("n").alias("n"), F.sqrt(F.avg(F.col("corr") * F.col("corr"))).alias("rms_corr"))


def top_k_features(df: DataFrame, features: Sequence[str], predictions: Sequence[str], k: int = 8,
                   targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """The k features most correlated with the raw residual of each target."""
    res = {t: residual(t, p, "raw") for t, p in zip(targets, predictions)}
    wide = df.agg(*[F.corr(F.col(f), e).alias(f"{f}|{t}") for f in features for t, e in res.items()])
    cells = [F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(f"`{f}|{t}`").alias("corr"))
             for f in features for t in targets]
    long = wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.abs("corr").desc_nulls_last(), "feature"))
    return long.withColumn("rank", rank).filter(F.col("rank") <= k)


def prediction_agreement(df: DataFrame, a: Sequence[str], b: Sequence[str], targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Correlation of two systems' predictions and of their residuals."""
    rows = by_target(scored_rows(df), {"a": a, "b": b})
    return rows.groupBy("target").agg(
        F.corr("p_a", "p_b").alias("prediction_corr"),
        F.corr(F.col("y") - F.col("p_a"), F.col("y") - F.col("p_b")).alias("residual_corr"),
    )


def error_atlas(df: DataFrame, features: Sequence[str], groups: dict[str, Sequence[int]], systems: Systems, spec: SequenceSpec,
                distances: Sequence[int] = (1, 10, 100)) -> DataFrame:
    """All error sections as one tidy table `(section, target, system, bucket, lag, n, value)`."""
    buckets = wp_by_bucket(df, systems, spec)
    cells = F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"{s}_wp").alias("value")) for s in systems])
    parts = [
        buckets.select(F.concat(F.lit("wp_"), F.col("slice")).alias("section"), "target", "bucket", "n", F.explode(cells).alias("_c"))
        .select("section", "target", F.col("_c.system").alias("system"), "bucket", F.lit(0).alias("lag"), "n", F.col("_c.value").alias("value"))
    ]
    bias = residual_bias_scale(df, systems)
    both = F.array(*[F.struct(F.lit(f"residual_{k}").alias("section"), F.col(k).alias("value")) for k in ("bias", "scale")])
    parts.append(bias.select("target", "system", "n", F.explode(both).alias("_c")).select(
        "_c.section", "target", "system", F.lit("all").alias("bucket"), F.lit(0).alias("lag"), "n", "_c.value"))
    parts.append(residual_persistence(df, systems, spec, distances).select(
        F.lit("residual_persistence").alias("section"), "target", "system", F.lit("all").alias("bucket"), "lag", "n", F.col("corr").alias("value")))
    relations = feature_residual_corr(df, features, systems, spec, (0, *distances))
    parts.append(feature_group_rms(relations, groups).select(
        F.lit("feature_relation").alias("section"), "target", "system", F.col("feature_group").alias("bucket"), "lag", "n", F.col("rms_corr").alias("value")))
    first, *others = systems
    for other in others:
        parts.append(_sequence_section(sequence_spread(df, systems, first, other), first, other))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["section", "target", "system", "bucket", "lag"]) if len(others) > 1 else out


def _sequence_section(spread: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Atlas rows of the per-sequence scores: deciles of both systems and the share of sequences where the candidate is better."""
    cells = [F.struct(F.lit("sequence_score").alias("section"), F.lit(s).alias("system"), F.lit(q).alias("bucket"), F.col(f"{s}_{q}").alias("value"))
             for s in (reference, candidate) for q in ("q10", "q50", "q90")]
    cells.append(F.struct(F.lit("sequence_better").alias("section"), F.lit(candidate).alias("system"), F.lit("all").alias("bucket"), F.col("better_share").alias("value")))
    rows = spread.select("target", "sequences", F.explode(F.array(*cells)).alias("_c"))
    return rows.select("_c.section", "target", "_c.system", "_c.bucket", F.lit(0).alias("lag"), F.col("sequences").alias("n"), "_c.value")


ATLAS_SCHEMA = {"section": "string", "target": "string", "system": "string", "bucket": "string", "lag": "int", "n": "bigint", "value": "double"}


def check_atlas(atlas: DataFrame) -> DataFrame:
    """Refuse an atlas with other columns or types, or with rows outside the allowed ranges."""
    actual = {f.name: f.dataType.simpleString() for f in atlas.schema}
    if actual != ATLAS_SCHEMA:
        raise ValueError(f"atlas schema {actual}")
    known = ["wp_all", "wp_position", "wp_target_magnitude", "wp_prediction_magnitude", "residual_bias", "residual_scale",
             "residual_persistence", "feature_relation", "sequence_score", "sequence_better"]
    bad = ~F.col("section").isin(known) | F.col("value").isNull() | F.isnan("value") | (F.col("n") < 0)
    score = F.col("section").startswith("wp_") | F.col("section").isin("residual_persistence", "feature_relation")
    return atlas.filter(bad | (score & (F.abs("value") > 1.0)))


def atlas_json(atlas: DataFrame) -> DataFrame:
    """One JSON text per section; sections are small by construction."""
    row = F.struct("target", "system", "bucket", "lag", "n", F.round("value", 6).alias("value"))
    return atlas.groupBy("section").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("report"))


