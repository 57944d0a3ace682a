"""Weighted correlation scores (WP) from six mergeable sums.

For a target y and a prediction p, both clipped to +-2, the weight is |y| times an optional focus.
The sums w, wy, wp, wyy, wpp, wyp add over rows, partitions and sequences; a score is computed from
pooled sums only, never by averaging scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, column
from seqloom.layout import KEY, NEED, SCORED

SUMS = ("w", "wy", "wp", "wyy", "wpp", "wyp")
Systems = dict[str, Sequence]  # name -> one prediction column per target


def six(y, p, focus=None, clip_prediction: bool = True) -> dict[str, Column]:
    """Row contributions to the six sums."""
    y = clip(y).cast("double")
    p = (clip(p) if clip_prediction else column(p)).cast("double")
    w = F.abs(y) if focus is None else F.abs(y) * column(focus)
    return {"w": w, "wy": w * y, "wp": w * p, "wyy": w * y * y, "wpp": w * p * p, "wyp": w * y * p}


def moments(
    df: DataFrame,
    systems: Systems,
    targets: Sequence[str] = ("t0", "t1"),
    by: Sequence = (),
    focus=None,
    clip_prediction: bool = True,
) -> DataFrame:
    """Long table `(by..., system, target, n, six sums)` from one aggregation without row expansion."""
    aggs = [F.count("*").alias("n")]
    for s, predictions in systems.items():
        for t, p in zip(targets, predictions):
            parts = six(t, p, focus, clip_prediction)
            aggs += [F.sum(c).alias(f"{s}|{t}|{m}") for m, c in parts.items()]
    wide = df.groupBy(*by).agg(*aggs)
    keys = [c for c in wide.columns if c != "n" and "|" not in c]
    return unpack(wide, keys, list(systems), targets)


def unpack(wide: DataFrame, keys: Sequence[str], systems: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Wide sums `system|target|sum` to long rows."""
    cells = [
        F.struct(F.lit(s).alias("system"), F.lit(t).alias("target"), *[F.col(f"`{s}|{t}|{m}`").alias(m) for m in SUMS])
        for s in systems
        for t in targets
    ]
    count = ["n"] if "n" in wide.columns else []
    return wide.select(*keys, *count, F.explode(F.array(*cells)).alias("_c")).select(*keys, *count, "_c.*")


def pack(long: DataFrame, keys: Sequence[str], systems: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Inverse of `unpack`: one row per key."""
    cells = [
        F.sum(F.when((F.col("system") == s) & (F.col("target") == t), F.col(m))).alias(f"{s}|{t}|{m}")
        for s in systems
        for t in targets
        for m in SUMS
    ]
    return long.groupBy(*keys).agg(*cells)


def wp(prefix: str = "", sums: dict[str, Column] | None = None, guard: bool = True) -> Column:
    """Score from six sums; 0 for tiny weight or variance, limited to +-1."""
    w, wy, wp_, wyy, wpp, wyp = [sums[m] for m in SUMS] if sums else [F.col(f"`{prefix}{m}`") for m in SUMS]
    safe = F.greatest(w, F.lit(1e-300))
    vy = F.greatest(wyy - wy * wy / safe, F.lit(0.0))
    vp = F.greatest(wpp - wp_ * wp_ / safe, F.lit(0.0))
    value = (wyp - wy * wp_ / safe) / F.sqrt(vy * vp)
    ok = (w >= 1e-8) & (vy / safe > 1e-16) & (vp / safe > 1e-16)
    return F.when(ok, clip(value, -1.0, 1.0)).otherwise(F.lit(0.0)) if guard else value


def add_sums(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge moment rows."""
    extra = ["n"] if "n" in df.columns else []
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*extra, *SUMS)])


def with_wp(df: DataFrame, name: str = "wp") -> DataFrame:
    return df.withColumn(name, wp())


def required_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(NEED))


def scored_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(NEED) & F.col(SCORED))


def global_wp(df: DataFrame, systems: Systems, targets: Sequence[str] = ("t0", "t1"), require: bool = True) -> DataFrame:
    """`(system, rows, t0, t1, combined)`; combined is the mean over targets."""
    m = with_wp(moments(scored_rows(df), systems, targets))
    out = m.groupBy("system").agg(
        F.first("n").alias("rows"), *[F.max(F.when(F.col("target") == t, F.col("wp"))).alias(t) for t in targets]
    )
    total = sum((F.col(t) for t in targets), F.lit(0.0)) / float(len(targets))
    out = out.withColumn("combined", total)
    if require:
        none = F.raise_error(F.lit("no rows selected by the scoring mask")).cast("bigint")
        out = out.withColumn("rows", F.when(F.col("rows") > 0, F.col("rows")).otherwise(none))
    return out


def wp_report(df: DataFrame, systems: Systems, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """`global_wp` plus sequence counts; counted per sequence first, so nothing is collected in a set."""
    marked = df.withColumn("_s", (F.col(NEED) & F.col(SCORED)).cast("int"))
    per = marked.groupBy(KEY).agg(F.sum("_s").alias("_k"))
    counts = per.agg(
        F.count("*").alias("sequences"),
        F.sum((F.col("_k") > 0).cast("bigint")).alias("sequences_with_scored_rows"),
    )
    return global_wp(df, systems, targets).crossJoin(F.broadcast(counts))  # one row


def two_pass_wp(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Centered form of the score: means first, then centered sums. Guards on standard deviations."""
    base = df.select(*by, clip(y).cast("double").alias("_y"), clip(p).cast("double").alias("_p"))
    base = base.withColumn("_w", F.abs("_y"))
    means = base.groupBy(*by).agg(
        F.sum("_w").alias("_m"),
        (F.sum(F.col("_w") * F.col("_y")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_my"),
        (F.sum(F.col("_w") * F.col("_p")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_mp"),
    )
    # Without groups this is one row; with groups Spark sizes the join itself.
    joined = base.join(means, list(by)) if by else base.crossJoin(F.broadcast(means))
    dy, dp = F.col("_y") - F.col("_my"), F.col("_p") - F.col("_mp")
    sums = joined.groupBy(*by).agg(
        F.max("_m").alias("_m"),
        F.sum(F.col("_w") * dy * dy).alias("_yy"),
        F.sum(F.col("_w") * dp * dp).alias("_pp"),
        F.sum(F.col("_w") * dy * dp).alias("_yp"),
    )
    sy, sp = F.sqrt(F.col("_yy") / F.col("_m")), F.sqrt(F.col("_pp") / F.col("_m"))
    value = clip(F.col("_yp") / F.col("_m") / (sy * sp), -1.0, 1.0)
    ok = (F.col("_m") >= 1e-8) & (sy > 1e-8) & (sp > 1e-8)
    return sums.select(*by, F.when(ok, value).otherwise(F.lit(0.0)).alias("wp"))


CENTERED = "weight double, mean_y double, mean_p double, m2_y double, m2_p double, cross double"


def _merge_blocks(blocks: pd.DataFrame) -> dict[str, float]:
    """Pairwise-variance merge of centered blocks, in one vectorized step around the pooled mean."""
    b = blocks[blocks["weight"] > 0]
    total = float(b["weight"].sum())
    if total <= 0:
        return dict.fromkeys(["weight", "mean_y", "mean_p", "m2_y", "m2_p", "cross"], 0.0)
    my, mp = float((b["weight"] * b["mean_y"]).sum() / total), float((b["weight"] * b["mean_p"]).sum() / total)
    dy, dp = b["mean_y"] - my, b["mean_p"] - mp
    return {
        "weight": total, "mean_y": my, "mean_p": mp,
        "m2_y": float((b["m2_y"] + b["weight"] * dy * dy).sum()),
        "m2_p": float((b["m2_p"] + b["weight"] * dp * dp).sum()),
        "cross": float((b["cross"] + b["weight"] * dy * dp).sum()),
    }


def centered_moments(df: DataFrame, y: str, p: str, limit: float | None = 2.0) -> DataFrame:
    """One centered moment row for the whole table, safe where means dwarf the spread.

    Every partition sends one block; blocks merge around the pooled mean. Use it for unclipped data;
    the plain sums are enough for data limited to +-2.
    """

    def blocks(batches):
        state = None
        for pdf in batches:
            yv, pv = pdf["y"].to_numpy(float), pdf["p"].to_numpy(float)
            if limit is not None:
                yv, pv = yv.clip(-limit, limit), pv.clip(-limit, limit)
            # A row without both numbers is left out, not the batch it came in.
            both = ~(np.isnan(yv) | np.isnan(pv))
            yv, pv = yv[both], pv[both]
            w = abs(yv)
            total = w.sum()
            if total == 0:
                continue
            my, mp = (w * yv).sum() / total, (w * pv).sum() / total
            row = {"weight": total, "mean_y": my, "mean_p": mp, "m2_y": (w * (yv - my) ** 2).sum(),
                   "m2_p": (w * (pv - mp) ** 2).sum(), "cross": (w * (yv - my) * (pv - mp)).sum()}
            rows = [row] if state is None else [state, row]
            state = _merge_blocks(pd.DataFrame(rows))
        if state is not None:
            yield pd.DataFrame([state])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_merge_blocks(pdf)])

    partial = df.select(column(y).alias("y"), column(p).alias("p")).mapInPandas(blocks, CENTERED)
    # Two rounds: blocks per hashed group of partitions, then at most 64 rows in the last one.
    grouped = partial.withColumn("_g", F.pmod(F.hash("weight", "cross"), F.lit(64)))
    middle = grouped.groupBy("_g").applyInPandas(lambda g: merge(g), CENTERED)
    return middle.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda g: merge(g), CENTERED)


def centered_wp() -> Column:
    sy, sp = F.sqrt(F.greatest(F.col("m2_y") / F.col("weight"), F.lit(0.0))), F.sqrt(F.greatest(F.col("m2_p") / F.col("weight"), F.lit(0.0)))
    ok = (F.col("weight") >= 1e-8) & (sy > 1e-8) & (sp > 1e-8)
    return F.when(ok, clip(F.col("cross") / F.col("weight") / (sy * sp), -1.0, 1.0)).otherwise(F.lit(0.0))
