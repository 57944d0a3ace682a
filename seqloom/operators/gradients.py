"""Gradients of the pooled score with respect to linear correction coefficients.

Per sequence, target and feature the sums of w*f, w*y*f and w*p*f over unsaturated rows are kept;
they add over sequences like the six score sums, and the gradient is arithmetic on pooled sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, column
from seqloom.layout import KEY, SequenceSpec
from seqloom.operators.resampling import bootstrap_sums
from seqloom.operators.ridge import present
from seqloom.operators.sampling import required_rank
from seqloom.operators.scoring import SUMS, moments
from seqloom.session import settle

CROSS = ("f0", "fy", "fp")


def gradient_moments(df: DataFrame, features: Sequence, base: Sequence, targets: Sequence[str] = ("t0", "t1"),
                     by: Sequence[str] = (KEY,), focus=None) -> DataFrame:
    """Long table `(by..., target, feature, f0, fy, fp)`; feature products are matrix products per task.

    A row with a NULL or NaN feature is left out; a NULL or NaN target, prediction or focus leaves it out for that target.
    """
    keys = list(by)
    parts = [column(f).cast("double") for f in features]
    vector = F.array(*parts)
    whole = reduce(and_, [present(c) for c in parts], F.lit(True))
    cols = [F.col(k) for k in keys]
    for i, (t, p) in enumerate(zip(targets, base)):
        w = F.abs(clip(t)) * (focus if focus is not None else F.lit(1.0))
        usable = present(F.col(t)) & present(column(p)) & present(w)
        active = F.when(usable & (F.abs(column(p)) < 2), w).otherwise(F.lit(0.0))
        cols += [active.alias(f"_a{i}"), *[F.when(active == 0, F.lit(0.0)).otherwise(active * clip(c)).alias(f"_{k}{i}") for k, c in (("y", t), ("p", p))]]
    rows = df.filter(whole).select(*cols, vector.alias("_f"))
    width, count = len(features), len(targets)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) if keys else ""

    def emit(total: dict) -> pd.DataFrame:
        out = []
        for key, sums in total.items():
            for i in range(count):
                part = pd.DataFrame({"target": targets[i], "feature": np.arange(width), "f0": sums[3 * i], "fy": sums[3 * i + 1], "fp": sums[3 * i + 2]})
                for k, v in zip(keys, key):
                    part.insert(0, k, v)
                out.append(part)
        return pd.concat(out)[[*keys, "target", "feature", *CROSS]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                f = np.concatenate(part["_f"].to_numpy()).astype(float).reshape(len(part), width)
                sums = np.stack([part[f"_{k}{i}"].to_numpy(float) @ f for i in range(count) for k in "ayp"])
                total[key] = sums if key not in total else total[key] + sums
            if len(total) > 512:  # keep the state small where sequences are not clustered
                yield emit(total)
                total = {}
        if total:
            yield emit(total)

    schema = (key_schema + ", " if key_schema else "") + "target string, feature int, f0 double, fy double, fp double"
    sums = rows.mapInPandas(run, schema)
    return sums.groupBy(*keys, "target", "feature").agg(*[F.sum(c).alias(c) for c in CROSS])


def wp_gradient(stats: DataFrame, cross: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Derivative of the pooled score per (by..., target, feature). Degenerate populations are errors."""
    w, wy, wp, wyy, wpp, wyp = (F.col(m) for m in SUMS)
    my, mp = wy / w, wp / w
    vy, vp, cov = wyy - wy * my, wpp - wp * mp, wyp - wy * mp
    stop = F.raise_error(F.lit("degenerate objective population")).cast("double")
    facts = stats.select(
        *by, "target", F.when((w > 0) & (vy > 1e-12) & (vp > 1e-12), my).otherwise(stop).alias("_my"), mp.alias("_mp"),
        (cov / vp).alias("_slope"), F.sqrt(vy * vp).alias("_d"))
    joined = cross.join(facts, [*by, "target"])
    g = (F.col("fy") - F.col("_my") * F.col("f0") - F.col("_slope") * (F.col("fp") - F.col("_mp") * F.col("f0"))) / F.col("_d")
    return joined.select(*by, "target", "feature", g.alias("gradient"))


def pooled_gradient(df: DataFrame, features: Sequence, base: Sequence, targets: Sequence[str] = ("t0", "t1"), by: Sequence[str] = (), focus=None) -> DataFrame:
    """Gradient of all rows of `df`, per group."""
    stats = moments(df, {"base": base}, targets, by, focus)
    return wp_gradient(stats, gradient_moments(df, features, base, targets, by, focus), by)


def gradient_cosine(a: DataFrame, b: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Cosine and norms of two gradients."""
    joined = a.withColumnRenamed("gradient", "_a").join(b.withColumnRenamed("gradient", "_b"), [*by, "feature"])
    na, nb = F.sqrt(F.sum(F.col("_a") * F.col("_a"))), F.sqrt(F.sum(F.col("_b") * F.col("_b")))
    return joined.groupBy(*by).agg(
        (F.sum(F.col("_a") * F.col("_b")) / F.greatest(na * nb, F.lit(1e-30))).alias("cosine"), na.alias("norm_a"), nb.alias("norm_b"))


def thinning_check(df: DataFrame, features: Sequence, base: Sequence, stride: int, spec: SequenceSpec) -> DataFrame:
    """Gradient of each stride phase against the gradient of all required rows.

    Sums are kept per phase; the full gradient is their total, so all phases cost one scan.
    """
    rows = required_rank(df, spec).withColumn("phase", F.pmod(F.col("_k"), F.lit(stride)).cast("int"))
    stats = settle(moments(rows, {"base": base}, by=["phase"]))
    cross = settle(gradient_moments(rows, features, base, by=["phase"]))
    full = wp_gradient(stats.groupBy("target").agg(*[F.sum(c).alias(c) for c in SUMS]),
                       cross.groupBy("target", "feature").agg(*[F.sum(c).alias(c) for c in CROSS]))
    each = wp_gradient(stats, cross, ["phase"])
    joined = each.join(full.withColumnRenamed("gradient", "_g"), ["target", "feature"])
    dot, a, b = (F.sum(F.col(x) * F.col(y)) for x, y in (("gradient", "_g"), ("gradient", "gradient"), ("_g", "_g")))
    gap = F.sum((F.col("gradient") - F.col("_g")) * (F.col("gradient") - F.col("_g")))
    out = joined.groupBy("phase", "target").agg((dot / F.sqrt(a * b)).alias("cosine"), F.sqrt(gap / b).alias("relative_error"))
    return out.join(stats.filter(F.col("target") == "t0").select("phase", F.col("n").alias("rows")), "phase")


def gradient_noise(df: DataFrame, features: Sequence, base: Sequence, draws: int, seed: int, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Norm of the gradient, bootstrap noise norm, their ratio, and the share of draws along the gradient."""
    width = len(features)
    stats = settle(moments(df, {"base": base}, targets, [KEY]))
    cross = settle(gradient_moments(df, features, base, targets, [KEY]))
    place = {m: i for i, m in enumerate(SUMS)}
    cells = F.array(*[F.struct(F.lit(place[m]).alias("i"), F.col(m).alias("v")) for m in SUMS])
    target_no = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col("target")) - 1
    block = 6 + 3 * width
    a = stats.select(KEY, target_no.alias("_t"), F.explode(cells).alias("_c")).select(KEY, (F.col("_t") * block + F.col("_c.i")).alias("i"), "_c.v")
    crosses = F.array(*[F.struct((F.lit(6 + k * width) + F.col("feature")).alias("i"), F.col(c).alias("v")) for k, c in enumerate(CROSS)])
    b = cross.select(KEY, target_no.alias("_t"), F.explode(crosses).alias("_c")).select(KEY, (F.col("_t") * block + F.col("_c.i")).alias("i"), "_c.v")
    entry = F.sort_array(F.collect_list(F.struct("i", "v")))  # a fixed number of cells per sequence
    vectors = settle(a.unionByName(b).groupBy(KEY).agg(F.transform(entry, lambda p: p["v"]).alias("vec")))
    sums = bootstrap_sums(vectors, draws, seed).select("draw", F.posexplode("sums").alias("position", "value"))
    # One draw holds (6 + 3 * features) values per target.
    long = sums.withColumns({"t": F.floor(F.col("position") / block).cast("int"), "i": F.pmod(F.col("position"), F.lit(block))})
    label = F.element_at(F.array(*[F.lit(t) for t in targets]), F.col("t") + 1)
    s = long.filter(F.col("i") < 6).groupBy("draw", label.alias("target")).agg(
        *[F.max(F.when(F.col("i") == place[m], F.col("value"))).alias(m) for m in SUMS])
    which = F.floor((F.col("i") - 6) / width)
    c = long.filter(F.col("i") >= 6).groupBy("draw", label.alias("target"), F.pmod(F.col("i") - 6, F.lit(width)).cast("int").alias("feature")).agg(
        *[F.max(F.when(which == k, F.col("value"))).alias(n) for k, n in enumerate(CROSS)])
    drawn = wp_gradient(s, c, ["draw"])
    point = wp_gradient(stats.groupBy("target").agg(*[F.sum(m).alias(m) for m in SUMS]),
                        cross.groupBy("target", "feature").agg(*[F.sum(m).alias(m) for m in CROSS])).withColumnRenamed("gradient", "_g")
    joined = drawn.join(point, ["target", "feature"])
    per = joined.groupBy("draw", "target").agg(
        F.sum((F.col("gradient") - F.col("_g")) * (F.col("gradient") - F.col("_g"))).alias("_e"),
        F.sum(F.col("gradient") * F.col("_g")).alias("_dot"), F.sum(F.col("_g") * F.col("_g")).alias("_n"))
    return per.groupBy("target").agg(
        F.sqrt(F.max("_n")).alias("norm"), F.sqrt(F.avg("_e")).alias("noise_norm"),
        (F.sqrt(F.max("_n")) / F.greatest(F.sqrt(F.avg("_e")), F.lit(1e-30))).alias("ratio"),
        F.avg((F.col("_dot") > 0).cast("double")).alias("positive_share"))
