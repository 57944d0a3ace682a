"""Additive tree models: scoring, and boosting from per-node histograms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, column, logistic, search_sorted
from seqloom.operators.quantiles import quantile_edges
from seqloom.session import settle


@dataclass(frozen=True)
class Node:
    """Leaf with a value, or a split: rows with `x[feature] <= threshold` go left."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def is_leaf(self) -> bool:
        return self.feature < 0


Tree = list[Node]
SHALLOW = 4  # deeper trees are walked with arrays instead of nested conditions


def depth(tree: Tree, at: int = 0, seen: int = 0) -> int:
    """Depth of a tree; a cycle or a missing child is an error."""
    if seen > len(tree) or not 0 <= at < len(tree):
        raise ValueError("invalid tree")
    node = tree[at]
    return 0 if node.is_leaf else 1 + max(depth(tree, node.left, seen + 1), depth(tree, node.right, seen + 1))


def tree_column(tree: Tree, features: Sequence, at: int = 0) -> Column:
    """One tree as nested conditions."""
    node = tree[at]
    if node.is_leaf:
        return F.lit(float(node.value))
    go_left = column(features[node.feature]) <= F.lit(float(node.threshold))
    return F.when(go_left, tree_column(tree, features, node.left)).otherwise(tree_column(tree, features, node.right))


def walk(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Values of one tree for a block of rows."""
    leaf = np.array([n.is_leaf for n in tree])
    feature = np.array([max(n.feature, 0) for n in tree])
    threshold = np.array([n.threshold for n in tree])
    left, right = np.array([n.left for n in tree]), np.array([n.right for n in tree])
    at = np.zeros(len(x), dtype=int)
    open_rows = np.flatnonzero(~leaf[at])
    while len(open_rows):
        node = at[open_rows]
        at[open_rows] = np.where(x[open_rows, feature[node]] <= threshold[node], left[node], right[node])
        open_rows = open_rows[~leaf[at[open_rows]]]
    return np.array([n.value for n in tree])[at]


def score_trees(trees: Sequence[Tree], features: Sequence, baseline: float = 0.0) -> Column:
    """Baseline plus the sum of all trees.

    Few shallow trees stay inside generated code; larger models go through Arrow batches.
    """
    deepest = max((depth(t) for t in trees), default=0)
    if deepest <= SHALLOW and sum(len(t) for t in trees) <= 512:
        out = F.lit(float(baseline))
        for t in trees:
            out = out + tree_column(t, features)
        return out

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        return pd.Series(baseline + sum(walk(t, x) for t in trees))

    return run(*[column(f).cast("double") for f in features])


def propensity_focus(folds: Sequence[tuple[Sequence[Tree], float, float]], features: Sequence) -> tuple[Column, Column]:
    """Mean over folds of p / rate limited to [0.2, 5], and mean p; a fold is (trees, baseline, rate)."""
    p = [logistic(score_trees(trees, features, baseline)) for trees, baseline, _ in folds]
    ratio, mean = F.lit(0.0), F.lit(0.0)
    for value, (_, _, rate) in zip(p, folds):
        ratio, mean = ratio + value / float(rate), mean + value
    return clip(ratio / float(len(folds)), 0.2, 5.0), mean / float(len(folds))


def node_histograms(df: DataFrame, bins: Sequence[str], node: Column, gradient: Column, weight: Column) -> DataFrame:
    """`(node, feature, bin, n, g, w)`: the only data a level of a tree needs."""
    rows = df.select(node.alias("node"), F.posexplode(F.array(*[F.col(b) for b in bins])).alias("feature", "bin"),
                     gradient.alias("_g"), weight.alias("_w")).filter(F.col("node").isNotNull())
    return rows.groupBy("node", "feature", "bin").agg(F.count("*").alias("n"), F.sum("_g").alias("g"), F.sum("_w").alias("w"))


def split_gains(hist: DataFrame, n_bins: int, l2: float, min_leaf: int) -> DataFrame:
    """Gain of every split `bin <= k` of every node; windows run over at most `n_bins` rows each."""
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("node", "feature")
    run = hist.select("node", "feature", "bin", *[F.sum(c).over(upto).alias(c) for c in ("n", "g", "w")],
                      *[F.sum(c).over(everything).alias(f"all_{c}") for c in ("n", "g", "w")])
    rest_g, rest_w = F.col("all_g") - F.col("g"), F.col("all_w") - F.col("w")
    gain = F.col("g") * F.col("g") / (F.col("w") + l2) + rest_g * rest_g / (rest_w + l2) - F.col("all_g") * F.col("all_g") / (F.col("all_w") + l2)
    ok = (F.col("n") >= min_leaf) & (F.col("all_n") - F.col("n") >= min_leaf) & (F.col("bin") < n_bins - 1)
    return run.filter(ok).withColumn("gain", gain)


def grow_tree(df: DataFrame, bins: Sequence[str], edges: Sequence[Sequence[float]], gradient: Column, weight: Column,
              max_depth: int = 2, min_leaf: int = 512, l2: float = 100.0, rate: float = 0.05) -> Tree:
    """One histogram tree, level by level: one aggregation per level, best splits chosen on the driver."""
    nodes: list[Node] = [Node()]
    codes: list[tuple[int, int] | None] = [None]  # (feature, bin) of a split, in bin units
    frontier = [0]

    def place(at: int = 0) -> Column:
        """Frontier node of a row."""
        if codes[at] is None:
            return F.lit(at if at in frontier else None).cast("int")
        f, k = codes[at]
        return F.when(F.col(bins[f]) <= k, place(nodes[at].left)).otherwise(place(nodes[at].right))

    def leaf(g: float, w: float) -> Node:
        return Node(value=rate * g / (w + l2))

    for level in range(max_depth + 1):
        hist = node_histograms(df, bins, place(), gradient, weight)
        if level == max_depth:
            sums = hist.filter("feature = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).collect()
            for row in sums:
                nodes[row["node"]] = leaf(row["g"], row["w"])
            break
        hist = settle(hist)  # nodes x features x bins rows
        for row in hist.filter("feature = 0").groupBy("node").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).collect():
            nodes[row["node"]] = leaf(row["g"], row["w"])
        order = F.struct(-F.col("gain"), F.col("feature"), F.col("bin"))
        best = split_gains(hist, len(edges[0]) + 1, l2, min_leaf).groupBy("node").agg(F.min_by(F.struct("feature", "bin", "gain"), order).alias("b")).collect()
        nxt = []
        for row in sorted(best, key=lambda x: x["node"]):
            f, k, gain = row["b"]
            if gain <= 0:
                continue
            at, a = row["node"], len(nodes)
            nodes += [Node(), Node()]
            codes += [None, None]
            nodes[at] = Node(feature=f, threshold=float(edges[f][k]), left=a, right=a + 1)
            codes[at] = (f, k)
            nxt += [a, a + 1]
        frontier = nxt
        if not frontier:
            break
    return nodes


def boosted_residual(df: DataFrame, features: Sequence[str], target: str, base: str, rounds: int = 32, n_bins: int = 32, **options) -> list[Tree]:
    """Weighted boosting of `clip(target) - base` with weight |clip(target)|.

    Bin codes are settled once. The running prediction is an expression over the raw features, so a
    round reads the settled table and writes nothing.
    """
    edges = [quantile_edges(df, f, n_bins) for f in features]
    names = [f"_b{i}" for i in range(len(features))]
    y = clip(target)
    cached = settle(df.select(
        *features, (y - F.col(base)).alias("_r"), F.abs(y).alias("_w"), *[search_sorted(f, e, "left").alias(n) for f, e, n in zip(features, edges, names)]))
    trees: list[Tree] = []
    for _ in range(rounds):
        gradient = F.col("_w") * (F.col("_r") - score_trees(trees, list(features)))
        trees.append(grow_tree(cached, names, edges, gradient, F.col("_w"), **options))
    return trees


def library_boosting(df: DataFrame, features: Sequence[str], label: Column, weight: Column, rounds: int = 100, max_depth: int = 4, seed: int = 1):
    """The same family through the built-in distributed trainer; returns a fitted pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = df.withColumns({"_label": label.cast("double"), "_weight": weight.cast("double")})
    model = GBTRegressor(featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), model]).fit(rows)
