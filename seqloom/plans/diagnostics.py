"""Calibration chosen on one split and frozen on the next, with residual diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.layout import NEED, SCORED, SequenceSpec
from seqloom.operators import sampling, scoring, slices


def calibrated_scores(tune: DataFrame, confirm: DataFrame, predictions: Sequence[str] = ("p0", "p1"), targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Score of both splits before and after the affine map that is best on the tune split."""
    best = {r["target"]: (r["scale"], r["bias"]) for r in slices.best_affine(slices.affine_grid(tune, predictions, targets)).collect()}
    moved = [F.col(p) * best[t][0] + best[t][1] for t, p in zip(targets, predictions)]
    parts = []
    for name, df in (("tune", tune), ("confirm", confirm)):
        m = scoring.with_wp(scoring.moments(scoring.scored_rows(df), {"plain": tuple(predictions), "calibrated": tuple(moved)}, targets))
        parts.append(m.select(F.lit(name).alias("split"), "system", "target", "n", "wp"))
    return parts[0].unionByName(parts[1])


def residual_diagnostics(df: DataFrame, features: Sequence[str], spec: SequenceSpec, predictions: Sequence[str] = ("p0", "p1"), k: int = 8) -> dict[str, DataFrame]:
    """Residual summary, persistence at lags 1/10/100, and the features most correlated with the residual."""
    mark = F.col(NEED) & F.col(SCORED)
    return {
        "summary": slices.residual_summary(df, predictions),
        "persistence": slices.residual_persistence(df, {"base": tuple(predictions)}, spec, kind="raw"),
        "features": slices.top_k_features(sampling.stride_sample(df, 20, spec, mark=mark), features, predictions, k),
    }
