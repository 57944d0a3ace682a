"""Fit a ridge correction on one role and evaluate it on another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, target_for_fit
from seqloom.functions.vectors import linear_design, linear_predict
from seqloom.layout import KEY, STEP, SequenceSpec
from seqloom.operators import resampling, ridge, sampling, scoring, slices
from seqloom.operators.populations import feature_scaler
from seqloom.session import settle


@dataclass
class Correction:
    """Fitted numbers: scaler, coefficients and strength per target."""

    features: tuple[str, ...]
    stats: dict[str, tuple[float, float]]
    base: dict[str, str]
    coef: dict[str, np.ndarray]
    strength: dict[str, float]

    def delta(self, target: str):
        """Unscaled correction column of one target; the model is part of the plan as literals."""
        return linear_predict(linear_design(self.features, self.stats, list(self.base.values())), self.coef[target])

    def apply(self, df: DataFrame, prefix: str = "c_") -> DataFrame:
        return df.withColumns({f"{prefix}{t}": F.col(p) + self.delta(t) * self.strength[t] for t, p in self.base.items()})


def check_roles(train: DataFrame, tune: DataFrame, minimum: int = 256) -> None:
    """Refuse shared sequences and too few training sequences."""
    if train.select(KEY).distinct().limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} training sequences")
    if sampling.leakage(train, tune).limit(1).count():
        raise ValueError("a sequence occurs in both roles")


def fit_correction(train: DataFrame, tune: DataFrame, features: Sequence[str], base: dict[str, str], spec: SequenceSpec, stride: int = 10,
                   penalty: float = 1e-3, target_mode: str = "raw", strengths: Sequence[float] = slices.STRENGTHS) -> Correction:
    """Scaler and Gram from strided training rows, strength per target from one scan of the tune role."""
    if not 1 <= stride <= 50 or not 1e-7 <= penalty <= 1.0:
        raise ValueError("sample stride or ridge penalty outside the allowed range")
    targets, predictions = list(base), list(base.values())
    sample = sampling.stride_sample(train, stride, spec)
    stats = feature_scaler(train.filter(F.pmod(F.col(STEP), F.lit(stride)) == 0), features)
    responses = {t: (target_for_fit(t, target_mode) - F.col(p), F.abs(clip(t))) for t, p in base.items()}
    coef = {k[0]: c for k, c in ridge.weighted_ridge(sample, linear_design(features, stats, predictions), responses, penalty).items()}
    model = Correction(tuple(features), stats, dict(base), coef, dict.fromkeys(targets, 1.0))
    grid = slices.strength_grid(scoring.scored_rows(tune), predictions, [model.delta(t) for t in targets], strengths, targets)
    model.strength = {r["target"]: r["strength"] for r in slices.pick_strength(grid).collect()}
    return model


def evaluate_correction(model: Correction, tune: DataFrame, draws: int = 500, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Global report and paired interval. Moments per sequence come from one scan and feed both."""
    systems = {"base": tuple(model.base.values()), "candidate": tuple(f"c_{t}" for t in model.base)}
    scored = model.apply(tune)
    per = settle(scoring.moments(scoring.scored_rows(scored), systems, list(model.base), [KEY]))
    pooled = scoring.with_wp(scoring.add_sums(per, ["system", "target"]))
    return pooled, resampling.paired_bootstrap(per, resampling.DELTA, draws, seed, targets=list(model.base))
