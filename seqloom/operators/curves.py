"""Bounded piecewise-linear output curves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip
from seqloom.functions.vectors import interpolation_basis
from seqloom.operators.ridge import grams

LIMIT = 1.9  # Fixed value: bound of curve values.
SMOOTH, TINY = 1e-4, 1e-10  # Fixed values: second-difference penalty and ridge, relative to the weight.


def _descend(gram: np.ndarray, rhs: np.ndarray, limit: float, sweeps: int = 20_000) -> np.ndarray:
    """Bounded quadratic minimum by cyclic coordinate descent; the matrix is positive definite."""
    x = np.clip(np.linalg.solve(gram, rhs), -limit, limit)
    for _ in range(sweeps):
        before = x.copy()
        for i in range(len(x)):
            x[i] = np.clip(x[i] + (rhs[i] - gram[i] @ x) / gram[i, i], -limit, limit)
        if np.abs(x - before).max() < 1e-13:
            break
    return x


def bounded_curve_fit(df: DataFrame, target: str, prediction: str, knots: Sequence[float] | None = None, focus: Column | None = None) -> dict[str, np.ndarray]:
    """Smooth curve from prediction to target within +-1.9, and its affine control, from one scan."""
    knots = list(np.linspace(-2.0, 2.0, 17)) if knots is None else list(knots)
    w = F.abs(clip(target)) * (focus if focus is not None else F.lit(1.0))
    p = clip(prediction)
    # Affine columns ride along in the same Gram matrix: constant and clipped prediction.
    features = [*interpolation_basis(p, knots), F.lit(1.0), p]
    g = grams(df, features, {"y": (clip(target), w)})[("y",)]
    k = len(knots)
    curve, line = g.part(range(k)), g.part([k, k + 1])
    second = np.diff(np.eye(k), n=2, axis=0)
    gram = curve.xx + g.mass * SMOOTH * (second.T @ second) + np.eye(k) * g.mass * TINY
    affine = np.linalg.solve(line.xx, line.xr)
    if affine[1] <= 0:
        raise ValueError("the affine control needs a positive slope")
    control = affine[0] + affine[1] * np.asarray(knots)
    control = control * min(1.0, LIMIT / np.abs(control).max())
    return {"knots": np.asarray(knots), "curve": _descend(gram, curve.xr, LIMIT), "affine": control, "line": affine}
