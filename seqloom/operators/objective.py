"""Direct fits of the score: several trial coefficients are evaluated in one pass, the optimizer state is tiny.

A pass goes over Arrow batches of (targets, base predictions, features) and adds up, per trial and group, the six sums of the score, the raw and the
clipped squared error, and the three feature sums of the gradient. A line search tries all its steps in one pass, a grid of strengths is one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import column
from seqloom.operators.ridge import grams, residual_responses, tangent_responses
from seqloom.session import settle

#: Steps of a line search that one pass tries.
STEPS = 6
LIMIT = 2.0  # fixed value: targets and predictions are clipped to +-2
Trial = tuple[int, np.ndarray]  # target and coefficients


@dataclass
class Terms:
    """Sums of one trial in one group: (w, wy, wp, wyy, wpp, wyp), squared errors, and (f0, fy, fp) per feature."""

    six: np.ndarray
    raw: float
    clipped: float
    cross: np.ndarray

    def loss(self) -> tuple[float, np.ndarray]:
        """Negative score and its gradient by the coefficients."""
        w, wy, wp, wyy, wpp, wyp = self.six
        my, mp = wy / w, wp / w
        vy, vp, cov = wyy - wy * my, max(wpp - wp * mp, 1e-12), wyp - wy * mp
        f0, fy, fp = self.cross
        scale = np.sqrt(vy * vp)
        return -cov / scale, -(fy - my * f0 - cov / vp * (fp - mp * f0)) / scale

    def score(self) -> float:
        """The score itself; 0 for tiny weight or variance, limited to +-1."""
        w, wy, wp, wyy, wpp, wyp = self.six
        safe = max(w, 1e-300)
        vy, vp = max(wyy - wy * wy / safe, 0.0), max(wpp - wp * wp / safe, 0.0)
        if w < 1e-8 or vy / safe <= 1e-16 or vp / safe <= 1e-16:
            return 0.0
        return float(min(1.0, max(-1.0, (wyp - wy * wp / safe) / np.sqrt(vy * vp))))


def stored_rows(df: DataFrame, features: Sequence, base: Sequence, targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`(by..., y, b, x)`: what a pass reads, stored once."""
    double = lambda cols: F.array(*[column(c).cast("double") for c in cols])
    return settle(df.select(*by, double(targets).alias("y"), double(base).alias("b"), double(features).alias("x")))


def trial_terms(stored: DataFrame, trials: Sequence[Trial], by: Sequence[str] = (), gradient: bool = True) -> dict[tuple, list[Terms]]:
    """Sums of every trial `base + x . coef` per group, from one pass; rows with a missing or NaN value in a trial are left out of it.

    Groups x trials x (8 + 3 features) sums reach the driver.
    """
    by = list(by)
    width = len(trials[0][1])
    coefs = np.array([c for _, c in trials], dtype=float)
    target = np.array([t for t, _ in trials])

    def sums(y: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
        p = b[:, target] + x @ coefs.T
        y = np.clip(y, -LIMIT, LIMIT)[:, target]
        ok = ~np.isnan(p) & ~np.isnan(y)
        p, y = np.where(ok, p, 0.0), np.where(ok, y, 0.0)
        w, q = np.abs(y), np.clip(p, -LIMIT, LIMIT)
        out = [w, w * y, w * q, w * y * y, w * q * q, w * y * q, w * (y - p) ** 2, w * (y - q) ** 2]
        found = np.stack([v.sum(0) for v in out], axis=1)
        if gradient:
            active = np.where(np.abs(p) < LIMIT, w, 0.0)
            x = np.where(np.isnan(x), 0.0, x)
            found = np.concatenate([found, active.T @ x, (active * y).T @ x, (active * q).T @ x], axis=1)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            n, kinds = batch.num_rows, [f.type for f in batch.schema][:len(by)]
            y, b, x = (batch.column(len(by) + i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else None for i in range(3))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(by))))) if by else ():
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items() if by else [((), slice(None))] if n else []:
                part = sums(y[rows], b[rows], x[rows])
                total[key] = part if key not in total else total[key] + part
        if total:
            keys = list(zip(*total)) if by else []
            yield pa.RecordBatch.from_arrays([*(pa.array(list(k), t) for k, t in zip(keys, kinds or [])), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))], names=[*by, "sums"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*by).schema), "sums array<double>"]) if by else "sums array<double>"
    parts = stored.select(*by, "y", "b", "x").mapInArrow(run, schema)
    rows = parts.select(*by, F.posexplode("sums").alias("_at", "_v")).groupBy(*by, "_at").agg(F.sum("_v").alias("_v")).collect()
    size = 8 + (3 * width if gradient else 0)
    flat: dict[tuple, np.ndarray] = {}
    for r in rows:
        flat.setdefault(tuple(r[k] for k in by), np.zeros(len(trials) * size))[r["_at"]] = r["_v"]
    return {key: [Terms(v[:6], v[6], v[7], v[8:].reshape(3, -1) if gradient else np.zeros((3, 0))) for v in line.reshape(len(trials), size)] for key, line in flat.items()}


def minimize(many: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], start: np.ndarray, iterations: int = 80, memory: int = 8,
             tolerance: float = 1e-10) -> tuple[np.ndarray, float, int]:
    """Limited-memory quasi-Newton descent; `many` evaluates several points at once, so an iteration's line search is one evaluation."""
    x = start.copy()
    ((value, grad),) = many([x])
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(iterations):
        q, alphas = grad.copy(), []
        for s, y in reversed(history):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if history:
            s, y = history[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(grad))
        for (s, y), a in zip(history, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        slope = -(grad @ q)
        if slope >= 0:
            history, q, slope = [], grad.copy(), -(grad @ grad)
        step, found = 1.0, None
        while found is None:
            steps = [step * 0.5**i for i in range(STEPS)]
            for t, (new_value, new_grad) in zip(steps, many([x - t * q for t in steps])):
                if new_value <= value + 1e-4 * t * slope or t < 1e-8:
                    found = (t, new_value, new_grad)
                    break
            step *= 0.5**STEPS
        step, new_value, new_grad = found
        moved, turned = -step * q, new_grad - grad
        done = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        if moved @ turned > 1e-14:
            history = [*history[-(memory - 1):], (moved, turned)]
        if new_value < value:
            x, value, grad = x + moved, new_value, new_grad
        if done or step < 1e-8:
            return x, value, k + 1
    return x, value, iterations


def fit_wp(df: DataFrame, features: Sequence, base: str, target: str, penalty: float, iterations: int = 80) -> tuple[np.ndarray, float]:
    """Coefficients that maximize the score minus penalty * |coef|^2 / 2, and the reached objective."""
    rows = stored_rows(df, features, [base], [target])

    def many(points):
        out = []
        for coef, terms in zip(points, trial_terms(rows, [(0, c) for c in points])[()]):
            value, grad = terms.loss()
            out.append((value + penalty * (coef @ coef) / 2.0, grad + penalty * coef))
        return out

    coef, value, _ = minimize(many, np.zeros(len(features)), iterations)
    return coef, value


def fit_wp_groups(df: DataFrame, features: Sequence, base: str, target: str, group: str, penalty: float, spread: float,
                  iterations: int = 80) -> tuple[np.ndarray, float]:
    """Mean loss over sequence groups, relative to no correction, plus `spread` times its variance between groups."""
    rows = stored_rows(df, features, [base], [target], [group])
    first = trial_terms(rows, [(0, np.zeros(len(features)))], [group])
    zero = {key: terms[0].loss()[0] for key, terms in first.items()}

    def many(points):
        found = trial_terms(rows, [(0, c) for c in points], [group])
        out = []
        for i, coef in enumerate(points):
            losses = [(found[k][i].loss(), zero[k]) for k in zero]
            values = np.array([v - z for (v, _), z in losses])
            grads = np.array([g for (_, g), _ in losses])
            centered = values - values.mean()
            out.append((values.mean() + spread * np.mean(centered**2) + penalty * (coef @ coef) / 2.0,
                        grads.mean(0) + 2.0 * spread * np.mean(centered[:, None] * grads, axis=0) + penalty * coef))
        return out

    coef, value, _ = minimize(many, np.zeros(len(features)), iterations)
    return coef, value


def exact_moment_fit(df: DataFrame, holdout: DataFrame, features: Sequence, base: Sequence[str], penalties: Sequence[float],
                     strengths: Sequence[float] = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0), targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Residual and tangent ridge fits on all rows; score and errors of every penalty and strength in one pass per split.

    Rows `(split, objective, penalty, target, strength, wp, raw_mse, clipped_mse)`.
    """
    fits = {}
    for objective, responses in (("raw_residual", residual_responses(base, targets, clipped=True)), ("pearson_tangent", tangent_responses(df, base, targets))):
        found = grams(df, features, responses)
        for penalty in penalties:
            for t in targets:
                fits[(objective, float(penalty), t)] = found[(t,)].solve(penalty)
    cells = [(objective, penalty, t, float(k)) for objective, penalty, t in fits for k in strengths]
    trials = [(list(targets).index(t), fits[objective, penalty, t] * k) for objective, penalty, t, k in cells]
    out = []
    for split, rows in (("fit", df), ("selection", holdout)):
        found = trial_terms(stored_rows(rows, features, base, targets), trials, gradient=False).get((), [])
        out += [(split, *cell, terms.score(), terms.raw / terms.six[0] if terms.six[0] else None, terms.clipped / terms.six[0] if terms.six[0] else None)
                for cell, terms in zip(cells, found)]
    return df.sparkSession.createDataFrame(
        [tuple(v if isinstance(v, str) or v is None else float(v) for v in row) for row in out],
        "split string, objective string, penalty double, target string, strength double, wp_score double, raw_mse double, clipped_mse double")
