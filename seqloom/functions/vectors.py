"""Feature bases over columns and array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, column, search_sorted, standardize


def dot(features: Column, weights: Column) -> Column:
    """Inner product of two arrays of the same size."""
    products = F.zip_with(features, weights, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def linear_predict(features: Sequence, coef: Sequence[float]) -> Column:
    """`sum(c_i * f_i)` as one expression; the coefficients are literals."""
    out = F.lit(0.0)
    for f, c in zip(features, coef):
        out = out + column(f) * float(c)
    return out


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def linear_design(xs: Sequence[str], stats: dict[str, tuple[float, float]], predictions: Sequence[str]) -> list[Column]:
    """`[1, standardized x, p]`; a missing prediction counts as 0."""
    scaled = [standardize(x, *stats[x]) for x in xs]
    return [F.lit(1.0), *scaled, *[F.coalesce(F.nanvl(F.col(p), F.lit(0.0)), F.lit(0.0)) for p in predictions]]


def quadratic_design(xs: Sequence, base) -> list[Column]:
    """`[1, x, |x|, x * clip(base)]`."""
    xs = [column(x) for x in xs]
    return [F.lit(1.0), *xs, *[F.abs(x) for x in xs], *[x * clip(base) for x in xs]]


def fourier_basis(xs: Sequence, weights: Sequence[Sequence[float]]) -> list[Column]:
    """`[1, cos(Wx)..., sin(Wx)...]` for fixed projections, one weight list per output."""
    phases = [linear_predict(xs, w) for w in weights]
    return [F.lit(1.0), *[F.cos(p) for p in phases], *[F.sin(p) for p in phases]]


def tanh_basis(xs: Sequence, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> list[Column]:
    """`tanh(Wx + b)` for fixed projections."""
    return [F.tanh(linear_predict(xs, w) + float(b)) for w, b in zip(weights, bias)]


def tanh_family(family: str, current: Sequence, hidden: Sequence, params: dict) -> list[Column]:
    """Fixed nonlinear feature families over current inputs and a recurrent state.

    `linear` keeps both blocks; `current` adds a basis of the inputs only; `separable` adds one basis
    per block; `joint` adds a basis over both blocks together.
    """
    current, hidden = [column(c) for c in current], [column(h) for h in hidden]
    if family == "linear":
        return [*current, *hidden]
    if family == "current":
        return [*current, *tanh_basis(current, *params["current"])]
    if family == "separable":
        return [*current, *hidden, *tanh_basis(current, *params["current"]), *tanh_basis(hidden, *params["hidden"])]
    if family == "joint":
        return [*current, *hidden, *tanh_basis([*current, *hidden], *params["joint"])]
    raise ValueError(f"unknown feature family: {family}")


def hinge_basis(p, knots: Sequence[float]) -> list[Column]:
    """`[1, p, max(p - k, 0)...]`."""
    p = column(p)
    return [F.lit(1.0), p, *[F.greatest(p - float(k), F.lit(0.0)) for k in knots]]


def interpolation_basis(p, knots: Sequence[float]) -> list[Column]:
    """Weight of each knot in the piecewise linear interpolation at `p`."""
    p = clip(p, knots[0], knots[-1])
    out = []
    for i, k in enumerate(knots):
        weight = F.lit(1.0)
        if i > 0:
            weight = F.when(p < k, (p - knots[i - 1]) / (k - knots[i - 1])).otherwise(weight)
        if i + 1 < len(knots):
            weight = F.when(p > k, (knots[i + 1] - p) / (knots[i + 1] - k)).otherwise(weight)
        out.append(F.greatest(weight, F.lit(0.0)))
    return out


def interpolate(p, knots: Sequence[float], values: Sequence[float], strength: float = 1.0) -> Column:
    """Curve through the knots, moved from the identity by `strength`."""
    base = clip(p)
    curve = linear_predict(interpolation_basis(base, knots), values)
    return base + (curve - base) * strength


def side_contrasts(first: tuple[Sequence, Sequence], second: tuple[Sequence, Sequence], plus: bool = False) -> list[Column]:
    """Eight order-free contrasts of two (bid, ask) level pairs.

    Per instrument: side-mean pressure over pooled RMS, mean-tanh contrast, second-moment contrast;
    then the pressure of each instrument times the activity of the other. `plus` adds the sides
    instead of subtracting them.
    """
    sign = 1.0 if plus else -1.0

    def mean(cols):
        total = cols[0]
        for c in cols[1:]:
            total = total + c
        return total / float(len(cols))

    out, pressures, activities = [], [], []
    for bid, ask in (first, second):
        b, a = [clip(c, -8, 8) for c in bid], [clip(c, -8, 8) for c in ask]
        b2, a2 = mean([c * c for c in b]), mean([c * c for c in a])
        rms = F.sqrt((b2 + a2) / 2.0)
        pressure = (mean(b) + mean(a) * sign) / (rms + 1.0)
        tanh = mean([F.tanh(c) for c in b]) + mean([F.tanh(c) for c in a]) * sign
        out += [pressure, tanh, (b2 + a2 * sign) / (b2 + a2 + 1.0)]
        pressures.append(pressure)
        activities.append(rms / (rms + 1.0))
    return [*out, pressures[0] * activities[1], pressures[1] * activities[0]]


def propensity_design(xs: Sequence, predictions: Sequence, step, length: int, late_step: int) -> list[Column]:
    """`[1, x, p, |p|, p^2, step / length, late]` for selection models."""
    ps = [clip(p) for p in predictions]
    step = column(step)
    return [F.lit(1.0), *[column(x) for x in xs], *ps, *[F.abs(p) for p in ps], *[p * p for p in ps],
            step / float(length), (step >= late_step).cast("double")]


def bin_index(c, edges: Sequence[float]) -> Column:
    """Histogram bin of a feature: number of edges strictly below it."""
    return search_sorted(c, edges, "left")
