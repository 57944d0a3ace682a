"""Row functions; all are plain columns, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def not_finite(c) -> Column:
    """True for NULL, NaN and infinities."""
    c = column(c)
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def fill_nonfinite(c, value: float = 0.0) -> Column:
    """Replace NULL, NaN and infinities."""
    return F.when(not_finite(c), F.lit(value)).otherwise(column(c))


def clip(c, lo: float = -2.0, hi: float = 2.0) -> Column:
    """Limit to [lo, hi]. NaN becomes NULL: min/max functions would turn it into `hi`."""
    c = column(c)
    return F.when(~F.isnan(c), F.greatest(number(lo), F.least(number(hi), c)))


def standardize(c, mean, scale, limit: float = 8.0, floor: float = 0.0) -> Column:
    """`(c - mean) / max(scale, floor)` limited to +-limit."""
    return clip((column(c) - number(mean)) / F.greatest(number(scale), F.lit(floor)), -limit, limit)


def calibrate(p, scale: float, bias: float) -> Column:
    """Affine output map in single precision."""
    one = F.lit(scale).cast("float") * column(p).cast("float")
    return (one.cast("float") + F.lit(bias).cast("float")).cast("float")


def logistic(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-column(c)))


def position_bucket(step, edges: Sequence[int], names: Sequence[str] = ("early", "middle", "late")) -> Column:
    """Half-open step ranges named in order."""
    step = column(step)
    out = F.lit(names[len(edges)])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(step < edge, F.lit(name)).otherwise(out)
    return out


# Magnitude bins, half open, the last one closed by a hair above the clip limit.
MAGNITUDE_EDGES = (0.5, 1.0, 1.5, 2.000001)
MAGNITUDE_NAMES = ("0_to_0.5", "0.5_to_1", "1_to_1.5", "1.5_to_2")


def magnitude_bucket(c) -> Column:
    """Bin of the absolute clipped value; NULL above the top edge."""
    size = F.abs(clip(c))
    out = F.lit(None).cast("string")
    for edge, name in reversed(list(zip(MAGNITUDE_EDGES, MAGNITUDE_NAMES))):
        out = F.when(size < edge, F.lit(name)).otherwise(out)
    return out


def search_sorted(c, edges: Sequence[float], side: str = "left") -> Column:
    """Index where `c` would be inserted into the sorted edges."""
    c = column(c)
    hits = [(F.lit(float(e)) <= c if side == "right" else F.lit(float(e)) < c).cast("int") for e in edges]
    out = F.lit(0)
    for h in hits:
        out = out + h
    return out


def target_for_fit(target: str, mode: str) -> Column:
    """Target as used by a fit: `raw`, `clipped`, or `t0_raw_t1_clipped` style per target."""
    if mode in ("raw", "clipped"):
        chosen = mode
    else:
        parts = mode.split("_")
        chosen = dict(zip(parts[::2], parts[1::2]))[target]
    return clip(target) if chosen == "clipped" else F.col(target)


def magnitude_gate(predictions: Sequence, threshold: float = 1.0) -> Column:
    """True where any prediction is at least `threshold` in size."""
    return F.greatest(*[F.abs(column(p)) for p in predictions], F.lit(0.0)) >= threshold


def consensus(a, b) -> Column:
    """Mean of two corrections, shrunk toward 0 by half their disagreement."""
    a, b = column(a), column(b)
    mean = (a + b) * 0.5
    return F.signum(mean) * F.greatest(F.abs(mean) - F.abs(a - b) * 0.5, F.lit(0.0))


def blend(a, b, alpha: float) -> Column:
    """`(1 - alpha) * a + alpha * b`."""
    return column(a) * (1.0 - alpha) + column(b) * alpha


def correlation(n, sx, sy, sxx, syy, sxy, floor: float = 1e-16) -> Column:
    """Pearson correlation from sums; 0 where a variance vanishes."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    value = (sxy - sx * sy / n) / F.sqrt(vx * vy)
    ok = (n >= 2) & (vx > floor) & (vy > floor)
    return F.when(ok, clip(value, -1.0, 1.0)).otherwise(F.lit(0.0))


def rounded(c, digits: int = 6) -> Column:
    """Round to nearest by floor, the same way on every engine.

    The tie point lies slightly off one half: exact decimal halves, whose last bit depends on the order
    of operations, then round alike everywhere.
    """
    unit = float(10**digits)
    return F.floor(column(c) * unit + 0.500123457) / F.lit(unit)
