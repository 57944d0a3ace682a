"""Weighted ridge fits from distributed Gram matrices.

Executors add up X'WX, X'Wr, r'Wr, weight and rows; only these sums, d*d numbers per response and
group, reach the driver, which solves the small systems.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import clip, column
from seqloom.operators.scoring import moments

# Up to this width the products are plain aggregate columns; wider designs use matrix products per task.
NARROW = 10
Response = tuple[Column, Column]  # value, weight


@dataclass
class Gram:
    """Sums of one response in one group."""

    xx: np.ndarray
    xr: np.ndarray
    rr: float
    mass: float
    rows: float

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.xx + other.xx, self.xr + other.xr, self.rr + other.rr, self.mass + other.mass, self.rows + other.rows)

    def part(self, columns: Sequence[int]) -> "Gram":
        """The model on some of the columns, without another scan."""
        c = list(columns)
        return Gram(self.xx[np.ix_(c, c)], self.xr[c], self.rr, self.mass, self.rows)

    def solve(self, penalty: float, scale: str = "rows") -> np.ndarray:
        """`scale="rows"`: penalty times rows; `"mass"`: sums divided by weight first."""
        eye = np.eye(len(self.xr))
        if scale == "mass":
            return np.linalg.solve(self.xx / self.mass + eye * penalty, self.xr / self.mass)
        return np.linalg.solve(self.xx + eye * (self.rows * penalty), self.xr)

    def mse(self, coef: np.ndarray) -> float:
        """Weighted squared error of a fit, from the sums alone."""
        return float((self.rr - 2.0 * coef @ self.xr + coef @ self.xx @ coef) / self.mass)


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def gram_table(df: DataFrame, features: Sequence, responses: dict[str, Response], by: Sequence[str] = ()) -> DataFrame:
    """Long sums `(by..., response, i, j, value)` for j >= i.

    Index d stands for the response: (i, d) is X'Wr and (d, d) is r'Wr; (d, d+1) is the weight and
    (d, d+2) the number of rows. A row with a NULL or NaN feature, response or weight is left out of every sum of that
    response, its count of rows included.
    """
    d = len(features)
    cols = [column(f).cast("double") for f in features]
    whole = reduce(and_, [present(c) for c in cols], F.lit(True))
    responses = {n: (v, F.when(whole & present(v) & present(w), w.cast("double"))) for n, (v, w) in responses.items()}
    if d <= NARROW:
        aggs = []
        for name, (value, weight) in responses.items():
            full = [*cols, value.cast("double")]
            for i in range(d + 1):
                for j in range(i, d + 1):
                    aggs.append(F.sum(weight * full[i] * full[j]).alias(f"{name}|{i}|{j}"))
            aggs += [F.sum(weight).alias(f"{name}|{d}|{d + 1}"), F.sum(weight.isNotNull().cast("double")).alias(f"{name}|{d}|{d + 2}")]
        wide = df.groupBy(*by).agg(*aggs)
        cells = []
        for c in wide.columns[len(by):]:
            n, i, j = c.split("|")
            cells.append(F.struct(F.lit(n).alias("response"), F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j"), F.col(f"`{c}`").alias("value")))
        return wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")
    names, keys = list(responses), list(by)
    rows = df.select(*keys, F.array(*cols).alias("_x"), *[
        c.cast("double").alias(f"_{k}{i}") for i, n in enumerate(names) for k, c in zip("vw", responses[n])])
    key_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema) if keys else ""
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for key, part in (pdf.groupby(keys, sort=False) if keys else [((), pdf)]):
                key = key if isinstance(key, tuple) else (key,)
                x = np.concatenate(part["_x"].to_numpy()).astype(float).reshape(len(part), d)
                for i in range(len(names)):
                    v, w = part[f"_v{i}"].to_numpy(float), part[f"_w{i}"].to_numpy(float)
                    used = ~np.isnan(w)
                    v, w = v[used], w[used]
                    full = np.column_stack([x[used], v])
                    # An infinity can still cancel to NaN, which a sum of columns would keep and Arrow would drop.
                    sums = np.concatenate([(full.T @ (w[:, None] * full))[upper], [w.sum(), float(len(w))]])
                    if np.isnan(sums).any():
                        raise ValueError(f"sums of {names[i]} are not numbers")
                    token = (key, i)
                    total[token] = sums if token not in total else total[token] + sums
        for (key, i), sums in total.items():
            out = pd.DataFrame({"response": names[i], "i": np.append(upper[0], [d, d]), "j": np.append(upper[1], [d + 1, d + 2]), "value": sums})
            for k, v in zip(keys, key):
                out.insert(0, k, v)
            yield out[[*keys, "response", "i", "j", "value"]]

    parts = rows.mapInPandas(run, key_schema + "response string, i int, j int, value double")
    return parts.groupBy(*keys, "response", "i", "j").agg(F.sum("value").alias("value"))


def collect_grams(table: DataFrame, d: int, by: Sequence[str] = ()) -> dict[tuple, Gram]:
    """Read the sums: d*d values per response and group. Keys are `(by..., response)`."""
    out: dict[tuple, Gram] = {}
    for row in table.collect():
        key = (*[row[b] for b in by], row["response"])
        g = out.setdefault(key, Gram(np.zeros((d, d)), np.zeros(d), 0.0, 0.0, 0.0))
        i, j, v = row["i"], row["j"], row["value"]
        if v is None or v != v:
            raise ValueError(f"no usable sums for {key}")
        if j < d:
            g.xx[i, j] = g.xx[j, i] = v
        elif j == d and i < d:
            g.xr[i] = v
        elif j == d:
            g.rr = v
        elif j == d + 1:
            g.mass = v
        else:
            g.rows = v
    return out


def grams(df: DataFrame, features: Sequence, responses: dict[str, Response], by: Sequence[str] = ()) -> dict[tuple, Gram]:
    return collect_grams(gram_table(df, features, responses, by), len(features), by)


def residual_responses(base: Sequence[str], targets: Sequence[str] = ("t0", "t1"), focus: Column | None = None, clipped: bool = False) -> dict[str, Response]:
    """Residual to be corrected and its weight |clip(y)| times focus."""
    out = {}
    for t, p in zip(targets, base):
        y = clip(t) if clipped else F.col(t)
        w = F.abs(clip(t)) if focus is None else F.abs(clip(t)) * focus
        out[t] = (y - F.col(p), w)
    return out


def target_responses(targets: Sequence[str] = ("t0", "t1")) -> dict[str, Response]:
    """The clipped target itself, for fits without the base prediction."""
    return {t: (clip(t), F.abs(clip(t))) for t in targets}


def coefficient_frame(df: DataFrame, fits: dict[tuple, np.ndarray], by: Sequence[str] = (), types: Sequence[str] = ()) -> DataFrame:
    """Fitted coefficients as a table `(by..., response, position, coef)`."""
    rows = [(*key, i, float(c)) for key, coef in sorted(fits.items()) for i, c in enumerate(coef)]
    schema = "".join(f"`{b}` {t}, " for b, t in zip(by, types)) + "response string, position int, coef double"
    return df.sparkSession.createDataFrame(rows, schema)


def weighted_ridge(df: DataFrame, features: Sequence, responses: dict[str, Response], penalty: float, by: Sequence[str] = (),
                   scale: str = "rows") -> dict[tuple, np.ndarray]:
    """Coefficients per `(by..., response)`."""
    return {k: g.solve(penalty, scale) for k, g in grams(df, features, responses, by).items()}


def magnitude_focus(predictions: Sequence[str]) -> Column:
    """`0.1 + min(max |p|, 2)^2`."""
    size = F.least(F.greatest(*[F.abs(F.col(p)) for p in predictions], F.lit(0.0)), F.lit(2.0))
    return size * size + 0.1


def replicated_fit(df: DataFrame, features: Sequence, responses: dict[str, Response], penalty: float, replica: str, scale: str = "rows") -> list[tuple]:
    """Fit per replica and pooled, with the weighted error of each, from one scan: `(replica, response, coef, mse)`."""
    found = grams(df, features, responses, [replica])
    pooled: dict[str, Gram] = {}
    for (_, name), g in found.items():
        pooled[name] = g if name not in pooled else pooled[name] + g
    out = []
    every = {(str(k[0]), k[1]): g for k, g in found.items()} | {("pooled", n): g for n, g in pooled.items()}
    for key, g in every.items():
        coef = g.solve(penalty, scale)
        out.append((*key, coef, g.mse(coef)))
    return out


def tangent_responses(df: DataFrame, base: Sequence[str], targets: Sequence[str] = ("t0", "t1")) -> dict[str, Response]:
    """Pseudo-targets whose ridge fit follows the score: centered y minus slope times centered p, 0 where saturated."""
    facts = {row["target"]: row for row in moments(df, {"base": base}, targets).collect()}
    out = {}
    for t, p in zip(targets, base):
        m = facts[t]
        my, mp = m["wy"] / m["w"], m["wp"] / m["w"]
        slope = (m["wyp"] - m["wy"] * mp) / (m["wpp"] - m["wp"] * mp)
        value = (clip(t) - my) - (clip(p) - mp) * slope
        out[t] = (F.when(F.abs(F.col(p)) >= 2, F.lit(0.0)).otherwise(value), F.abs(clip(t)))
    return out
