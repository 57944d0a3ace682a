"""Cross-fitted models of the probability that a row is scored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalar import column, logistic
from seqloom.layout import KEY, SequenceSpec
from seqloom.operators.boosting import Response, Settings, boost, predicted
from seqloom.operators.ordered import per_sequence
from seqloom.operators.sampling import crossfit_folds
from seqloom.session import settle


def _terms(rows: DataFrame, names: Sequence[str], coefs: np.ndarray) -> np.ndarray:
    """Per fold, over the rows outside it: rows, labels, log loss, gradient and Hessian at the fold's coefficients, from one pass."""
    folds, d = coefs.shape
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 3 + d + len(upper[0])))
        for batch in batches:
            fold, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = np.column_stack([np.ones(len(y)), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, d + 1))])
            if np.isnan(x).any() or np.isnan(y).any():
                raise ValueError("a feature or label of the selection model is NULL or NaN")
            for k in range(folds):
                used, yk = x[fold != k], y[fold != k]
                z = used @ coefs[k]
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = (np.logaddexp(0, z) - yk * z).sum()
                total[k] += np.concatenate([[len(yk), yk.sum(), loss], used.T @ (p - yk), (used.T @ ((p * (1 - p))[:, None] * used))[upper]])
        k, i = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total.reshape(-1))], names=["k", "i", "value"])

    out = np.zeros((folds, 3 + d + len(upper[0])))
    for r in rows.select("fold", "_label", *names).mapInArrow(run, "k long, i long, value double").groupBy("k", "i").agg(F.sum("value").alias("value")).collect():
        out[r["k"], r["i"]] = r["value"]
    return out


def _newton(rows: DataFrame, names: Sequence[str], folds: int, penalty: float, tolerance: float, steps: int = 150) -> np.ndarray:
    """Coefficients per fold, the intercept first: Newton steps of all folds, each step one pass over the rows."""
    d = len(names) + 1
    upper, ridge = np.triu_indices(d), np.append(0.0, np.full(d - 1, penalty))
    coefs, step, before = np.zeros((folds, d)), np.zeros((folds, d)), np.full(folds, np.inf)
    done = np.zeros(folds, bool)
    for _ in range(steps):
        terms = _terms(rows, names, np.where(np.isfinite(coefs), coefs, 0.0))
        for k in np.flatnonzero(~done):
            n, ones, loss = terms[k, :3]
            if not n:
                raise ValueError(f"no rows outside fold {k}")
            if ones in (0, n):
                coefs[k], done[k] = np.append(np.inf if ones else -np.inf, np.zeros(d - 1)), True
                continue
            value = loss / n + 0.5 * (ridge * coefs[k] ** 2).sum()
            if value > before[k] + 1e-12:
                # Too far: half the step back.
                step[k] /= 2
                coefs[k] -= step[k]
                continue
            before[k] = value
            hessian = np.zeros((d, d))
            hessian[upper] = terms[k, 3 + d:] / n
            hessian = np.triu(hessian) + np.triu(hessian, 1).T + np.diag(ridge)
            step[k] = -np.linalg.solve(hessian, terms[k, 3:3 + d] / n + ridge * coefs[k])
            coefs[k] += step[k]
            done[k] = abs(step[k]).max() <= tolerance * max(1.0, abs(coefs[k]).max())
        if done.all():
            return coefs
    raise RuntimeError("the selection model did not settle")


def logistic_propensity(df: DataFrame, features: Sequence, label: Column, spec: SequenceSpec, folds: int = 4, penalty: float = 0.1,
                        tolerance: float = 1e-8) -> DataFrame:
    """Out-of-fold logistic probabilities; ridge on all coefficients but the intercept, no rescaling.

    The models of all folds are fitted in the same passes. Each row is scored by the model of its own fold, which has not seen the fold.
    """
    names = [f"_f{i}" for i in range(len(features))]
    tagged = per_sequence(df, crossfit_folds(df, folds), spec=spec)
    # Every step reads these rows, so the features are stored once.
    rows = settle(tagged.withColumns({n: column(f).cast("double") for n, f in zip(names, features)} | {"_label": label.cast("double")}))
    score = F.lit(None).cast("double")
    for k, coef in enumerate(_newton(rows, names, folds, penalty, tolerance)):
        score = F.when(F.col("fold") == k, reduce(add, [F.col(n) * F.lit(float(c)) for n, c in zip(names, coef[1:])], F.lit(float(coef[0])))).otherwise(score)
    return rows.withColumn("propensity", logistic(score)).drop(*names, "_label")


#: Fixed values of the tree fit.
TREES = Settings(rounds=64, leaves=15, rate=0.1, l2=1.0, min_leaf=40, bins=255, loss="logistic")


def tree_propensity(df: DataFrame, features: Sequence, label: Column, spec: SequenceSpec, folds: int = 4, settings: Settings = TREES) -> DataFrame:
    """Out-of-fold probabilities of boosted leaf-wise trees; the models of all folds grow in the same passes."""
    names = [f"_f{i}" for i in range(len(features))]
    tagged = per_sequence(df, crossfit_folds(df, folds), spec=spec)
    rows = settle(tagged.withColumns({n: column(f).cast("double") for n, f in zip(names, features)} | {"_label": label.cast("double")}))
    models = boost(rows, names, [Response(F.col("_label"), F.lit(1.0), F.col("fold") != k) for k in range(folds)], settings)
    return rows.withColumn("propensity", logistic(predicted(models, names, F.col("fold")))).drop(*names, "_label")


def fold_rates(df: DataFrame, label: Column, folds: DataFrame, spec: SequenceSpec) -> DataFrame:
    """Base rate of the rows outside each fold: the prior a fold's model starts from."""
    per = df.groupBy(KEY).agg(F.count("*").alias("_n"), F.sum(label.cast("bigint")).alias("_k")).join(folds, KEY)
    by = per.groupBy("fold").agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    total = by.agg(F.sum("_n").alias("_tn"), F.sum("_k").alias("_tk"))
    rate = (F.col("_tk") - F.col("_k")) / (F.col("_tn") - F.col("_n"))
    return by.crossJoin(F.broadcast(total)).select("fold", rate.alias("rate"))  # one row
