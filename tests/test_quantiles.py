"""Quantiles of many columns and groups against numpy, and the number of passes they take."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqloom.operators import quantiles

PROBS = [0.0, 0.01, 0.1, 0.5, 0.77, 0.999, 1.0]


def _jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    out = run()
    spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 30_000
    cols = {"even": rng.random(n), "wild": np.exp(rng.normal(0, 30, n)) * rng.choice([-1, 1], n), "hot": np.where(rng.random(n) < 0.7, 3.0, rng.normal(size=n)),
            "one": np.full(n, 5.0), "near": 1.0 + rng.integers(0, 9_000, n) * 2.0**-52, "tiny": rng.integers(0, 5_000, n) * 5e-324, "range": rng.choice([-1e308, 0.0, 1e308], n) * rng.random(n)}
    part = rng.integers(0, 3, n)
    rows = [(None if p == 2 else int(p), *map(float, r)) for p, r in zip(part, np.column_stack(list(cols.values())))]
    return spark.createDataFrame(rows, "part int, " + ", ".join(f"{c} double" for c in cols)).repartition(5), cols, part


def test_columns_and_groups_equal_numpy(table):
    df, cols, part = table
    got = quantiles.many_quantiles(df, {c: c for c in cols}, PROBS, by=["part"])
    assert set(got) == {(0,), (1,), (None,)}
    for k, key in enumerate([(0,), (1,), (None,)]):
        for c, v in cols.items():
            assert got[key][c] == pytest.approx(list(np.quantile(v[part == k], PROBS)), rel=1e-12, abs=1e-323), (key, c)


def test_deep_intervals(table, monkeypatch):
    df, cols, _ = table
    monkeypatch.setattr(quantiles, "BINS", 8)
    monkeypatch.setattr(quantiles, "SMALL", 4)
    names = ("even", "hot", "one", "near")
    got = quantiles.many_quantiles(df, {c: c for c in names}, PROBS)[()]
    for c in names:
        assert got[c] == pytest.approx(list(np.quantile(cols[c], PROBS)), rel=1e-12, abs=0), c


def test_odd_values(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, math.nan, 2.0), (2, math.inf, None), (2, -math.inf, 4.0)], "part int, a double, b double")
    got = quantiles.many_quantiles(df, {"a": "a", "b": F.col("b") * 2}, [0.0, 0.5], by=["part"])
    assert all(math.isnan(x) for part in (1, 2) for x in got[part,]["a"]) and got[1,]["b"] == [2.0, 3.0] and got[2,]["b"] == [8.0, 8.0]
    assert all(math.isnan(x) for x in quantiles.exact_quantiles(df.limit(0), "a", [0.5]))
    assert quantiles.many_quantiles(df.limit(0), {"a": "a"}, [0.5], by=["part"]) == {}


def test_jobs_do_not_grow_with_columns(spark):
    rng = np.random.default_rng(2)
    v = spark.range(20_000, numPartitions=4).select(*[F.rand(int(rng.integers(1e6))).alias(f"c{i}") for i in range(112)])
    few, a = _jobs(spark, lambda: quantiles.many_quantiles(v, {f"c{i}": f"c{i}" for i in range(3)}, [k / 16 for k in range(1, 16)]))
    many, b = _jobs(spark, lambda: quantiles.many_quantiles(v, {f"c{i}": f"c{i}" for i in range(112)}, [k / 16 for k in range(1, 16)]))
    assert a == b and len(many[()]) == 112 and many[()]["c1"] == few[()]["c1"]
