"""The splitting bootstrap: totals, law of the counts, sums against counts, independence of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqloom.layout import KEY
from seqloom.operators import resampling
from seqloom.operators.resampling import Splitter, levels


def test_counts_follow_the_multinomial_law():
    n, draws = 5_000, 300
    depth = levels(n) - levels(256)
    s = Splitter(n, draws, 7, depth)
    parts = [s.counts(leaf) for leaf in range(1 << depth)]
    counts = np.concatenate([c for _, c in parts])
    assert [f for f, _ in parts] == np.cumsum([0, *(len(c) for _, c in parts)])[:-1].tolist()
    assert counts.shape == (n, draws) and (counts.sum(0) == n).all() and counts.min() >= 0
    # A count is binomial (n, 1/n): shares of 0, 1, 2, 3 picks, and no correlation between halves beyond the common total.
    share = np.bincount(counts.ravel(), minlength=4)[:4] / counts.size
    assert share == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=2e-3)
    half = counts[: n // 2].sum(0)
    assert abs(half.mean() - n / 2) < 4 * np.sqrt(n / 4 / draws) and 0.8 < half.var() / (n / 4) < 1.25
    assert abs(np.corrcoef(counts[0], counts[1])[0, 1]) < 0.2


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65])
def test_small_numbers(n):
    s = Splitter(n, 50, 3, 0)
    first, counts = s.counts(0)
    assert first == 0 and counts.shape == (n, 50) and (counts.sum(0) == n).all()


def test_depth_does_not_change_the_counts():
    whole = Splitter(700, 20, 5, 0).counts(0)[1]
    deep = Splitter(700, 20, 5, 4)
    assert (np.concatenate([deep.counts(i)[1] for i in range(16)]) == whole).all()


def test_sums_equal_counts_times_vectors(spark, monkeypatch):
    monkeypatch.setattr(resampling, "LEAF", 16)
    df = spark.range(130).select((F.col("id") * 7 + 3).alias(KEY), F.array(F.col("id").cast("double"), F.when(F.col("id") % 5 > 0, F.sin("id")), F.lit(1.0)).alias("vec"))
    counts = resampling.bootstrap_counts(df.select(KEY).repartition(3), 12, 9)
    want = counts.join(df, KEY).groupBy("draw").agg(*[F.sum(F.col("times") * F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0))).alias(f"v{i}") for i in range(3)])
    want = {r["draw"]: list(r)[1:] for r in want.collect()}
    for parts in (1, 5):
        got = {r["draw"]: r["sums"] for r in resampling.bootstrap_sums(df.repartition(parts), 12, 9).collect()}
        assert set(got) == set(range(12)) and all(got[d] == pytest.approx(want[d], rel=1e-12) and got[d][2] == 130.0 for d in got)
    monkeypatch.setattr(resampling, "LEAF", 4_096)
    again = resampling.bootstrap_counts(df.select(KEY), 12, 9)
    assert counts.exceptAll(again).count() == 0 and again.exceptAll(counts).count() == 0


def test_no_sequences(spark):
    df = spark.createDataFrame([], f"{KEY} long, vec array<double>")
    assert resampling.bootstrap_counts(df.select(KEY), 3, 1).count() == 0 and resampling.bootstrap_sums(df, 3, 1).count() == 0
