"""Missing values, declared lengths, sparse ids, retries and gaps: nothing may vanish without a trace."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from seqloom.layout import KEY, NEED, STEP, SequenceSpec
from seqloom.operators import decisions, gradients, memory, ordered, quantiles, retrieval, ridge, sampling, scoring
from seqloom.sources import sequences
from seqloom.streaming import replay


def _steps(spark, n=40, key=1):
    return spark.createDataFrame([(key, i, i >= 2, float(i)) for i in range(n)], f"{KEY} bigint, {STEP} bigint, {NEED} boolean, x double")


def test_steps_past_the_declared_length_raise(spark):
    df = _steps(spark)
    good = ordered.running_sum(df, {"s": "x"}, SequenceSpec(length=40, chunk=4)).orderBy(STEP).collect()
    assert [r["s"] for r in good] == np.cumsum(np.arange(40.0)).tolist()
    for make in (lambda s: ordered.running_sum(df, {"s": "x"}, s), lambda s: memory.legendre_memory(df, ["x"], s)):
        with pytest.raises(Exception, match="declared length"):
            make(SequenceSpec(length=16, chunk=4)).collect()


def test_polynomial_memory_ignores_chunks_with_missing_values(spark):
    df = _steps(spark).withColumn("x", F.when(F.col(STEP) % 7 == 3, F.lit(None)).when(F.col(STEP) == 11, F.lit(float("nan"))).otherwise(F.col("x")))
    found = [memory.legendre_memory(df, ["x"], SequenceSpec(length=64, chunk=c), span=16.0).orderBy(STEP).toPandas().filter(like="leg").to_numpy() for c in (4, 64)]
    assert np.allclose(*found, rtol=1e-9) and np.isfinite(found[0]).all()


@pytest.mark.parametrize("width", [3, 12])
def test_gram_leaves_out_incomplete_rows(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(20, width + 2))
    x[3, 0], x[5, width], x[6, width + 1] = np.nan, np.nan, np.nan
    names = [f"f{i}" for i in range(width)] + ["y", "w"]
    df = spark.createDataFrame([[float(v) if not (i == 7 and j == 1) else None for j, v in enumerate(row)] for i, row in enumerate(x)], ", ".join(f"{n} double" for n in names))
    keep = [i for i in range(20) if i not in (3, 5, 6, 7)]
    g = ridge.grams(df, names[:width], {"r": (F.col("y"), F.col("w"))})[("r",)]
    part, w = x[keep, :width], x[keep, width + 1]
    assert g.rows == 16 and np.allclose(g.xx, part.T @ (w[:, None] * part)) and np.allclose(g.xr, part.T @ (w * x[keep, width]))


def test_gradient_sums_keep_the_other_rows(spark):
    rows = [(i % 2, 1.0, 0.5, 1.0 if i else float("nan")) for i in range(40)]
    df = spark.createDataFrame(rows, f"{KEY} bigint, t double, p double, f double").repartition(1)
    found = gradients.gradient_moments(df, ["f"], ["p"], ("t",), by=()).first()
    assert (found["f0"], found["fy"], found["fp"]) == (39.0, 39.0, 19.5)


def test_centered_moments_keep_the_batch(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 3)) for i in range(30)] + [(float("nan"), 1.0), (None, 1.0)], "y double, p double").repartition(1)
    clean = scoring.centered_moments(df.filter("not isnan(y)"), "y", "p").first()
    assert scoring.centered_moments(df, "y", "p").first() == clean and clean["weight"] > 0


def test_equal_sums_do_not_hide_missing_steps(spark):
    rows = [(1, i, i >= 2) for i in (0, 2, 2, 3, 3, 4, 7, 7, 8, 9)] + [(2, i, i >= 2) for i in range(10)] + [(3, i, i >= 2) for i in range(40_000)]
    df = spark.createDataFrame(rows, f"{KEY} bigint, {STEP} bigint, {NEED} boolean")
    found = sequences.validate_sequences(df, SequenceSpec(warmup=2), fixed_length=False).collect()
    assert [(r[KEY], r["broken_steps"]) for r in found] == [(1, True)]


def test_cache_after_a_lost_second_write(spark, tmp_path):
    df = _steps(spark, 24).withColumn("split", F.lit("a"))
    path = str(tmp_path / "cache")
    sequences.write_cache(df, path, {"v": "1"})
    # The first call had written its rows and died before it said so.
    import shutil

    shutil.rmtree(f"{path}/done")
    assert sequences.write_cache(df, path, {"v": "1"}) == 24
    assert sequences.read_cache(spark, path).count() == 24


def test_large_ids_stay_apart(spark):
    class Count:
        def reset(self):
            self.n = 0

        def predict(self, block):
            out = np.arange(self.n, self.n + len(block), dtype=float)
            self.n += len(block)
            return out

    big = (1 << 60) + 1
    df = spark.createDataFrame([(big + k, i, True) for k in range(3) for i in range(8)], f"{KEY} bigint, {STEP} bigint, {NEED} boolean")
    rows = memory.stateful_batch_score(df, [], Count, ["y"]).collect()
    assert all(r["y"] == r[STEP] for r in rows) and len(rows) == 24


def test_quantiles_of_odd_values(spark):
    values = [float(i) for i in range(11)] + [float("nan"), math.inf, -math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.0, 0.5, 0.75, 1.0]) == [0.0, 5.0, 7.5, 10.0]
    wide = [s * v * 1e304 for v in range(1, 16_000, 3) for s in (-1.0, 1.0)]
    df = spark.createDataFrame([(v,) for v in wide], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.25]) == pytest.approx(np.quantile(np.array(wide) / 1e304, [0.25]) * 1e304)


def test_places_of_sparse_ids(spark):
    ids = sorted({int(v) for v in np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5_000)})
    found = sampling.sequence_places(spark.createDataFrame([(i,) for i in ids], f"{KEY} bigint")).collect()
    assert {r[KEY]: r["place"] for r in found} == {v: i for i, v in enumerate(ids)}


def test_several_root_rows_raise(spark):
    runs = spark.createDataFrame([("a", None, 1.0)], "run string, parent string, m double")
    with pytest.raises(Exception, match="several rows"):
        decisions.deltas_vs_reference(runs, "run", "parent", "m", spark.createDataFrame([(1.0,), (2.0,)], "m double")).collect()


def test_neighbours_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 5)).round(1), rng.normal(size=(20, 5)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>")
    found = retrieval.vector_knn(df, "id", "e", {str(i): v for i, v in enumerate(q)}, 6).toPandas()
    for i, v in enumerate(q):
        d = ((x - v) ** 2).sum(1)
        assert found[found["query"] == str(i)].sort_values("rank")["id"].tolist() == np.lexsort((np.arange(300), d))[:6].tolist()


def running_total():
    """A model class of its own per call: workers get it by value, without this file."""
    class Steps(replay.StepModel):
        outputs = ("y",)

        def start(self):
            return np.zeros(1)

        def step(self, state, step, row):
            return state + row, (float(state[0] + row[0]),)

    return Steps


@pytest.mark.parametrize("hot", [1_000, 5])
def test_title_sets_that_share_their_rare_tokens(spark, monkeypatch, hot):
    monkeypatch.setattr(retrieval, "HOT_BUCKET", hot)
    rng = np.random.default_rng(6)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, ["rare", *rng.choice(common, 6, replace=False).tolist()]) for i in range(120)] + [(500 + i, [f"z{i}", *common[:7], "rare"]) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    found = {r["id"]: (r["copies"], r["partner"] is not None) for r in retrieval.near_duplicate_titles(df, "id", F.col("w"), 0.7).collect()}
    first: dict = {}
    for i, w in rows:
        first.setdefault(frozenset(w), []).append(i)
    want = {}
    for s, ids in first.items():
        near = any(t != s and len(s & t) / len(s | t) >= 0.7 for t in first)
        if len(ids) > 1 or near:
            want[ids[0]] = (len(ids), near)
    assert found == want


@pytest.mark.parametrize("most", [None, 2])
def test_replay_reports_gaps_and_repeats(spark, tmp_path, most):
    batches = [[(0, 1.0), (1, 1.0), (4, 1.0)], [(4, 9.0), (5, 1.0), (0, 1.0)], [(6, 1.0), (8, 1.0)], [(replay.END, 0.0)]]
    schema = f"{KEY} bigint, {STEP} bigint, {NEED} boolean, x double"
    for i, rows in enumerate(batches):
        pd.DataFrame({KEY: 1, STEP: [r[0] for r in rows], NEED: True, "x": [r[1] for r in rows]}).to_json(tmp_path / f"in{i}.json", orient="records", lines=True)
        (tmp_path / "in").mkdir(exist_ok=True)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        (tmp_path / f"in{i}.json").rename(tmp_path / "in" / f"{i}.json")
        replay.run_available(replay.stream_replay(stream, ["x"], running_total(), most), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r[STEP], r["status"], r["y"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = [(0, "late", None), (0, "ok", 1.0), (1, "ok", 2.0), (2, "gap", None), (4, "ok", 3.0), (4, "repeat", None), (5, "ok", 4.0), (6, "ok", 5.0), (7, "gap", None), (8, "ok", 6.0)]
    assert sorted(got, key=str) == sorted(want, key=str)
