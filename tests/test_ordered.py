"""Chunked windows and recursions against plain loops, across several levels of chunks and a hot sequence."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from seqloom.layout import KEY, NEED, SCORED, STEP, SequenceSpec
from seqloom.operators import memory, ordered, sampling
from seqloom.sources import ingest, sequences

RNG = np.random.default_rng(5)
# One sequence holds most rows; chunks of four steps give five levels of carry.
SIZES = {1: 700, 2: 60, 3: 1, 4: 130}
SPEC = SequenceSpec(length=700, warmup=5, chunk=4)


@pytest.fixture(scope="module")
def frame(spark):
    parts = [pd.DataFrame({KEY: k, STEP: np.arange(n), "x": RNG.normal(size=n), "z": RNG.normal(size=n)}) for k, n in SIZES.items()]
    pdf = pd.concat(parts, ignore_index=True)
    pdf[NEED] = pdf[STEP] >= SPEC.warmup
    pdf[SCORED] = pdf[NEED] & (RNG.random(len(pdf)) < 0.1)
    return pdf, spark.createDataFrame(pdf.sample(frac=1.0, random_state=1)).repartition(5).cache()


def back(df, cols):
    return df.select(KEY, STEP, *cols).toPandas().sort_values([KEY, STEP]).reset_index(drop=True)


def loop_ema(x, a):
    out, s = [], 0.0
    for v in x:
        s = a * v + (1 - a) * s
        out.append(s)
    return np.array(out)


def test_number_rows_with_a_hot_key(spark):
    pdf = pd.DataFrame({"k": np.where(RNG.random(5000) < 0.6, 0, RNG.integers(0, 40, 5000)), "o": RNG.permutation(5000)})
    got = ingest.number_rows(spark.createDataFrame(pdf).repartition(7), ["k"], ["o"], "n").toPandas()
    want = pdf.sort_values("o").assign(n=lambda d: d.groupby("k").cumcount())
    merged = got.merge(want, on=["k", "o"])
    assert len(merged) == 5000 and (merged.n_x == merged.n_y).all()


def test_lags_cross_chunk_borders(frame):
    pdf, df = frame
    got = back(ordered.lags(df, {"a": ("x", 1), "b": ("x", 4)}, SPEC, 0.0), ["a", "b"])
    for name, d in (("a", 1), ("b", 4)):
        want = pdf.groupby(KEY)["x"].shift(d).fillna(0.0)
        assert np.allclose(got[name], want)
    with pytest.raises(ValueError):
        ordered.lags(df, {"a": ("x", 5)}, SPEC, 0.0)


@pytest.mark.parametrize("alpha", [0.5, 0.02, 0.001, 1.0 - 1e-9])
def test_ema_over_many_levels(frame, alpha):
    pdf, df = frame
    got = back(memory.ema(df, {"s": ("x", alpha)}, SPEC), ["s"])
    want = np.concatenate([loop_ema(g["x"], alpha) for _, g in pdf.groupby(KEY)])
    assert np.allclose(got["s"], want, atol=1e-12)


def test_ema_with_vanishing_decay_between_chunks(frame):
    pdf, df = frame
    spec = SequenceSpec(length=700, warmup=5, chunk=256)
    got = back(memory.ema(df, {"s": ("x", 0.97), "t": ("z", 0.001)}, spec), ["s", "t"])
    for name, col, a in (("s", "x", 0.97), ("t", "z", 0.001)):
        want = np.concatenate([loop_ema(g[col], a) for _, g in pdf.groupby(KEY)])
        assert np.allclose(got[name], want, atol=1e-12)


def test_running_sum_and_rank(frame):
    pdf, df = frame
    got = back(ordered.running_sum(df, {"s": "x"}, SPEC), ["s"])
    assert np.allclose(got["s"], pdf.groupby(KEY)["x"].cumsum())
    marked = back(sampling.with_rank(df, F.col(SCORED), SPEC), ["_k"])
    want = pdf[pdf[SCORED]].assign(k=lambda d: d.groupby(KEY).cumcount())
    assert (marked["_k"].to_numpy() == want["k"].to_numpy()).all()


def test_previous_marked_row_may_be_many_chunks_back(frame):
    pdf, df = frame
    got = back(ordered.previous_marked(df, F.col(SCORED), {"x": F.col("x")}, SPEC), ["prev_x"])
    want = pdf[pdf[SCORED]].groupby(KEY)["x"].shift(1)
    assert np.allclose(got["prev_x"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_legendre_memory_matches_loop(frame):
    pdf, df = frame
    a, b = memory.legendre_system()
    got = back(memory.legendre_memory(df.select(KEY, STEP, "x"), ["x"], SPEC), [f"x_leg{i}" for i in range(4)])
    want = []
    for _, g in pdf.groupby(KEY):
        s = np.zeros(4)
        for v in g["x"]:
            s = a @ s + b * v
            want.append(s)
    assert np.allclose(got[[f"x_leg{i}" for i in range(4)]].to_numpy(), np.array(want), atol=1e-12)


def test_dilated_stack_equals_endpoints(frame):
    _, df = frame
    spec = SequenceSpec(length=700, warmup=5, chunk=100)
    w, b = RNG.normal(size=(4, 2, 2, 2)) * 0.5, RNG.normal(size=(4, 2)) * 0.1
    full = back(memory.dilated_stack(df.select(KEY, STEP, "x", "z"), ["x", "z"], w, b, spec), ["h"])
    sparse = back(memory.endpoint_features(memory.gather_offsets(df.select(KEY, STEP, "x", "z"), ["x", "z"], spec), ["x", "z"], w, b), ["h"])
    assert np.allclose(np.vstack(full["h"]), np.vstack(sparse["h"]))


def test_endpoints_of_other_dilations(frame):
    _, df = frame
    spec = SequenceSpec(length=700, warmup=5, chunk=100)
    w, b = RNG.normal(size=(3, 2, 1, 1)), RNG.normal(size=(3, 1)) * 0.1
    dilations, offsets = (2, 3, 7), (12, 10, 9, 7, 5, 3, 2, 0, 1)
    assert [v.tolist() for v in memory.needed_offsets(dilations)] == [[0, 2, 3, 5, 7, 9, 10, 12], [0, 3, 7, 10], [0, 7], [0]]
    full = back(memory.dilated_stack(df.select(KEY, STEP, "x"), ["x"], w, b, spec, dilations), ["h"])
    gathered = memory.gather_offsets(df.select(KEY, STEP, "x"), ["x"], spec, offsets)
    sparse = back(memory.endpoint_features(gathered, ["x"], w, b, dilations=dilations, offsets=offsets), ["h"])
    assert np.allclose(np.vstack(full["h"]), np.vstack(sparse["h"]))


def test_operators_are_causal_and_reset(frame):
    _, df = frame
    for op, outs in ((lambda d: memory.dual_ema(d, ["x"], SPEC), ["x_fast", "x_slow"]), (lambda d: memory.innovation(d, ["x", "z"], SPEC), ["innovation"])):
        assert memory.causality_violations(df, op, outs, 20, ["x", "z"]).count() == 0


def test_stateful_scoring_with_and_without_bounded_memory(frame):
    pdf, df = frame

    class LastTwo:
        def reset(self):
            self.past = 0.0

        def predict(self, block):
            x = block["x"].to_numpy(float)
            before = np.concatenate([[self.past], x[:-1]])
            self.past = x[-1]
            return x + before

    want = (pdf["x"] + pdf.groupby(KEY)["x"].shift(1).fillna(0.0))[pdf[NEED]].to_numpy()
    for back_rows in (None, 1):
        out = memory.stateful_batch_score(df, ["x"], LastTwo, ["y"], back_rows, SPEC)
        got = out.filter(NEED).toPandas().sort_values([KEY, STEP])
        assert np.allclose(got["y"], want)


def test_contract_checks(spark, frame):
    _, df = frame
    assert sequences.validate_sequences(df, SPEC, fixed_length=False).count() == 0
    broken = df.filter(~((F.col(KEY) == 2) & (F.col(STEP) == 10)))
    found = sequences.validate_sequences(broken, SPEC, fixed_length=False).collect()
    assert [r[KEY] for r in found] == [2] and found[0]["broken_steps"]
    # A repeated step that keeps count, minimum, maximum and sum of the steps is still found.
    swapped = df.withColumn(STEP, F.when((F.col(KEY) == 4) & (F.col(STEP) == 10), 11).when((F.col(KEY) == 4) & (F.col(STEP) == 13), 12).otherwise(F.col(STEP)))
    assert sequences.validate_sequences(swapped, SPEC, fixed_length=False).count() == 1


def test_sampling_is_exact_repeatable_and_ignores_partitioning(frame):
    _, df = frame
    a = sampling.sample_n_per_sequence(df, 10, 3).select(KEY, STEP)
    b = sampling.sample_n_per_sequence(df.repartition(11), 10, 3).select(KEY, STEP)
    assert a.exceptAll(b).count() == 0
    assert {r[KEY]: r["count"] for r in a.groupBy(KEY).count().collect()} == {1: 10, 2: 10, 4: 10}


def test_roles_are_disjoint(frame):
    _, df = frame
    roles = sampling.reserve_roles(df, df.filter(f"{KEY} = 3"), {"fit": 2, "selection": 1}, 4).collect()
    assert len({r[KEY] for r in roles}) == 3 and 3 not in {r[KEY] for r in roles}
    with pytest.raises(ValueError):
        sampling.reserve_roles(df, df.filter(f"{KEY} = 3"), {"fit": 4}, 4)
