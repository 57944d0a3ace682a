"""Replay of out-of-order streams against a plain loop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from seqloom.layout import KEY, NEED, STEP
from seqloom.streaming import replay

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("mode", ["linear", "bilinear", "normalize"])
def test_stream_correction_equals_loop(spark, tmp_path, mode):
    pdf = pd.DataFrame({KEY: np.repeat([4, 9], 60), STEP: np.tile(np.arange(60), 2), "x": RNG.normal(size=120), "p": RNG.normal(size=120)})
    pdf.loc[pdf[STEP] < 7, "p"] = np.nan
    pdf[NEED] = pdf[STEP] >= 7
    width = {"linear": 5, "bilinear": 7, "normalize": 6}[mode]
    coef = RNG.normal(size=width)

    def make():
        return replay.MemoryCorrection([0.1], [2.0], coef, 0.5, mode, from_step=20)

    want = {}
    for k, g in pdf.groupby(KEY):
        model = make()
        state = model.start()
        for _, r in g.iterrows():
            state, (v,) = model.step(state, int(r[STEP]), np.array([r["x"], r["p"]]))
            if r[NEED]:
                want[(k, int(r[STEP]))] = v
    df = spark.createDataFrame(pdf).repartition(5, F.rand(1))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    replay.run_available(replay.stream_replay(stream, ["x", "p"], make), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["status"] for r in got} == {"ok"} and len(got) == len(want) == 106
    assert max(abs(r["corrected"] - want[(r[KEY], r[STEP])]) for r in got) < 1e-12


def test_unknown_mode_is_refused():
    with pytest.raises(ValueError):
        replay.MemoryCorrection([0.0], [1.0], [0.0], mode="cubic")
