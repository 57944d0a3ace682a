"""Fusion whose tasks stay of one size, and its votes against a plain version."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from seqloom import session
from seqloom.operators import fusion
from seqloom.suite import fixture, library


def test_more_rows_give_more_tasks_of_the_same_size(spark, monkeypatch):
    from conftest import SF_DIR

    monkeypatch.setattr(session, "TASK_ROWS", 2_000)
    rows = fixture.table(spark, SF_DIR, "lineitem").count()
    voted = fusion.fuse_vote(library.predictions(spark, SF_DIR, library.number), fusion.fusion_weights(library.models(spark)))
    sizes = [r["count"] for r in voted.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) <= rows and len(sizes) >= rows // 2_000 and max(sizes) < 3 * 2_000


def test_cellwise_votes_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    values = [None, "", "  ", "a b", "b a", "a  b\tc", "\u00e9 \U0001f600", "\u00e9 z", " a"]
    rows = [(i % 7, i, f"m{k}", k, values[rng.integers(len(values))]) for i in range(400) for k in range(5) if rng.random() < 0.8]
    rows += [(1, 999, f"m{k}", k, " kept  as it is ") for k in range(5)]
    weights = {k: w for k, w in enumerate([0.3, 0.3, 0.2, 0.1, 0.1])}
    pred = spark.createDataFrame([(g, i, m, v) for g, i, m, _, v in rows], "g int, id long, model string, value string")
    given = spark.createDataFrame([(f"m{k}", k, w, 0.0, True) for k, w in weights.items()], "model string, rank int, weight double, metric double, maximize boolean")
    fused = fusion.fuse_cellwise(pred, given, ["g", "id"])
    assert "MapInArrow" in fused._jdf.queryExecution().optimizedPlan().toString()  # a batch of cells at once, no interpreted array work
    got = {(r["g"], r["id"]): r["value"] for r in fused.collect()}
    cells = defaultdict(list)
    for g, i, _, k, v in rows:
        cells[g, i].append((k, v or ""))
    assert got.keys() == cells.keys()
    for key, votes in cells.items():
        if len({v for _, v in votes}) == 1:
            assert got[key] == votes[0][1]
            continue
        want = []
        for pos in range(max(len(v.split()) for _, v in votes)):
            here = [(k, v.split()[pos]) for k, v in votes if pos < len(v.split())]
            want.append(min({t for _, t in here}, key=lambda t: (-round(sum(weights[k] for k, x in here if x == t), 12), min(k for k, x in here if x == t))))
        assert got[key] == " ".join(want)
