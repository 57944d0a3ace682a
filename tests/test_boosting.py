"""Leaf-wise boosting against a plain version that opens one leaf at a time."""

import heapq

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from seqloom.operators import boosting
from seqloom.operators.boosting import Response, Settings


def _plain(codes, y, w, s, start):
    """Boost one model on bin codes, every histogram counted from its rows."""
    pred, out = np.full(len(y), start), []
    for _ in range(s.rounds):
        g, h = boosting.slopes(y, w, pred, s.loss)

        def look(rows):
            best = None
            for f in range(codes.shape[1]):
                for k in range(s.bins - 1):
                    left = codes[rows, f] <= k
                    n = int(left.sum())
                    if min(n, len(rows) - n) < s.min_leaf:
                        continue
                    parts = [(g[rows[m]].sum(), h[rows[m]].sum()) for m in (left, ~left)]
                    gain = sum(a * a / (b + s.l2) for a, b in parts) - g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                    if gain > 0 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, k)
            return best

        leaves, heap, splits = {0: np.arange(len(y))}, [], []
        if first := look(leaves[0]):
            heap = [(-first[0], 0, first)]
        count = 1
        while heap and len(splits) < s.leaves - 1:
            _, node, (_, f, k) = heapq.heappop(heap)
            rows = leaves.pop(node)
            splits.append((f, k))
            for side in (rows[codes[rows, f] <= k], rows[codes[rows, f] > k]):
                leaves[count] = side
                if found := look(side):
                    heapq.heappush(heap, (-found[0], count, found))
                count += 1
        for rows in leaves.values():
            pred[rows] += s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
        out.append(sorted(splits))
    return out, pred


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_equals_one_leaf_at_a_time(spark, loss):
    rng = np.random.default_rng(4)
    n, s = 1_500, Settings(rounds=4, leaves=9, rate=0.3, l2=1.5, min_leaf=20, bins=11, loss=loss)
    codes = rng.integers(0, 11, (n, 3))
    x = codes.astype(float)
    y = np.sin(x[:, 0]) + (x[:, 1] > 4) * (x[:, 2] - 3) / 4 + rng.normal(0, 0.3, n)
    if loss == "logistic":
        y = (y > 0.3).astype(float)
    w, fold = rng.random(n) + 0.1, rng.integers(0, 3, n)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b), int(k)) for r, a, b, k in zip(x, y, w, fold)], "a double, b double, c double, y double, w double, fold int").repartition(4)
    responses = [Response(F.col("y"), F.col("w"), F.col("fold") != k) for k in range(2)]
    edges = [[float(k) for k in range(10)]] * 3
    got = boosting.boost(df, ["a", "b", "c"], responses, s, edges)
    for k in range(2):
        rows = fold != k
        want, pred = _plain(codes[rows], y[rows], w[rows], s, got[k].baseline)
        assert [sorted((m.feature, int(m.threshold)) for m in t if not m.is_leaf) for t in got[k].codes] == want
        assert got[k].predict(x[rows]) == pytest.approx(pred, abs=1e-9)
        assert all(sum(m.is_leaf for m in t) <= s.leaves for t in got[k].trees)


def test_predictions_are_stored_between_rounds(spark, monkeypatch):
    df = spark.range(3_000).select((F.rand(1) * 4).alias("a"), F.rand(2).alias("b")).withColumn("y", F.sin("a") * F.col("b"))
    one = [Response(F.col("y"), F.lit(1.0), F.lit(True))]
    s = Settings(rounds=5, leaves=5, min_leaf=30, bins=16, rate=0.5, l2=0.0)
    far = boosting.boost(df, ["a", "b"], one, s)[0]
    monkeypatch.setattr(boosting, "STORE", 2)
    monkeypatch.setattr(boosting, "DIRECT", 0)  # sums by key
    near = boosting.boost(df, ["a", "b"], one, s)[0]
    assert [[(m.feature, m.threshold) for m in t] for t in far.trees] == [[(m.feature, m.threshold) for m in t] for t in near.trees]
    fit = df.select("y", boosting.predicted([far], ["a", "b"]).alias("p"))
    before, after = fit.select(F.var_pop("y"), F.avg((F.col("y") - F.col("p")) ** 2)).first()
    assert after < 0.1 * before


def test_missing_values_and_empty(spark):
    nan = float("nan")
    rows = [(None, 1.0, 1.0), (nan, 1.0, 1.0), (1.0, None, 1.0), (1.0, nan, 1.0), (1.0, 0.0, None), (1.0, 0.0, 1.0), (2.0, 0.0, 2.0)] * 3
    df = spark.createDataFrame(rows, "a double, y double, w double")
    s = Settings(rounds=2, leaves=3, min_leaf=1, bins=4, l2=0.0, rate=1.0)
    m = boosting.boost(df, ["a"], [Response(F.col("y"), F.col("w"), F.lit(True))], s)
    assert m[0].baseline == pytest.approx(6 / 15)
    got = df.select("a", boosting.predicted(m, ["a"]).alias("p")).distinct().collect()
    # Missing values share the last bin with 2.0: above every edge.
    assert all(r["p"] == pytest.approx(0.0 if r["a"] == 1.0 else 0.5) for r in got)
    none = boosting.boost(df.limit(0), ["a"], [Response(F.col("y"), F.col("w"), F.lit(True))], s)
    assert none[0].predict(np.array([[1.0]])) == 0.0


def test_place_by_bits_equals_a_walk_at_every_size():
    from seqloom.operators.trees import Node

    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (4, 500)).astype(np.uint8)
    for leaves in (1, 2, 15, 16, 17, 63, 64, 65, 100):
        tree = [Node()]
        while sum(node.is_leaf for node in tree) < leaves:
            at = int(rng.choice([i for i, node in enumerate(tree) if node.is_leaf]))
            tree[at] = Node(feature=int(rng.integers(4)), threshold=float(rng.integers(0, 256)), left=len(tree), right=len(tree) + 1)
            tree += [Node(value=1.0), Node(value=2.0)]
        got = boosting.place(codes, tree)
        assert (got == boosting._walked(codes, tree)).all() and got.dtype == np.int32


def _cross_fit(spark, n, folds=4):
    df = spark.range(n).select((F.rand(1) * 4).alias("a"), F.rand(2).alias("b"), F.pmod(F.xxhash64("id"), F.lit(folds)).alias("fold")).coalesce(2)
    df = df.withColumn("y", (F.sin("a") * F.col("b") > 0.2).cast("double"))
    return df, [Response(F.col("y"), F.lit(1.0), F.col("fold") != k) for k in range(folds)]


def test_models_share_equal_lines(spark):
    # Four cross-fitted models kept four copies of responses and weights: 98 bytes a row of two features, most of what a pass reads.
    df, responses = _cross_fit(spark, 20_000)
    stored = boosting.blocks(df, ["a", "b"], [[1.0, 2.0], [0.5]], responses, [0.0] * 4)
    size, n = stored.select(F.sum(sum(F.length(c) for c in stored.columns[1:])), F.sum("n")).first()
    assert n == 20_000 and size < 45 * n
    codes, y, w, used, pred = boosting._open(pa.RecordBatch.from_pandas(stored.limit(1).toPandas(), preserve_index=False), 0)
    assert y.shape == w.shape == used.shape == pred.shape and (w == 1).all() and (used.sum(0) == 3).all()


def test_lines_are_packed_without_loss():
    rng = np.random.default_rng(6)
    for a in (rng.random((2, 9)), np.tile(rng.random(9), (3, 1)), np.ones((4, 5)), np.array([[0.0, 255.0]]), np.array([[-1.0, 256.0]]), np.array([[0.1, 1e300]]), np.array([[0.5, -0.25]])):
        assert (boosting.unpacked(boosting.packed(a), *a.shape) == a).all()


def test_models_do_not_wait_for_each_other(spark, monkeypatch):
    # A pass counted for one tree of every model, so that all waited for the deepest tree of the round.
    df, responses = _cross_fit(spark, 3_000)
    s = Settings(rounds=6, leaves=9, min_leaf=10, bins=16, rate=0.5, l2=1.0, loss="logistic")
    passes, count = [], boosting.histograms

    def seen(*args):
        passes.append(sum(map(bool, args[3])))
        return count(*args)

    monkeypatch.setattr(boosting, "histograms", seen)
    together = boosting.boost(df, ["a", "b"], responses, s)
    most = len(passes)
    alone, single = [], []
    for r in responses:
        passes.clear()
        alone += boosting.boost(df, ["a", "b"], [r], s)
        single.append(len(passes))
    assert most == max(single)
    for one, all_ in zip(alone, together):
        assert [[(m.feature, m.threshold) for m in t] for t in one.trees] == [[(m.feature, m.threshold) for m in t] for t in all_.trees]


def test_prediction_by_codes_equals_a_walk(spark):
    from seqloom.operators.trees import walk

    df, responses = _cross_fit(spark, 2_000)
    model = boosting.boost(df, ["a", "b"], responses[:1], Settings(rounds=5, leaves=6, min_leaf=10, bins=16, loss="logistic"))[0]
    x = np.array([[e + d, 0.3] for e in model.edges[0] for d in (-1e-9, 0.0, 1e-9)] + [[np.nan, 0.5], [np.inf, np.nan], [-np.inf, 1.0]])
    assert (model.predict(x) == model.baseline + sum((walk(t, x) for t in model.trees), np.zeros(len(x)))).all()


def test_passes_take_small_batches(spark):
    # 92 blocks came to a task in one batch of 40 MB; the caller's setting stands again afterwards.
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, sizes = spark.conf.get(name), []
    df, responses = _cross_fit(spark, 10_000)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boosting, "histograms", lambda *a: sizes.append(spark.conf.get(name)) or {(j, k): np.zeros((2, 3, 16)) for j, w in enumerate(a[3]) for k in w})
        boosting.boost(df, ["a", "b"], responses, Settings(rounds=1, leaves=3, bins=16))
    assert sizes and set(sizes) == {str(boosting.BATCH)} and spark.conf.get(name) == before
