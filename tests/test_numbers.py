"""Scores, fits, trees, resampling, retrieval and fusion against NumPy or brute force on small fixtures."""

import hashlib
import itertools
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from seqloom.functions import scalar, vectors
from seqloom.layout import KEY, NEED, SCORED, STEP, FeatureLayout, SequenceSpec
from seqloom.operators import curves, fusion, gradients, objective, populations, quantiles, resampling, retrieval, ridge, scoring, selection, slices, trees
from seqloom.sources import documents, ledger, sequences, tables

RNG = np.random.default_rng(11)
SPEC = SequenceSpec(length=80, warmup=5, position_edges=(25, 50), chunk=32)


def wp(y, p):
    y, p = np.clip(y, -2, 2), np.clip(p, -2, 2)
    w = np.abs(y)
    if w.sum() < 1e-8:
        return 0.0
    my, mp = (w * y).sum() / w.sum(), (w * p).sum() / w.sum()
    sy, sp = np.sqrt((w * (y - my) ** 2).sum() / w.sum()), np.sqrt((w * (p - mp) ** 2).sum() / w.sum())
    return 0.0 if sy <= 1e-8 or sp <= 1e-8 else float((w * (y - my) * (p - mp)).sum() / w.sum() / (sy * sp))


@pytest.fixture(scope="module")
def data(spark):
    n_seq, n = 12, 80
    pdf = pd.DataFrame({KEY: np.repeat(np.arange(n_seq), n), STEP: np.tile(np.arange(n), n_seq)})
    for c in ("x0", "x1", "x2"):
        pdf[c] = RNG.normal(size=len(pdf))
    pdf["p0"], pdf["p1"] = RNG.normal(size=len(pdf)), RNG.normal(size=len(pdf)) * 1.5
    pdf["t0"] = pdf.p0 * 0.7 + 0.5 * pdf.x0 - 0.3 * pdf.x1 * (pdf.x2 > 0) + RNG.normal(size=len(pdf)) * 0.5
    pdf["t1"] = pdf.p1 * 0.5 + RNG.normal(size=len(pdf))
    pdf[NEED] = pdf[STEP] >= SPEC.warmup
    pdf[SCORED] = pdf[NEED] & (RNG.random(len(pdf)) < 1 / (1 + np.exp(-pdf.x0)))
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_score_is_mergeable_and_guarded(spark, data):
    pdf, df = data
    rows = pdf[pdf[SCORED]]
    got = {r["target"]: r["wp"] for r in scoring.with_wp(scoring.add_sums(scoring.moments(scoring.scored_rows(df), {"b": ("p0", "p1")}, by=[KEY]), ["system", "target"])).collect()}
    assert got["t0"] == pytest.approx(wp(rows.t0, rows.p0), abs=1e-12) and got["t1"] == pytest.approx(wp(rows.t1, rows.p1), abs=1e-12)
    assert abs(got["t0"] - np.corrcoef(rows.t0, rows.p0)[0, 1]) > 1e-4
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "t0 double, p0 double")
    assert scoring.with_wp(scoring.moments(flat, {"b": ("p0",)}, ("t0",))).first()["wp"] == 0.0
    constant = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "t0 double, p0 double")
    assert scoring.with_wp(scoring.moments(constant, {"b": ("p0",)}, ("t0",))).first()["wp"] == 0.0
    assert spark.range(1).select(scalar.clip(F.lit(float("nan"))).alias("c")).first()["c"] is None


def test_no_scored_rows_is_an_error(data):
    _, df = data
    with pytest.raises(Exception, match="no rows selected"):
        scoring.global_wp(df.withColumn(SCORED, F.lit(False)), {"b": ("p0", "p1")}).collect()


def test_centered_blocks_survive_a_large_offset(data):
    pdf, df = data
    y, p = pdf.t0 + 1e7, pdf.p0 + 1e7
    got = scoring.centered_moments(df.select((F.col("t0") + 1e7).alias("y"), (F.col("p0") + 1e7).alias("p")), "y", "p", None).select(scoring.centered_wp()).first()[0]
    assert got == pytest.approx(float(np.cov(y, p, aweights=y)[0, 1] / np.sqrt(np.cov(y, p, aweights=y)[0, 0] * np.cov(y, p, aweights=y)[1, 1])), abs=1e-9)


def test_exact_quantiles_with_a_hot_value(spark):
    v = np.concatenate([np.full(4000, 2.0), RNG.normal(size=7001) ** 3, [1e9]])
    df = spark.createDataFrame(pd.DataFrame({"v": RNG.permutation(v)}))
    probs = [0.0, 0.01, 0.3, 0.5, 0.75, 0.999, 1.0]
    assert np.allclose(quantiles.exact_quantiles(df, "v", probs), np.quantile(v, probs), rtol=0, atol=1e-12)


def test_cumulative_and_auc(spark, data):
    pdf, df = data
    score = np.round(pdf.x0, 1)
    auc = populations.roc_auc(df, F.col(SCORED), F.round("x0", 1)).first()["auc"]
    pos, neg = score[pdf[SCORED]].to_numpy(), score[~pdf[SCORED]].to_numpy()
    want = ((pos[:, None] > neg).mean() + 0.5 * (np.abs(pos[:, None] - neg) < 1e-9).mean())
    assert auc == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("scale", ["rows", "mass"])
def test_wide_and_narrow_ridge_agree_with_dense_algebra(data, scale):
    pdf, df = data
    wide = [F.lit(1.0), "x0", "x1", "x2", *[F.col("x0") * F.col("x1") * float(k) + F.pow("x2", F.lit(k)) for k in range(2, 10)]]
    x = np.column_stack([np.ones(len(pdf)), pdf.x0, pdf.x1, pdf.x2, *[pdf.x0 * pdf.x1 * k + pdf.x2**k for k in range(2, 10)]])
    for feats, m in ((wide, x), (wide[:4], x[:, :4])):
        got = ridge.weighted_ridge(df, feats, ridge.residual_responses(("p0", "p1")), 0.05, scale=scale)
        for t, p in (("t0", "p0"), ("t1", "p1")):
            w, r = np.abs(np.clip(pdf[t], -2, 2)).to_numpy(), (pdf[t] - pdf[p]).to_numpy()
            gram, rhs = m.T @ (w[:, None] * m), m.T @ (w * r)
            d = m.shape[1]
            want = np.linalg.solve(gram + np.eye(d) * len(m) * 0.05, rhs) if scale == "rows" else np.linalg.solve(gram / w.sum() + np.eye(d) * 0.05, rhs / w.sum())
            assert np.allclose(got[(t,)], want, rtol=1e-7, atol=1e-9)


def test_mass_scaling_ignores_weight_scale_and_mse_needs_no_scan(data):
    pdf, df = data
    f = [F.lit(1.0), "x0"]
    a = ridge.grams(df, f, ridge.residual_responses(("p0", "p1")))[("t0",)]
    b = ridge.grams(df, f, ridge.residual_responses(("p0", "p1"), focus=F.lit(7.0)))[("t0",)]
    assert np.allclose(a.solve(0.1, "mass"), b.solve(0.1, "mass"))
    coef = a.solve(0.01)
    w = np.abs(np.clip(pdf.t0, -2, 2))
    direct = (w * (pdf.t0 - pdf.p0 - coef[0] - coef[1] * pdf.x0) ** 2).sum() / w.sum()
    assert a.mse(coef) == pytest.approx(direct)


def test_score_gradient_matches_finite_differences_and_fit_improves(data):
    pdf, df = data
    rows = pdf[pdf[NEED]]
    f = [F.lit(1.0), "x0", "x1"]
    m = np.column_stack([np.ones(len(rows)), rows.x0, rows.x1])
    g = {r["feature"]: r["gradient"] for r in gradients.pooled_gradient(scoring.required_rows(df), f, ("p0", "p1")).filter("target = 't0'").collect()}
    for k in range(3):
        h = 1e-6
        want = (wp(rows.t0, rows.p0 + h * m[:, k]) - wp(rows.t0, rows.p0 - h * m[:, k])) / (2 * h)
        assert g[k] == pytest.approx(want, abs=1e-4)
    coef, value = objective.fit_wp(scoring.required_rows(df), f, "p0", "t0", 0.01, iterations=10)
    assert -value > wp(rows.t0, rows.p0) + 0.05
    assert wp(rows.t0, rows.p0 + m @ coef) == pytest.approx(-value + 0.01 * coef @ coef / 2, abs=1e-9)


def test_tree_level_picks_the_brute_force_split(data):
    pdf, df = data
    rows = pdf[pdf[NEED]]
    edges = [[-1.0, 0.0, 1.0], [-0.5, 0.0, 0.5]]
    binned = scoring.required_rows(df).withColumns({"b0": scalar.search_sorted("x0", edges[0]), "b1": scalar.search_sorted("x1", edges[1])})
    w, r = F.abs(scalar.clip("t0")), scalar.clip("t0") - F.col("p0")
    tree = trees.grow_tree(binned, ["b0", "b1"], edges, w * r, w, max_depth=1, min_leaf=20, l2=10.0, rate=1.0)
    y = np.clip(rows.t0, -2, 2)
    ww, g = np.abs(y), np.abs(y) * (y - rows.p0)
    best = max((((g[s].sum()) ** 2 / (ww[s].sum() + 10) + (g[~s].sum()) ** 2 / (ww[~s].sum() + 10)), j, e)
               for j, c in enumerate(("x0", "x1")) for e in edges[j] for s in [rows[c] <= e] if s.sum() >= 20 and (~s).sum() >= 20)
    assert (tree[0].feature, tree[0].threshold) == best[1:]
    left = rows[("x0", "x1")[best[1]]] <= best[2]
    assert tree[1].value == pytest.approx(g[left].sum() / (ww[left].sum() + 10))
    scored = scoring.required_rows(df).select(F.sum(trees.score_trees([tree], ["x0", "x1"]))).first()[0]
    arrow = scoring.required_rows(df).select(F.sum(trees.score_trees([tree] * 400, ["x0", "x1"]))).first()[0]
    assert arrow == pytest.approx(scored * 400)
    with pytest.raises(ValueError):
        trees.depth([trees.Node(feature=0, left=0, right=0)])


def test_boosting_lowers_the_weighted_error(data):
    _, df = data
    rows = scoring.required_rows(df)
    model = trees.boosted_residual(rows, ["x0", "x1"], "t0", "p0", rounds=3, n_bins=8, min_leaf=20, l2=1.0, rate=0.5)
    moved = rows.withColumn("q0", F.col("p0") + trees.score_trees(model, ["x0", "x1"]))
    w, y = F.abs(scalar.clip("t0")), scalar.clip("t0")
    before, after = moved.agg(*[F.sum(w * (y - F.col(c)) ** 2) for c in ("p0", "q0")]).first()
    assert after < before * 0.9


def test_curve_is_bounded_and_optimal(data):
    pdf, df = data
    fit = curves.bounded_curve_fit(df, "t0", "p0")
    assert np.abs(fit["curve"]).max() <= 1.9 + 1e-12 and np.abs(fit["affine"]).max() <= 1.9 + 1e-12
    g = ridge.grams(df, vectors.interpolation_basis("p0", list(fit["knots"])), {"y": (scalar.clip("t0"), F.abs(scalar.clip("t0")))})[("y",)]
    second = np.diff(np.eye(17), n=2, axis=0)
    slope = (g.xx + g.mass * 1e-4 * second.T @ second + np.eye(17) * g.mass * 1e-10) @ fit["curve"] - g.xr
    free = np.abs(fit["curve"]) < 1.9 - 1e-9
    assert np.abs(slope[free]).max() < 1e-6 * g.mass
    assert all(s * c <= 1e-9 for s, c in zip(slope[~free], fit["curve"][~free]))


def test_selection_models_never_see_their_own_fold(data):
    pdf, df = data
    out = selection.logistic_propensity(scoring.required_rows(df), ["x0", "x1"], F.col(SCORED), SPEC)
    assert populations.roc_auc(out, F.col(SCORED), F.col("propensity")).first()["auc"] > 0.6
    assert out.select(KEY, "fold").distinct().count() == 12
    # Changing the labels of one fold must not change its own probabilities.
    flipped = scoring.required_rows(df).withColumn(SCORED, F.when(F.col(KEY) % 4 == 0, ~F.col(SCORED)).otherwise(F.col(SCORED)))
    again = selection.logistic_propensity(flipped, ["x0", "x1"], F.col(SCORED), SPEC)
    both = out.filter("fold = 0").select(KEY, STEP, "propensity").join(again.select(KEY, STEP, F.col("propensity").alias("q")), [KEY, STEP])
    assert both.agg(F.max(F.abs(F.col("propensity") - F.col("q")))).first()[0] < 1e-6


def test_selection_models_settle_in_few_shared_passes(data, monkeypatch):
    pdf, df = data
    passes, whole = [], selection._terms

    def counting(rows, names, coefs):
        passes.append(whole(rows, names, coefs))
        return passes[-1]

    monkeypatch.setattr(selection, "_terms", counting)
    out = selection.logistic_propensity(scoring.required_rows(df), ["x0", "x1"], F.col(SCORED), SPEC).toPandas()
    # Four models, one pass for a step of all of them.
    assert len(passes) <= 10
    for k in range(4):
        part = out[out.fold == k]
        logit, x = np.log(part.propensity / (1 - part.propensity)), np.column_stack([np.ones(len(part)), part.x0, part.x1])
        coef = np.linalg.lstsq(x, logit, rcond=None)[0]
        rest = out[out.fold != k]
        x = np.column_stack([np.ones(len(rest)), rest.x0, rest.x1])
        slope = x.T @ (1 / (1 + np.exp(-x @ coef)) - rest[SCORED].astype(float)) / len(rest) + 0.1 * coef * [0, 1, 1]
        assert np.abs(slope).max() < 1e-9


def test_bootstrap_counts_and_pairing(data):
    _, df = data
    counts = resampling.bootstrap_counts(df, 15, 3).groupBy("draw").agg(F.sum("times").alias("n")).collect()
    assert len(counts) == 15 and {r["n"] for r in counts} == {12}
    same = {"base": ("p0", "p1"), "candidate": ("p0", "p1")}
    out = resampling.paired_bootstrap(scoring.moments(scoring.scored_rows(df), same, by=[KEY]), draws=20).collect()
    assert all(r["point"] == r["lower"] == r["upper"] == 0.0 for r in out)


def test_side_contrasts_are_antisymmetric_order_free_and_finite(spark):
    x = RNG.normal(size=(9, 8)) * 3
    x[0] = 1e20
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(8)]))

    def run(order):
        c = [f"c{i}" for i in order]
        return np.array(df.select(*vectors.side_contrasts((c[0:2], c[2:4]), (c[4:6], c[6:8]))).collect())

    plain, swapped, permuted = run(range(8)), run([2, 3, 0, 1, 6, 7, 4, 5]), run([1, 0, 3, 2, 5, 4, 7, 6])
    assert np.isfinite(plain).all() and np.allclose(plain, -swapped) and np.allclose(plain, permuted)


def test_consensus_keeps_agreement_and_drops_conflict(spark):
    got = [r[0] for r in spark.createDataFrame([(1.0, 3.0), (1.0, -3.0), (-2.0, -1.0)], "a double, b double").select(scalar.consensus("a", "b")).collect()]
    assert got == [1.0, 0.0, -1.0]


def test_atlas_rejects_poisoned_rows(data):
    _, df = data
    both = df.withColumns({"q0": F.col("p0") * 0.9, "q1": F.col("p1") * 0.9})
    atlas = slices.error_atlas(both, ["x0", "x1"], {"all": (0, 1)}, {"base": ("p0", "p1"), "candidate": ("q0", "q1")}, SPEC, (1, 10)).cache()
    assert slices.check_atlas(atlas).count() == 0
    assert slices.check_atlas(atlas.withColumn("value", F.lit(float("nan")))).count() == atlas.count()
    with pytest.raises(ValueError):
        slices.check_atlas(atlas.withColumn("secret", F.lit(1)))
    assert slices.atlas_json(atlas).count() == 10


def test_near_duplicates_equal_brute_force_with_many_copies(spark):
    words = [f"w{i}" for i in range(40)]
    sets = [" ".join(RNG.choice(words, size=RNG.integers(8, 20), replace=False)) for _ in range(40)]
    texts = sets + [s + " extra" for s in sets[:10]] + [" ".join(reversed(s.split())) for s in sets[:5]] + [sets[0]] * 50
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = retrieval.near_duplicate_titles(df, "id", retrieval.tokens(F.col("text"))).collect()
    bags = [frozenset(t.split()) for t in texts]
    first = {}
    for i, b in enumerate(bags):
        first.setdefault(b, i)
    near = {(x, y) for x, y in itertools.permutations(set(bags), 2) if len(x & y) / len(x | y) >= 0.85}
    assert {r["id"] for r in got if r["partner"] is not None} == {first[x] for x, _ in near}
    assert all((bags[r["id"]], bags[r["partner"]]) in near for r in got if r["partner"] is not None)
    assert {r["id"]: r["copies"] for r in got if r["copies"] > 1} == {first[b]: bags.count(b) for b in set(bags) if bags.count(b) > 1}


def test_vote_ties_go_to_the_best_ranked_model(spark):
    models = spark.createDataFrame([("a", 0, 1.0, True), ("b", 1, 2.0, True), ("c", 2, 0.0, True)], "model string, rank int, metric double, maximize boolean")
    weights = fusion.fusion_weights(models)
    assert [round(r["weight"], 6) for r in weights.orderBy("rank").collect()] == [round(3 / 7, 6), round(4 / 7, 6), 0.0]
    even = weights.withColumn("weight", F.lit(1 / 3))
    pred = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z"), ("a", 2, " p  q"), ("b", 2, "p r"), ("c", 2, "p r s"), ("a", 3, " k  k"), ("b", 3, " k  k"), ("c", 3, " k  k")], "model string, id int, value string")
    assert fusion.fuse_vote(pred, even).filter("id = 1").first()["value"] == "x"
    assert {r["id"]: r["value"] for r in fusion.fuse_cellwise(pred, even).collect()} == {1: "x", 2: "p r s", 3: " k  k"}
    zero = fusion.fusion_weights(models.withColumn("metric", F.lit(0.0)))
    assert {round(r["weight"], 6) for r in zero.collect()} == {round(1 / 3, 6)}
    bad = spark.createDataFrame([("a", 0, -1.0, False), ("b", 1, -0.0, False), ("c", 2, 0.5, False)], "model string, rank int, metric double, maximize boolean")
    assert [(r["model"], r["rank"]) for r in fusion.usable_models(bad).collect()] == [("c", 0)]


def test_formats(spark):
    def kind(rows, schema):
        return fusion.detect_format(spark.createDataFrame(rows, schema)).first().asDict()

    assert kind([(i, i % 2) for i in range(9)], "id int, y int")["fusion"] == "vote"
    assert kind([(i, f"{i} 0 1") for i in range(9)], "id int, y string")["fusion"] == "cellwise"
    assert kind([(i, "1 " * (i + 2)) for i in range(9)], "id int, y string")["fusion"] == "text_vote"
    assert kind([(1, "cat")] * 9, "k int, y string") | {} == {"id_columns": "", "prediction_columns": "k,y", "passthrough_columns": "", "fusion": "vote", "normalize": False}


def test_cache_refuses_another_identity_and_resumes(spark, data, tmp_path):
    _, df = data
    rows = df.withColumn("split", F.lit("fit"))
    path = str(tmp_path / "cache")
    assert sequences.write_cache(rows.filter(f"{KEY} < 5"), path, {"v": "1"}) == 5 * 80
    assert sequences.write_cache(rows, path, {"v": "1"}) == 7 * 80
    assert sequences.write_cache(rows, path, {"v": "1"}) == 0
    assert sequences.read_cache(spark, path).count() == 12 * 80
    with pytest.raises(ValueError):
        sequences.write_cache(rows, path, {"v": "2"})


def test_scan_checks_columns(spark, tmp_path):
    layout = FeatureLayout(("f0", "f1"))
    good = spark.createDataFrame([], layout.schema(SPEC, True))
    good.write.parquet(str(tmp_path / "good"))
    good.withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "bad"))
    assert sequences.sequence_scan(spark, str(tmp_path / "good"), layout, SPEC, True, [KEY, "f1"]).columns == [KEY, "f1"]
    with pytest.raises(ValueError):
        sequences.sequence_scan(spark, str(tmp_path / "bad"), layout, SPEC, True)
    assert len(FeatureLayout.order_book().names) == 112 and FeatureLayout.order_book().groups["delta_velocity"] == tuple([*range(48, 52), *range(100, 104)])


def test_content_hash_ignores_storage_but_not_order(data):
    _, df = data
    a = sequences.content_hash(df, ["x0"], SPEC)
    assert a.exceptAll(sequences.content_hash(df.repartition(9), ["x0"], SPEC)).count() == 0
    moved = df.withColumn(STEP, F.when(F.col(STEP) < 2, 1 - F.col(STEP)).otherwise(F.col(STEP)))
    assert a.join(sequences.content_hash(moved, ["x0"], SPEC), [KEY, "digest"]).count() == 0


def test_digests_have_two_levels_at_every_length(spark):
    spec = replace(SPEC, length=50, chunk=3)
    rows = [(7, i, True, True, float(i % 5)) for i in range(50)]  # more than 3 * 3 steps
    df = spark.createDataFrame(rows, f"{KEY} bigint, {STEP} int, need_prediction boolean, is_scored boolean, x0 double")

    def sha(cells):
        return hashlib.sha256("".join(cells).encode()).hexdigest()

    def two_levels(cells):
        return sha(sha(cells[i:i + 3]) for i in range(0, len(cells), 3))

    want = two_levels([hashlib.md5(f"{i}|{x}".encode()).hexdigest() for _, i, *_, x in rows])
    assert sequences.content_hash(df, ["x0"], spec).first()["digest"] == want
    masked = sha([sha([two_levels([str(i) for _, i, *_ in rows])])])
    assert sequences.mask_digest(df, spec).first()["digest"] == masked


def test_cards_and_manifest(spark, tmp_path):
    import json

    card = {"schema_version": 1, "card_id": "abc", "version": 1, "card_type": "paper", "family": "f", "tags": ["a"], "title": "t", "authors": ["x"], "year": 2000,
            "source_url": "https://e.org/a", "source_locator": "p1", "claim_confidence": "high", "mechanism": "m", "useful_when": "u", "limitations": "l", "verified_on": "2020-01-01"}
    for name, extra in (("abc", {}), ("abd", {"card_id": "abd", "year": 1800, "authors": []}), ("abe", {"card_id": "zzz"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(card | extra))
    docs = documents.read_documents(spark, str(tmp_path))
    rules = documents.card_rules(["title", "mechanism"], "ignore previous")
    got = {r["file_id"]: r["failed"] for r in documents.validate_documents(docs, rules).collect()}
    assert got == {"abc": [], "abd": ["list_authors", "year"], "abe": ["file_name"]}
    a = ledger.manifest_hash(docs, ["card_id", "version"]).first()[0]
    assert a == ledger.manifest_hash(docs.repartition(3), ["card_id", "version"]).first()[0]
    assert documents.duplicate_sources(docs, ["source_url"]).first()["uses"] == 3


def test_profile_and_json_schema(spark):
    df = spark.createDataFrame([(i, i % 3, f"s{i % 20}", i % 2 == 0) for i in range(100)], "a int, b int, c string, d boolean")
    got = {r["column"]: r for r in tables.profile_table(df).collect()}
    assert got["a"]["max"] == 99.0 and got["a"]["examples"] is None
    assert got["b"]["examples"] == "0,1,2" and got["c"]["distinct_values"] == 20 and got["d"]["true_share"] == 0.5
    assert got["c"]["examples"] == "s0,s1,s10,s11"
    js = spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "b": "x"}',)], "j string")
    assert tables.infer_json_schema(js, "j").first()[0] == "OBJECT<a: BIGINT, b: STRING>"


def test_bundled_documents_need_no_file_each(spark, tmp_path):
    path = str(tmp_path / "cards")
    rows = [(f"c{i}", None if i == 3 else f'line\n"{i}" é') for i in range(500)]
    df = spark.createDataFrame(rows, "card_id string, title string").repartition(3)
    documents.write_bundles(df, path, F.concat(F.lit("n-"), "card_id"))
    assert len(list((tmp_path / "cards").glob("part-*"))) == 3
    read = documents.read_documents(spark, path, "card_id string, title string", bundled=True)
    assert sorted((r["card_id"], r["title"], r["file_id"]) for r in read.collect()) == sorted((c, t, f"n-{c}") for c, t in rows)


def test_document_query_opens_few_files(spark):
    from conftest import SF_DIR
    from seqloom.suite import rows

    assert len(rows.s16(spark, SF_DIR).inputFiles()) < 50


@pytest.mark.parametrize("hot", [1_000, 6])
def test_near_duplicates_of_long_sets_are_exact_and_move_few_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(retrieval, "HOT_BUCKET", hot)
    rng = np.random.default_rng(3)
    bags = [set(rng.choice(2_000, rng.integers(60, 300), replace=False).tolist()) for _ in range(150)]
    for i in range(150):  # around the threshold, and one family just below it
        base = list(bags[i % 40 if i < 100 else 0])
        drop = int(len(base) * rng.choice([0.03, 0.07, 0.08, 0.12]))
        bags.append(set(base[drop:]) | {10_000 + 500 * i + j for j in range(drop)})
    df = spark.createDataFrame([(i, [f"w{t}" for t in b]) for i, b in enumerate(bags)], "id long, w array<string>").repartition(8)

    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.length()))

    before = shuffled()
    found = {r["id"] for r in retrieval.near_duplicate_titles(df, "id", F.col("w")).collect()}
    assert found == {i for i, x in enumerate(bags) if any(i != j and len(x & y) / len(x | y) >= 0.85 for j, y in enumerate(bags))}
    assert 100 < len(found) < len(bags)
    if hot == 1_000:
        assert 0 < (shuffled() - before) / sum(map(len, bags)) < 50  # bytes a token
