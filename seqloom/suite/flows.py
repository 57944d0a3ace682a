"""End-to-end flows with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.layout import KEY
from seqloom.operators import resampling
from seqloom.plans import correction, diagnostics, frozen
from seqloom.session import shared_dir
from seqloom.suite import evidence, scores
from seqloom.suite.fits import fit3, rows3
from seqloom.suite.fixture import BOTH, LONG_SQL, r, round_all, seq, six_sql, spec, sql, wp_sql

Q: dict = {}
SCORED = "need_prediction AND is_scored"


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


STATS = ("fs AS (SELECT avg(x0) AS m, sqrt(greatest(avg(x0*x0) - avg(x0)*avg(x0), 0.000001)) AS s FROM seq WHERE seq_ix % 2 = 0 AND step_in_seq % 5 = 0)",
         "sx AS (SELECT seq.*, greatest(-8.0::DOUBLE, least(8.0::DOUBLE, (x0 - m) / s)) AS z FROM seq, fs)")


@query("flow_fit_and_evaluate", sql(
    f"""SELECT target, strength, {r('bw')} AS base_wp, {r('wp')} AS candidate_wp, {r('point')} AS point, {r('lower')} AS lower, {r('upper')} AS upper FROM pk JOIN iv USING (target) WHERE k = 1""", *STATS,
    # One target at a time: its design is 1, z and its own base prediction.
    *fit3(rows3(["1.0::DOUBLE", "z", "p0"], src="sx", where="need_prediction AND seq_ix % 2 = 0 AND (step_in_seq - 9) % 5 = 0").split(" UNION ALL ")[0], 0.001),
    "st AS (SELECT unnest([0.0::DOUBLE, 0.05, 0.1, 0.25, 0.5, 1.0]) AS strength)",
    f"gr AS (SELECT 't0' AS target, strength, {six_sql('t0', 'p0 + strength * (c0 + c1*z + c2*p0)')} FROM sx, coef, st WHERE {SCORED} AND seq_ix % 2 = 1 GROUP BY ALL)",
    f"gv AS (SELECT target, strength, {wp_sql()} AS wp FROM gr)",
    "pk AS (SELECT *, max(CASE WHEN strength = 0 THEN wp END) OVER () AS bw, row_number() OVER (ORDER BY wp DESC, strength) AS k FROM gv)",
    f"""ls AS (SELECT seq_ix, 'base' AS lab, 't0' AS target, {six_sql('t0', 'p0')} FROM sx WHERE {SCORED} AND seq_ix % 2 = 1 GROUP BY ALL
    UNION ALL SELECT seq_ix, 'candidate', 't0', {six_sql('t0', 'p0 + strength * (c0 + c1*z + c2*p0)')} FROM sx, coef, (SELECT strength FROM pk WHERE k = 1) WHERE {SCORED} AND seq_ix % 2 = 1 GROUP BY ALL)""",
    *evidence.drawn_contrast([], {"candidate": 1.0, "base": -1.0}, 1),
    "iv AS (SELECT target, max(pe.v) AS point, quantile_cont(de.v, 0.025) AS lower, quantile_cont(de.v, 0.975) AS upper FROM de JOIN pe USING (target) GROUP BY target)"))
def fit_and_evaluate(s, d):
    df = seq(s, d)
    train, tune = df.filter(F.col(KEY) % 2 == 0), df.filter(F.col(KEY) % 2 == 1)
    correction.check_roles(train, tune, minimum=5)
    model = correction.fit_correction(train, tune, ["x0"], {"t0": "p0"}, spec(s, d), stride=5)
    pooled, interval = correction.evaluate_correction(model, tune, draws=evidence.DRAWS)
    wide = pooled.groupBy("target").agg(*[F.max(F.when(F.col("system") == n, F.col("wp"))).alias(f"{n}_wp") for n in ("base", "candidate")])
    found = wide.join(interval.drop("contrast"), "target")
    return round_all(found.withColumn("strength", F.lit(model.strength["t0"])), "strength")


@query("flow_score_frozen", sql(
    f"""SELECT system AS name, target, {r('v')} AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM v
    UNION ALL SELECT 'delta', target, {r('max(pe.v)')}, {r('quantile_cont(de.v, 0.025)')}, {r('quantile_cont(de.v, 0.975)')} FROM de JOIN pe USING (target) GROUP BY target""",
    *evidence.DRAWN, scores.M, scores.V))
def score_frozen(s, d):
    path = f"{shared_dir(s)}/moments-{uuid.uuid4().hex}"
    frozen.store_moments(seq(s, d).filter(F.col(KEY) < 10), BOTH, path)
    stored = frozen.store_moments(seq(s, d), BOTH, path)  # resumes with the missing sequences
    return round_all(frozen.score_frozen(stored, resampling.DELTA, evidence.DRAWS, 17))


@query("flow_calibrated_scores", sql(
    f"SELECT split, system, target, n, {r(wp_sql())} AS wp FROM cm", LONG_SQL,
    "lb AS (SELECT *, CASE WHEN seq_ix % 2 = 0 THEN 'tune' ELSE 'confirm' END AS split FROM long WHERE system = 'base' AND need_prediction AND is_scored)",
    "sc AS (SELECT unnest([0.75::DOUBLE, 0.9, 1.0, 1.1, 1.25]) AS scale)", "bi AS (SELECT unnest([-0.1::DOUBLE, 0.0, 0.1]) AS bias)",
    f"al AS (SELECT scale, bias, target, {six_sql('y', 'p * scale + bias')} FROM lb, sc, bi WHERE split = 'tune' GROUP BY ALL)",
    f"be AS (SELECT target, scale, bias FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {wp_sql()} DESC, scale, bias) AS k FROM al) WHERE k = 1)",
    f"""cm AS (SELECT split, 'plain' AS system, target, count(*) AS n, {six_sql('y', 'p')} FROM lb GROUP BY ALL
    UNION ALL SELECT split, 'calibrated', target, count(*), {six_sql('y', 'p * scale + bias')} FROM lb JOIN be USING (target) GROUP BY ALL)"""))
def calibrated(s, d):
    df = seq(s, d)
    return round_all(diagnostics.calibrated_scores(df.filter(F.col(KEY) % 2 == 0), df.filter(F.col(KEY) % 2 == 1)))


QUERIES = Q
