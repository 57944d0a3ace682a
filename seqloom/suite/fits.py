"""Gradient, fit and tree queries (A42-A45, A54, M1-M19, P17, P18, F13) with SQL twins where SQL can solve them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import scalar, vectors
from seqloom.layout import KEY, STEP
from seqloom.operators import boosting, curves, gradients, joins, memory, objective, ordered, populations, ridge, sampling, scoring, selection, slices, transport, trees
from seqloom.operators.quantiles import exact_quantiles
from seqloom.suite.fixture import LONG_SQL, counts_sql, XS, r, round_all, sclip, seq, six_sql, spec, sql, wp_sql

Q: dict = {}
SCORED = "need_prediction AND is_scored"
ONE = "1.0::DOUBLE"


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


# ---- gradients -----------------------------------------------------------------------------

FEATS = [ONE, "x0", "x2", "x3"]
CROSS_SQL = ("cr AS (SELECT {by} target, feature, sum(a * f) AS f0, sum(a * f * yc) AS fy, sum(a * f * pc) AS fp FROM (SELECT {by} target, "
             "unnest([0, 1, 2, 3]) AS feature, unnest([1.0::DOUBLE, x0, x2, x3]) AS f, " + f"{sclip('y')} AS yc, {sclip('p')} AS pc, "
             f"CASE WHEN abs(p) < 2 THEN abs({sclip('y')}) ELSE 0 END AS a FROM {{src}}) GROUP BY ALL)")
GRAD = "(fy - wy/w*f0 - (wyp-wy*wp/w)/(wpp-wp*wp/w)*(fp - wp/w*f0)) / sqrt((wyy-wy*wy/w)*(wpp-wp*wp/w))"
BASE_LONG = f"bl AS (SELECT * FROM long WHERE system = 'base' AND {SCORED})"


def features():
    return [F.lit(1.0), "x0", "x2", "x3"]


@query("a42_gradient_moments", sql(
    f"SELECT seq_ix, target, feature, {r('f0')} AS f0, {r('fy')} AS fy, {r('fp')} AS fp FROM cr", LONG_SQL, BASE_LONG, CROSS_SQL.format(by="seq_ix,", src="bl")))
def a42(s, d):
    return round_all(gradients.gradient_moments(scoring.scored_rows(seq(s, d)), features(), ("p0", "p1")))


@query("a43_wp_gradient", sql(
    f"SELECT target, feature, {r(GRAD)} AS gradient FROM cr JOIN st USING (target)", LONG_SQL, BASE_LONG, CROSS_SQL.format(by="", src="bl"),
    f"st AS (SELECT target, {six_sql('y', 'p')} FROM bl GROUP BY ALL)"))
def a43(s, d):
    return round_all(gradients.pooled_gradient(scoring.scored_rows(seq(s, d)), features(), ("p0", "p1")))


@query("a44_gradient_cosine", sql(
    f"""SELECT target, {r('sum(a.g*b.g)/sqrt(sum(a.g*a.g)*sum(b.g*b.g))')} AS cosine, {r('sqrt(sum(a.g*a.g))')} AS norm_a, {r('sqrt(sum(b.g*b.g))')} AS norm_b
    FROM gr a JOIN gr b USING (target, feature) WHERE a.is_scored AND NOT b.is_scored GROUP BY target""", LONG_SQL,
    "bl AS (SELECT * FROM long WHERE system = 'base' AND need_prediction)", CROSS_SQL.format(by="is_scored,", src="bl"),
    f"st AS (SELECT is_scored, target, {six_sql('y', 'p')} FROM bl GROUP BY ALL)",
    f"gr AS (SELECT is_scored, target, feature, {GRAD} AS g FROM cr JOIN st USING (is_scored, target))"))
def a44(s, d):
    g = gradients.pooled_gradient(scoring.required_rows(seq(s, d)), features(), ("p0", "p1"), by=["is_scored"])
    return round_all(gradients.gradient_cosine(g.filter("is_scored").drop("is_scored"), g.filter("NOT is_scored").drop("is_scored")))


CNT = ("ids AS (SELECT seq_ix, row_number() OVER (ORDER BY substr(md5(seq_ix::VARCHAR), 1, 3), seq_ix) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT seq_ix FROM bl))",
       counts_sql(9, 30))


@query("a44_gradient_noise", sql(
    f"""SELECT target, {r('sqrt(max(n))')} AS norm, {r('sqrt(avg(e))')} AS noise_norm, {r('sqrt(max(n))/sqrt(avg(e))')} AS ratio, {r('avg((dot > 0)::INT)')} AS positive_share FROM (
    SELECT draw, target, sum((a.g-b.g)*(a.g-b.g)) AS e, sum(a.g*b.g) AS dot, sum(b.g*b.g) AS n FROM dg a JOIN pg b USING (target, feature) GROUP BY ALL) GROUP BY target""",
    LONG_SQL, BASE_LONG, *CNT, CROSS_SQL.format(by="seq_ix,", src="bl"), f"st AS (SELECT seq_ix, target, {six_sql('y', 'p')} FROM bl GROUP BY ALL)",
    "dc AS (SELECT draw, target, feature, sum(times*f0) AS f0, sum(times*fy) AS fy, sum(times*fp) AS fp FROM cnt JOIN cr USING (seq_ix) GROUP BY ALL)",
    "ds AS (SELECT draw, target, " + ", ".join(f"sum(times*{m}) AS {m}" for m in scoring.SUMS) + " FROM cnt JOIN st USING (seq_ix) GROUP BY ALL)",
    f"dg AS (SELECT draw, target, feature, {GRAD} AS g FROM dc JOIN ds USING (draw, target))",
    "pc AS (SELECT target, feature, sum(f0) AS f0, sum(fy) AS fy, sum(fp) AS fp FROM cr GROUP BY ALL)",
    "ps AS (SELECT target, " + ", ".join(f"sum({m}) AS {m}" for m in scoring.SUMS) + " FROM st GROUP BY ALL)",
    f"pg AS (SELECT target, feature, {GRAD} AS g FROM pc JOIN ps USING (target))"))
def a44b(s, d):
    return round_all(gradients.gradient_noise(scoring.scored_rows(seq(s, d)), features(), ("p0", "p1"), 30, 9))


@query("a45_thinning_check", sql(
    f"""SELECT phase, target, {r('sum(a.g*b.g)/sqrt(sum(a.g*a.g)*sum(b.g*b.g))')} AS cosine, {r('sqrt(sum((a.g-b.g)*(a.g-b.g))/sum(b.g*b.g))')} AS relative_error, max(a.n) AS rows
    FROM pg a JOIN fg b USING (target, feature) GROUP BY ALL""", LONG_SQL,
    "bl AS (SELECT *, ((row_number() OVER (PARTITION BY seq_ix, target ORDER BY step_in_seq) - 1) % 5)::INT AS phase FROM long WHERE system = 'base' AND need_prediction)",
    CROSS_SQL.format(by="phase,", src="bl"), f"st AS (SELECT phase, target, count(*) AS n, {six_sql('y', 'p')} FROM bl GROUP BY ALL)",
    f"pg AS (SELECT phase, target, feature, n, {GRAD} AS g FROM cr JOIN st USING (phase, target))",
    "fc AS (SELECT target, feature, sum(f0) AS f0, sum(fy) AS fy, sum(fp) AS fp FROM cr GROUP BY ALL)",
    "fs AS (SELECT target, " + ", ".join(f"sum({m}) AS {m}" for m in scoring.SUMS) + " FROM st GROUP BY ALL)",
    f"fg AS (SELECT target, feature, {GRAD} AS g FROM fc JOIN fs USING (target))"))
def a45(s, d):
    return round_all(gradients.thinning_check(seq(s, d), features(), ("p0", "p1"), 5, spec(s, d)))


# ---- ridge fits: three-column designs, so that SQL solves them by determinants ---------------

def det3(m):
    return (f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]}) "
            f"+ {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))")


def fit3(rows, penalty, scale="rows", by=(), src="fit"):
    """CTEs from `rows` (SELECT by, response, f0, f1, f2, v, w) to `coef(by, response, c0, c1, c2, rr, mass...)`."""
    keys = ", ".join([*by, "response"])
    sums = ", ".join([f"sum(w*f{i}*f{j}) AS a{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(w*f{i}*v) AS b{i}" for i in range(3)]
                     + ["sum(w*v*v) AS rr", "sum(w) AS mass", "count(*)::DOUBLE AS n"])

    def a(i, j):
        i, j = min(i, j), max(i, j)
        base = f"a{i}{j}/mass" if scale == "mass" else f"a{i}{j}"
        if i != j:
            return f"({base})"
        return f"({base} + {penalty}::DOUBLE)" if scale == "mass" else f"({base} + {penalty}::DOUBLE * n)"

    b = [f"(b{i}/mass)" if scale == "mass" else f"b{i}" for i in range(3)]
    m = [[a(i, j) for j in range(3)] for i in range(3)]
    out = []
    for k in range(3):
        mk = [[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
        out.append(f"{det3(mk)} / {det3(m)} AS c{k}")
    return [f"{src} AS ({rows})", f"sums AS (SELECT {keys}, {sums} FROM {src} GROUP BY ALL)", f"coef AS (SELECT *, {', '.join(out)} FROM sums)"]


def coef_body(by=()):
    keys = ", ".join([*by, "response"])
    return " UNION ALL ".join(f"SELECT {keys}, {k} AS position, {r(f'c{k}')} AS coef FROM coef" for k in range(3))


def rows3(f, v=("t0 - p0", "t1 - p1"), w=None, extra="", src="seq", where="need_prediction"):
    w = w or [f"abs({sclip('t0')})", f"abs({sclip('t1')})"]
    return " UNION ALL ".join(
        f"SELECT {extra}'t{t}' AS response, {f[0]} AS f0, {f[1]} AS f1, {f[2]} AS f2, {v[t]} AS v, {w[t]} AS w FROM {src} WHERE {where}" for t in (0, 1))


def ridge_query(name, f_sql, f_spark, penalty=0.001, scale="rows", prepare=None, focus_sql=None, focus=None, by=(), by_types=(), by_sql="",
                ctes=(), src="seq", where="need_prediction", v=("t0 - p0", "t1 - p1"), responses=None, recursive=False):
    """Register one ridge variant: design, weights, groups and filter are its only differences."""
    w = [f"abs({sclip(t)}) * ({focus_sql})" for t in ("t0", "t1")] if focus_sql else None
    text = sql(coef_body(by), *ctes, *fit3(rows3(f_sql, v, w, by_sql, src, where), penalty, scale, by))
    if recursive:
        text = text.replace("WITH ", "WITH RECURSIVE ", 1)

    def fn(s, d):
        df = seq(s, d)
        df = prepare(s, d, df) if prepare else scoring.required_rows(df)
        resp = responses() if responses else ridge.residual_responses(("p0", "p1"), focus=focus() if focus else None)
        fits = ridge.weighted_ridge(df, f_spark(), resp, penalty, by, scale)
        return round_all(ridge.coefficient_frame(df, fits, by, by_types))

    Q[name] = (fn, text)


F3, F3S = [ONE, "x0", "x2"], lambda: [F.lit(1.0), "x0", "x2"]
STRIDE_SQL = "st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_ix ORDER BY step_in_seq) - 1 AS k FROM seq WHERE need_prediction) WHERE k % 5 = 0)"
ridge_query("m01_weighted_ridge", F3, F3S, ctes=[STRIDE_SQL], src="st", prepare=lambda s, d, df: sampling.stride_sample(df, 5, spec(s, d)))
ridge_query("m02_mass_normalized_ridge", F3, F3S, 0.1, "mass")
MAGF = "0.1::DOUBLE + least(greatest(abs(p0), abs(p1)), 2) * least(greatest(abs(p0), abs(p1)), 2)"
ridge_query("m03_magnitude_weighted_ridge", F3, F3S, focus_sql=MAGF, focus=lambda: ridge.magnitude_focus(["p0", "p1"]))
ridge_query("m04_gated_ridge", F3, F3S, by=["high"], by_types=["boolean"], by_sql="greatest(abs(p0), abs(p1)) >= 1 AS high, ",
            prepare=lambda s, d, df: scoring.required_rows(df).withColumn("high", scalar.magnitude_gate(["p0", "p1"])))
INNO = ("iv AS MATERIALIZED (SELECT *, (abs(p0 - coalesce(lag(p0) OVER w, p0)) + abs(p1 - coalesce(lag(p1) OVER w, p1))) / 2.0::DOUBLE AS dv FROM seq WINDOW w AS (PARTITION BY seq_ix ORDER BY step_in_seq))",
        "em AS (SELECT seq_ix, step_in_seq, 0.02::DOUBLE * dv AS e FROM iv WHERE step_in_seq = 0 UNION ALL SELECT i.seq_ix, i.step_in_seq, 0.02::DOUBLE * i.dv + 0.98::DOUBLE * em.e FROM em JOIN iv i ON i.seq_ix = em.seq_ix AND i.step_in_seq = em.step_in_seq + 1)",
        "gt AS (SELECT * FROM seq JOIN em USING (seq_ix, step_in_seq))", "md AS (SELECT quantile_cont(e, 0.5) AS med FROM gt WHERE need_prediction)")


def innovation_gate(s, d, df):
    rows = scoring.required_rows(memory.innovation(df, ["p0", "p1"], spec(s, d)))
    return rows.withColumn("high", F.col("innovation") >= exact_quantiles(rows, "innovation", [0.5])[0])


ridge_query("m04_innovation_gated_ridge", F3, F3S, by=["high"], by_types=["boolean"], by_sql="e >= (SELECT med FROM md) AS high, ", ctes=INNO, src="gt", recursive=True, prepare=innovation_gate)
ridge_query("m05_late_expert_ridge", F3, F3S, where="need_prediction AND step_in_seq >= 140",
            prepare=lambda s, d, df: scoring.required_rows(df).filter(F.col(STEP) >= spec(s, d).position_edges[1]))
PB = ("((step_in_seq >= 20)::INT + (step_in_seq >= 60)::INT + (step_in_seq >= 120)::INT)",
      "((greatest(abs(p0), abs(p1)) >= 0.5)::INT + (greatest(abs(p0), abs(p1)) >= 1)::INT + (greatest(abs(p0), abs(p1)) >= 2)::INT)")
PROP = [f"prop AS (SELECT {PB[0]} AS position, {PB[1]} AS magnitude, count(*) AS req, sum(is_scored::INT) AS sc FROM seq WHERE need_prediction GROUP BY ALL)",
        "foc AS (SELECT position, magnitude, greatest(0.2, least(5.0, (sc + 0.5) / (req + 1.0) / (SELECT sum(sc) / sum(req) FROM prop))) AS focus FROM prop)",
        f"sf AS (SELECT seq.*, focus FROM seq JOIN foc ON position = {PB[0]} AND magnitude = {PB[1]})"]


def with_focus(s, d, df):
    pos, mag = joins.bin_pair(STEP, ["p0", "p1"], [9, 20, 60, 120, 1 << 40], [0, 0.5, 1, 2])
    cells = populations.propensity_table(df, pos, mag).collect()  # position bins x magnitude bins
    rates = {(c["position"], c["magnitude"]): c["focus"] for c in cells}
    return scoring.required_rows(joins.lookup_rates(df, rates, pos, mag, "focus"))


ridge_query("m06_propensity_weighted_ridge", F3, F3S, focus_sql="focus", focus=lambda: F.col("focus"), ctes=PROP, src="sf", prepare=with_focus)
ridge_query("m07_spline_ridge", [ONE, "p0", "greatest(p0 - 0.5::DOUBLE, 0.0::DOUBLE)"], lambda: vectors.hinge_basis("p0", [0.5]))
ridge_query("m07_fourier_ridge", [ONE, "cos(x0*0.3::DOUBLE + x2*0.8::DOUBLE)", "sin(x0*0.3::DOUBLE + x2*0.8::DOUBLE)"], lambda: vectors.fourier_basis(["x0", "x2"], [[0.3, 0.8]]))
ridge_query("m07_quadratic_ridge", ["x2", "abs(x2)", f"x2 * {sclip('p0')}"], lambda: vectors.quadratic_design(["x2"], "p0")[1:], 0.01)
LAGS = ["lg AS (SELECT *, coalesce(lag(x0, 10) OVER (PARTITION BY seq_ix ORDER BY step_in_seq), 0.0::DOUBLE) AS l10 FROM seq)"]
ridge_query("m07_lag_ridge", [ONE, "x0", "l10"], lambda: [F.lit(1.0), "x0", "l10"], ctes=LAGS, src="lg",
            prepare=lambda s, d, df: scoring.required_rows(ordered.lags(df, {"l10": ("x0", 10)}, spec(s, d), 0.0)))
EMAS = ["iv AS MATERIALIZED (SELECT * FROM seq)", "em AS (SELECT seq_ix, step_in_seq, 0.01::DOUBLE * x0 AS fast FROM iv WHERE step_in_seq = 0 UNION ALL SELECT i.seq_ix, i.step_in_seq, 0.01::DOUBLE * i.x0 + 0.99::DOUBLE * em.fast FROM em JOIN iv i ON i.seq_ix = em.seq_ix AND i.step_in_seq = em.step_in_seq + 1)",
        "gt AS (SELECT * FROM seq JOIN em USING (seq_ix, step_in_seq))"]
ridge_query("m07_ema_ridge", [ONE, "x0", "fast"], lambda: [F.lit(1.0), "x0", "x0_fast"], ctes=EMAS, src="gt", recursive=True,
            prepare=lambda s, d, df: scoring.required_rows(memory.dual_ema(df, ["x0"], spec(s, d))))
CHG = ["lg AS (SELECT *, p1 - coalesce(lag(p1) OVER (PARTITION BY seq_ix ORDER BY step_in_seq), 0.0::DOUBLE) AS chg FROM seq)"]
ridge_query("m07_state_change_ridge", [ONE, "p1", "chg"], lambda: [F.lit(1.0), "p1", "p1_change"], ctes=CHG, src="lg",
            prepare=lambda s, d, df: scoring.required_rows(memory.state_change(df, ["p1"], spec(s, d))))
SIDE = "(({0} + {1}) / 2.0::DOUBLE - ({2} + {3}) / 2.0::DOUBLE) / (1 + sqrt((({0}*{0} + {1}*{1}) / 2.0::DOUBLE + ({2}*{2} + {3}*{3}) / 2.0::DOUBLE) / 2.0::DOUBLE))"
ridge_query("m07_side_ridge", [ONE, SIDE.format(*[sclip(x, "-8.0", "8.0") for x in XS]), "x0"],
            lambda: [F.lit(1.0), vectors.side_contrasts((("x0", "x1"), ("x2", "x3")), (("x0", "x1"), ("x2", "x3")))[0], "x0"], 0.01)
ridge_query("m07_readout_ridge", [ONE, "tanh(x0*0.3::DOUBLE + x2*0.8::DOUBLE)", "tanh(x3*0.5::DOUBLE - 0.2::DOUBLE)"],
            lambda: [F.lit(1.0), *vectors.tanh_basis(["x0", "x2"], [[0.3, 0.8]], [0.0]), *vectors.tanh_basis(["x3"], [[0.5]], [-0.2])])


@query("m08_replicated_fit", sql(
    " UNION ALL ".join(f"SELECT replica, response, {k} AS position, {r(f'c{k}')} AS coef, {r('mse')} AS mse FROM q" for k in range(3)),
    *fit3(rows3(F3, extra="unnest([(seq_ix % 2)::VARCHAR, 'pooled']) AS replica, "), 0.01, by=["replica"]),
    "q AS (SELECT *, (rr - 2*(c0*b0+c1*b1+c2*b2) + c0*c0*a00 + c1*c1*a11 + c2*c2*a22 + 2*(c0*c1*a01 + c0*c2*a02 + c1*c2*a12)) / mass AS mse FROM coef)"))
def m08(s, d):
    df = scoring.required_rows(seq(s, d)).withColumn("replica", (F.col(KEY) % 2).cast("string"))
    found = ridge.replicated_fit(df, F3S(), ridge.residual_responses(("p0", "p1")), 0.01, "replica")
    rows = [(a, b, i, float(c), m) for a, b, coef, m in found for i, c in enumerate(coef)]
    return round_all(s.createDataFrame(rows, "replica string, response string, position int, coef double, mse double"))


@query("m09_standalone_vs_incremental", sql(
    coef_body(), *fit3(rows3(F3) + " UNION ALL " + rows3(F3, (sclip("t0"), sclip("t1"))).replace("'t0' AS", "'alone_t0' AS").replace("'t1' AS", "'alone_t1' AS"), 0.1, "mass")))
def m09(s, d):
    df = scoring.required_rows(seq(s, d))
    resp = ridge.residual_responses(("p0", "p1")) | {f"alone_{t}": v for t, v in ridge.target_responses().items()}
    return round_all(ridge.coefficient_frame(df, ridge.weighted_ridge(df, F3S(), resp, 0.1, scale="mass")))


TANG = ["tm AS (SELECT " + ", ".join(f"sum(w{t}) AS w_{t}, sum(w{t}*y{t}) AS wy_{t}, sum(w{t}*p{t}c) AS wp_{t}, sum(w{t}*p{t}c*p{t}c) AS wpp_{t}, sum(w{t}*y{t}*p{t}c) AS wyp_{t}" for t in (0, 1))
        + " FROM (SELECT " + ", ".join(f"abs({sclip(f't{t}')}) AS w{t}, {sclip(f't{t}')} AS y{t}, {sclip(f'p{t}')} AS p{t}c" for t in (0, 1)) + " FROM seq WHERE need_prediction))",
        "sx AS (SELECT * FROM seq, tm)"]
TV = tuple(f"CASE WHEN abs(p{t}) >= 2 THEN 0 ELSE ({sclip(f't{t}')} - wy_{t}/w_{t}) - (wyp_{t}-wy_{t}*wp_{t}/w_{t})/(wpp_{t}-wp_{t}*wp_{t}/w_{t}) * ({sclip(f'p{t}')} - wp_{t}/w_{t}) END" for t in (0, 1))


@query("m10_tangent_ridge", sql(coef_body(), *TANG, *fit3(rows3(F3, TV, src="sx"), 0.01)))
def m10(s, d):
    df = scoring.required_rows(seq(s, d))
    return round_all(ridge.coefficient_frame(df, ridge.weighted_ridge(df, F3S(), ridge.tangent_responses(df, ("p0", "p1")), 0.01)))


@query("m18_exact_moment_fit", sql(
    f"""SELECT split, objective, 0.1::DOUBLE AS penalty, target, strength, {r(wp_sql())} AS wp_score, {r('raw / w')} AS raw_mse, {r('clp / w')} AS clipped_mse FROM em""",
    *TANG,
    *fit3(rows3(F3, (f"{sclip('t0')} - p0", f"{sclip('t1')} - p1"), where="need_prediction AND seq_ix % 5 <> 0"), 0.1)[:1],
    *[c.replace("tm AS", "tn AS").replace("sx AS", "sy AS").replace("FROM seq, tm", "FROM seq, tn").replace("WHERE need_prediction)", "WHERE need_prediction AND seq_ix % 5 <> 0)") for c in TANG],
    "fit2 AS (SELECT 'raw_residual' AS objective, * FROM fit UNION ALL SELECT 'pearson_tangent', * FROM (" + rows3(F3, TV, src="sy", where="need_prediction AND seq_ix % 5 <> 0") + "))",
    *[c.replace("FROM fit ", "FROM fit2 ") for c in fit3("SELECT 1", 0.1, by=["objective"])[1:]],
    f"""pr AS (SELECT CASE WHEN seq_ix % 5 = 0 THEN 'selection' ELSE 'fit' END AS split, objective, response AS target, strength,
      CASE WHEN response = 't0' THEN t0 ELSE t1 END AS y, CASE WHEN response = 't0' THEN p0 ELSE p1 END + strength * (c0 + c1*x0 + c2*x2) AS p
      FROM seq, coef, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS strength) WHERE need_prediction)""",
    f"""em AS (SELECT split, objective, target, strength, {six_sql('y', 'p')}, sum(abs({sclip('y')})*({sclip('y')}-p)*({sclip('y')}-p)) AS raw,
      sum(abs({sclip('y')})*({sclip('y')}-{sclip('p')})*({sclip('y')}-{sclip('p')})) AS clp FROM pr GROUP BY ALL)"""))
def m18(s, d):
    df = scoring.required_rows(seq(s, d)).withColumns({"c0": scalar.clip("t0"), "c1": scalar.clip("t1")})
    fit, held = df.filter(F.col(KEY) % 5 != 0), df.filter(F.col(KEY) % 5 == 0)
    out = objective.exact_moment_fit(fit, held, F3S(), ("p0", "p1"), [0.1], (0.0, 0.5, 1.0))
    return round_all(out, "strength", "penalty")


@query("f13_two_way_crossfit", sql(
    f"SELECT own, target, {r(wp_sql())} AS wp FROM sc", *fit3(rows3(F3, extra="seq_ix % 2 AS role, "), 0.001, by=["role"]),
    f"""sc AS (SELECT (seq_ix % 2 = role) AS own, response AS target, {six_sql("CASE WHEN response = 't0' THEN t0 ELSE t1 END", "CASE WHEN response = 't0' THEN p0 ELSE p1 END + c0 + c1*x0 + c2*x2")}
      FROM seq, coef WHERE {SCORED} GROUP BY ALL)"""))
def f13(s, d):
    df = seq(s, d).withColumn("role", F.col(KEY) % 2)
    fits = ridge.weighted_ridge(scoring.required_rows(df), F3S(), ridge.residual_responses(("p0", "p1")), 0.001, ["role"])
    rows = scoring.scored_rows(df)
    systems = {}
    for own in (True, False):
        cols = []
        for t, p in (("t0", "p0"), ("t1", "p1")):
            even, odd = (vectors.linear_predict(F3S(), fits[(k, t)]) for k in (0, 1))
            first, second = (even, odd) if own else (odd, even)
            cols.append(F.col(p) + F.when(F.col("role") == 0, first).otherwise(second))
        systems[str(own)] = cols
    out = scoring.with_wp(scoring.moments(rows, systems))
    return round_all(out.select((F.col("system") == "True").alias("own"), "target", "wp"))


# Wide design: inputs, their products and their products with both predictions, as text for both engines.
WIDE = [f"x{i}" for i in range(4)] + [f"x{i} * x{j}" for i in range(4) for j in range(i, 4)] + [f"x{i} * p{k}" for i in range(4) for k in (0, 1)] + ["p0", "p1"]


@query("m01_wide_gram", sql(
    f"""SELECT response, i::INTEGER AS i, j::INTEGER AS j, {r('sum(w * f[i + 1] * f[j + 1])', 4)} AS value
    FROM wide, range({len(WIDE) + 1}) a(i), range({len(WIDE) + 1}) b(j) WHERE j >= i GROUP BY ALL""",
    "wide AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS response, abs({sclip(t)}) AS w, [{', '.join(f'({e})::DOUBLE' for e in [*WIDE, f'{t} - {p}'])}] AS f FROM seq WHERE need_prediction"
        for t, p in (("t0", "p0"), ("t1", "p1"))) + ")"))
def m01_wide(s, d):
    table = ridge.gram_table(scoring.required_rows(seq(s, d)), [F.expr(e) for e in WIDE], ridge.residual_responses(("p0", "p1")))
    return round_all(table.filter(F.col("j") <= len(WIDE)), digits=4)


@query("m08_wide_replicated", sql(
    f"SELECT CAST(seq_ix % 2 AS VARCHAR) AS replica, response, {r('sum(w)', 4)} AS mass, count(*) AS n FROM wide GROUP BY ALL",
    "wide AS (" + " UNION ALL ".join(f"SELECT seq_ix, '{t}' AS response, abs({sclip(t)}) AS w FROM seq WHERE need_prediction" for t in ("t0", "t1")) + ")"))
def m08_wide(s, d):
    df = scoring.required_rows(seq(s, d)).withColumn("half", F.col(KEY) % 2)
    found = ridge.grams(df, [F.expr(e) for e in WIDE], ridge.residual_responses(("p0", "p1")), ["half"])
    for g in found.values():
        # The fit must not be worse than no correction, and solve its own equations.
        coef = g.solve(1e-3)
        if g.mse(coef) > g.rr / g.mass or abs((g.xx + 1e-3 * g.rows * np.eye(len(coef))) @ coef - g.xr).max() > 1e-6 * abs(g.xr).max():
            raise ValueError("the wide fit does not solve its equations")
    rows = [(str(k[0]), k[1], float(g.mass), int(g.rows)) for k, g in found.items()]
    return round_all(s.createDataFrame(rows, "replica string, response string, mass double, n bigint"), digits=4)


# ---- fits without a closed form in SQL: row checks here, numeric checks in the tests -----------

@query("m11_fit_wp")
def m11(s, d):
    df = scoring.required_rows(seq(s, d))
    coef, value = objective.fit_wp(df, F3S(), "p0", "t0", 0.01)
    return round_all(s.createDataFrame([(i, float(c), float(value)) for i, c in enumerate(coef)], "position int, coef double, objective double"))


@query("m12_fit_wp_groups")
def m12(s, d):
    df = scoring.required_rows(seq(s, d)).withColumn("grp", F.col(KEY) % 4)
    coef, value = objective.fit_wp_groups(df, F3S(), "p0", "t0", "grp", 0.1, 100.0)
    return round_all(s.createDataFrame([(i, float(c), float(value)) for i, c in enumerate(coef)], "position int, coef double, objective double"))


POINTS = [[0.0, 0.0, 0.0], [0.1, -0.2, 0.05], [-0.4, 0.3, 1.5]]


def _point(c):
    return f"p0 + ({c[0]}::DOUBLE) + ({c[1]}::DOUBLE) * x0 + ({c[2]}::DOUBLE) * x2"


@query("m12_trial_terms", sql(
    f"""SELECT grp, trial, feature, {r('-(wyp - wy * wp / w) / sqrt((wyy - wy * wy / w) * greatest(wpp - wp * wp / w, 1e-12))')} AS loss,
    {r('-((fy - wy / w * f0) - (wyp - wy * wp / w) / greatest(wpp - wp * wp / w, 1e-12) * (fp - wp / w * f0)) / sqrt((wyy - wy * wy / w) * greatest(wpp - wp * wp / w, 1e-12))')} AS gradient
    FROM tsum JOIN tgrad USING (grp, trial)""",
    "tp AS (" + " UNION ALL ".join(f"SELECT seq_ix % 4 AS grp, {i} AS trial, t0 AS y, {_point(c)} AS p, x0, x2 FROM seq WHERE need_prediction" for i, c in enumerate(POINTS)) + ")",
    f"tsum AS (SELECT grp, trial, {six_sql('y', 'p')} FROM tp GROUP BY ALL)",
    f"""tgrad AS (SELECT grp, trial, feature, sum(a * f) AS f0, sum(a * {sclip('y')} * f) AS fy, sum(a * {sclip('p')} * f) AS fp FROM (SELECT *, CASE WHEN abs(p) < 2 THEN abs({sclip('y')}) ELSE 0.0 END AS a,
      unnest([0, 1, 2]) AS feature, unnest([1.0::DOUBLE, x0, x2]) AS f FROM tp) GROUP BY grp, trial, feature)"""))
def m12b(s, d):
    """Loss and gradient of three trial points in four groups, from one pass."""
    df = scoring.required_rows(seq(s, d)).withColumn("grp", F.col(KEY) % 4)
    found = objective.trial_terms(objective.stored_rows(df, F3S(), ["p0"], ["t0"], ["grp"]), [(0, np.array(c)) for c in POINTS], ["grp"])
    rows = [(g, i, f, float(loss), float(v)) for (g,), terms in found.items() for i, t in enumerate(terms) for loss, grad in [t.loss()] for f, v in enumerate(grad)]
    return round_all(s.createDataFrame(rows, "grp bigint, trial int, feature int, loss double, gradient double"))


def _selection_report(df):
    p, y = F.col("propensity"), F.col("is_scored")
    return populations.log_loss(df, y, p).crossJoin(F.broadcast(populations.roc_auc(df, y, p)))  # one row each


@query("m13_selection_model")
def m13(s, d):
    rows = scoring.required_rows(seq(s, d))
    design = vectors.propensity_design(XS, ["p0", "p1"], STEP, 200, 140)[1:]
    return round_all(_selection_report(selection.logistic_propensity(rows, design, F.col("is_scored"), spec(s, d))))


@query("m14_selection_trees")
def m14(s, d):
    rows = scoring.required_rows(seq(s, d))
    return round_all(_selection_report(selection.tree_propensity(rows, [*XS, "p0", "p1"], F.col("is_scored"), spec(s, d))))


HIST = [f"hb AS (SELECT 0 AS node, unnest([0, 1]) AS feature, unnest([(x1 > 1)::INT + (x1 > 3)::INT + (x1 > 5)::INT, (x2 > 0.5)::INT + (x2 > 1.0)::INT + (x2 > 1.5)::INT]) AS bin, abs({sclip('t0')}) AS w, abs({sclip('t0')}) * ({sclip('t0')} - p0) AS g FROM seq WHERE need_prediction)",
        "hs AS (SELECT node, feature, bin, count(*) AS n, sum(g) AS g, sum(w) AS w FROM hb GROUP BY ALL)",
        "hr AS (SELECT node, feature, bin, sum(n) OVER u AS n, sum(g) OVER u AS g, sum(w) OVER u AS w, sum(n) OVER a AS an, sum(g) OVER a AS ag, sum(w) OVER a AS aw FROM hs WINDOW u AS (PARTITION BY node, feature ORDER BY bin), a AS (PARTITION BY node, feature))"]


@query("m15_split_gains", sql(
    f"SELECT node, feature, bin, n::BIGINT AS n, {r('g*g/(w+100) + (ag-g)*(ag-g)/(aw-w+100) - ag*ag/(aw+100)')} AS gain FROM hr WHERE n >= 50 AND an - n >= 50 AND bin < 3", *HIST))
def m15(s, d):
    df = scoring.required_rows(seq(s, d)).withColumns({"b0": scalar.search_sorted("x1", [1, 3, 5]), "b1": scalar.search_sorted("x2", [0.5, 1.0, 1.5])})
    w = F.abs(scalar.clip("t0"))
    hist = trees.node_histograms(df, ["b0", "b1"], F.lit(0), w * (scalar.clip("t0") - F.col("p0")), w)
    return round_all(trees.split_gains(hist, 4, 100.0, 50).select("node", "feature", "bin", "n", "gain"))


def _residual(target, base):
    y = scalar.clip(target)
    return boosting.Response(y - F.col(base), F.abs(y), F.lit(True))


@query("m15_boosted_residual")
def m15b(s, d):
    rows = scoring.required_rows(seq(s, d))
    features = [*XS, "p0", "p1"]
    models = boosting.boost(rows, features, [_residual("t0", "p0"), _residual("t1", "p1")], boosting.Settings())
    moved = [F.col(f"p{k}") + boosting.predicted(models, features, F.lit(k)) for k in (0, 1)]
    return round_all(slices.weighted_mse(rows.withColumns({"b0": moved[0], "b1": moved[1]}), {"base": ("p0", "p1"), "boosted": ("b0", "b1")}))


@query("m15_small_trees")
def m15d(s, d):
    rows = scoring.required_rows(seq(s, d))
    features = [*XS, scalar.clip("p0"), scalar.clip("p1")]
    model = boosting.boost(rows, features, [_residual("t0", "p0")], boosting.Settings(rounds=32, leaves=7, rate=0.08, l2=20.0, min_leaf=100))
    rows = rows.withColumn("c", boosting.predicted(model, features))
    grid = {f"{k:g}": (F.col("p0") + F.col("c") * k, F.col("p1")) for k in (0.0, 0.25, 0.5, 1.0)}
    return round_all(scoring.wp_report(rows, grid))


CODES = "(x1 > 1)::INT + (x1 > 3)::INT + (x1 > 5)::INT", "(x2 > 0.5)::INT + (x2 > 1.0)::INT + (x2 > 1.5)::INT"
EDGES = [[1.0, 3.0, 5.0], [0.5, 1.0, 1.5]]
ROOT = "g*g/(w+10) + (ag-g)*(ag-g)/(aw-w+10) - ag*ag/(aw+10)"


def _cut(name, source, node):
    """The best split of every node of `source`, rows `(node, feature, bin, gain)`."""
    return [f"{name}h AS (SELECT {node} AS node, feature, bin, count(*) AS n, sum(g) AS g, sum(w) AS w FROM {source} GROUP BY ALL)",
            f"""{name}r AS (SELECT node, feature, bin, sum(n) OVER u AS n, sum(g) OVER u AS g, sum(w) OVER u AS w, sum(n) OVER a AS an, sum(g) OVER a AS ag, sum(w) OVER a AS aw
            FROM {name}h WINDOW u AS (PARTITION BY node, feature ORDER BY bin), a AS (PARTITION BY node, feature))""",
            f"""{name}s AS (SELECT node, feature, bin, {ROOT} AS gain FROM {name}r WHERE n >= 50 AND an - n >= 50 AND bin < 3 AND {ROOT} > 0
            QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) = 1)"""]


@query("m15_first_tree", sql(
    f"SELECT feature_path, n::BIGINT AS n, {r('0.05::DOUBLE * g / (w + 10)')} AS value FROM leaf",
    f"""fb AS (SELECT *, row_number() OVER () AS id, y - base AS z FROM (SELECT {CODES[0]} AS c0, {CODES[1]} AS c1, abs({sclip('t0')}) AS w, {sclip('t0')} - p0 AS y,
      sum(abs({sclip('t0')}) * ({sclip('t0')} - p0)) OVER () / sum(abs({sclip('t0')})) OVER () AS base FROM seq WHERE need_prediction))""",
    "fl AS (SELECT id, w, w * z AS g, 0 AS feature, c0 AS bin, c0, c1 FROM fb UNION ALL SELECT id, w, w * z, 1, c1, c0, c1 FROM fb)",
    *_cut("ra", "fl", "0"),
    "fm AS (SELECT fl.*, CASE WHEN (CASE ras.feature WHEN 0 THEN c0 ELSE c1 END) <= ras.bin THEN 1 ELSE 2 END AS node FROM fl, ras)",
    *_cut("rb", "fm", "node"),
    "pick AS (SELECT * FROM rbs ORDER BY gain DESC, node LIMIT 1)",
    """leaf AS (SELECT feature_path, count(*) AS n, sum(g) AS g, sum(w) AS w FROM (SELECT fm.g, fm.w, CASE WHEN fm.node = pick.node THEN
      fm.node || CASE WHEN (CASE pick.feature WHEN 0 THEN c0 ELSE c1 END) <= pick.bin THEN 'l' ELSE 'r' END ELSE fm.node::VARCHAR END AS feature_path
      FROM fm, pick WHERE fm.feature = 0) GROUP BY ALL)"""))
def m15e(s, d):
    """Three leaves of the first tree; a leaf is named by the side of the root and, under the second split, of that."""
    rows = scoring.required_rows(seq(s, d))
    model = boosting.boost(rows, ["x1", "x2"], [_residual("t0", "p0")], boosting.Settings(rounds=1, leaves=3, min_leaf=50, bins=4), EDGES)[0]
    tree = model.trees[0]
    root = tree[0]
    path = {}
    for name, at in (("1", root.left), ("2", root.right)):
        path |= {at: name} if tree[at].is_leaf else {tree[at].left: name + "l", tree[at].right: name + "r"}
    named = [trees.Node(v.value, v.feature, v.threshold, v.left, v.right) if not v.is_leaf else trees.Node(float(i)) for i, v in enumerate(tree)]
    found = rows.select(trees.tree_column(named, ["x1", "x2"]).cast("int").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    names = s.createDataFrame([(i, p, float(tree[i].value)) for i, p in path.items()], "leaf int, feature_path string, value double")
    return round_all(found.join(F.broadcast(names), "leaf").drop("leaf"))  # as many rows as leaves


@query("m14_first_histogram", sql(
    f"""SELECT fold, feature, bin, count(*) AS n, {r('sum(y - rate)')} AS g, {r('sum(rate * (1 - rate))')} AS h
    FROM (SELECT f.fold, y, rate, unnest([0, 1]) AS feature, unnest([c0, c1]) AS bin FROM sf JOIN fr f ON sf.fold <> f.fold) GROUP BY ALL""",
    "pl AS (SELECT seq_ix, (row_number() OVER (ORDER BY seq_ix) - 1) % 4 AS fold FROM (SELECT DISTINCT seq_ix FROM seq WHERE need_prediction))",
    f"sf AS (SELECT fold::INT AS fold, is_scored::INT AS y, {CODES[0]} AS c0, {CODES[1]} AS c1 FROM seq JOIN pl USING (seq_ix) WHERE need_prediction)",
    "fr AS (SELECT k AS fold, avg(y) AS rate FROM sf, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE fold <> k GROUP BY k)"))
def m14b(s, d):
    """The histograms of the first logistic round, for the models of four folds from one pass."""
    rows = ordered.per_sequence(scoring.required_rows(seq(s, d)), sampling.crossfit_folds(scoring.required_rows(seq(s, d))), spec=spec(s, d))
    responses = [boosting.Response(F.col("is_scored").cast("double"), F.lit(1.0), F.col("fold") != k) for k in range(4)]
    start = boosting.baselines(rows, responses, "logistic")
    stored = boosting.blocks(rows.withColumns({"f0": F.col("x1"), "f1": F.col("x2")}), ["f0", "f1"], EDGES, responses, start)
    found = boosting.histograms(stored, [[]] * 4, [[trees.Node()]] * 4, [[0]] * 4, 2, 4, "logistic")
    cells = [(k, f, b, int(h[f, 2, b]), float(h[f, 0, b]), float(h[f, 1, b])) for (k, _), h in found.items() for f in range(2) for b in range(4) if h[f, 2, b]]
    return round_all(s.createDataFrame(cells, "fold int, feature int, bin int, n bigint, g double, h double"))


@query("m15_library_boosting")
def m15c(s, d):
    df = scoring.required_rows(seq(s, d))
    model = trees.library_boosting(df, XS, scalar.clip("t1") - F.col("p1"), F.abs(scalar.clip("t1")), rounds=2, max_depth=2)
    return round_all(model.transform(df).agg(F.avg(F.col("prediction")).alias("mean_correction"), F.count("*").alias("n")))


@query("m16_bounded_curve_fit")
def m16(s, d):
    fit = curves.bounded_curve_fit(scoring.required_rows(seq(s, d)), "t0", "p0")
    rows = [(float(k), float(c), float(a)) for k, c, a in zip(fit["knots"], fit["curve"], fit["affine"])]
    return round_all(s.createDataFrame(rows, "knot double, curve double, affine double"))


def _gradient_parts(s, d, rows):
    feats = [F.lit(1.0), "x0", "x2"]
    fit = rows.filter(F.col(KEY) % 3 != 0)
    ref = transport.reference_moments(fit, ("p0", "p1"))
    return [transport.sequence_gradients(part, feats, ("p0", "p1"), ref, 50.0) for part in (fit, rows.filter(F.col(KEY) % 3 == 0))]


@query("m19_context_ridge")
def m19(s, d):
    fit, _ = _gradient_parts(s, d, scoring.required_rows(seq(s, d)))
    context = memory.prefix_context(seq(s, d), ["x0", "x2"], 40)
    coefs, _, _ = transport.context_ridge(fit, context, ["x0_mean", "x2_logstd"], 0.1)
    return round_all(s.createDataFrame([(t, f, i, float(c)) for (t, f), co in sorted(coefs.items()) for i, c in enumerate(co)], "target string, feature int, position int, coef double"))


@query("a54_gradient_predictability")
def a54(s, d):
    fit, dev = _gradient_parts(s, d, scoring.required_rows(seq(s, d)))
    context = memory.prefix_context(seq(s, d), ["x0", "x2"], 40)
    out = transport.gradient_predictability(fit, dev, context, context, ["x0_mean", "x2_logstd"])
    return round_all(out)


@query("a54_gradient_reliability")
def a54b(s, d):
    rows = scoring.required_rows(seq(s, d))
    ref = transport.reference_moments(rows, ("p0", "p1"))
    parts = [transport.sequence_gradients(rows.filter(F.col(STEP) % 2 == k), [F.lit(1.0), "x0"], ("p0", "p1"), ref, 50.0) for k in (0, 1)]
    return round_all(transport.gradient_reliability(*parts))


# ---- trees ---------------------------------------------------------------------------------

STUMP = [trees.Node(feature=0, threshold=2.0, left=1, right=2), trees.Node(value=0.5), trees.Node(feature=1, threshold=1.0, left=3, right=4), trees.Node(value=-0.25), trees.Node(value=0.125)]
OTHER = [trees.Node(feature=1, threshold=0.75, left=1, right=2), trees.Node(value=-1.0), trees.Node(value=0.3)]
STUMP_SQL = "CASE WHEN x1 <= 2 THEN 0.5 WHEN x2 <= 1.0 THEN -0.25 ELSE 0.125 END::DOUBLE"
OTHER_SQL = "CASE WHEN x2 <= 0.75 THEN -1.0 ELSE 0.3 END::DOUBLE"


@query("p17_score_trees", sql(f"SELECT seq_ix, step_in_seq, {r(f'0.1::DOUBLE + {STUMP_SQL} + {OTHER_SQL}')} AS s FROM seq"))
def p17(s, d):
    return round_all(seq(s, d).select(KEY, STEP, trees.score_trees([STUMP, OTHER], ["x1", "x2"], 0.1).alias("s")))


@query("p17_score_trees_arrow", sql(f"SELECT seq_ix, step_in_seq, {r(f'0.1::DOUBLE + 150 * ({STUMP_SQL} + {OTHER_SQL})')} AS s FROM seq"))
def p17b(s, d):
    return round_all(seq(s, d).select(KEY, STEP, trees.score_trees([STUMP, OTHER] * 150, ["x1", "x2"], 0.1).alias("s")))


def _exp(e):
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({e}))))"


@query("p18_propensity_focus", sql(
    f"""SELECT seq_ix, step_in_seq, {r(f"greatest(0.2, least(5.0, ({_exp(f'0.2::DOUBLE + {STUMP_SQL}')} / 0.6::DOUBLE + {_exp(f'-0.1::DOUBLE + {OTHER_SQL}')} / 0.5::DOUBLE) / 2))")} AS focus,
    {r(f"({_exp(f'0.2::DOUBLE + {STUMP_SQL}')} + {_exp(f'-0.1::DOUBLE + {OTHER_SQL}')}) / 2")} AS propensity FROM seq"""))
def p18(s, d):
    focus, mean = trees.propensity_focus([([STUMP], 0.2, 0.6), ([OTHER], -0.1, 0.5)], ["x1", "x2"])
    return round_all(seq(s, d).select(KEY, STEP, focus.alias("focus"), mean.alias("propensity")))


QUERIES = Q
