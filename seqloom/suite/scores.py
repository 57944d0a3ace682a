"""Score and error-slice queries (A1-A23, A33-A36) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.layout import KEY
from seqloom.operators import sampling, scoring, slices
from seqloom.suite.fixture import BOTH, LONG_SQL, XS, r, round_all, sclip, seq, six_sql, spec, sql, wp_sql

SIX_R = ", ".join(f"{r(c)} AS {c}" for c in scoring.SUMS)
SCORED = "need_prediction AND is_scored"
M = f"m AS (SELECT system, target, count(*) AS n, {six_sql('y', 'p')} FROM long WHERE {SCORED} GROUP BY ALL)"
MSEQ = f"mseq AS (SELECT seq_ix, system, target, count(*) AS n, {six_sql('y', 'p')} FROM long WHERE {SCORED} GROUP BY ALL)"
V = f"v AS (SELECT system, target, n, {wp_sql()} AS v FROM m)"
POS = "CASE WHEN step_in_seq < 70 THEN 'early' WHEN step_in_seq < 140 THEN 'middle' ELSE 'late' END"


def mag(e):
    a = f"abs({sclip(e)})"
    return (f"CASE WHEN {a} < 0.5 THEN '0_to_0.5' WHEN {a} < 1.0 THEN '0.5_to_1' WHEN {a} < 1.5 THEN '1_to_1.5' "
            f"WHEN {a} < 2.000001 THEN '1.5_to_2' END")


Q: dict = {}


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


@query("a01_wp_moments", sql(f"SELECT system, target, n, {SIX_R} FROM m", LONG_SQL, M))
def a01(s, d):
    return round_all(scoring.moments(scoring.scored_rows(seq(s, d)), BOTH))


@query("a01_wp_moments_by_sequence", sql(f"SELECT seq_ix, system, target, n, {SIX_R} FROM mseq", LONG_SQL, MSEQ))
def a01b(s, d):
    return round_all(scoring.moments(scoring.scored_rows(seq(s, d)), BOTH, by=[KEY]))


@query("a02_wp_from_moments", sql(f"SELECT system, target, {r('v')} AS wp FROM v", LONG_SQL, M, V))
def a02(s, d):
    m = scoring.moments(scoring.scored_rows(seq(s, d)), BOTH, by=[KEY])
    return round_all(scoring.with_wp(scoring.add_sums(m, ["system", "target"])).select("system", "target", "wp"))


@query("a03_two_pass_wp", sql(
    f"""SELECT {r("sum(w*(y-my)*(p-mp))/max(tw) / (sqrt(sum(w*(y-my)*(y-my))/max(tw)) * sqrt(sum(w*(p-mp)*(p-mp))/max(tw)))")} AS wp
    FROM c, k""",
    f"c AS (SELECT {sclip('t1')} AS y, {sclip('p1')} AS p, abs({sclip('t1')}) AS w FROM seq WHERE {SCORED})",
    "k AS (SELECT sum(w) AS tw, sum(w*y)/sum(w) AS my, sum(w*p)/sum(w) AS mp FROM c)"))
def a03(s, d):
    return round_all(scoring.two_pass_wp(scoring.scored_rows(seq(s, d)), "t1", "p1"))


@query("a04_merged_centered_wp", sql(
    f"""SELECT {r("max(tw)")} AS weight, {r("max(my)")} AS mean_y, {r("max(mp)")} AS mean_p,
    {r("sum(w*(y-my)*(p-mp))/max(tw) / (sqrt(sum(w*(y-my)*(y-my))/max(tw)) * sqrt(sum(w*(p-mp)*(p-mp))/max(tw)))")} AS wp FROM c, k""",
    f"c AS (SELECT t0 + 1000.0::DOUBLE AS y, p0 AS p, abs(t0 + 1000.0::DOUBLE) AS w FROM seq WHERE {SCORED})",
    "k AS (SELECT sum(w) AS tw, sum(w*y)/sum(w) AS my, sum(w*p)/sum(w) AS mp FROM c)"))
def a04(s, d):
    rows = scoring.scored_rows(seq(s, d)).select((F.col("t0") + 1000.0).alias("y"), F.col("p0").alias("p"))
    m = scoring.centered_moments(rows, "y", "p", limit=None)
    return round_all(m.select("weight", "mean_y", "mean_p", scoring.centered_wp().alias("wp")))


@query("a05_global_wp", sql(
    f"""SELECT a.system, a.n AS rows, {r('a.v')} AS t0, {r('b.v')} AS t1, {r('(a.v+b.v)/2')} AS combined
    FROM v a JOIN v b ON a.system = b.system AND a.target = 't0' AND b.target = 't1'""", LONG_SQL, M, V))
def a05(s, d):
    return round_all(scoring.global_wp(seq(s, d), BOTH))


@query("a06_wp_report", sql(
    f"""SELECT a.system, a.n AS rows, {r('a.v')} AS t0, {r('b.v')} AS t1, {r('(a.v+b.v)/2')} AS combined,
    (SELECT count(DISTINCT seq_ix) FROM seq) AS sequences,
    (SELECT count(DISTINCT seq_ix) FROM seq WHERE {SCORED}) AS sequences_with_scored_rows
    FROM v a JOIN v b ON a.system = b.system AND a.target = 't0' AND b.target = 't1'""", LONG_SQL, M, V))
def a06(s, d):
    return round_all(scoring.wp_report(seq(s, d), BOTH))


BUCKETS = [
    "root AS (" + " UNION ALL ".join(
        f"SELECT seq_ix, step_in_seq, '{name}' AS system, '{t}' AS target, {t} AS y, {p} AS p, {base} AS pb FROM seq WHERE {SCORED}"
        for name, pair in BOTH.items() for t, p, base in zip(("t0", "t1"), pair, BOTH["base"])) + ")",
    f"""b AS (SELECT system, target, y, p, {POS} AS position, {mag('y')} AS target_magnitude, {mag('pb')} AS prediction_magnitude FROM root)""",
    f"cell AS (SELECT system, target, position, target_magnitude, prediction_magnitude, count(*) AS n, {six_sql('y', 'p')} FROM b GROUP BY system, target, position, target_magnitude, prediction_magnitude)",
    "g AS (" + " UNION ALL ".join(
        f"SELECT system, target, '{name}' AS slice, {bucket} AS bucket, CAST(sum(n) AS BIGINT) AS n, {', '.join(f'sum({m}) AS {m}' for m in ('w', 'wy', 'wp', 'wyy', 'wpp', 'wyp'))} FROM cell GROUP BY system, target, {bucket}"
        for name, bucket in (("all", "'all'"), *((c, c) for c in ("position", "target_magnitude", "prediction_magnitude")))) + ")",
    f"gv AS (SELECT system, target, slice, bucket, n, {wp_sql()} AS v FROM g)",
]


@query("a07_wp_by_bucket", sql(
    f"""SELECT a.target, a.slice, a.bucket, a.n, {r('a.v')} AS base_wp, {r('c.v')} AS candidate_wp, {r('c.v - a.v')} AS candidate_delta
    FROM gv a JOIN gv c USING (target, slice, bucket) WHERE a.system = 'base' AND c.system = 'candidate'""", *BUCKETS))
def a07(s, d):
    return round_all(slices.wp_by_bucket(seq(s, d), BOTH, spec(s, d)))


@query("a08_wp_per_sequence", sql(f"SELECT seq_ix, system, target, n, {r(wp_sql())} AS wp FROM mseq", LONG_SQL, MSEQ))
def a08(s, d):
    return round_all(slices.wp_per_sequence(seq(s, d), BOTH).select(KEY, "system", "target", "n", "wp"))


@query("a08_sequence_spread", sql(
    "SELECT target, count(*) AS sequences, " + r("avg((c > b)::INT)") + " AS better_share, "
    + ", ".join(f"{r(f'quantile_cont({x}, {q})')} AS {n}_q{k}" for n, x in (("base", "b"), ("candidate", "c"))
                for q, k in ((0.1, "10"), (0.5, "50"), (0.9, "90"))) + " FROM p GROUP BY target",
    LONG_SQL, MSEQ, f"""p AS (SELECT seq_ix, target, max(CASE WHEN system='base' THEN {wp_sql()} END) AS b,
    max(CASE WHEN system='candidate' THEN {wp_sql()} END) AS c FROM mseq GROUP BY ALL)"""))
def a08b(s, d):
    return round_all(slices.sequence_spread(seq(s, d), BOTH))


FOCUS = "0.5::DOUBLE + x3 * 0.25::DOUBLE"


@query("a09_wp_populations", sql(
    f"SELECT population, system, target, n, {r(wp_sql())} AS wp FROM pm", LONG_SQL,
    f"""pop AS (SELECT *, 'uniform' AS population, 1.0::DOUBLE AS f FROM long WHERE need_prediction
      UNION ALL SELECT *, 'official', 1.0 FROM long WHERE {SCORED}
      UNION ALL SELECT *, 'weighted', {FOCUS} FROM long WHERE need_prediction)""",
    f"pm AS (SELECT population, system, target, count(*) AS n, {six_sql('y', 'p', focus='f')} FROM pop GROUP BY ALL)"))
def a09(s, d):
    pops = {"uniform": F.lit(1.0), "official": F.col("is_scored").cast("double"), "weighted": 0.5 + F.col("x3") * 0.25}
    return round_all(slices.wp_populations(seq(s, d), BOTH, pops).select("population", "system", "target", "n", "wp"))


@query("a10_within_wp", sql(
    f"""SELECT system, target, {r('sum(wyp-wy*wp/w)/sqrt(greatest(sum(wyy-wy*wy/w)*sum(wpp-wp*wp/w),1e-30))')} AS within_wp
    FROM mseq WHERE w > 0 GROUP BY ALL""", LONG_SQL, MSEQ))
def a10(s, d):
    per = scoring.moments(scoring.scored_rows(seq(s, d)), BOTH, by=[KEY])
    return round_all(slices.within_wp(per).select("system", "target", "within_wp"))


@query("a11_between_fraction", sql(
    f"""SELECT system, target, {r('((sum(wyp)-sum(wy)*sum(wp)/sum(w)) - sum(wyp-wy*wp/w))/(sum(wyp)-sum(wy)*sum(wp)/sum(w))')} AS between_fraction
    FROM mseq WHERE w > 0 GROUP BY ALL""", LONG_SQL, MSEQ))
def a11(s, d):
    per = scoring.moments(scoring.scored_rows(seq(s, d)), BOTH, by=[KEY])
    return round_all(slices.within_wp(per).select("system", "target", "between_fraction"))


@query("a12_clipping_contrast", sql(
    f"SELECT system, form, target, {r(wp_sql())} AS wp FROM k", LONG_SQL,
    f"""k AS (SELECT system, 'clipped' AS form, target, {six_sql('y', 'p')} FROM long WHERE {SCORED} GROUP BY ALL
    UNION ALL SELECT system, 'raw', target, {six_sql('y', 'p', clip_prediction=False)} FROM long WHERE {SCORED} GROUP BY ALL)"""))
def a12(s, d):
    return round_all(slices.clipping_contrast(seq(s, d), BOTH).select("system", "form", "target", "wp"))


GRID = [
    "st AS (SELECT unnest([0.0::DOUBLE, 0.05, 0.1, 0.25, 0.5, 1.0]) AS strength)",
    f"""gl AS (SELECT strength, 't0' AS target, t0 AS y, p0 + (q0 - p0) * strength AS p, is_scored FROM seq, st WHERE need_prediction
      UNION ALL SELECT strength, 't1', t1, p1 + (q1 - p1) * strength, is_scored FROM seq, st WHERE need_prediction)""",
    f"gm AS (SELECT strength, target, {six_sql('y', 'p')} FROM gl WHERE is_scored GROUP BY ALL)",
    f"gw AS (SELECT strength, target, {wp_sql()} AS wp FROM gm)",
]


def corrections():
    return ["p0", "p1"], [F.col("q0") - F.col("p0"), F.col("q1") - F.col("p1")]


@query("a13_strength_grid", sql(f"SELECT strength, target, {r('wp')} AS wp FROM gw", *GRID))
def a13(s, d):
    return round_all(slices.strength_grid(scoring.scored_rows(seq(s, d)), *corrections()).select("strength", "target", "wp"), "strength")


@query("a14_pick_strength", sql(
    f"SELECT target, strength, {r('wp')} AS wp FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY wp DESC, strength) AS k FROM gw) WHERE k = 1", *GRID))
def a14(s, d):
    grid = slices.strength_grid(scoring.scored_rows(seq(s, d)), *corrections())
    return round_all(slices.pick_strength(grid), "strength")


@query("a15_pick_minmax_strength", sql(
    f"SELECT target, strength, {r('gain')} AS gain FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gain DESC, strength) AS k FROM mn) WHERE k = 1",
    *GRID[:2],
    f"""pg AS (SELECT 'uniform' AS population, strength, target, {six_sql('y', 'p')} FROM gl GROUP BY ALL
      UNION ALL SELECT 'official', strength, target, {six_sql('y', 'p')} FROM gl WHERE is_scored GROUP BY ALL)""",
    f"pw AS (SELECT population, strength, target, {wp_sql()} AS wp FROM pg)",
    "mn AS (SELECT a.target, a.strength, min(a.wp - z.wp) AS gain FROM pw a JOIN pw z ON a.population = z.population AND a.target = z.target AND z.strength = 0.0 GROUP BY ALL)"))
def a15(s, d):
    rows = scoring.required_rows(seq(s, d))
    pops = F.when(F.col("is_scored"), F.array(F.lit("uniform"), F.lit("official"))).otherwise(F.array(F.lit("uniform")))
    rows = rows.withColumn("population", F.explode(pops))
    grid = slices.strength_grid(rows, *corrections(), by=["population"])
    return round_all(slices.pick_minmax_strength(grid), "strength")


AFFINE = [
    "sc AS (SELECT unnest([0.75::DOUBLE, 0.9, 1.0, 1.1, 1.25]) AS scale)", "bi AS (SELECT unnest([-0.1::DOUBLE, 0.0, 0.1]) AS bias)",
    f"al AS (SELECT scale, bias, target, {six_sql('y', 'p * scale + bias')} FROM long, sc, bi WHERE {SCORED} AND system = 'base' GROUP BY ALL)",
    f"aw AS (SELECT scale, bias, target, {wp_sql()} AS wp FROM al)",
]


@query("a16_affine_grid", sql(f"SELECT scale, bias, target, {r('wp')} AS wp FROM aw", LONG_SQL, *AFFINE))
def a16(s, d):
    return round_all(slices.affine_grid(seq(s, d)), "scale", "bias")


@query("m17_calibrate_affine", sql(
    f"""SELECT target, scale, bias, {r('wp')} AS wp FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(wp, 12) DESC, scale, bias) AS k FROM aw) WHERE k = 1""",
    LONG_SQL, *AFFINE))
def m17(s, d):
    grid = slices.affine_grid(seq(s, d)).withColumn("wp", F.round("wp", 12))
    return round_all(slices.best_affine(grid), "scale", "bias")


W, E = f"abs({sclip('y')})", f"({sclip('y')} - {sclip('p')})"


@query("a17_weighted_mse", sql(
    f"""SELECT target, system, {r(f"sum({W}*({sclip('y')}-p)*({sclip('y')}-p))/sum({W})")} AS raw_mse,
    {r(f"sum({W}*{E}*{E})/sum({W})")} AS clipped_mse FROM long WHERE {SCORED} GROUP BY ALL""", LONG_SQL))
def a17(s, d):
    return round_all(slices.weighted_mse(seq(s, d), BOTH))


@query("a19_saturation", sql(
    f"""SELECT target, system, count(*) AS rows, {r(f"sum({W}*{sclip('y')})/sum({W})")} AS mean_target, {r("avg((abs(p)>=2)::INT)")} AS saturated_share,
    {r(f"sum({W}*(abs(p)>=2)::INT)/sum({W})")} AS saturated_weight_share, {r(f"sum({W}*{sclip('p')})/sum({W})")} AS mean_clipped,
    {r(f"sum({W}*p)/sum({W})")} AS mean_raw,
    {r(f"(sum({W}*{sclip('y')}*{sclip('p')})-sum({W}*{sclip('y')})*sum({W}*{sclip('p')})/sum({W}))/(sum({W}*{sclip('p')}*{sclip('p')})-sum({W}*{sclip('p')})*sum({W}*{sclip('p')})/sum({W}))")} AS tangent_slope
    FROM long WHERE {SCORED} GROUP BY ALL""", LONG_SQL))
def a19(s, d):
    return round_all(slices.saturation(seq(s, d), BOTH))


@query("a20_residual_summary", sql(
    "SELECT target, " + r("avg(y-p)") + " AS residual_mean, " + r("stddev_pop(y-p)") + " AS residual_std, "
    f"(SELECT {r('corr(t0-p0, t1-p1)')} FROM seq WHERE {SCORED}) AS cross_target_corr, "
    + ", ".join(f"{r(f'quantile_cont(p, {q})')} AS q{n}" for q, n in ((0.0, "00"), (0.01, "01"), (0.5, "50"), (0.99, "99"), (1.0, "100")))
    + f" FROM long WHERE {SCORED} AND system = 'base' GROUP BY target", LONG_SQL))
def a20(s, d):
    return round_all(slices.residual_summary(seq(s, d)))


@query("a21_residual_bias_scale", sql(
    f"""SELECT target, system, count(*) AS n, {r(f"sum({W}*{E})/sum({W})")} AS bias,
    {r(f"sqrt(greatest(sum({W}*{E}*{E})/sum({W}) - (sum({W}*{E})/sum({W}))*(sum({W}*{E})/sum({W})), 0.0))")} AS scale
    FROM long WHERE {SCORED} GROUP BY ALL""", LONG_SQL))
def a21(s, d):
    return round_all(slices.residual_bias_scale(seq(s, d), BOTH))


def persistence_sql(e):
    return sql(
        f"SELECT lag, system, target, count(*) AS n, {r('corr(a, b)')} AS corr FROM pr WHERE ma AND mb GROUP BY ALL", LONG_SQL,
        f"e AS (SELECT seq_ix, step_in_seq, system, target, ({SCORED}) AS m, {e} AS e FROM long)",
        "pr AS (SELECT l.lag, a.system, a.target, a.e AS a, b.e AS b, a.m AS ma, b.m AS mb FROM e a, (VALUES (1), (10), (100)) l(lag), e b "
        "WHERE b.seq_ix = a.seq_ix AND b.system = a.system AND b.target = a.target AND b.step_in_seq = a.step_in_seq - l.lag)")


@query("a22_residual_persistence", persistence_sql(E))
def a22(s, d):
    return round_all(slices.residual_persistence(seq(s, d), BOTH, spec(s, d)))


@query("a22_residual_persistence_raw", persistence_sql("y - p"))
def a22b(s, d):
    return round_all(slices.residual_persistence(seq(s, d), BOTH, spec(s, d), kind="raw"))


@query("a23_adjacent_scored_cosine", sql(
    f"""SELECT {r('sum(e0*l0)/sqrt(sum(CASE WHEN l0 IS NOT NULL THEN e0*e0 END)*sum(l0*l0))')} AS adjacent_t0,
    {r('sum(e1*l1)/sqrt(sum(CASE WHEN l1 IS NOT NULL THEN e1*e1 END)*sum(l1*l1))')} AS adjacent_t1,
    {r('sum(e0*e1)/sqrt(sum(e0*e0)*sum(e1*e1))')} AS cross_target FROM a""",
    f"""a AS (SELECT t0-p0 AS e0, t1-p1 AS e1, lag(t0-p0) OVER w AS l0, lag(t1-p1) OVER w AS l1 FROM seq WHERE {SCORED}
    WINDOW w AS (PARTITION BY seq_ix ORDER BY step_in_seq))"""))
def a23(s, d):
    return round_all(slices.adjacent_scored_cosine(seq(s, d), spec(s, d)))


GROUPS = {"signal": (0, 1), "clock": (2, 3)}
REL = [
    LONG_SQL,
    "fx AS (SELECT seq_ix, step_in_seq, unnest([0, 1, 2, 3]) AS feature, unnest([x0, x1, x2, x3]) AS x FROM seq)",
    f"""fr AS (SELECT f.feature, l.lag, a.target, a.system, count(*) AS n, sum({W}) AS w, sum({W}*x) AS wx, sum({W}*x*x) AS wxx, sum({W}*{E}) AS wr,
      sum({W}*{E}*{E}) AS wrr, sum({W}*{E}*x) AS wxr FROM long a, (VALUES (0), (1), (10), (100)) l(lag), fx f
      WHERE {SCORED} AND f.seq_ix = a.seq_ix AND f.step_in_seq = a.step_in_seq - l.lag GROUP BY ALL)""",
    "fc AS (SELECT feature, lag, target, system, n, (wxr - wx*wr/w)/sqrt((wxx-wx*wx/w)*(wrr-wr*wr/w)) AS corr FROM fr)",
]


@query("a33_feature_residual_corr", sql(f"SELECT feature, lag, target, system, n, {r('corr')} AS corr FROM fc", *REL))
def a33(s, d):
    return round_all(slices.feature_residual_corr(seq(s, d), XS, BOTH, spec(s, d)))


@query("a33_feature_group_rms", sql(
    f"""SELECT CASE WHEN feature < 2 THEN 'signal' ELSE 'clock' END AS feature_group, lag, target, system, max(n) AS n,
    {r('sqrt(avg(corr*corr))')} AS rms_corr FROM fc GROUP BY ALL""", *REL))
def a33b(s, d):
    return round_all(slices.feature_group_rms(slices.feature_residual_corr(seq(s, d), XS, BOTH, spec(s, d)), GROUPS))


@query("a34_top_k_features", sql(
    f"""SELECT target, feature, {r('c')} AS corr, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(c) DESC, feature) AS rank
    FROM k) WHERE rank <= 2""",
    f"s20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_ix ORDER BY step_in_seq) AS rn FROM seq WHERE {SCORED}) WHERE (rn - 1) % 20 = 0)",
    "k AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{x}' AS feature, corr({x}, {t} - {p}) AS c FROM s20" for x in XS for t, p in (("t0", "p0"), ("t1", "p1"))) + ")"))
def a34(s, d):
    rows = sampling.stride_sample(seq(s, d), 20, spec(s, d), mark=F.col("need_prediction") & F.col("is_scored"))
    out = slices.top_k_features(rows, XS, ("p0", "p1"), k=2)
    return round_all(out.withColumn("rank", F.col("rank").cast("bigint")))


@query("a35_prediction_agreement", sql(
    f"""SELECT 't0' AS target, {r('corr(p0, q0)')} AS prediction_corr, {r('corr(t0-p0, t0-q0)')} AS residual_corr FROM seq WHERE {SCORED}
    UNION ALL SELECT 't1', {r('corr(p1, q1)')}, {r('corr(t1-p1, t1-q1)')} FROM seq WHERE {SCORED}"""))
def a35(s, d):
    return round_all(slices.prediction_agreement(seq(s, d), BOTH["base"], BOTH["candidate"]))


@query("a36_error_atlas", sql(
    f"""SELECT section, target, system, bucket, lag, n, {r('value')} AS value FROM (
    SELECT 'wp_' || slice AS section, target, system, bucket, 0 AS lag, n, v AS value FROM gv
    UNION ALL SELECT 'residual_bias', target, system, 'all', 0, count(*), sum({W}*{E})/sum({W}) FROM long WHERE {SCORED} GROUP BY target, system
    UNION ALL SELECT 'residual_scale', target, system, 'all', 0, count(*),
      sqrt(greatest(sum({W}*{E}*{E})/sum({W}) - (sum({W}*{E})/sum({W}))*(sum({W}*{E})/sum({W})), 0.0)) FROM long WHERE {SCORED} GROUP BY target, system
    UNION ALL SELECT 'residual_persistence', target, system, 'all', lag, count(*), corr(a, b) FROM pr WHERE ma AND mb GROUP BY target, system, lag
    UNION ALL SELECT 'feature_relation', target, system, CASE WHEN feature < 2 THEN 'signal' ELSE 'clock' END, lag, max(n), sqrt(avg(corr*corr)) FROM fc GROUP BY ALL
    UNION ALL SELECT 'sequence_score', target, system, unnest(['q10', 'q50', 'q90']), 0, count(*), unnest(quantile_cont(wp, [0.1, 0.5, 0.9])) FROM sv GROUP BY target, system
    UNION ALL SELECT 'sequence_better', a.target, 'candidate', 'all', 0, count(*), avg((b.wp > a.wp)::INT) FROM sv a JOIN sv b USING (seq_ix, target) WHERE a.system = 'base' AND b.system = 'candidate' GROUP BY a.target)""",
    *BUCKETS, LONG_SQL, MSEQ, f"sv AS (SELECT seq_ix, system, target, {wp_sql()} AS wp FROM mseq)", *REL[1:],
    f"e AS (SELECT seq_ix, step_in_seq, system, target, ({SCORED}) AS m, {E} AS e FROM long)",
    "pr AS (SELECT l.lag, a.system, a.target, a.e AS a, b.e AS b, a.m AS ma, b.m AS mb FROM e a, (VALUES (1), (10), (100)) l(lag), e b "
    "WHERE b.seq_ix = a.seq_ix AND b.system = a.system AND b.target = a.target AND b.step_in_seq = a.step_in_seq - l.lag)"))
def a36(s, d):
    return round_all(slices.error_atlas(seq(s, d), XS, GROUPS, BOTH, spec(s, d)))


QUERIES = Q
