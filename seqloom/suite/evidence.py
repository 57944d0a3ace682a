"""Resampling and population queries (A24-A32, A37-A41, A46-A57) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import scalar
from seqloom.layout import KEY, STEP
from seqloom.operators import joins, populations, resampling, sampling, scoring
from seqloom.suite.fixture import BASE, BOTH, LONG_SQL, XS, counts_sql, r, round_all, sclip, seq, six_sql, spec, sql, table, wp_sql

Q: dict = {}
SCORED = "need_prediction AND is_scored"
MSEQ = f"mseq AS (SELECT seq_ix, system, target, count(*) AS n, {six_sql('y', 'p')} FROM long WHERE {SCORED} GROUP BY ALL)"
SUM6 = ", ".join(f"sum({m}) AS {m}" for m in scoring.SUMS)


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


def per_sequence(s, d, df=None):
    return scoring.moments(scoring.scored_rows(seq(s, d) if df is None else df), BOTH, by=[KEY])


DRAWS = 100
IDX = "ids AS (SELECT seq_ix, row_number() OVER (ORDER BY substr(md5(seq_ix::VARCHAR), 1, 3), seq_ix) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT seq_ix FROM mseq))"


def picks(seed, draws=DRAWS):
    return counts_sql(seed, draws)


def drawn(seed, draws=DRAWS):
    """`de` holds the contrast of every draw, `pe` its value on all sequences."""
    return [
        LONG_SQL, MSEQ, IDX, picks(seed, draws),
        "dm AS (SELECT draw, system, target, " + ", ".join(f"sum(times * {m}) AS {m}" for m in scoring.SUMS) + " FROM cnt JOIN mseq USING (seq_ix) GROUP BY ALL)",
        f"dw AS (SELECT draw, system, target, {wp_sql()} AS wp FROM dm)",
        "dd AS (SELECT draw, a.target, a.wp - b.wp AS v FROM dw a JOIN dw b USING (draw, target) WHERE a.system = 'candidate' AND b.system = 'base')",
        "de AS (SELECT draw, target, v FROM dd UNION ALL SELECT draw, 'combined', avg(v) FROM dd GROUP BY draw)",
        f"pm AS (SELECT system, target, {SUM6} FROM mseq GROUP BY ALL)",
        f"pw AS (SELECT a.target, {wp_sql('a.')} - {wp_sql('b.')} AS v FROM pm a JOIN pm b USING (target) WHERE a.system = 'candidate' AND b.system = 'base')",
        "pe AS (SELECT target, v FROM pw UNION ALL SELECT 'combined', avg(v) FROM pw)",
    ]


DRAWN = drawn(17)


@query("a24_paired_bootstrap", sql(
    f"""SELECT 'delta' AS contrast, target, {r('max(pe.v)')} AS point, {r('quantile_cont(de.v, 0.025)')} AS lower, {r('quantile_cont(de.v, 0.975)')} AS upper
    FROM de JOIN pe USING (target) GROUP BY target""", *DRAWN))
def a24(s, d):
    return round_all(resampling.paired_bootstrap(per_sequence(s, d), draws=DRAWS, seed=17))


@query("a25_bootstrap_counts", sql("SELECT draw, seq_ix, times FROM cnt", LONG_SQL, MSEQ, IDX, picks(17, 20)))
def a25(s, d):
    ids = scoring.scored_rows(seq(s, d)).select(KEY)
    return resampling.bootstrap_counts(ids, 20, 17)


LOO = [
    LONG_SQL, MSEQ, f"tot AS (SELECT system, target, {', '.join(f'sum({m}) AS {m}' for m in scoring.SUMS)} FROM mseq GROUP BY ALL)",
    "lm AS (SELECT m.seq_ix, system, target, " + ", ".join(f"t.{m} - m.{m} AS {m}" for m in scoring.SUMS) + " FROM mseq m JOIN tot t USING (system, target))",
    f"lw AS (SELECT a.seq_ix, a.target, {wp_sql('a.')} - {wp_sql('b.')} AS v FROM lm a JOIN lm b USING (seq_ix, target) WHERE a.system = 'candidate' AND b.system = 'base')",
    f"fw AS (SELECT a.target, {wp_sql('a.')} - {wp_sql('b.')} AS f FROM tot a JOIN tot b USING (target) WHERE a.system = 'candidate' AND b.system = 'base')",
    "le AS (SELECT seq_ix, target, v, f FROM lw JOIN fw USING (target) UNION ALL SELECT seq_ix, 'combined', avg(v), avg(f) FROM lw JOIN fw USING (target) GROUP BY seq_ix)",
]


@query("a26_leave_one_out", sql(f"SELECT seq_ix, 'delta' AS contrast, target, {r('v')} AS without, {r('f - v')} AS influence FROM le", *LOO))
def a26(s, d):
    return round_all(resampling.leave_one_out(per_sequence(s, d)))


@query("a27_drop_top_influence", sql(
    f"""SELECT 'delta' AS contrast, target, {r('v')} AS value FROM kw UNION ALL SELECT 'delta', 'combined', {r('avg(v)')} FROM kw""", *LOO,
    "top5 AS (SELECT seq_ix FROM le WHERE target = 'combined' ORDER BY abs(f - v) DESC, seq_ix LIMIT 5)",
    f"km AS (SELECT system, target, {SUM6} FROM mseq WHERE seq_ix NOT IN (SELECT seq_ix FROM top5) GROUP BY ALL)",
    f"kw AS (SELECT a.target, {wp_sql('a.')} - {wp_sql('b.')} AS v FROM km a JOIN km b USING (target) WHERE a.system = 'candidate' AND b.system = 'base')"))
def a27(s, d):
    return round_all(resampling.drop_top_influence(per_sequence(s, d)))


HALF_TAIL = [
    f"hm AS (SELECT draw, half, system, target, {SUM6} FROM mseq JOIN hv USING (seq_ix) GROUP BY ALL)",
    f"hw AS (SELECT a.draw, a.half, a.target, {wp_sql('a.')} - {wp_sql('b.')} AS v FROM hm a JOIN hm b USING (draw, half, target) WHERE a.system = 'candidate' AND b.system = 'base')",
    "he AS (SELECT draw, half, target, v FROM hw UNION ALL SELECT draw, half, 'combined', avg(v) FROM hw GROUP BY draw, half)",
]


@query("a28_split_half", sql(
    f"""SELECT 'delta' AS contrast, target, {r('avg((a.v * b.v > 0)::INT)')} AS same_sign_share, {r('avg(abs(a.v - b.v))')} AS mean_difference
    FROM he a JOIN he b USING (draw, target) WHERE a.half = 1 AND b.half = 2 GROUP BY target""", LONG_SQL, MSEQ, IDX,
    """hv AS (SELECT seq_ix, draw, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY md5('5:' || draw || ':' || seq_ix), seq_ix) <= n // 2 THEN 1 ELSE 2 END AS half
    FROM ids, (SELECT unnest(range(40)) AS draw))""", *HALF_TAIL))
def a28(s, d):
    return round_all(resampling.split_half(per_sequence(s, d), draws=40, seed=5))


@query("a29_halves_check", sql(
    f"SELECT half, 'delta' AS contrast, target, {r('v')} AS value FROM he", LONG_SQL, MSEQ,
    "hv AS (SELECT seq_ix, 0 AS draw, ntile(2) OVER (ORDER BY seq_ix)::INT AS half FROM (SELECT DISTINCT seq_ix FROM mseq))", *HALF_TAIL))
def a29(s, d):
    return round_all(resampling.halves_check(per_sequence(s, d)))


def drawn_contrast(systems_sql, contrast, seed):
    """SQL of a paired interval for a linear contrast over labelled systems; `ls` holds (seq_ix, lab, target, six sums)."""
    value = " + ".join(f"{w}::DOUBLE * sum(CASE WHEN lab = '{n}' THEN wp END)" for n, w in contrast.items())
    return [
        *systems_sql,
        IDX.replace("FROM mseq", "FROM ls"), picks(seed),
        "dm AS (SELECT draw, lab, target, " + ", ".join(f"sum(times * {m}) AS {m}" for m in scoring.SUMS) + " FROM cnt JOIN ls USING (seq_ix) GROUP BY ALL)",
        f"dd AS (SELECT draw, target, {value} AS v FROM (SELECT draw, lab, target, {wp_sql()} AS wp FROM dm) GROUP BY ALL)",
        "de AS (SELECT draw, target, v FROM dd UNION ALL SELECT draw, 'combined', avg(v) FROM dd GROUP BY draw)",
        f"pd AS (SELECT target, {value} AS v FROM (SELECT lab, target, {wp_sql()} AS wp FROM (SELECT lab, target, {SUM6} FROM ls GROUP BY ALL)) GROUP BY ALL)",
        "pe AS (SELECT target, v FROM pd UNION ALL SELECT 'combined', avg(v) FROM pd)",
    ]


def contrast_body(name):
    return (f"SELECT '{name}' AS contrast, target, {r('max(pe.v)')} AS point, {r('quantile_cont(de.v, 0.025)')} AS lower, "
            f"{r('quantile_cont(de.v, 0.975)')} AS upper FROM de JOIN pe USING (target) GROUP BY target")


POSITION = {"middle|candidate": 1.0, "middle|base": -1.0, "outer|candidate": -1.0, "outer|base": 1.0}


@query("a30_position_contrast", sql(contrast_body("middle_minus_outer"), *drawn_contrast(
    [LONG_SQL, f"""ls AS (SELECT seq_ix, CASE WHEN step_in_seq >= 70 AND step_in_seq < 140 THEN 'middle|' ELSE 'outer|' END || system AS lab, target, {six_sql('y', 'p')}
     FROM long WHERE {SCORED} GROUP BY ALL)"""], POSITION, 23)))
def a30(s, d):
    a, b = spec(s, d).position_edges
    where = F.when((F.col(STEP) >= a) & (F.col(STEP) < b), F.lit("middle")).otherwise(F.lit("outer"))
    m = scoring.moments(scoring.scored_rows(seq(s, d)), BOTH, by=[KEY, where.alias("place")])
    m = m.withColumn("system", F.concat_ws("|", "place", "system")).drop("place")
    return round_all(resampling.paired_bootstrap(m, {"middle_minus_outer": POSITION}, draws=DRAWS, seed=23))


POPULATION = {"official|candidate": 1.0, "official|base": -1.0, "uniform|candidate": -1.0, "uniform|base": 1.0}


@query("a31_population_contrast", sql(contrast_body("official_minus_uniform"), *drawn_contrast(
    [LONG_SQL, f"""ls AS (SELECT seq_ix, 'official|' || system AS lab, target, {six_sql('y', 'p')} FROM long WHERE {SCORED} GROUP BY ALL
     UNION ALL SELECT seq_ix, 'uniform|' || system, target, {six_sql('y', 'p')} FROM long WHERE need_prediction GROUP BY ALL)"""], POPULATION, 29)))
def a31(s, d):
    pops = F.when(F.col("is_scored"), F.array(F.lit("uniform"), F.lit("official"))).otherwise(F.array(F.lit("uniform")))
    rows = scoring.required_rows(seq(s, d)).withColumn("population", F.explode(pops))
    m = scoring.moments(rows, BOTH, by=[KEY, "population"])
    m = m.withColumn("system", F.concat_ws("|", "population", "system")).drop("population")
    return round_all(resampling.paired_bootstrap(m, {"official_minus_uniform": POPULATION}, draws=DRAWS, seed=29))


MODELS = {"a1": 0.5, "a2": 0.5, "b1": -0.5, "b2": -0.5}
CANDS = {"a1": "p{} + 0.05::DOUBLE * x0", "a2": "p{} + 0.1::DOUBLE * x0", "b1": "p{} + 0.05::DOUBLE * x3", "b2": "p{} + 0.1::DOUBLE * x3"}


@query("a32_model_contrast", sql(contrast_body("a_minus_b"), *drawn_contrast(
    ["ls AS (" + " UNION ALL ".join(
        f"SELECT seq_ix, '{n}' AS lab, 't{t}' AS target, {six_sql(f't{t}', e.format(t))} FROM seq WHERE {SCORED} GROUP BY ALL" for n, e in CANDS.items() for t in (0, 1)) + ")"], MODELS, 31)))
def a32(s, d):
    add = {"a1": ("x0", 0.05), "a2": ("x0", 0.1), "b1": ("x3", 0.05), "b2": ("x3", 0.1)}
    systems = {n: [F.col(p) + F.col(x) * w for p in ("p0", "p1")] for n, (x, w) in add.items()}
    m = scoring.moments(scoring.scored_rows(seq(s, d)), systems, by=[KEY])
    return round_all(resampling.paired_bootstrap(m, {"a_minus_b": MODELS}, draws=DRAWS, seed=31))


# ---- populations ---------------------------------------------------------------------------

SAMPLE10 = "s10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq_ix ORDER BY step_in_seq) - 1 AS k FROM seq WHERE need_prediction) WHERE k % 10 = 0)"


@query("a37_feature_scaler", sql(" UNION ALL ".join(
    f"SELECT '{x}' AS feature, {r(f'avg({x})')} AS mean, {r(f'sqrt(greatest(avg({x}*{x}) - avg({x})*avg({x}), 0.000001))')} AS scale FROM s10" for x in XS), SAMPLE10))
def a37(s, d):
    return round_all(populations.scaler_table(sampling.stride_sample(seq(s, d), 10, spec(s, d)), XS))


@query("a38_covariate_shift", sql(
    f"SELECT feature, {r('shift')} AS shift FROM (" + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, (avg({x}) FILTER (seq_ix % 2 = 1) - avg({x}) FILTER (seq_ix % 2 = 0)) / stddev_pop({x}) FILTER (seq_ix % 2 = 0) AS shift FROM seq" for x in XS)
    + ") ORDER BY abs(shift) DESC LIMIT 3"))
def a38(s, d):
    df = seq(s, d)
    return round_all(populations.covariate_shift(df.filter(F.col(KEY) % 2 == 0), df.filter(F.col(KEY) % 2 == 1), XS, 3))


BINS = ("((step_in_seq >= 20)::INT + (step_in_seq >= 60)::INT + (step_in_seq >= 120)::INT)",
        "((greatest(abs(p0), abs(p1)) >= 0.5)::INT + (greatest(abs(p0), abs(p1)) >= 1)::INT + (greatest(abs(p0), abs(p1)) >= 2)::INT)")
EDGES = ([9, 20, 60, 120, 1 << 40], [0, 0.5, 1, 2])
PROP = (f"prop AS (SELECT {BINS[0]} AS position, {BINS[1]} AS magnitude, count(*) AS required, sum(is_scored::INT)::BIGINT AS scored FROM seq WHERE need_prediction GROUP BY ALL)")


@query("a39_propensity_table", sql(
    f"""SELECT position, magnitude, required, scored, {r('(scored + 0.5) / (required + 1.0)')} AS rate,
    {r('greatest(0.2, least(5.0, (scored + 0.5) / (required + 1.0) / (SELECT sum(scored) / sum(required) FROM prop)))')} AS focus FROM prop""", PROP))
def a39(s, d):
    pos, mag = joins.bin_pair(STEP, ["p0", "p1"], *EDGES)
    return round_all(populations.propensity_table(seq(s, d), pos, mag))


LAB = "lab AS (SELECT quality AS y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(n_chars - 1000) / 2000.0::DOUBLE)) AS p, n_chars FROM labels JOIN documents USING (doc_id))"


def labelled(s, d):
    df = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return df.withColumn("p", scalar.logistic((F.col("n_chars") - 1000) / 2000.0))


def loss_sql(p):
    c = f"greatest(1e-12, least(1 - 1e-12, {p}))"
    return f"avg(-y * ln({c}) - (1 - y) * ln(1 - {c}))"


@query("a40_log_loss", f"WITH {LAB} SELECT {r(loss_sql('p'))} AS log_loss, {r(loss_sql('(SELECT avg(y) FROM lab)'))} AS prior_log_loss FROM lab")
def a40(s, d):
    return round_all(populations.log_loss(labelled(s, d), F.col("quality"), F.col("p")))


@query("a41_roc_auc", f"""WITH {LAB}, rk AS (SELECT y, rank() OVER (ORDER BY n_chars // 200) + (count(*) OVER (PARTITION BY n_chars // 200) - 1) / 2.0 AS rk FROM lab)
SELECT {r('(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))')} AS auc FROM rk""")
def a41(s, d):
    return round_all(populations.roc_auc(labelled(s, d), F.col("quality") == 1, F.floor(F.col("n_chars") / 200)))


@query("a46_effective_mass", sql(f"SELECT {r('sum(m) * sum(m) / sum(m * m)')} AS effective_sequences FROM (SELECT seq_ix, sum(abs({sclip('t0')})) AS m FROM seq WHERE {SCORED} GROUP BY ALL)"))
def a46(s, d):
    return round_all(populations.effective_mass(scoring.scored_rows(seq(s, d)).withColumn("m", F.abs(scalar.clip("t0"))), "m"))


WGT = "greatest(0.2::DOUBLE, least(5.0::DOUBLE, x0))"


@query("a47_cap_fraction", sql(
    f"SELECT {r(f'avg(({WGT} <= 0.2)::INT)')} AS low_share, {r(f'avg(({WGT} >= 5.0)::INT)')} AS high_share, "
    + ", ".join(f"{r(f'quantile_cont({WGT}, {q})')} AS q{n}" for q, n in ((0.01, "01"), (0.5, "50"), (0.99, "99"))) + " FROM seq"))
def a47(s, d):
    return round_all(populations.weight_profile(seq(s, d).withColumn("w", scalar.clip("x0", 0.2, 5.0)), "w"))


MC_KEYS = "side, pb, pos, pp"


@query("a48_matched_contrast", sql(
    f"""SELECT side AS target, sum(c)::BIGINT AS matched_rows, count(*) AS cells, {r(wp_sql('z0'))} AS unscored_wp, {r(wp_sql('z1'))} AS scored_wp,
    {r('(z0wyy + z0wpp - 2 * z0wyp) / z0w')} AS unscored_mse, {r('(z1wyy + z1wpp - 2 * z1wyp) / z1w')} AS scored_mse,
    {r('((z1wyy + z1wpp - 2 * z1wyp) / z1w) / ((z0wyy + z0wpp - 2 * z0wyp) / z0w)')} AS mse_ratio FROM tot JOIN pr USING (side) GROUP BY ALL""",
    LONG_SQL,
    f"""cl AS (SELECT target AS side, (x2 > 0.5)::INT + (x2 > 1.0)::INT AS pb, (step_in_seq >= 70)::INT AS pos, ({sclip('p')} > -1)::INT + ({sclip('p')} > 0)::INT + ({sclip('p')} > 1)::INT AS pp,
      is_scored, count(*) AS n, {six_sql('y', 'p')} FROM long WHERE need_prediction AND system = 'base' GROUP BY ALL)""",
    f"pr AS (SELECT {MC_KEYS}, a.n AS n0, b.n AS n1, least(a.n, b.n) AS c FROM cl a JOIN cl b USING ({MC_KEYS}) WHERE NOT a.is_scored AND b.is_scored AND a.n >= 20 AND b.n >= 20)",
    "tot AS (SELECT side, " + ", ".join(f"sum(CASE WHEN {'' if k else 'NOT '}is_scored THEN {m} * c / n END) AS z{k}{m}" for k in (0, 1) for m in scoring.SUMS)
    + f" FROM cl JOIN pr USING ({MC_KEYS}) GROUP BY side)"))
def a48(s, d):
    pos = (F.col(STEP) >= 70).cast("int")
    return round_all(populations.matched_contrast(seq(s, d), BASE, F.col("x2"), pos, [0.5, 1.0], minimum=20))


EA, EB = f"({sclip('y')} - {sclip('a')})", f"({sclip('y')} - {sclip('b')})"


@query("a49_poor_row_gain", sql(
    f"""SELECT target, sum((abs({EA}) >= thr)::INT)::BIGINT AS poor_rows, {r(f"sum(CASE WHEN abs({EA}) >= thr THEN abs({sclip('y')}) * ({EA}*{EA} - {EB}*{EB}) END) / sum(CASE WHEN abs({EA}) >= thr THEN abs({sclip('y')}) END)")} AS poor_gain,
    {r(f"sum(abs({sclip('y')}) * ({EA}*{EA} - {EB}*{EB})) / sum(abs({sclip('y')}))")} AS gain FROM ab JOIN th USING (target) GROUP BY target""",
    f"ab AS (SELECT 't0' AS target, t0 AS y, p0 AS a, q0 AS b FROM seq WHERE {SCORED} UNION ALL SELECT 't1', t1, p1, q1 FROM seq WHERE {SCORED})",
    f"th AS (SELECT target, quantile_cont(abs({EA}), 0.75) AS thr FROM ab GROUP BY target)"))
def a49(s, d):
    rows = scoring.scored_rows(seq(s, d))
    limits = populations.poor_row_thresholds(rows, {"t0": "p0", "t1": "p1"})
    return round_all(populations.poor_row_gain(seq(s, d), BASE["base"], BOTH["candidate"], limits))


CONS = "sign((a + b) * 0.5) * greatest(abs((a + b) * 0.5) - abs(a - b) * 0.5, 0)"


@query("a50_amplitude_ratio", sql(
    f"SELECT target, {r(f'sqrt(sum(({CONS}) * ({CONS})) / sum((a + b) * 0.5 * (a + b) * 0.5))')} AS ratio, {r('avg((a * b > 0)::INT)')} AS agreement FROM ab GROUP BY target",
    "ab AS (SELECT 't0' AS target, q0 - p0 AS a, 0.1::DOUBLE * (x2 - 1.0::DOUBLE) AS b FROM seq UNION ALL SELECT 't1', q1 - p1, 0.1::DOUBLE * (x2 - 1.0::DOUBLE) FROM seq)"))
def a50(s, d):
    other = (F.col("x2") - 1.0) * 0.1
    a = {"t0": F.col("q0") - F.col("p0"), "t1": F.col("q1") - F.col("p1")}
    return round_all(populations.amplitude_ratio(seq(s, d), a, {"t0": other, "t1": other}, scalar.consensus))


@query("a51_quantile_bins", sql(
    "SELECT (" + " + ".join(f"(quantile_cont_{k} < p0)::INT" for k in range(1, 8)) + ") AS bin, count(*) AS n FROM seq, e GROUP BY ALL",
    "e AS (SELECT " + ", ".join(f"quantile_cont(p0, {k / 8}) AS quantile_cont_{k}" for k in range(1, 8)) + " FROM seq)"))
def a51(s, d):
    from seqloom.operators.quantiles import binned, quantile_edges
    edges = quantile_edges(seq(s, d), "p0", 8)
    return binned(seq(s, d), "p0", edges, "bin").groupBy("bin").agg(F.count("*").alias("n"))


MANY = {"x0": "x0", "x1": "x1", "p0": "p0", "residual": "t1 - p1"}


@query("a51_many_quantiles", sql(" UNION ALL ".join(
    f"SELECT seq_ix % 4 AS part, '{n}' AS name, {q}::DOUBLE AS q, {r(f'quantile_cont({e}, {q})')} AS value FROM seq GROUP BY ALL" for n, e in MANY.items() for q in (0.0, 0.05, 0.5, 0.9, 1.0))))
def a51b(s, d):
    from seqloom.operators.quantiles import many_quantiles
    probs = (0.0, 0.05, 0.5, 0.9, 1.0)
    found = many_quantiles(seq(s, d).withColumn("part", F.col(KEY) % 4), {n: F.expr(e) for n, e in MANY.items()}, probs, by=["part"])
    rows = [(part, n, q, v) for (part,), table in found.items() for n, line in table.items() for q, v in zip(probs, line)]
    return round_all(s.createDataFrame(rows, "part bigint, name string, q double, value double"))


KNOTS = [-2.0, -1.0, 0.0, 1.0, 2.0]


@query("a52_knot_mass", sql(" UNION ALL ".join(
    f"SELECT {k}::DOUBLE AS knot, {r(f'''sum(abs({sclip('t0')}) * greatest(0.0::DOUBLE, 1.0::DOUBLE - abs({sclip('p0')} - ({k})::DOUBLE)))''')} AS mass FROM seq" for k in KNOTS)))
def a52(s, d):
    return round_all(populations.knot_mass(seq(s, d), "t0", "p0", KNOTS))


@query("a53_sequence_groups", sql(
    f"SELECT seq_ix, {r('m')} AS mean, (m >= a)::INT + (m >= b)::INT + (m >= c)::INT AS \"group\" FROM (SELECT seq_ix, avg(p1) AS m FROM seq GROUP BY ALL), e",
    "e AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.5) AS b, quantile_cont(m, 0.75) AS c FROM (SELECT seq_ix, avg(p1) AS m FROM seq WHERE seq_ix % 5 <> 0 GROUP BY ALL))"))
def a53(s, d):
    df = seq(s, d)
    return round_all(populations.sequence_groups(df.filter(F.col(KEY) % 5 != 0), df, F.col("p1")))


@query("a55_agreement_counts", sql("SELECT seq_ix % 3 AS part, count(*) AS rows, sum(is_scored::INT)::BIGINT AS scored, sum((greatest(abs(p0), abs(p1)) >= 1)::INT)::BIGINT AS high_expert FROM seq WHERE need_prediction GROUP BY ALL"))
def a55(s, d):
    flags = {"scored": F.col("is_scored"), "high_expert": scalar.magnitude_gate(["p0", "p1"])}
    return populations.counts_by(scoring.required_rows(seq(s, d)), flags, [(F.col(KEY) % 3).alias("part")])


@query("a56_error_decomposition", sql(
    f"""SELECT target, 'candidate' AS candidate, {r(f"sum(abs({sclip('y')})*{EA}*{EB}) / sqrt(sum(abs({sclip('y')})*{EA}*{EA}) * sum(abs({sclip('y')})*{EB}*{EB}))")} AS error_corr,
    {r(f"(sum(abs({sclip('y')})*{EA}*{EA}) - sum(abs({sclip('y')})*{EB}*{EB})) / sum(abs({sclip('y')}))")} AS mse_gain FROM ab GROUP BY target""",
    f"ab AS (SELECT 't0' AS target, t0 AS y, p0 AS a, q0 AS b FROM seq WHERE {SCORED} UNION ALL SELECT 't1', t1, p1, q1 FROM seq WHERE {SCORED})"))
def a56(s, d):
    return round_all(populations.error_decomposition(seq(s, d), BASE["base"], {"candidate": BOTH["candidate"]}))


@query("a57_selection_agreement", f"""WITH c AS (SELECT o_custkey AS k, floor(avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice - 250000 END) / 1000) AS fit, floor(avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice - 250000 END) / 1000) AS ev
  FROM orders GROUP BY 1 HAVING fit IS NOT NULL AND ev IS NOT NULL),
k AS (SELECT *, rank() OVER (ORDER BY fit) + (count(*) OVER (PARTITION BY fit) - 1) / 2.0 AS rf, rank() OVER (ORDER BY ev) + (count(*) OVER (PARTITION BY ev) - 1) / 2.0 AS re FROM c)
SELECT count(*) AS candidates, {r('corr(rf, re)')} AS spearman, sum((fit > 0 AND ev < 0)::INT)::BIGINT AS better_fit_worse_evaluation FROM k""")
def a57(s, d):
    o = table(s, d, "orders")
    even, price = F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") - 250000
    c = o.groupBy("o_custkey").agg(F.floor(F.avg(F.when(even, price)) / 1000).alias("fit"), F.floor(F.avg(F.when(~even, price)) / 1000).alias("ev")).dropna()
    return round_all(populations.selection_agreement(c, "fit", "ev"))


QUERIES = Q
