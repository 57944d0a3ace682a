"""Window and memory queries (W1-W18) with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.layout import KEY, STEP
from seqloom.operators import memory, ordered
from seqloom.suite.fixture import XS, r, round_all, seq, spec, sql

Q: dict = {}
WIN = "WINDOW w AS (PARTITION BY seq_ix ORDER BY step_in_seq)"


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


def ema_sql(columns: dict, tail: str = "", extra_ctes: tuple = ()) -> str:
    """Recursive evaluation of EMAs: `columns[name] = (expression over seq, alpha)`."""
    first = ", ".join(f"{a}::DOUBLE * {n}_v AS {n}" for n, (_, a) in columns.items())
    nxt = ", ".join(f"{a}::DOUBLE * i.{n}_v + {1.0 - a}::DOUBLE * e.{n}" for n, (_, a) in columns.items())
    inputs = ", ".join(f"({e}) AS {n}_v" for n, (e, _) in columns.items())
    ctes = [
        *extra_ctes,
        f"inp AS MATERIALIZED (SELECT seq_ix, step_in_seq, {inputs} FROM {'base' if extra_ctes else 'seq'})",
        f"em AS (SELECT seq_ix, step_in_seq, {first} FROM inp WHERE step_in_seq = 0 "
        f"UNION ALL SELECT i.seq_ix, i.step_in_seq, {nxt} FROM em e JOIN inp i ON i.seq_ix = e.seq_ix AND i.step_in_seq = e.step_in_seq + 1)",
    ]
    return sql(tail, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query("w01_lag_fill", sql(f"SELECT seq_ix, step_in_seq, {r('coalesce(lag(x0, 10) OVER w, -1.0::DOUBLE)')} AS x0_lag FROM seq {WIN}"))
def w01(s, d):
    return round_all(ordered.lags(seq(s, d), {"x0_lag": ("x0", 10)}, spec(s, d), -1.0).select(KEY, STEP, "x0_lag"))


@query("w02_multi_lag", sql(
    "SELECT seq_ix, step_in_seq, " + ", ".join(f"coalesce({f'lag({x}, {k}) OVER w' if k else x}, 0.0::DOUBLE) AS {x}_{k}" for x in XS for k in (0, 1, 4, 16, 64))
    + f" FROM seq {WIN}"))
def w02(s, d):
    values = {f"{x}_{k}": (x, k) for x in XS for k in (0, 1, 4, 16, 64)}
    return ordered.lags(seq(s, d), values, spec(s, d), 0.0).select(KEY, STEP, *values)


EMA_TAIL = "SELECT seq_ix, step_in_seq, {cols} FROM em"


def _cols(names):
    return EMA_TAIL.format(cols=", ".join(f"{r(n)} AS {n}" for n in names))


@query("w03_ema", ema_sql({"s": ("x0", 0.05)}, _cols(["s"])))
def w03(s, d):
    return round_all(memory.ema(seq(s, d), {"s": ("x0", 0.05)}, spec(s, d)).select(KEY, STEP, "s"))


@query("w04_dual_ema", ema_sql({f"{x}_{n}": (x, a) for x in ("x0", "x1") for n, a in (("fast", 0.01), ("slow", 0.001))},
                               _cols([f"{x}_{n}" for x in ("x0", "x1") for n in ("fast", "slow")])))
def w04(s, d):
    out = memory.dual_ema(seq(s, d), ["x0", "x1"], spec(s, d))
    return round_all(out.select(KEY, STEP, *[f"{x}_{n}" for x in ("x0", "x1") for n in ("fast", "slow")]))


@query("w05_ema_zscore", ema_sql(
    {"m": ("x0", 0.001), "q": ("x0 * x0", 0.001)},
    f"SELECT seq_ix, step_in_seq, {r('greatest(-8.0::DOUBLE, least(8.0::DOUBLE, (x0 - m) / sqrt(greatest(q - m * m, 0.1::DOUBLE))))')} AS x0_z FROM em JOIN seq USING (seq_ix, step_in_seq)"))
def w05(s, d):
    return round_all(memory.ema_zscore(seq(s, d), ["x0"], spec(s, d)).select(KEY, STEP, "x0_z"))


@query("w06_ema_interaction", ema_sql(
    {"f": ("x0", 0.01), "g": ("x0", 0.001)},
    f"SELECT seq_ix, step_in_seq, {r('x0 * f', 9)} AS x0_x_fast, {r('x0 * g', 9)} AS x0_x_slow FROM em JOIN seq USING (seq_ix, step_in_seq)"))
def w06(s, d):
    return round_all(memory.ema_interaction(seq(s, d), ["x0"], spec(s, d)).select(KEY, STEP, "x0_x_fast", "x0_x_slow"), digits=9)


INNOVATION_BASE = (f"base AS (SELECT seq_ix, step_in_seq, (abs(p0 - coalesce(lag(p0) OVER w, p0)) + abs(p1 - coalesce(lag(p1) OVER w, p1))) / 2.0::DOUBLE AS dv FROM seq {WIN})",)


@query("w07_innovation", ema_sql({"innovation": ("dv", 0.02)}, _cols(["innovation"]), INNOVATION_BASE))
def w07(s, d):
    return round_all(memory.innovation(seq(s, d), ["p0", "p1"], spec(s, d)).select(KEY, STEP, "innovation"))


@query("w08_state_change", sql(f"SELECT seq_ix, step_in_seq, {r('p1 - coalesce(lag(p1) OVER w, 0.0::DOUBLE)', 9)} AS p1_change FROM seq {WIN}"))
def w08(s, d):
    return round_all(memory.state_change(seq(s, d), ["p1"], spec(s, d)).select(KEY, STEP, "p1_change"), digits=9)


@query("w09_multi_horizon_ema", ema_sql(
    {f"x0_h{h}": ("x0", 1.0 - float(np.exp(-1.0 / h))) for h in memory.HORIZONS}, _cols([f"x0_h{h}" for h in memory.HORIZONS])))
def w09(s, d):
    return round_all(memory.multi_horizon_ema(seq(s, d), ["x0"], spec(s, d)).select(KEY, STEP, *[f"x0_h{h}" for h in memory.HORIZONS]))


def legendre_sql() -> str:
    a, b = memory.legendre_system()
    nxt = ", ".join(
        " + ".join(f"{float(a[i, j])!r}::DOUBLE * e.m{j}" for j in range(4)) + f" + {float(b[i])!r}::DOUBLE * i.x0" for i in range(4))
    first = ", ".join(f"{float(b[i])!r}::DOUBLE * x0 AS m{i}" for i in range(4))
    body = "SELECT seq_ix, step_in_seq, " + ", ".join(f"{r(f'm{i}')} AS x0_leg{i}" for i in range(4)) + " FROM lm"
    return sql(body, "inp AS MATERIALIZED (SELECT seq_ix, step_in_seq, x0 FROM seq)",
               f"lm AS (SELECT seq_ix, step_in_seq, {first} FROM inp WHERE step_in_seq = 0 UNION ALL "
               f"SELECT i.seq_ix, i.step_in_seq, {nxt} FROM lm e JOIN inp i ON i.seq_ix = e.seq_ix AND i.step_in_seq = e.step_in_seq + 1)"
               ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("w10_legendre_memory", legendre_sql())
def w10(s, d):
    out = memory.legendre_memory(seq(s, d).select(KEY, STEP, "x0"), ["x0"], spec(s, d))
    return round_all(out.select(KEY, STEP, *[f"x0_leg{i}" for i in range(4)]))


# One-column layers with fixed weights, so that SQL can spell them out.
STACK_W = np.array([[[[0.5]], [[0.25]]], [[[0.4]], [[-0.3]]], [[[0.7]], [[0.2]]], [[[0.6]], [[0.5]]]])
STACK_B = np.array([[0.1], [0.0], [-0.1], [0.05]])


def stack_sql(body: str) -> str:
    ctes, before = ["h0 AS (SELECT seq_ix, step_in_seq, need_prediction, x0 AS h FROM seq)"], "h0"
    for k, dist in enumerate(memory.DILATIONS):
        w0, w1, bias = float(STACK_W[k, 0, 0, 0]), float(STACK_W[k, 1, 0, 0]), float(STACK_B[k, 0])
        keep = ", ".join(["seq_ix, step_in_seq, need_prediction", *[f"l{i}" for i in range(k)]])
        ctes.append(f"g{k} AS (SELECT {keep}, tanh(h * {w0}::DOUBLE + coalesce(lag(h, {dist}) OVER w, 0.0::DOUBLE) * {w1}::DOUBLE + {bias}::DOUBLE) AS h FROM {before} {WIN})")
        ctes.append(f"h{k + 1} AS (SELECT *, h AS l{k} FROM g{k})")
        before = f"h{k + 1}"
    return sql(body.format(table=before), *ctes)


@query("w11_dilated_stack", stack_sql("SELECT seq_ix, step_in_seq, " + ", ".join(f"{r(f'l{i}')} AS l{i}" for i in range(4)) + " FROM {table}"))
def w11(s, d):
    out = memory.dilated_stack(seq(s, d).select(KEY, STEP, "x0"), ["x0"], STACK_W, STACK_B, spec(s, d))
    return round_all(out.select(KEY, STEP, *[F.col("h")[i].alias(f"l{i}") for i in range(4)]))


@query("w12_gather_offsets", sql(
    "SELECT seq_ix, step_in_seq, " + ", ".join(f"coalesce(lag(x0, {k}) OVER w, 0.0::DOUBLE) AS v{k}, (lag(x0, {k}) OVER w) IS NOT NULL AS ok{k}" for k in (1, 4, 5, 16, 85))
    + f" FROM seq {WIN}"))
def w12(s, d):
    out = memory.gather_offsets(seq(s, d), ["x0"], spec(s, d))
    at = {k: memory.ENDPOINT_OFFSETS.index(k) for k in (1, 4, 5, 16, 85)}
    return out.select(KEY, STEP, *[F.col("x0_window")[i].alias(f"v{k}") for k, i in at.items()], *[F.col("valid")[i].alias(f"ok{k}") for k, i in at.items()])


@query("w13_endpoint_features", stack_sql(
    "SELECT seq_ix, step_in_seq, " + ", ".join(f"{r(f'l{i}')} AS l{i}" for i in range(4))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY seq_ix ORDER BY step_in_seq) AS rn FROM {table} WHERE need_prediction) WHERE (rn - 1) % 5 = 0"))
def w13(s, d):
    from seqloom.operators.sampling import stride_sample
    rows = memory.gather_offsets(seq(s, d).select(KEY, STEP, "need_prediction", "x0"), ["x0"], spec(s, d))
    out = memory.endpoint_features(stride_sample(rows, 5, spec(s, d)), ["x0"], STACK_W, STACK_B)
    return round_all(out.select(KEY, STEP, *[F.col("h")[i].alias(f"l{i}") for i in range(4)]))


@query("w14_prefix_context", sql(
    f"""SELECT seq_ix, {r('avg(x0)')} AS x0_mean, {r('avg(x1)')} AS x1_mean, {r('ln(greatest(stddev_pop(x0), 0.05))')} AS x0_logstd,
    {r('ln(greatest(stddev_pop(x1), 0.05))')} AS x1_logstd FROM seq WHERE step_in_seq < 40 GROUP BY seq_ix"""))
def w14(s, d):
    return round_all(memory.prefix_context(seq(s, d), ["x0", "x1"], 40))


@query("w15_running_aggregate", sql(
    f"""SELECT seq_ix, step_in_seq, {r('total')} AS total, n FROM (SELECT seq_ix, step_in_seq, need_prediction, sum(x0) OVER w AS total,
    count(*) OVER w AS n FROM seq {WIN}) WHERE need_prediction"""))
def w15(s, d):
    out = memory.running_aggregate(seq(s, d), {"total": "x0", "n": F.lit(1).cast("bigint")}, spec(s, d))
    return round_all(out.select(KEY, STEP, "total", F.col("n").cast("bigint").alias("n")))


@query("w16_rank_ntile", sql(
    """SELECT seq_ix, step_in_seq, third, rn FROM (SELECT seq_ix, step_in_seq, need_prediction, ntile(3) OVER w AS third,
    row_number() OVER (PARTITION BY seq_ix, need_prediction ORDER BY step_in_seq) AS rn FROM seq """ + WIN + ") WHERE need_prediction"))
def w16(s, d):
    from seqloom.operators.sampling import thirds, with_rank
    rows = with_rank(thirds(seq(s, d), spec(s, d)), F.col("need_prediction"), spec(s, d))
    return rows.select(KEY, STEP, "third", (F.col("_k") + 1).cast("bigint").alias("rn"))


class LeakyModel:
    """Test model: one leaky state per sequence, fed block by block."""

    def reset(self):
        self.state = 0.0

    def predict(self, block):
        out = np.empty(len(block))
        for i, x in enumerate(block["x0"].to_numpy(float)):
            self.state = 0.1 * x + 0.9 * self.state
            out[i] = self.state
        return out


@query("w17_stateful_batch_score", ema_sql({"y": ("x0", 0.1)}, f"SELECT seq_ix, step_in_seq, need_prediction, {r('y')} AS y FROM em JOIN seq USING (seq_ix, step_in_seq) WHERE need_prediction"))
def w17(s, d):
    out = memory.stateful_batch_score(seq(s, d), ["x0"], LeakyModel, ["y"])
    return round_all(out.filter("need_prediction"))


ALTERED = "CASE WHEN step_in_seq >= 50 THEN x0 * -3.0::DOUBLE + 7.0::DOUBLE ELSE x0 END"


@query("w18_causality_check", ema_sql(
    {"a": ("x0", 0.05), "b": ("alt", 0.05)},
    """SELECT 'ema' AS operator, count(*) FILTER (step_in_seq < 50 AND a IS DISTINCT FROM b) AS violations FROM em
    UNION ALL SELECT 'lag', count(*) FILTER (step_in_seq < 50 AND la IS DISTINCT FROM lb) FROM wi
    UNION ALL SELECT 'peak', count(*) FILTER (step_in_seq < 50 AND x0 - pa IS DISTINCT FROM x0 - pb) FROM wi""",
    (f"base AS (SELECT *, {ALTERED} AS alt FROM seq)",
     """wi AS (SELECT *, lag(x0, 10) OVER w AS la, lag(alt, 10) OVER w AS lb, max(x0) OVER (PARTITION BY seq_ix) AS pa, max(alt) OVER (PARTITION BY seq_ix) AS pb
     FROM base WINDOW w AS (PARTITION BY seq_ix ORDER BY step_in_seq))""")))
def w18(s, d):
    """Two causal operators, and one that looks ahead: the distance from the sequence's peak."""
    df, sp = seq(s, d).select(KEY, STEP, "x0"), spec(s, d)
    operators = {"ema": lambda x: memory.ema(x, {"o": ("x0", 0.05)}, sp), "lag": lambda x: ordered.lags(x, {"o": ("x0", 10)}, sp),
                 "peak": lambda x: x.join(x.groupBy(KEY).agg(F.max("x0").alias("_m")), KEY).withColumn("o", F.col("x0") - F.col("_m"))}
    out = None
    for name, fn in operators.items():
        part = memory.causality_violations(df, fn, ["o"], 50, ["x0"]).agg(F.count("*").alias("violations")).select(F.lit(name).alias("operator"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = Q
