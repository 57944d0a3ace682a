"""Streaming queries (X1-X6): a stream over the stored tables, its result compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.layout import KEY, STEP
from seqloom.operators import memory
from seqloom.session import shared_dir
from seqloom.streaming import metric, replay
from seqloom.suite.fixture import BOTH, LONG_SQL, r, round_all, seq, six_sql, spec, sql, table, wp_sql
from seqloom.suite.sequences import ema_sql

Q: dict = {}
SCORED = "need_prediction AND is_scored"


def query(name, text=None):
    def add(fn):
        Q[name] = (fn, text)
        return fn
    return add


def place(s):
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def as_stream(s, df, per_batch=2):
    """The stored files of a table as a stream, a few files per batch."""
    path = place(s)
    df.write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


class Leaky(replay.StepModel):
    """State s = 0.1 x + 0.9 s."""

    outputs = ("y",)

    def start(self):
        import numpy as np
        return np.zeros(1)

    def step(self, state, step, row):
        state = 0.1 * row[:1] + 0.9 * state
        return state, (float(state[0]),)

    def block(self, state, first, rows):
        import numpy as np
        at, out = float(state[0]), []
        for x in rows[:, 0].tolist():
            at = 0.1 * x + 0.9 * at
            out.append(at)
        return np.array([at]), np.array(out)[:, None]


def replayed(s, df, visible, model):
    out, check = place(s), place(s)
    # Rows land in arbitrary files, so steps arrive out of order across and inside batches.
    shuffled = df.repartition(4, F.xxhash64(KEY, STEP))
    replay.run_available(replay.stream_replay(as_stream(s, shuffled), visible, model), out, check)
    return s.read.parquet(out)


@query("x01_stream_replay", ema_sql({"y": ("x0", 0.1)}, f"SELECT seq_ix, step_in_seq, 'ok' AS status, {r('y')} AS y FROM em JOIN seq USING (seq_ix, step_in_seq) WHERE need_prediction"))
def x01(s, d):
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0")
    return round_all(replayed(s, df, ["x0"], Leaky))


@query("x01_continued_replay", ema_sql({"y": ("x0", 0.1)}, f"SELECT seq_ix, step_in_seq, 'ok' AS status, {r('y')} AS y FROM em JOIN seq USING (seq_ix, step_in_seq) WHERE need_prediction AND step_in_seq >= 50"))
def x01b(s, d):
    """A stream that begins at step 50, from states that a batch run left."""
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0")
    batch = memory.ema(df, {"y": ("x0", 0.1)}, spec(s, d)).filter(F.col(STEP) == 49)
    start = batch.select(KEY, F.lit(50).cast("bigint").alias("expected"), F.array("y").alias("state"))
    late = as_stream(s, df.filter(F.col(STEP) >= 50).repartition(4, F.xxhash64(KEY, STEP)))
    out = place(s)
    replay.run_available(replay.stream_replay(late, ["x0"], Leaky, start=start), out, place(s))
    return round_all(s.read.parquet(out))


@query("x06_timed_gap", ema_sql(
    {"y": ("x0", 0.1)}, f"""SELECT seq_ix, own AS step_in_seq, 'ok' AS status, {r('y')} AS y FROM em JOIN base USING (seq_ix, step_in_seq) WHERE need_prediction
    UNION ALL SELECT DISTINCT seq_ix, 40, 'gap', NULL::DOUBLE FROM base WHERE own > 40""",
    ("base AS (SELECT seq_ix, step_in_seq AS own, row_number() OVER (PARTITION BY seq_ix ORDER BY step_in_seq) - 1 AS step_in_seq, need_prediction, x0 FROM seq WHERE step_in_seq <> 40)",)))
def x06b(s, d):
    """Step 40 never comes: when its followers have waited for a millisecond, the next batch gives it up."""
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0").filter(F.col(STEP) != 40)
    path, out, check = place(s), place(s), place(s)
    # A row of another sequence makes the second batch.
    other = df.limit(1).select(F.lit(-7).cast("bigint").alias(KEY), F.lit(0).cast(df.schema[STEP].dataType).alias(STEP), F.lit(False).alias("need_prediction"), F.lit(0.0).alias("x0"))
    for rows in (df, other):
        rows.write.mode("append").parquet(path)
        stream = s.readStream.schema(df.schema).parquet(path)
        replay.run_once(replay.stream_replay(stream, ["x0"], Leaky, patience_ms=1), out, check)
    return round_all(s.read.parquet(out))


COEF = [0.05, 0.1, 0.02, 0.3, -0.2]


def correction():
    return replay.MemoryCorrection([0.5], [0.4], COEF, strength=0.5, from_step=20)


@query("x02_stream_correction", ema_sql(
    {"f": ("greatest(-8.0::DOUBLE, least(8.0::DOUBLE, (x0 - 0.5::DOUBLE) / 0.4::DOUBLE))", 0.01), "g": ("greatest(-8.0::DOUBLE, least(8.0::DOUBLE, (x0 - 0.5::DOUBLE) / 0.4::DOUBLE))", 0.001)},
    f"""SELECT seq_ix, step_in_seq, {r('p0 + CASE WHEN step_in_seq >= 20 THEN 0.5 * (0.05 + 0.1 * greatest(-2.0, least(2.0, p0)) + 0.02 * greatest(-8.0, least(8.0, (x0 - 0.5) / 0.4)) + 0.3 * f - 0.2 * g) ELSE 0 END')} AS corrected
    FROM em JOIN seq USING (seq_ix, step_in_seq) WHERE need_prediction"""))
def x02(s, d):
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0", "p0")
    return round_all(replayed(s, df, ["x0", "p0"], correction).select(KEY, STEP, "corrected"))


@query("x03_stream_metric", sql(f"SELECT system, target, n, {r(wp_sql())} AS wp FROM m", LONG_SQL, f"m AS (SELECT system, target, count(*) AS n, {six_sql('y', 'p')} FROM long WHERE {SCORED} GROUP BY ALL)"))
def x03(s, d):
    path = place(s)
    metric.stream_metric(as_stream(s, seq(s, d).repartition(6)), path, place(s), BOTH)
    return round_all(metric.read_metric(s, path).select("system", "target", "n", "wp"))


@query("x04_stream_ledger", """SELECT o_custkey % 40 AS branch, arg_max(o_orderpriority, o_orderkey) AS status, max(o_orderkey) AS last_event, max(o_totalprice) AS best, count(*) AS events FROM orders GROUP BY 1""")
def x04(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") % 40).alias("branch"), "o_orderkey", "o_orderpriority", "o_totalprice")
    agg = metric.stream_ledger(as_stream(s, o.repartition(4)), "branch", "o_orderkey", "o_orderpriority", "o_totalprice")
    path = place(s)
    # Every batch replaces the stored ledger; no driver holds it.
    q = agg.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode("complete").option(
        "checkpointLocation", place(s)).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(path)


@query("x05_parity_check", sql("SELECT count(*) AS stream_rows, count(*) AS batch_rows, 0::BIGINT AS unmatched, 0.0::DOUBLE AS gap_y FROM seq WHERE need_prediction"))
def x05(s, d):
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0")
    batch = memory.ema(df, {"y": ("x0", 0.1)}, spec(s, d)).filter("need_prediction")
    return round_all(replay.parity(replayed(s, df, ["x0"], Leaky), batch, ["y"]), digits=9)


@query("x05_parity_gap", ema_sql(
    {"a": ("x0", 0.1), "b": ("x0", 0.11)},
    f"""SELECT count(*) AS stream_rows, count(*) FILTER (step_in_seq % 13 <> 5) AS batch_rows, count(*) FILTER (step_in_seq % 13 = 5) AS unmatched,
    {r('max(abs(a - b)) FILTER (step_in_seq % 13 <> 5)')} AS gap_y FROM em JOIN seq USING (seq_ix, step_in_seq) WHERE need_prediction"""))
def x05b(s, d):
    """A batch side of another decay and with rows left out: both faults are found and measured."""
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0")
    batch = memory.ema(df, {"y": ("x0", 0.11)}, spec(s, d)).filter("need_prediction").filter(F.col(STEP) % 13 != 5)
    return round_all(replay.parity(replayed(s, df, ["x0"], Leaky), batch, ["y"]))


@query("x06_late_rows", sql("SELECT seq_ix, step_in_seq FROM seq WHERE step_in_seq % 17 = 3"))
def x06(s, d):
    df = seq(s, d).select(KEY, STEP, "need_prediction", "x0")
    again = df.filter(F.col(STEP) % 17 == 3)
    path, out, check = place(s), place(s), place(s)
    df.write.parquet(path)
    stream = s.readStream.schema(df.schema).parquet(path)
    replay.run_available(replay.stream_replay(stream, ["x0"], Leaky), out, check)
    again.write.mode("append").parquet(path)  # steps that were already processed
    replay.run_available(replay.stream_replay(s.readStream.schema(df.schema).parquet(path), ["x0"], Leaky), out, check)
    return s.read.parquet(out).filter("status = 'late'").select(KEY, STEP)


QUERIES = Q
