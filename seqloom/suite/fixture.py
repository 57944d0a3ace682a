"""Stand-in sequence data built from the driver's `events` table, with the same relation in SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalar import rounded
from seqloom.layout import KEY, NEED, SCORED, STEP, SequenceSpec
from seqloom.operators import resampling
from seqloom.operators.ordered import lags
from seqloom.session import shared_dir
from seqloom.sources.ingest import number_rows

# Chunks small enough that the test sequences span several of them.
SPEC = SequenceSpec(length=100_000_000, warmup=9, position_edges=(70, 140), chunk=128)
XS = ("x0", "x1", "x2", "x3")
BASE = {"base": ("p0", "p1")}
BOTH = {"base": ("p0", "p1"), "candidate": ("q0", "q1")}
_tables: dict[tuple[str, str], tuple[str, SequenceSpec]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence table from raw events: number the rows, derive columns, one look-back for p0."""
    events = table(spark, sf_dir, "events")
    raw = events.select(F.pmod(F.col("user_id"), F.lit(50)).alias(KEY), "ts", "event_id", "event_type", "value")
    rows = number_rows(raw, [KEY], ["ts", "event_id"], STEP)
    eid, value = F.col("event_id"), F.col("value")
    rows = rows.select(
        KEY, STEP,
        (F.col(STEP) >= SPEC.warmup).alias(NEED),
        ((F.col(STEP) >= SPEC.warmup) & (F.col("event_type") != "error")).alias(SCORED),
        (value / 25.0).alias("x0"), (eid % 7).cast("double").alias("x1"),
        (F.hour("ts") / 12.0).alias("x2"), (F.dayofmonth("ts") / 15.0).alias("x3"),
        ((value - 50.0) / 25.0).alias("t0"),
        ((value - 40.0) / 40.0 + ((eid % 11) - 5) / 5.0).alias("t1"),
    )
    rows = lags(rows, {"_t0": ("t0", 1)}, SPEC, 0.0)
    rows = rows.withColumns({"p0": F.col("t0") * 0.5 + F.col("_t0") * 0.5, "p1": F.col("t1") * 0.7 + F.col("x2") * 0.3})
    rows = rows.withColumns({"q0": F.col("p0") * 0.9 + F.col("x2") * 0.1, "q1": F.col("p1") * 0.9 + F.col("x3") * 0.05})
    return rows.drop("_t0")


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence table, written once per session and read back with pruning and pushdown."""
    token = (spark.sparkContext.applicationId, sf_dir)
    if token not in _tables:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        path = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
        build(spark, sf_dir).sortWithinPartitions(KEY, STEP).write.parquet(path)
        longest = spark.read.parquet(path).agg(F.max(STEP)).first()[0] + 1
        _tables[token] = (path, replace(SPEC, length=longest))
    return spark.read.parquet(_tables[token][0])


def spec(spark: SparkSession, sf_dir: str) -> SequenceSpec:
    """Contract of the built table, with its longest sequence."""
    seq(spark, sf_dir)
    return _tables[(spark.sparkContext.applicationId, sf_dir)][1]


SEQ_SQL = """
ev AS (SELECT *, user_id % 50 AS seq_ix,
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1 AS step_in_seq FROM events),
s0 AS (SELECT seq_ix, step_in_seq, step_in_seq >= 9 AS need_prediction,
  step_in_seq >= 9 AND event_type <> 'error' AS is_scored,
  value / 25.0::DOUBLE AS x0, (event_id % 7)::DOUBLE AS x1, hour(ts)::DOUBLE / 12.0::DOUBLE AS x2,
  day(ts)::DOUBLE / 15.0::DOUBLE AS x3, (value - 50.0::DOUBLE) / 25.0::DOUBLE AS t0,
  (value - 40.0::DOUBLE) / 40.0::DOUBLE + ((event_id % 11) - 5)::DOUBLE / 5.0::DOUBLE AS t1 FROM ev),
s1 AS (SELECT *, t0 * 0.5::DOUBLE + coalesce(lag(t0) OVER (PARTITION BY seq_ix ORDER BY step_in_seq), 0.0::DOUBLE) * 0.5::DOUBLE AS p0,
  t1 * 0.7::DOUBLE + x2 * 0.3::DOUBLE AS p1 FROM s0),
seq AS (SELECT *, p0 * 0.9::DOUBLE + x2 * 0.1::DOUBLE AS q0, p1 * 0.9::DOUBLE + x3 * 0.05::DOUBLE AS q1 FROM s1)
"""


def sql(body: str, *ctes: str) -> str:
    """Query over `seq` with further common table expressions; `tree` is a recursive one."""
    text = ",\n".join([SEQ_SQL, *ctes])
    return ("WITH RECURSIVE " if "tree AS (" in text else "WITH ") + text + "\n" + body


def _mix_sql(x: str) -> str:
    """The 64-bit mixer in wide integers."""
    wrap = "18446744073709551616::UHUGEINT"
    for shift, step in ((None, None), (30, resampling.MIX_ONE), (27, resampling.MIX_TWO)):
        if shift is None:
            x = f"(((({x})::UHUGEINT + {resampling.MIX_ADD}::UHUGEINT) % {wrap})::UBIGINT)"
        else:
            x = f"(((xor({x}, {x} >> {shift}))::UHUGEINT * {step}::UHUGEINT % {wrap})::UBIGINT)"
    return f"xor({x}, {x} >> 31)"


def counts_sql(seed: int, draws: int) -> str:
    """`cnt(draw, seq_ix, times)` of the sequences `ids(seq_ix, idx, n)`: picks split down the halves by the same digits as the operator."""
    first = int(resampling.mix(np.uint64(seed))[0])
    ends = ", ".join(f"(n * (2 * (node - (1 << level)) + {k})) >> (level + 1) AS {name}" for k, name in enumerate(("lo", "mid", "hi")))
    return f"""dr AS (SELECT draw, {_mix_sql(f"xor({first}::UBIGINT, draw::UBIGINT)")} AS h FROM (SELECT unnest(range({draws})) AS draw)),
nn AS (SELECT count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE ceil(log2(count(*)))::INT END AS deep FROM ids),
shapes AS (SELECT DISTINCT (s + k) // 2 AS l, s FROM nn, unnest(range(1, n + 1)) AS a(s), unnest([0, 1]) AS b(k)),
cd AS (SELECT l, s, m, list(c ORDER BY j) AS cs FROM (SELECT l, s, m, j, sum(CASE WHEN l = 0 THEN (j = 0)::INT::DOUBLE WHEN l = s THEN 0.0::DOUBLE ELSE
  exp(lgamma(m + 1.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - lgamma(m - j + 1.0::DOUBLE) + j * ln(CASE WHEN l = 0 THEN 1 ELSE l END::DOUBLE / s) + (m - j) * ln(CASE WHEN l = s THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - l::DOUBLE / s END)) END)
  OVER (PARTITION BY l, s, m ORDER BY j) AS c FROM shapes, nn, unnest(range(1, n + 1)) AS a(m), unnest(range(0, m)) AS b(j)) GROUP BY l, s, m),
tree AS (SELECT draw, h, 1::BIGINT AS node, 0 AS level, n AS m FROM dr, nn
  UNION ALL SELECT draw, h, 2 * node + side, level + 1, CASE side WHEN 0 THEN k ELSE m - k END FROM (SELECT t.*, coalesce(len(list_filter(cs, lambda c: c <= t.u)), 0) AS k FROM
    (SELECT draw, h, node, level, m, {ends}, ({_mix_sql("xor(h, (node << 24)::UBIGINT)")} >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM tree, nn WHERE level < deep) t
    LEFT JOIN cd ON cd.l = t.mid - t.lo AND cd.s = t.hi - t.lo AND cd.m = t.m), (SELECT unnest([0, 1]) AS side)),
cnt AS (SELECT draw, seq_ix, m AS times FROM (SELECT draw, m, (nn.n * (node - (1 << level))) >> level AS lo FROM tree, nn WHERE level = deep AND m > 0) q JOIN ids ON ids.idx = q.lo)"""


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of `rounded`."""
    unit = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {unit} + 0.500123457::DOUBLE) / {unit})"


def sclip(expr: str, lo: str = "-2.0", hi: str = "2.0") -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {expr}))"


def six_sql(y: str, p: str, prefix: str = "", focus: str = "1.0::DOUBLE", clip_prediction: bool = True) -> str:
    """Six summed columns of the score."""
    y = sclip(y)
    p = sclip(p) if clip_prediction else p
    w = f"(abs({y}) * ({focus}))"
    return (f"sum({w}) AS {prefix}w, sum({w}*{y}) AS {prefix}wy, sum({w}*{p}) AS {prefix}wp, "
            f"sum({w}*{y}*{y}) AS {prefix}wyy, sum({w}*{p}*{p}) AS {prefix}wpp, sum({w}*{y}*{p}) AS {prefix}wyp")


def wp_sql(pre: str = "") -> str:
    w, wy, wp, wyy, wpp, wyp = [f"{pre}{m}" for m in ("w", "wy", "wp", "wyy", "wpp", "wyp")]
    vy, vp = f"greatest({wyy}-{wy}*{wy}/{w},0.0)", f"greatest({wpp}-{wp}*{wp}/{w},0.0)"
    return (f"(CASE WHEN {w} >= 1e-8 AND {vy}/{w} > 1e-16 AND {vp}/{w} > 1e-16 "
            f"THEN greatest(-1.0, least(1.0, ({wyp}-{wy}*{wp}/{w})/sqrt({vy}*{vp}))) ELSE 0.0 END)")


# Long form of `seq`: one row per (row, system, target).
LONG_SQL = """
long AS (SELECT seq_ix, step_in_seq, need_prediction, is_scored, x0, x1, x2, x3, 'base' AS system, 't0' AS target, t0 AS y, p0 AS p FROM seq
UNION ALL SELECT seq_ix, step_in_seq, need_prediction, is_scored, x0, x1, x2, x3, 'base', 't1', t1, p1 FROM seq
UNION ALL SELECT seq_ix, step_in_seq, need_prediction, is_scored, x0, x1, x2, x3, 'candidate', 't0', t0, q0 FROM seq
UNION ALL SELECT seq_ix, step_in_seq, need_prediction, is_scored, x0, x1, x2, x3, 'candidate', 't1', t1, q1 FROM seq)
"""


def round_all(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Round every double column not named in `keep`."""
    return df.select(*[
        rounded(F.col(f"`{f.name}`"), digits).alias(f.name)
        if f.dataType.typeName() == "double" and f.name not in keep else F.col(f"`{f.name}`")
        for f in df.schema
    ])
