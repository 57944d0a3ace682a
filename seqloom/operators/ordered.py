"""Ordered work over long sequences, cut into chunks of steps.

A window partitioned by sequence sends a whole sequence to one task. Steps are consecutive integers
by contract, so `chunk_id = step div size` needs no earlier pass, and (sequence, chunk) is the
partition key of every ordered operator here. What must cross a chunk border is either a bounded
number of earlier rows (`with_halo`) or one carried value per chunk (`running_sum`, `decayed_sum`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import column
from seqloom.layout import KEY, STEP, SequenceSpec

CHUNK = "_chunk"
# exp(600) is still a finite double, with room for the summed values.
MAX_EXPONENT = 600.0


def chunk_id(spec: SequenceSpec, step: str = STEP) -> Column:
    return F.floor(F.col(step) / F.lit(spec.chunk)).cast("bigint")


def with_halo(df: DataFrame, back: int, spec: SequenceSpec) -> DataFrame:
    """Repeat the last `back` rows of each chunk in front of the next one.

    `_own` marks the original rows; windows over (sequence, chunk) may look back `back` rows.
    """
    if back > spec.chunk:
        raise ValueError("the look-back must fit into one chunk")
    here = chunk_id(spec)
    tail = F.pmod(F.col(STEP), F.lit(spec.chunk)) >= spec.chunk - back
    copies = F.when(tail, F.array(here, here + 1)).otherwise(F.array(here))
    spread = df.withColumn(CHUNK, F.explode(copies))
    return spread.withColumn("_own", F.col(CHUNK) == chunk_id(spec))


def chunk_window(key: str = KEY, step: str = STEP):
    return Window.partitionBy(key, CHUNK).orderBy(step)


def look_back(df: DataFrame, columns: dict[str, Column], back: int, spec: SequenceSpec) -> DataFrame:
    """Add columns built from `lag` over `chunk_window()`; all share one exchange and one sort."""
    wide = with_halo(df, back, spec).withColumns(columns)
    return wide.filter("_own").drop(CHUNK, "_own")


def lags(df: DataFrame, values: dict[str, tuple[object, int]], spec: SequenceSpec, fill=None) -> DataFrame:
    """`values[name] = (column, distance)`; rows before the start get `fill` (or NULL)."""
    window = chunk_window()
    out = {}
    for name, (value, distance) in values.items():
        c = F.lag(column(value), distance).over(window) if distance else column(value)
        out[name] = c if fill is None else F.coalesce(c, fill if isinstance(fill, Column) else F.lit(fill))
    return look_back(df, out, max(d for _, d in values.values()), spec)


def _carried(ends: DataFrame, names: Sequence[str], decays: Sequence[float], key: str, spec: SequenceSpec, span: int) -> DataFrame:
    """State at the end of every chunk, from each chunk's own contribution."""
    levels = max(1, math.ceil(span / spec.chunk))
    summed = _prefix(ends, dict(zip(names, zip([F.col(n) for n in names], decays))), key, CHUNK, spec, levels)
    return summed.select(key, (F.col(CHUNK) + 1).alias(CHUNK), *[F.col(f"{n}_state").alias(f"{n}_carry") for n in names])


def _prefix(df: DataFrame, values: dict[str, tuple[Column, float]], key: str, order: str, spec: SequenceSpec, span: int) -> DataFrame:
    """Add `{name}_state`: s[t] = decay * s[t-1] + value[t], for consecutive integers in `order`.

    Inside a chunk the recursion is a running sum of value * decay^-i, scaled back by decay^i. Every
    task therefore holds one chunk; the end state of each chunk is an ordinary aggregate, and the
    states carried between chunks follow the same rule one level up, on a table `chunk` times smaller.
    """
    short = {n: (v, d) for n, (v, d) in values.items() if 0.0 < d < math.exp(-MAX_EXPONENT / 2)}
    if short:
        df = _prefix_short(df, short, key, order, spec)
        values = {n: v for n, v in values.items() if n not in short}
        return _prefix(df, values, key, order, spec, span) if values else df
    names = list(values)
    safe = [MAX_EXPONENT / -math.log(d) for _, d in values.values() if 0.0 < d < 1.0]
    size = max(2, min([spec.chunk, *[int(s) for s in safe]]))
    local = "_l"
    offset = F.pmod(F.col(order), F.lit(size)).cast("double")

    def scaled(v: Column, d: float) -> Column:
        return v if d == 1.0 else v * F.pow(F.lit(d), -offset)

    def unscaled(c: Column, d: float, shift: int = 0) -> Column:
        return c if d == 1.0 else c * F.pow(F.lit(d), offset + float(shift))

    cut = df.withColumn(local, F.floor(F.col(order) / size).cast("bigint"))
    window = Window.partitionBy(key, local).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = {n: unscaled(F.sum(scaled(v, d)).over(window), d) for n, (v, d) in values.items()}
    if span <= size:
        return cut.withColumns({f"{n}_state": c for n, c in running.items()}).drop(local)
    rest = F.lit(float(size - 1)) - offset
    ends = cut.groupBy(key, F.col(local).alias(CHUNK)).agg(
        *[F.sum(v if d == 1.0 else v * F.pow(F.lit(d), rest)).alias(n) for n, (v, d) in values.items()]
    )
    carry = _carried(ends, names, [d**size for _, d in values.values()], key, spec, math.ceil(span * spec.chunk / size))
    carry = carry.withColumnRenamed(CHUNK, local)
    joined = cut.join(carry, [key, local], "left")
    full = {
        f"{n}_state": running[n] + unscaled(F.coalesce(F.col(f"{n}_carry"), F.lit(0)), d, 1)
        for n, (_, d) in values.items()
    }
    return joined.withColumns(full).drop(local, *[f"{n}_carry" for n in names])


def _prefix_short(df: DataFrame, values: dict[str, tuple[Column, float]], key: str, order: str, spec: SequenceSpec) -> DataFrame:
    """The same for decays whose square is below the smallest double: only the previous row still matters."""
    size = spec.chunk
    here = F.floor(F.col(order) / size).cast("bigint")
    tail = F.pmod(F.col(order), F.lit(size)) == size - 1
    spread = df.withColumn("_l", F.explode(F.when(tail, F.array(here, here + 1)).otherwise(F.array(here))))
    window = Window.partitionBy(key, "_l").orderBy(order)
    out = {f"{n}_state": v + F.coalesce(F.lag(v, 1).over(window), F.lit(0.0)) * d for n, (v, d) in values.items()}
    return spread.withColumns(out).filter(F.col("_l") == here).drop("_l")


def inside(value: Column, spec: SequenceSpec) -> Column:
    """The value, or an error on a row past `spec.length`: carried states are planned for that many steps only."""
    note = F.lit(f"a step lies at or past the declared length {spec.length}; raise SequenceSpec.length")
    return F.when(F.col(STEP) >= spec.length, F.raise_error(note).cast("double")).otherwise(value)


def decayed_sum(df: DataFrame, values: dict[str, tuple[object, float]], spec: SequenceSpec) -> DataFrame:
    """Add one column per entry `(value, decay)`: s[t] = decay * s[t-1] + value[t], s[-1] = 0."""
    plain = {n: (inside(column(v), spec), d) for n, (v, d) in values.items() if d != 0.0}
    out = _prefix(df, plain, KEY, STEP, spec, spec.length) if plain else df
    for n in plain:
        out = out.withColumnRenamed(f"{n}_state", n)
    return out.withColumns({n: column(v) for n, (v, d) in values.items() if d == 0.0})


def running_sum(df: DataFrame, values: dict[str, object], spec: SequenceSpec) -> DataFrame:
    """Sum of all rows up to the current one, per sequence."""
    return decayed_sum(df, {n: (v, 1.0) for n, v in values.items()}, spec)


def previous_marked(df: DataFrame, mark: Column, values: dict[str, Column], spec: SequenceSpec) -> DataFrame:
    """Keep marked rows and add each value as of the previous marked row of the sequence.

    The previous marked row may lie many chunks back, so every chunk offers its last marked row and
    the first marked row of a chunk takes the latest such offer.
    """
    kept = df.filter(mark).withColumn(CHUNK, chunk_id(spec))
    window = Window.partitionBy(KEY, CHUNK).orderBy(STEP)
    pack = F.struct(*[v.alias(n) for n, v in values.items()])
    lasts = kept.groupBy(KEY, CHUNK).agg(F.max_by(pack, F.col(STEP)).alias("_last"))
    # One row per chunk.
    offers = lasts.select(KEY, CHUNK, F.lag("_last").over(Window.partitionBy(KEY).orderBy(CHUNK)).alias("_offer"))
    joined = kept.join(offers, [KEY, CHUNK], "left")
    joined = joined.withColumn("_prev", F.coalesce(F.lag(pack).over(window), F.col("_offer")))
    return joined.select("*", *[F.col(f"_prev.{n}").alias(f"prev_{n}") for n in values]).drop(CHUNK, "_offer", "_prev")


def per_sequence(df: DataFrame, small: DataFrame, how: str = "inner", salts: int = 64, spec: SequenceSpec | None = None) -> DataFrame:
    """Join one row per sequence onto its rows; a hot sequence is spread over `salts` partitions.

    If Spark finds the small side below its broadcast limit at run time, no row moves at all.
    """
    spec = spec or SequenceSpec()
    left = df.withColumn("_salt", F.pmod(chunk_id(spec), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [KEY, "_salt"], how).drop("_salt")
