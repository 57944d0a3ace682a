"""Reproducible sampling, splits and set checks over sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.hashing import coin, digest, digest_int
from seqloom.layout import KEY, NEED, STEP, SequenceSpec
from seqloom.operators.ordered import per_sequence, running_sum
from seqloom.session import settle


def with_rank(df: DataFrame, mark: Column, spec: SequenceSpec, out: str = "_k") -> DataFrame:
    """Position (from 0) of each marked row among the marked rows of its sequence; others dropped."""
    ranked = running_sum(df.withColumn("_mark", mark.cast("int")), {out: F.col("_mark")}, spec)
    return ranked.filter(F.col("_mark") == 1).withColumn(out, F.col(out) - 1).drop("_mark")


def required_rank(df: DataFrame, spec: SequenceSpec, out: str = "_k") -> DataFrame:
    """Required rows with their position: by contract they are the steps from the warm-up on, so this is a projection."""
    return df.filter(F.col(NEED)).withColumn(out, F.col(STEP) - spec.warmup)


def stride_sample(df: DataFrame, k: int, spec: SequenceSpec, phase: int = 0, mark: Column | None = None) -> DataFrame:
    """Every k-th required row of each sequence, from row `phase`; any other mark is ranked first."""
    ranked = required_rank(df, spec) if mark is None else with_rank(df, mark, spec)
    return ranked.filter(F.pmod(F.col("_k") - phase, F.lit(k)) == 0).drop("_k")


def random_phase_stride(df: DataFrame, k: int, seed: int, spec: SequenceSpec) -> DataFrame:
    """Every k-th required row, with a phase drawn per sequence."""
    phase = F.pmod(digest_int(seed, F.col(KEY)), F.lit(k))
    return required_rank(df, spec).filter(F.pmod(F.col("_k") - phase, F.lit(k)) == 0).drop("_k")


def _hash_rank(df: DataFrame, n: int, seed: int, block: int = 65_536) -> DataFrame:
    """Rows with the n lowest digests of each sequence, ranked from 1.

    Each block of steps keeps its own n lowest first, so a task sorts at most `block` rows of a sequence,
    and the final ranking only sees n rows per block. Spark applies both limits before the exchanges too.
    """
    h = digest(seed, F.col(KEY), F.col(STEP))
    rows = df.withColumn("_h", h).withColumn("_block", F.floor(F.col(STEP) / block))
    first = F.row_number().over(Window.partitionBy(KEY, "_block").orderBy("_h", STEP))
    rows = rows.withColumn("_r", first).filter(F.col("_r") <= n)
    second = F.row_number().over(Window.partitionBy(KEY).orderBy("_h", STEP))
    return rows.withColumn("_r", second).filter(F.col("_r") <= n).drop("_h", "_block")


def sample_n_per_sequence(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly n required rows per sequence (all rows of a shorter one)."""
    return _hash_rank(df.filter(F.col(NEED)), n, seed).drop("_r")


def nested_budget_sample(df: DataFrame, seed: int, narrow_rows: int, broad_rows: int, narrow_share: int, broad_share: int) -> DataFrame:
    """Two arms with one row budget: few groups with many rows, or many groups with few rows.

    Groups are ranked by digest in 100 shares; the narrow arm uses the first `narrow_share`, the broad
    arm the first `broad_share`. Inside a group, the broad rows are the first rows of the narrow arm.
    """
    share = F.pmod(digest_int(seed, F.col(KEY)), F.lit(100))
    rows = _hash_rank(df.filter(F.col(NEED) & (share < max(narrow_share, broad_share))), max(narrow_rows, broad_rows), seed)
    arms = F.array_compact(F.array(
        F.when((share < narrow_share) & (F.col("_r") <= narrow_rows), F.lit("narrow")),
        F.when((share < broad_share) & (F.col("_r") <= broad_rows), F.lit("broad")),
    ))
    return rows.withColumn("arm", F.explode(arms)).drop("_r")


def bernoulli_mask(df: DataFrame, probability, seed: int, out: str = "mask") -> DataFrame:
    """Label-free coin per row: required and u(seed, sequence, step) < probability."""
    p = probability if isinstance(probability, Column) else F.lit(float(probability))
    return df.withColumn(out, F.col(NEED) & (coin(seed, F.col(KEY), F.col(STEP)) < p))


def random_mask_same_rate(df: DataFrame, probability: Column, seed: int, spec: SequenceSpec, out: str = "mask") -> DataFrame:
    """Coin with the mean probability of the required rows of the sequence."""
    rates = df.filter(F.col(NEED)).groupBy(KEY).agg(F.avg(probability).alias("_rate"))
    joined = per_sequence(df, rates, "left", spec=spec)
    return bernoulli_mask(joined, F.coalesce(F.col("_rate"), F.lit(0.0)), seed, out).drop("_rate")


def order_sequences(ids: DataFrame, seed: int, out: str = "place") -> DataFrame:
    """Seeded shuffle of distinct ids: place from 1 in digest order, numbered per digest prefix."""
    keyed = ids.select(KEY).distinct().withColumn("_h", digest(seed, F.col(KEY)))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, 3))
    sizes = keyed.groupBy("_b").agg(F.count("*").alias("_n"))  # at most 4,096 rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy("_h", KEY))
    return keyed.withColumn("_rn", local).join(F.broadcast(sizes), "_b").select(KEY, (F.col("_o") + F.col("_rn")).alias(out))


def split_sequences(ids: DataFrame, seed: int, roles: dict[str, tuple[int, int]]) -> DataFrame:
    """Roles by place range (from, to], nested ranges allowed: `(seq, place, roles)`."""
    placed = order_sequences(ids, seed)
    names = F.array_compact(F.array(*[
        F.when((F.col("place") > a) & (F.col("place") <= b), F.lit(n)) for n, (a, b) in roles.items()
    ]))
    return placed.withColumn("roles", names)


def reserve_roles(ids: DataFrame, excluded: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """Disjoint roles from ids not used before; an error if there are too few."""
    fresh = ids.select(KEY).distinct().join(excluded.select(KEY).distinct(), KEY, "left_anti")
    total = sum(sizes.values())
    if fresh.limit(total).count() < total:
        raise ValueError(f"fewer than {total} unused sequences")
    role, start = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        role = F.when((F.col("place") > start) & (F.col("place") <= start + size), F.lit(name)).otherwise(role)
        start += size
    return order_sequences(fresh, seed).withColumn("role", role).filter(F.col("role").isNotNull()).select(KEY, "role")


def leakage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequences present on both sides."""
    return a.select(KEY).intersect(b.select(KEY))


def sequence_places(ids: DataFrame) -> DataFrame:
    """Distinct ids with their index in id order.

    Range partitioning puts neighbouring ids together however sparse they are; rows are numbered inside their partition
    and moved by the number of ids in the partitions before it. The placed rows are stored, so that both steps see the
    same partitions; one count per partition is all that meets.
    """
    placed = settle(ids.select(KEY).distinct().repartitionByRange(F.col(KEY)).withColumn("_b", F.spark_partition_id()))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(KEY))
    return placed.withColumn("_rn", local).join(F.broadcast(sizes), "_b").select(KEY, (F.col("_o") + F.col("_rn") - 1).alias("place"))


def every_kth_holdout(ids: DataFrame, k: int = 5) -> DataFrame:
    """Role per sequence: every k-th one in id order is held out."""
    role = F.when(F.pmod(F.col("place"), F.lit(k)) == 0, F.lit("selection")).otherwise(F.lit("fit"))
    return sequence_places(ids).select(KEY, role.alias("role"))


def crossfit_folds(ids: DataFrame, k: int = 4) -> DataFrame:
    """Fold per sequence: index in id order modulo k."""
    return sequence_places(ids).select(KEY, F.pmod(F.col("place"), F.lit(k)).alias("fold"))


def row_budget(df: DataFrame, arm: str = "arm") -> DataFrame:
    """Rows and groups of each arm, and whether all arms have the same number of rows."""
    per = df.groupBy(arm, KEY).agg(F.count("*").alias("_n"))
    arms = per.groupBy(arm).agg(F.sum("_n").alias("rows"), F.count("*").alias("groups"))
    everywhere = Window.partitionBy()  # one row per arm
    return arms.withColumn("equal_rows", F.min("rows").over(everywhere) == F.max("rows").over(everywhere))


def combine_ids(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Union, difference or intersection of two id lists, without duplicates."""
    a, b = a.select(KEY), b.select(KEY)
    if how == "union":
        return a.union(b).distinct()
    if how == "difference":
        return a.subtract(b)
    if how == "intersection":
        return a.intersect(b)
    raise ValueError(f"unknown set operation: {how}")


def thirds(df: DataFrame, spec: SequenceSpec, out: str = "third") -> DataFrame:
    """Equal thirds of each sequence by row index; the first ones take the remainder, as in ntile."""
    sizes = df.groupBy(KEY).agg((F.max(STEP) + 1).alias("_n"))
    joined = per_sequence(df, sizes, spec=spec)
    base, rest = F.floor(F.col("_n") / 3), F.pmod(F.col("_n"), F.lit(3))
    head = rest * (base + 1)
    late = rest + F.floor((F.col(STEP) - head) / F.greatest(base, F.lit(1)))
    third = F.when(F.col(STEP) < head, F.floor(F.col(STEP) / (base + 1))).otherwise(late)
    return joined.withColumn(out, (third + 1).cast("bigint")).drop("_n")


def role_frames(df: DataFrame, roles: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """Rows of each named role."""
    tagged = per_sequence(df, roles)
    return {n: tagged.filter(F.col("role") == n) for n in names}
