"""Ranking, ledger queries and decision rules over experiment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.resampling import paired_bootstrap
from seqloom.operators.scoring import SUMS, with_wp


def sort_ranked(df: DataFrame, score: str, key: str) -> DataFrame:
    """Best score first, ties by key."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc())


def top_k_with_group_cap(df: DataFrame, score: str, key: str, group: str, k: int, cap: int, ascending: bool = False) -> DataFrame:
    """Best k rows with at most `cap` rows of a group, ranked from 1.

    Both limits are applied before the exchange as well: a group offers `cap` rows per task, the final
    limit `k` rows per task.
    """
    order = [F.col(score).asc() if ascending else F.col(score).desc(), F.col(key).asc()]
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    best = df.withColumn("_g", inside).filter(F.col("_g") <= cap).drop("_g").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def best_so_far(df: DataFrame, key: str, order: str, value: str, out: str = "best", block: int = 65_536, maximize: bool = True) -> DataFrame:
    """Running best per key. `order` is an integer; blocks of it are numbered on their own and the best of
    earlier blocks is carried in, so a long ledger does not pass through one task."""
    pick = F.max if maximize else F.min
    join2 = F.greatest if maximize else F.least
    cut = df.withColumn("_b", F.floor(F.col(order) / block).cast("bigint"))
    local = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tops = cut.groupBy(key, "_b").agg(pick(value).alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    carry = tops.select(key, "_b", pick("_top").over(earlier).alias("_carry"))
    joined = cut.join(carry, [key, "_b"])
    return joined.withColumn(out, join2(pick(value).over(local), F.col("_carry"))).drop("_b", "_carry")


def deltas_vs_reference(df: DataFrame, run: str, parent: str, metric: str, root: DataFrame | None = None) -> DataFrame:
    """Metric minus that of the parent run, and minus that of a one-row root table."""
    parents = df.select(F.col(run).alias(parent), F.col(metric).alias("_p"))
    out = df.join(parents, parent, "left").withColumn("delta_parent", F.col(metric) - F.col("_p")).drop("_p")
    if root is not None:
        # One row by aggregation; several root rows have no single difference.
        one = root.agg(F.when(F.count("*") > 1, F.raise_error(F.lit("the root table has several rows")).cast("double")).otherwise(F.first(metric)).alias("_r"))
        out = out.crossJoin(F.broadcast(one)).withColumn("delta_root", F.col(metric) - F.col("_r")).drop("_r")
    return out


def run_signature(columns: Sequence[str]) -> Column:
    """Digest of the settings that define a run; prose and paths are not listed, so they do not count."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]), 256)


def duplicate_runs(df: DataFrame, run: str, columns: Sequence[str]) -> DataFrame:
    """Signatures used more than once, with the number of runs and the first one."""
    return df.groupBy(run_signature(columns).alias("signature")).agg(F.count("*").alias("runs"), F.min(run).alias("first_run")).filter("runs > 1")


def latest_status(events: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Kind of the last event per id."""
    return events.groupBy(key).agg(F.max_by(kind, order).alias("status"), F.max(order).alias("last_event"), F.count("*").alias("events"))


def best_finished(latest: DataFrame, results: DataFrame, key: str, metric: str, finished: str) -> DataFrame:
    """Best finished candidate by metric, ties by id."""
    done = latest.filter(F.col("status") == finished).join(results, key)
    return done.orderBy(F.col(metric).desc(), F.col(key)).limit(1)


# The qualification rule.
MIN_DELTA, MIN_TARGET_DELTA = 0.0002, -0.0002


def qualify(df: DataFrame, delta: str, lower: str, target_deltas: Sequence[str], cost: str, cost_limit: float) -> DataFrame:
    """`qualified` and the list of failed conditions."""
    rules = {"delta": F.col(delta) >= MIN_DELTA, "interval": F.col(lower) > 0, "cost": F.col(cost) <= cost_limit}
    rules |= {f"target_{t}": F.col(t) >= MIN_TARGET_DELTA for t in target_deltas}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.withColumn("reasons", F.sort_array(failed)).withColumn("qualified", F.size("reasons") == 0)


def eligible_history(df: DataFrame, status: str, metric: str, threshold: float, success: str = "success") -> DataFrame:
    return df.filter((F.col(status) == success) & (F.col(metric) >= threshold))


def replication_gate(checks: DataFrame, by: Sequence[str], value: str, minimum: float = 0.0) -> DataFrame:
    """An effect passes if every population, half and replica shows it."""
    return checks.groupBy(*by).agg(F.bool_and(F.col(value) > minimum).alias("passed"), F.min(value).alias("worst"), F.count("*").alias("checks"))


def prospective_selection(selection: DataFrame, audit: DataFrame, base: str, draws: int, seed: int, level: float = 0.99) -> DataFrame:
    """Pick the best system per population on one block of sequences, then judge all of them on the other.

    Both inputs are per-sequence moments `(seq, population, system, target, sums)`. Draws are shared
    by all systems and populations of the audit.
    """
    pooled = with_wp(selection.groupBy("population", "system", "target").agg(*[F.sum(c).alias(c) for c in SUMS]))
    mean = pooled.groupBy("population", "system").agg(F.avg("wp").alias("selection_wp"))
    chosen = mean.groupBy("population").agg(F.min_by("system", F.struct(-F.col("selection_wp"), F.col("system"))).alias("_chosen"))
    names = [(r["population"], r["system"]) for r in mean.select("population", "system").collect()]  # systems x populations
    labelled = audit.withColumn("system", F.concat_ws("|", "population", "system")).drop("population")
    contrasts = {f"{p}|{s}": {f"{p}|{s}": 1.0, f"{p}|{base}": -1.0} for p, s in names if s != base}
    outcome = paired_bootstrap(labelled, contrasts, draws, seed, level).filter("target = 'combined'")
    parts = F.split("contrast", r"\|")
    outcome = outcome.select(parts[0].alias("population"), parts[1].alias("system"), F.col("point").alias("audit_delta"), "lower", "upper")
    joined = mean.join(chosen, "population").join(outcome, ["population", "system"], "left")
    return joined.withColumn("selected", F.col("system") == F.col("_chosen")).drop("_chosen")


def compare_models(parts: Sequence[DataFrame], draws: int, seed: int, contrasts: dict, level: float = 0.95) -> DataFrame:
    """Contrasts over the union of stored per-sequence moments of several splits."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return paired_bootstrap(every, contrasts, draws, seed, level)


def outcome_label(df: DataFrame, run: str, parent: str, stage: str, buggy: str, metric: str, maximize: bool = True) -> DataFrame:
    """+1 / 0 / -1 of each run against its parent.

    Drafts count as +1; a repair is +1 if it fixes a broken parent, else -1; other runs compare metrics.
    """
    parents = df.select(F.col(run).alias(parent), F.col(buggy).alias("_pb"), F.col(metric).alias("_pm"))
    joined = df.join(parents, parent, "left")
    better = F.signum(F.col(metric) - F.col("_pm")) * (1 if maximize else -1)
    repaired = F.coalesce(F.col("_pb") & ~F.col(buggy), F.lit(False))
    label = (
        F.when(F.col(stage).isin("draft", "fusion_draft"), F.lit(1))
        .when(F.col(stage) == "debug", F.when(repaired, F.lit(1)).otherwise(F.lit(-1)))
        .when(F.col(stage).isin("improve", "evolution", "fusion"), F.coalesce(better.cast("int"), F.lit(0)))
        .otherwise(F.lit(0))
    )
    return joined.withColumn("label", label).drop("_pb", "_pm")


def patience(df: DataFrame, branch: str, order: str, buggy: str, metric: str, maximize: bool = True) -> DataFrame:
    """Runs and successful runs since the first best run of each branch.

    One pass finds the best run of a branch, the second counts later runs; the joined side has one row
    per branch.
    """
    ok = ~F.col(buggy) & F.col(metric).isNotNull()
    gain = F.col(metric) if maximize else -F.col(metric)
    best = df.groupBy(branch).agg(
        F.max_by(F.struct(F.col(order).alias("o"), F.col(metric).alias("m")), F.when(ok, F.struct(gain, -F.col(order)))).alias("_best"),
        F.count("*").alias("_all"))
    joined = df.select(branch, order, ok.alias("_ok")).join(best.drop("_all"), branch)
    later = F.col("_best.o").isNull() | (F.col(order) > F.col("_best.o"))
    return joined.groupBy(branch).agg(
        F.sum((later & F.col("_ok")).cast("bigint")).alias("success_patience"), F.sum(later.cast("bigint")).alias("total_patience"),
        F.first("_best.m").alias("best"))


def extreme_metric(df: DataFrame, metric: str, maximize: bool, high: float = 0.9999, low: float = 1e-6) -> DataFrame:
    """Runs whose score is too good to be true."""
    return df.filter(F.col(metric) >= high if maximize else F.col(metric) <= low)
