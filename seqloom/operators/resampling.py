"""Sequence bootstrap, influence and block checks on per-sequence moments.

A bootstrap draw picks n of n sequences with replacement. The picks are not made one by one: the number that falls to the left half of a range of
sequences is binomial given the number that falls to the range, so each task finds the counts of its own range by splitting n down the halves from
the whole to single sequences. All tasks that pass a node make the same split from the same digits of (seed, draw, node), so nothing but the
moments is moved and only draws x sums leave a task. Systems and populations compared in one call share the draws, and results do not
depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.hashing import digest
from seqloom.layout import KEY
from seqloom.operators.quantiles import exact_quantiles
from seqloom.operators.sampling import sequence_places
from seqloom.operators.scoring import SUMS, pack, unpack, with_wp
from seqloom.session import place_for_python, settle
from seqloom.sources.ingest import dense_index

Contrasts = dict[str, dict[str, float]]  # name -> coefficient per system
DELTA: Contrasts = {"delta": {"candidate": 1.0, "base": -1.0}}
#: Picks that one digit splits, and sequences of a range, about; a range's counts are held at once.
PIECE, LEAF = 512, 2_048
# The steps of the 64-bit mixer.
MIX_ADD, MIX_ONE, MIX_TWO = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = np.atleast_1d(np.asarray(x, np.uint64)) + np.uint64(MIX_ADD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_ONE)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_TWO)
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray, node: np.ndarray, piece: int) -> np.ndarray:
    """Uniform numbers in [0, 1): a row per node, a column per draw."""
    key = (np.asarray(node, np.uint64).reshape(-1, 1) << np.uint64(24)) | np.uint64(piece)
    return (mix(h[None, :] ^ key) >> np.uint64(11)).astype(float) / 2.0**53


@lru_cache(maxsize=4_096)
def _cumulated(m: int, left: int, size: int) -> np.ndarray:
    """Probabilities of at most 0 .. m - 1 of m picks going left."""
    if left in (0, size):
        return np.full(m, 0.0 if left else 1.0)
    p, j = left / size, np.arange(m)
    logs = [math.lgamma(m + 1.0) - math.lgamma(i + 1.0) - math.lgamma(m - i + 1.0) for i in range(m)]
    return np.cumsum(np.exp(np.array(logs) + j * math.log(p) + (m - j) * math.log(1.0 - p)))


def _inverse(u: np.ndarray, m: np.ndarray, left: int, size: int) -> np.ndarray:
    """Binomial numbers of m picks from uniform numbers."""
    sizes, at = np.unique(m, return_inverse=True)
    rows = [_cumulated(int(k), left, size) for k in sizes]
    start = np.cumsum([0, *map(len, rows)])[:-1]
    # Tables one after another, 2 apart: one search serves all.
    flat = np.concatenate([row + 2.0 * i for i, row in enumerate(rows)])
    at = at.reshape(m.shape)
    return np.searchsorted(flat, u + 2.0 * at, side="right") - start[at]


def _split(m: np.ndarray, left: int, size: int, h: np.ndarray, node: np.ndarray) -> np.ndarray:
    """How many of the m picks of each node and draw go left; m picks are split in pieces of `PIECE`."""
    out = np.zeros_like(m)
    for piece in range(-(-int(m.max(initial=0)) // PIECE)):
        part = np.clip(m - PIECE * piece, 0, PIECE)
        out += _inverse(_unit(h, node, piece), part, left, size)
    return out


def draw_keys(draws: int, seed: int) -> np.ndarray:
    return mix(mix(np.uint64(seed)) ^ np.arange(draws, dtype=np.uint64))


def levels(n: int) -> int:
    """Halvings from n sequences to ranges of at most one."""
    return max(0, (n - 1).bit_length())


class Splitter:
    """Counts of ranges of sequences; the upper nodes met on the way are remembered, one row of draws each."""

    def __init__(self, n: int, draws: int, seed: int, depth: int):
        self.n, self.depth, self.h = n, depth, draw_keys(draws, seed)
        self.known: dict[int, np.ndarray] = {1: np.full((1, draws), n, dtype=np.int64)}

    def bounds(self, level: int, place: int) -> tuple[int, int, int]:
        """First, middle and end sequence of a node: the ends are whole parts of multiples of n / 2^level."""
        return tuple(self.n * (2 * place + k) >> (level + 1) for k in range(3))

    def node(self, node: int) -> np.ndarray:
        """Picks of a node in each draw."""
        if node not in self.known:
            parent = node >> 1
            level = parent.bit_length() - 1
            lo, mid, hi = self.bounds(level, parent - (1 << level))
            m = self.node(parent)
            k = _split(m, mid - lo, hi - lo, self.h, np.array([parent]))
            self.known[2 * parent], self.known[2 * parent + 1] = k, m - k
        return self.known[node]

    def counts(self, leaf: int) -> tuple[int, np.ndarray]:
        """First sequence of a leaf range, and picks of its sequences, a row each."""
        nodes, m = np.array([(1 << self.depth) + leaf]), self.node((1 << self.depth) + leaf)
        first = self.bounds(self.depth, leaf)[0]
        for level in range(self.depth, levels(self.n)):
            ends = np.array([self.bounds(level, int(x) - (1 << level)) for x in nodes])
            left, size = ends[:, 1] - ends[:, 0], ends[:, 2] - ends[:, 0]
            k = np.zeros_like(m)
            for a, b in np.unique(np.stack([left, size], 1), axis=0):
                here = np.flatnonzero((left == a) & (size == b))
                if b:
                    k[here] = _split(m[here], int(a), int(b), self.h, nodes[here])
            nodes = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel()
            m = np.stack([k, m - k], 1).reshape(len(nodes), -1)
        ends = np.array([self.bounds(levels(self.n), int(x) - (1 << levels(self.n))) for x in nodes])
        return first, m[ends[:, 2] > ends[:, 0]]


def _leaves(indexed: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows with the number `_leaf` of their range of sequences, ranges together and in order; the number of sequences, and halvings to a range."""
    n = indexed.agg(F.max("n")).first()[0] or 0
    depth = max(0, levels(n) - levels(LEAF))
    leaf = F.floor(((F.col("idx") + 1) * F.lit(1 << depth) - 1) / F.lit(max(n, 1))).cast("long")
    return place_for_python(indexed.withColumn("_leaf", leaf), "_leaf").sortWithinPartitions("_leaf", "idx"), n, depth


def _by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one range after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        leaf = b.column("_leaf").to_numpy()
        cuts = [0, *(np.flatnonzero(leaf[1:] != leaf[:-1]) + 1).tolist(), len(leaf)]
        for start, stop in zip(cuts, cuts[1:]):
            part = b.slice(start, stop - start)
            if held and held[0].column("_leaf")[0].as_py() != leaf[start]:
                yield held[0].column("_leaf")[0].as_py(), pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield held[0].column("_leaf")[0].as_py(), pa.Table.from_batches(held)


def bootstrap_counts(ids: DataFrame, draws: int, seed: int, key: str = KEY) -> DataFrame:
    """`(draw, key, times)`: how often each sequence is picked in each draw, made where the sequence is."""
    placed, n, depth = _leaves(settle(dense_index(ids, key)))
    schema = f"draw int, idx long, times long, `{key}` {ids.schema[key].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(n, draws, seed, depth)
        for leaf, rows in _by_leaf(batches):
            first, counts = splitter.counts(leaf)
            idx, keys = rows.column("idx").to_numpy(), rows.column(key).combine_chunks()
            for start in range(0, len(idx), 64):
                part = counts[idx[start:start + 64] - first]
                at, draw = np.nonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array(draw.astype(np.int32)), pa.array(idx[start:start + 64][at]), pa.array(part[at, draw]), keys.take(pa.array(start + at))], names=["draw", "idx", "times", key])

    return placed.mapInArrow(run, schema).select("draw", key, "times")


def bootstrap_sums(vectors: DataFrame, draws: int, seed: int, key: str = KEY) -> DataFrame:
    """`(draw, sums array<double>)`: sum over sequences of times * vector, for rows `(key, vec array<double>)`, one per sequence.

    A missing number counts as 0. Only one (draws x width) block leaves each task.
    """
    placed, n, depth = _leaves(vectors.join(dense_index(vectors, key), key).select("idx", "n", "vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, total = Splitter(n, draws, seed, depth), None
        for leaf, rows in _by_leaf(batches):
            first, counts = splitter.counts(leaf)
            x = np.nan_to_num(rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1), nan=0.0, posinf=np.inf, neginf=-np.inf)
            part = counts[rows.column("idx").to_numpy() - first].T.astype(float) @ x
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["draw", "sums"])

    cells = placed.mapInArrow(run, "draw int, sums array<double>").select("draw", F.posexplode("sums").alias("position", "value"))
    total = cells.groupBy("draw", "position").agg(F.sum("value").alias("value"))
    entry = F.array_sort(F.collect_list(F.struct("position", "value")))  # as many as a vector is wide
    return total.groupBy("draw").agg(F.transform(entry, lambda p: p["value"]).alias("sums"))


def names_of(contrasts: Contrasts) -> list[str]:
    return sorted({s for c in contrasts.values() for s in c})


def contrast_values(scored: DataFrame, contrasts: Contrasts, by: Sequence[str] = ()) -> DataFrame:
    """Linear contrasts of `wp` per target, plus their mean as target `combined`."""
    cells = []
    for name, weights in contrasts.items():
        value = F.lit(0.0)
        for system, weight in weights.items():
            value = F.when(F.col("system") == system, F.lit(float(weight)) * F.col("wp")).otherwise(F.lit(0.0)) + value
        cells.append(F.struct(F.lit(name).alias("contrast"), value.alias("_v")))
    long = scored.select(*by, "target", F.explode(F.array(*cells)).alias("_c")).select(*by, "target", "_c.*")
    per = long.groupBy(*by, "contrast", "target").agg(F.sum("_v").alias("value"))
    both = per.withColumn("target", F.explode(F.array(F.col("target"), F.lit("combined"))))
    return both.groupBy(*by, "contrast", "target").agg(F.avg("value").alias("value"))


def bootstrap_draws(per_sequence: DataFrame, contrasts: Contrasts, draws: int, seed: int, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Contrast values of every draw. `per_sequence` holds `(seq, system, target, six sums)`."""
    systems = names_of(contrasts)
    wide = pack(per_sequence, [KEY], systems, targets)
    cells = [f"{s}|{t}|{m}" for s in systems for t in targets for m in SUMS]
    vectors = settle(wide.select(KEY, F.array(*[F.col(f"`{c}`") for c in cells]).alias("vec")))  # one row per sequence
    pooled = bootstrap_sums(vectors, draws, seed).select("draw", *[F.get("sums", F.lit(i)).alias(c) for i, c in enumerate(cells)])
    return contrast_values(with_wp(unpack(pooled, ["draw"], systems, targets)), contrasts, ["draw"])


def paired_bootstrap(per_sequence: DataFrame, contrasts: Contrasts = DELTA, draws: int = 500, seed: int = 1,
                     level: float = 0.95, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Point value and interval of each contrast per target and combined.

    The moments, one row per sequence and system, are settled: the rows behind them are scanned once.
    """
    per_sequence = settle(per_sequence)
    tail = (1.0 - level) / 2.0
    drawn = bootstrap_draws(per_sequence, contrasts, draws, seed, targets)
    # The number of values per group is the number of draws.
    bounds = drawn.groupBy("contrast", "target").agg(
        F.percentile("value", F.lit(tail)).alias("lower"), F.percentile("value", F.lit(1.0 - tail)).alias("upper"))
    point = contrast_values(with_wp(per_sequence.groupBy("system", "target").agg(*[F.sum(c).alias(c) for c in SUMS])), contrasts)
    return point.join(bounds, ["contrast", "target"]).withColumnRenamed("value", "point")


def leave_one_out(per_sequence: DataFrame, contrasts: Contrasts = DELTA, targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Influence of each sequence: contrast on all sequences minus contrast without it."""
    systems = names_of(contrasts)
    wide = settle(pack(per_sequence, [KEY], systems, targets))
    cells = [f"{s}|{t}|{m}" for s in systems for t in targets for m in SUMS]
    total = wide.agg(*[F.sum(f"`{c}`").alias(f"_{c}") for c in cells])
    rest = wide.crossJoin(F.broadcast(total))  # one row
    rest = rest.select(KEY, *[(F.col(f"`_{c}`") - F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in cells])
    without = contrast_values(with_wp(unpack(rest, [KEY], systems, targets)), contrasts, [KEY])
    everything = with_wp(unpack(total.toDF(*cells), [], systems, targets))
    full = contrast_values(everything, contrasts).withColumnRenamed("value", "_full")
    joined = without.join(F.broadcast(full), ["contrast", "target"])  # contrasts x targets rows
    return joined.select(KEY, "contrast", "target", F.col("value").alias("without"), (F.col("_full") - F.col("value")).alias("influence"))


def drop_top_influence(per_sequence: DataFrame, k: int = 5, contrasts: Contrasts = DELTA, target: str = "combined",
                       targets: Sequence[str] = ("t0", "t1")) -> DataFrame:
    """Contrasts without the k sequences of largest absolute influence on `target`."""
    name = next(iter(contrasts))
    per_sequence = settle(per_sequence)
    loud = leave_one_out(per_sequence, {name: contrasts[name]}, targets).filter(F.col("target") == target)
    loud = loud.orderBy(F.abs("influence").desc(), KEY).limit(k).select(KEY)
    kept = per_sequence.join(F.broadcast(loud), KEY, "left_anti")  # k rows
    return contrast_values(with_wp(kept.groupBy("system", "target").agg(*[F.sum(c).alias(c) for c in SUMS])), contrasts)


def halves_check(per_sequence: DataFrame, contrasts: Contrasts = DELTA) -> DataFrame:
    """Contrasts in the first and the second half of the sequences in id order."""
    per_sequence = settle(per_sequence)
    places = sequence_places(per_sequence)
    size = places.agg(F.count("*").alias("_n"))
    half = places.crossJoin(F.broadcast(size))  # one row
    half = half.select(KEY, F.when(F.col("place") < F.ceil(F.col("_n") / 2), F.lit(1)).otherwise(F.lit(2)).alias("half"))
    pooled = per_sequence.join(half, KEY).groupBy("half", "system", "target").agg(*[F.sum(c).alias(c) for c in SUMS])
    return contrast_values(with_wp(pooled), contrasts, ["half"])


def random_halves(ids: DataFrame, draws: int, seed: int) -> DataFrame:
    """`(draw, seq, half)`: the first half of a fresh shuffle against the rest, per draw.

    Places are numbered per (draw, 3 digits of the digest); a draw only sums up 4,096 bucket sizes.
    """
    index = dense_index(ids, KEY)
    shuffled = index.select(KEY, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    shuffled = shuffled.withColumn("_h", digest(seed, F.col("draw"), F.col(KEY))).withColumn("_b", F.substring("_h", 1, 3))
    earlier = Window.partitionBy("draw").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shuffled.groupBy("draw", "_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("draw", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("draw", "_b").orderBy("_h", KEY))
    placed = shuffled.withColumn("_rn", local).join(sizes, ["draw", "_b"])
    first = F.col("_o") + F.col("_rn") <= F.floor(F.col("n") / 2)
    return placed.select("draw", KEY, F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("half"))


def split_half(per_sequence: DataFrame, contrasts: Contrasts = DELTA, draws: int = 100, seed: int = 1) -> DataFrame:
    """Contrast in both halves of random splits; agreement is their difference and common sign."""
    per_sequence = settle(per_sequence)
    halves = random_halves(per_sequence, draws, seed)
    pooled = halves.join(per_sequence, KEY).groupBy("draw", "half", "system", "target").agg(*[F.sum(c).alias(c) for c in SUMS])
    values = contrast_values(with_wp(pooled), contrasts, ["draw", "half"])
    wide = values.groupBy("draw", "contrast", "target").agg(
        F.max(F.when(F.col("half") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("half") == 2, F.col("value"))).alias("b"))
    return wide.groupBy("contrast", "target").agg(
        F.avg((F.col("a") * F.col("b") > 0).cast("double")).alias("same_sign_share"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_difference"))


def interval(drawn: DataFrame, value: str, level: float = 0.95) -> tuple[float, float]:
    """Interval of one drawn statistic."""
    tail = (1.0 - level) / 2.0
    lower, upper = exact_quantiles(drawn, value, (tail, 1.0 - tail))
    return lower, upper
