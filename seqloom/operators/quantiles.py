"""Exact quantiles of many columns and groups over any number of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import column, search_sorted
from seqloom.session import settle

BINS = 4_096
SMALL = 4_096  # an interval of at most so many values is read value by value


@dataclass
class _Interval:
    """Values of one (group, column) in [lo, hi] that hold wanted ranks; `ranks` maps a rank inside the interval to the rank in the column."""

    cell: int
    lo: float
    hi: float
    n: int
    ranks: dict[int, int]

    @property
    def by_value(self) -> bool:
        """Few values, or few that a double can tell apart."""
        return self.n <= SMALL or self.hi - self.lo <= BINS * math.ulp(max(abs(self.lo), abs(self.hi)))

    @property
    def width(self) -> float:
        width = (self.hi - self.lo) / BINS
        # The range itself may be no double: scale both ends first.
        return self.hi / BINS - self.lo / BINS if math.isinf(width) else width


def many_quantiles(df: DataFrame, columns: dict[str, object], probs: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, dict[str, list[float]]]:
    """Linearly interpolated quantiles of every column in every group: `{group: {column: values}}`, the group `()` without `by`.

    A pass is one aggregation keyed (interval, bin) for all groups, columns and ranks together: the first finds range and count, the next ones
    cut every open interval into 4,096 bins, open those that hold a wanted rank, and read intervals of few values value by value. So the number of
    jobs depends on how unevenly values lie, not on columns, groups or ranks; up to 16 million evenly spread values per column take three passes.
    At most groups x columns x ranks intervals are open; that many rows reach the driver and are broadcast. Repeated values cost
    nothing extra. NULL, NaN and infinite values are left out; a group's column without values has NaN quantiles. The narrow columns are stored once.
    """
    names = list(columns)
    stored = settle(df.select(*by, *[column(v).cast("double").alias(f"_v{i}") for i, v in enumerate(columns.values())]))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_v{i}").alias("v")) for i in range(len(names))]))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    long = stored.select(*by, group.alias("g"), cells.alias("_c")).select(*by, "g", "_c.c", "_c.v")
    finite = (F.col("v") > float("-inf")) & (F.col("v") < float("inf"))
    value = F.when(finite, F.col("v"))
    ranges = long.groupBy("g", "c").agg(*[F.first(b).alias(b) for b in by], F.min(value).alias("_a"), F.max(value).alias("_z"), F.count(value).alias("_n")).collect()
    found: dict[int, dict[int, float]] = {}
    start: dict[tuple[str, int], int] = {}
    level: list[_Interval] = []
    for cell, r in enumerate(ranges):
        found[cell] = {}
        if r["_n"]:
            ranks = {f: f for p in probs for f in (math.floor(p * (r["_n"] - 1)), math.ceil(p * (r["_n"] - 1)))}
            if r["_a"] == r["_z"]:
                found[cell] = dict.fromkeys(ranks, r["_a"])
            elif ranks:
                start[r["g"], r["c"]] = len(level)
                level.append(_Interval(cell, r["_a"], r["_z"], r["_n"], ranks))
    spark = df.sparkSession
    rows, keys = long.filter(finite).select("g", "c", "v"), ["g", "c"]
    places: list[tuple] = list(start)
    while level:
        # Rows find their interval by the keys of the pass before; all of these tables have a row per open interval.
        table = spark.createDataFrame(
            [(*place, i, x.lo, x.width, math.isinf((x.hi - x.lo) / BINS), x.by_value) for i, (place, x) in enumerate(zip(places, level))],
            ("g string, c int" if keys[0] == "g" else "i int, b int") + ", j int, lo double, w double, far boolean, each boolean")
        place = F.when(F.col("far"), F.col("v") / F.col("w") - F.col("lo") / F.col("w")).otherwise((F.col("v") - F.col("lo")) / F.col("w"))
        bin_ = F.when(F.col("each"), 0).otherwise(F.least(F.floor(F.when(~F.col("each"), place)), F.lit(BINS - 1))).cast("int")
        rows = rows.join(F.broadcast(table), keys).select(F.col("j").alias("i"), bin_.alias("b"), "v", F.when(F.col("each"), F.col("v")).alias("e"))
        cells_ = rows.groupBy("i", "b", "e").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, 0))  # at most 4,096 rows each
        wanted = spark.createDataFrame([(i, k) for i, x in enumerate(level) for k in x.ranks], "i int, k long")
        hit = cells_.withColumn("upto", upto).join(F.broadcast(wanted), "i").filter((F.col("k") >= F.col("upto") - F.col("n")) & (F.col("k") < F.col("upto")))
        opened: dict[tuple[int, int], _Interval] = {}
        for r in hit.select("i", "b", "k", (F.col("upto") - F.col("n")).alias("below"), "n", "a", "z").collect():
            x = level[r["i"]]
            if r["a"] == r["z"]:
                found[x.cell][x.ranks[r["k"]]] = r["a"]
            else:
                opened.setdefault((r["i"], r["b"]), _Interval(x.cell, r["a"], r["z"], r["n"], {})).ranks[r["k"] - r["below"]] = x.ranks[r["k"]]
        rows, keys, places, level = rows.select("i", "b", "v"), ["i", "b"], list(opened), list(opened.values())
    out: dict[tuple, dict[str, list[float]]] = {} if by else {(): {}}
    for cell, r in enumerate(ranges):
        line = []
        for p in probs:
            at = p * (r["_n"] - 1)
            if r["_n"]:
                a, z = found[cell][math.floor(at)], found[cell][math.ceil(at)]
                line.append(a + (z - a) * (at - math.floor(at)))
            else:
                line.append(math.nan)
        out.setdefault(tuple(r[b] for b in by), {})[names[r["c"]]] = line
    for table in out.values():
        for n in names:
            table.setdefault(n, [math.nan] * len(probs))
    return out


def exact_quantiles(df: DataFrame, value, probs: Sequence[float]) -> list[float]:
    """Quantiles of one column, as `many_quantiles` gives them."""
    return many_quantiles(df, {"v": value}, probs)[()]["v"]


def quantile_edges(df: DataFrame, value, bins: int) -> list[float]:
    """Inner edges of `bins` equally filled bins."""
    return exact_quantiles(df, value, [k / bins for k in range(1, bins)])


def many_edges(df: DataFrame, columns: dict[str, object], bins: int) -> dict[str, list[float]]:
    """Inner edges for several columns from the same passes."""
    return many_quantiles(df, columns, [k / bins for k in range(1, bins)])[()]


def binned(df: DataFrame, value: str, edges: Sequence[float], out: str) -> DataFrame:
    """Bin code: number of edges strictly below the value."""
    return df.withColumn(out, search_sorted(value, edges, "left"))
