"""Histogram boosting with leaf-wise trees, several models in shared passes.

A model is a response with weights and the rows it may learn from; models that differ only in the rows left out (cross-fitting) or in the response
share their bins and every pass over the rows, each at its own tree. Rows are stored once as blocks of at most `BLOCK` rows: bin codes as one byte per feature,
feature by feature, next to responses, weights and running predictions, which models share where they are equal. A pass returns histograms per (model, node, feature), summed by key
before they leave Spark; the driver holds at most models x leaves x features x bins of them.

Trees grow best first: of all open leaves the one of the largest gain is split, up to a number of leaves. To take few passes, a pass opens every
leaf that the order known so far would split before the leaves run out; only histograms of the smaller child are counted, the larger one's are
the parent's less its sibling's. The tree is final when no split that the order takes has unknown children that could come before a later one.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Generator, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalar import column, not_finite
from seqloom.operators.quantiles import many_edges
from seqloom.operators.trees import Node, Tree
from seqloom.session import settle

BLOCK = 8_192
#: Bytes of histograms that the tasks of a pass may send to the driver as they are; more are summed by key first.
DIRECT = 32 << 20
#: Blocks to an Arrow batch of a pass, one or two MB; batches of tens of MB take several times as long to reach Python.
BATCH = 4
#: Rounds after which running predictions are stored; a pass adds up the trees since then.
STORE = 8


@dataclass(frozen=True)
class Response:
    """What one model learns: values, their weights, and the rows that take part; of these, rows without a finite value and weight do not."""

    value: Column
    weight: Column
    rows: Column

    @property
    def finite(self) -> Column:
        return ~not_finite(self.value) & ~not_finite(self.weight)

    @property
    def sound(self) -> Column:
        return self.rows & self.finite


@dataclass(frozen=True)
class Settings:
    """Fixed values of a fit. `loss` is "squared" or "logistic" (values 0 and 1)."""

    rounds: int = 100
    leaves: int = 15
    rate: float = 0.05
    l2: float = 10.0
    min_leaf: int = 80
    bins: int = 127
    loss: str = "squared"


@dataclass
class Boosted:
    """Baseline plus trees; `codes` are the trees in bin units of `edges`."""

    baseline: float
    edges: Sequence[Sequence[float]]
    trees: list[Tree] = field(default_factory=list)
    codes: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predictor()(x)

    def predictor(self) -> Callable[[np.ndarray], np.ndarray]:
        """The prediction with its tables made, for many blocks of rows."""
        places, cuts = Places.values(self.codes), [np.array(e) for e in self.edges]
        return lambda x: self.baseline + places.total(coded(x, cuts))


def baselines(df: DataFrame, responses: Sequence[Response], loss: str) -> list[float]:
    """Weighted mean of each response, as log-odds for the logistic loss."""
    sums = df.agg(*[F.coalesce(F.sum(F.when(r.sound, x)), F.lit(0.0)) for r in responses for x in (r.weight * r.value, r.weight.cast("double"))]).first()
    out = []
    for j in range(len(responses)):
        mean = sums[2 * j] / sums[2 * j + 1] if sums[2 * j + 1] else 0.0
        if loss == "logistic":
            mean = min(max(mean, 1e-12), 1.0 - 1e-12)
            mean = math.log(mean / (1.0 - mean))
        out.append(mean)
    return out


_BLOCK = "n int, codes binary, y binary, w binary, used binary, pred binary"
_NAMES = [part.split()[0] for part in _BLOCK.split(", ")]


def coded(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin codes, feature by feature: the number of edges below each value."""
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(cuts)]).astype(np.uint8)


def packed(a: np.ndarray) -> bytes:
    """Lines of numbers, only one if all lines are equal, in the narrowest type that keeps every number; the last byte is its size."""
    if (a == a[:1]).all():
        a = a[:1]
    with np.errstate(all="ignore"):
        small = next((b for b in (a.astype(kind) for kind in (np.uint8, np.float32)) if (b == a).all()), a.astype(float))
    return small.tobytes() + bytes([small.itemsize])


def unpacked(data: bytes, lines: int, n: int) -> np.ndarray:
    kind = {1: np.uint8, 4: np.float32, 8: np.float64}[data[-1]]
    a = np.frombuffer(data, kind, (len(data) - 1) // data[-1]).reshape(-1, n)
    return np.broadcast_to(a, (lines, n))


def blocks(df: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], responses: Sequence[Response], start: Sequence[float]) -> DataFrame:
    """Rows packed into blocks, features as the number of edges below them, with the rows that each model uses."""
    if not features or not responses:
        raise ValueError("features and responses are needed")
    wide = df.select(F.array(*features).alias("x"), F.array(*[F.when(r.finite, r.value.cast("double")).otherwise(0.0) for r in responses]).alias("y"),
                     F.array(*[F.when(r.finite, r.weight.cast("double")).otherwise(0.0) for r in responses]).alias("w"),
                     F.array(*[F.when(r.sound & (r.weight >= 0), 1.0).otherwise(0.0) for r in responses]).alias("used"))
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                n = b.num_rows
                x, *lines = (b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for i in range(4))
                pred = np.repeat(np.array(start)[:, None], n, 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in (coded(x, cuts).tobytes(), *(packed(a.T) for a in lines), pred.tobytes())]],
                    names=_NAMES)

    return wide.mapInArrow(run, _BLOCK)


def _open(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """Codes, responses, weights, used rows and predictions of a block."""
    n = b.column(0)[i].as_py()
    codes, *lines, pred = (b.column(k)[i].as_py() for k in range(1, 6))
    pred = np.frombuffer(pred).reshape(-1, n)
    return np.frombuffer(codes, np.uint8).reshape(-1, n), *(unpacked(a, len(pred), n) for a in lines), pred


class Places:
    """Marks of the leaves that rows fall in, for several trees at once; thresholds are bin numbers. Made once per task.

    Leaves are bits. A split strikes out those of the side a row does not take, whether or not the row comes by, which leaves the
    row's own bit; the splits of one feature act together through a table by bin. Four trees of at most 16 marked leaves share a word, so
    that a row costs one look-up per feature for all of them. Rows in leaves without a mark get `none`.
    """

    def __init__(self, trees: Sequence[tuple[Tree, dict[int, float]]], none: float = 0.0, kind: type = float):
        self.trees, self.none, self.kind = trees, none, kind
        lanes: dict[int, list[int]] = {}
        for i, (_, marks) in enumerate(trees):
            lanes.setdefault(next((size for size in (16, 64) if len(marks) <= size), 0), []).append(i)
        self.far = lanes.pop(0, [])
        self.words = [self._word(ids[at:at + 64 // lane], lane) for lane, ids in lanes.items() for at in range(0, len(ids), 64 // lane)]

    @classmethod
    def values(cls, trees: Sequence[Tree]) -> "Places":
        return cls([(t, {i: node.value for i, node in enumerate(t) if node.is_leaf}) for t in trees])

    def _word(self, ids: list[int], lane: int) -> tuple:
        start, tables, marked = 0, {}, []
        for k, i in enumerate(ids):
            tree, marks = self.trees[i]
            below = [0] * len(tree)
            for m, leaf in enumerate(marks):
                below[leaf] = 1 << (k * lane + m)
            for at in range(len(tree) - 1, -1, -1):  # children come after their parents
                node = tree[at]
                if not node.is_leaf:
                    left, right = below[node.left], below[node.right]
                    below[at] = left | right
                    if left | right:
                        table = tables.setdefault(node.feature, np.full(256, ~np.uint64(0), "<u8"))
                        cut = int(node.threshold) + 1
                        table[:cut] &= ~np.uint64(right)
                        table[cut:] &= ~np.uint64(left)
            start |= below[0]
            # By bit in a lane of 16, else by the number of the bit.
            mark = np.empty(1 << len(marks) if lane == 16 else len(marks) + 1, self.kind)
            mark[[0, *(1 << m if lane == 16 else m + 1 for m in range(len(marks)))]] = [self.none, *marks.values()]
            marked.append(mark)
        for table in tables.values():
            table &= np.uint64(start)
        return ids, lane, np.uint64(start), list(tables.items()), marked

    def of(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per tree, the mark of every row."""
        out: list = [None] * len(self.trees)
        for ids, lane, start, tables, marked in self.words:
            bits = None
            for feature, table in tables:
                part = table.take(codes[feature], mode="clip")
                bits = part if bits is None else np.bitwise_and(bits, part, out=bits)
            if bits is None:
                bits = np.full(codes.shape[1], start, "<u8")
            if lane == 16:
                parts = bits.view("<u2").reshape(-1, 4)
                for k, (i, mark) in enumerate(zip(ids, marked)):
                    out[i] = mark.take(parts[:, k], mode="clip")
            else:
                out[ids[0]] = marked[0].take(np.frexp(bits.astype(float))[1])
        for i in self.far:
            tree, marks = self.trees[i]
            out[i] = np.array([marks.get(at, self.none) for at in range(len(tree))], self.kind)[_walked(codes, tree)]
        return out

    def total(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the marks over the trees, in their order."""
        return sum(self.of(codes), np.zeros(codes.shape[1]))


def place(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of every row."""
    return Places([(tree, {i: i for i, node in enumerate(tree) if node.is_leaf})], kind=np.int32).of(codes)[0]


def _walked(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of every row by one pass over the nodes, for trees of any size."""
    at = np.zeros(codes.shape[1], dtype=np.int32)
    for i, node in enumerate(tree):
        if not node.is_leaf:
            here = np.flatnonzero(at == i)
            at[here] = np.where(codes[node.feature, here] <= node.threshold, node.left, node.right)
    return at


def slopes(y: np.ndarray, w: np.ndarray, pred: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Descent direction and curvature of every row."""
    if loss == "squared":
        return w * (y - pred), w
    p = 1.0 / (1.0 + np.exp(-pred))
    return w * (y - p), w * p * (1.0 - p)


def histograms(stored: DataFrame, since: Sequence[Sequence[Tree]], growing: Sequence[Tree], wanted: Sequence[Sequence[int]], width: int, bins: int, loss: str,
               parts: int | None = None) -> dict[tuple[int, int], np.ndarray]:
    """`{(model, node): (feature, 3, bin) sums of slope, curvature and rows}` of the wanted nodes of the growing trees.

    `parts` is the number of partitions, if known: few partitions and nodes need no exchange.
    """
    spots = [(j, node) for j, nodes in enumerate(wanted) for node in nodes]

    asked = [j for j, nodes in enumerate(wanted) if nodes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Places([(growing[j], {node: k for k, node in enumerate(wanted[j])}) for j in asked], -1, np.intp)
        values = [Places.values(since[j]) for j in asked]
        total = {j: np.zeros((width, 3, len(wanted[j]) * bins)) for j in asked}
        any_rows = False
        for b in batches:
            for i in range(b.num_rows):
                any_rows = True
                codes, y, w, used, pred = _open(b, i)
                for j, order, value in zip(asked, orders.of(codes), values):
                    mine = np.flatnonzero((order >= 0) & (used[j] > 0))
                    if not len(mine):
                        continue
                    here, size = codes.take(mine, axis=1), len(wanted[j]) * bins
                    g, h = slopes(y[j].take(mine).astype(float), w[j].take(mine).astype(float), pred[j].take(mine) + value.total(here), loss)
                    first = order.take(mine) * bins
                    for f in range(width):
                        key = first + here[f]
                        total[j][f, 0] += np.bincount(key, g, size)
                        total[j][f, 1] += np.bincount(key, h, size)
                        total[j][f, 2] += np.bincount(key, minlength=size)
        if any_rows and asked:
            rows = [(j, node, f, total[j][f, :, k * bins:(k + 1) * bins].tobytes()) for j in asked for f in range(width) for k, node in enumerate(wanted[j])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["model", "node", "feature", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, sums in zip(*(b.column(i).to_pylist() for i in range(4))):
                have, part = total.get(tuple(key)), np.frombuffer(sums)
                total[tuple(key)] = part if have is None else have + part
        rows = [(*k, v.tobytes()) for k, v in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["model", "node", "feature", "sums"])

    schema = "model int, node int, feature int, sums binary"
    out = {spot: np.zeros((width, 3, bins)) for spot in spots}
    found = stored.mapInArrow(count, schema)
    if parts is None or parts * len(spots) * width * 3 * bins * 8 > DIRECT:
        found = found.repartition("model", "node", "feature").mapInArrow(add, schema)
    for r in found.collect():
        out[r["model"], r["node"]][r["feature"]] += np.frombuffer(r["sums"]).reshape(3, bins)
    return out


def advanced(stored: DataFrame, since: Sequence[Sequence[Tree]]) -> DataFrame:
    """Blocks with the trees added to their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [Places.values(trees) for trees in since]
        for b in batches:
            preds = []
            for i in range(b.num_rows):
                codes, *_, pred = _open(b, i)
                preds.append(np.stack([p + value.total(codes) for p, value in zip(pred, values)]).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(preds, pa.binary())], names=_NAMES)

    return stored.mapInArrow(run, _BLOCK)


def best_split(hist: np.ndarray, l2: float, min_leaf: int) -> tuple[float, int, int] | None:
    """`(gain, feature, bin)` of the best split `code <= bin`; ties go to the lower feature, then the lower bin."""
    total = hist[0].sum(1)
    run = np.cumsum(hist, axis=2)[:, :, :-1]
    rest = total[None, :, None] - run
    gain = run[:, 0] ** 2 / (run[:, 1] + l2 + 1e-300) + rest[:, 0] ** 2 / (rest[:, 1] + l2 + 1e-300) - total[0] ** 2 / (total[1] + l2 + 1e-300)
    gain = np.where((run[:, 2] >= min_leaf) & (rest[:, 2] >= min_leaf), gain, -np.inf)
    at = int(np.argmax(gain))
    f, k = divmod(at, gain.shape[1])
    return (float(gain[f, k]), f, k) if gain.size and gain[f, k] > 0 else None


class Grower:
    """One tree that grows best first; nodes are numbered as they are opened."""

    def __init__(self, settings: Settings):
        self.set = settings
        self.parent: list[tuple[int, int] | None] = [None]  # (parent, side)
        self.hist: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple[float, int, int] | None] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.sums: dict[int, np.ndarray] = {}

    def learn(self, node: int, hist: np.ndarray) -> None:
        self.hist[node] = hist
        self.sums[node] = hist[0].sum(1)
        self.split[node] = best_split(hist, self.set.l2, self.set.min_leaf)

    def order(self) -> tuple[list[int], list[int]]:
        """Splits that best-first order takes with what is known, and those among them whose children must be known first."""
        taken, unknown = [], []
        heap = [(-self.split[0][0], 0)] if self.split.get(0) else []
        while heap and len(taken) < self.set.leaves - 1:
            _, node = heapq.heappop(heap)
            taken.append(node)
            if node not in self.children:
                unknown.append(node)
            else:
                for child in self.children[node]:
                    if self.split[child]:
                        heapq.heappush(heap, (-self.split[child][0], child))
        # The split that uses up the leaves needs no children: nothing follows it.
        if len(taken) == self.set.leaves - 1 and unknown and unknown[-1] == taken[-1]:
            unknown.pop()
        return taken, unknown

    def open(self, nodes: Sequence[int]) -> None:
        for node in nodes:
            a = len(self.parent)
            self.parent += [(node, 0), (node, 1)]
            self.children[node] = (a, a + 1)

    def smaller(self, node: int) -> int:
        """The child of fewer rows, the left one of equals."""
        _, f, k = self.split[node]
        left = self.hist[node][f, 2, :k + 1].sum()
        a, b = self.children[node]
        return a if 2 * left <= self.sums[node][2] else b

    def tree(self, splits: Sequence[int], edges: Sequence[Sequence[float]] | None, leaves_valued: bool = True) -> tuple[Tree, dict[int, int]]:
        """Nodes of the tree with these splits, parents first, and the place of every node; thresholds are bins without `edges`."""
        order, chosen = [0], set(splits)
        for node in order:
            if node in chosen:
                order += self.children[node]
        spot = {node: i for i, node in enumerate(order)}
        out = []
        for node in order:
            if node in chosen:
                _, f, k = self.split[node]
                out.append(Node(feature=f, threshold=float(k if edges is None else edges[f][k]), left=spot[self.children[node][0]], right=spot[self.children[node][1]]))
            else:
                g, h, _ = self.sums[node] if node in self.sums else (0.0, 0.0, 0.0)
                out.append(Node(value=self.set.rate * g / (h + self.set.l2) if leaves_valued and h + self.set.l2 > 0 else 0.0))
        return out, spot


def grow(settings: Settings) -> Generator[tuple[Tree, list[int]], dict[int, np.ndarray], Grower]:
    """Grow one tree: hands out its shape and the nodes whose histograms it wants, and is sent these."""
    g = Grower(settings)
    found = yield [Node()], [0]
    g.learn(0, found[0])
    while True:
        _, unknown = g.order()
        g.open(unknown)
        shape, spot = g.tree(list(g.children), None, leaves_valued=False)
        smaller = {g.smaller(node): node for node in unknown}
        if not smaller:
            break
        found = yield shape, [spot[c] for c in smaller]
        for child, node in smaller.items():
            a, b = g.children[node]
            g.learn(child, found[spot[child]])
            g.learn(b if child == a else a, g.hist[node] - found[spot[child]])
    _close(g)
    return g


def _close(g: Grower) -> None:
    """Children of the last split of a full tree: their sums follow from the parent's histogram."""
    for node in g.order()[0]:
        if node not in g.children:
            g.open([node])
            _, f, k = g.split[node]
            a, b = g.children[node]
            g.sums[a] = g.hist[node][f, :, :k + 1].sum(1)
            g.sums[b] = g.sums[node] - g.sums[a]
            g.split[a] = g.split[b] = None


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows in the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def boost(df: DataFrame, features: Sequence, responses: Sequence[Response], settings: Settings, edges: Sequence[Sequence[float]] | None = None) -> list[Boosted]:
    """One boosted model per response; bins and passes are shared."""
    if not 2 <= settings.bins <= 256:
        raise ValueError("bin codes are one byte")
    names = [f"_f{i}" for i in range(len(features))]
    # A missing value goes the way of NaN: above every edge.
    wide = df.withColumns({n: F.coalesce(column(f).cast("double"), F.lit(math.nan)) for n, f in zip(names, features)})
    if edges is None:
        found = many_edges(wide, {n: n for n in names}, settings.bins)
        # Equal edges hold no rows between them; a feature without values has none.
        edges = [sorted({e for e in found[n] if not math.isnan(e)}) for n in names]
    start = baselines(wide, responses, settings.loss)
    # Every pass reads the blocks: in memory as far as they fit, else from local disk.
    with batches_of(df.sparkSession, BLOCK):
        stored = settle(blocks(wide, names, edges, responses, start)).persist()
    models = [Boosted(b, edges) for b in start]
    kept, parts = [0] * len(models), stored.rdd.getNumPartitions()
    # Models do not wait for each other: one may be a tree ahead, and a pass counts what each asks for.
    runs = [grow(settings) for _ in models]
    asked = [next(run) if settings.rounds else None for run in runs]
    with batches_of(df.sparkSession, BATCH):
        while any(asked):
            shapes, wanted = zip(*[a or ([Node()], []) for a in asked])
            found = histograms(stored, [m.codes[k:] for m, k in zip(models, kept)], shapes, wanted, len(names), settings.bins, settings.loss, parts)
            for j, m in enumerate(models):
                if not asked[j]:
                    continue
                try:
                    asked[j] = runs[j].send({node: found[j, node] for node in wanted[j]})
                except StopIteration as grown:
                    g = grown.value
                    splits = g.order()[0]
                    m.trees.append(g.tree(splits, edges)[0])
                    m.codes.append(g.tree(splits, None)[0])
                    runs[j] = grow(settings)
                    asked[j] = next(runs[j]) if len(m.trees) < settings.rounds else None
            if any(asked) and any(len(m.codes) - k >= STORE for m, k in zip(models, kept)):
                last, stored = stored, settle(advanced(stored, [m.codes[k:] for m, k in zip(models, kept)])).persist()
                last.unpersist()
                kept = [len(m.codes) for m in models]
    stored.unpersist()
    return models


def predicted(models: Sequence[Boosted], features: Sequence, model: Column | None = None) -> Column:
    """Prediction of every row by the model whose number stands in `model` (the first one without it)."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        made = [m.predictor() for m in models]
        for cols in batches:
            x = np.column_stack([c.to_numpy(float) for c in cols[1:]])
            out, number = np.full(len(x), np.nan), cols[0].to_numpy()
            for j, predict in enumerate(made):
                here = np.flatnonzero(number == j)
                if len(here):
                    out[here] = predict(x[here])
            yield pd.Series(out)

    return run((F.lit(0) if model is None else model).cast("int"), *[column(f).cast("double") for f in features])
