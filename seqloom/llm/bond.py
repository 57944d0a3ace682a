"""Hard negatives by a vertical scan: vectors lie column by column, each anchor reads the columns of its largest values first.

Rows are packed into blocks of `BLOCK_ROWS`, sorted by label, one contiguous array per dimension with its least and greatest
value. Anchors are packed into chunks of `CHUNK_ANCHORS`. Every chunk meets every block once (a stated query set against all
rows, in blocks). In such a tile an anchor keeps a bitmap of candidates and their partial scores. After every `STRIDE` dimensions, in order of
descending |anchor value|, the dimensions not yet read can add at most the sum of max(a*min, a*max) and at least that of min(a*min, a*max);
candidates that cannot reach what is asked for leave the bitmap. Two passes:

1. positives: rows of the anchor's label. A candidate leaves when its greatest possible score is below the k-th greatest of the least
   possible ones; a tile gives the k + 1 best, the merge the k best other rows.
2. negatives: rows of other labels. Every positive asks for a window of scores; a candidate leaves when its possible scores meet no window, or
   lie below the n-th greatest sure score of every window they meet. What is left when all dimensions are read is resolved exactly.

Scores are whole numbers and exact: float32 or float64 sums are used only where no partial sum can leave their whole-number range,
else Python integers.

Defined results: a row with a null label, a null vector, or any null or non-finite component takes no part; missing trailing components count
as zero; an empty vector scores zero; a null id is no anchor, has its label as it is, and comes last among ties; rows with equal ids
are rows of their own, and an anchor's other rows are all but one row of its id and its own score; an empty table gives no rows; a
score beyond the range of long saturates; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import settle

#: Rows of a block, anchors of a chunk, dimensions read between two looks at the bitmap.
BLOCK_ROWS, CHUNK_ANCHORS, STRIDE = 8_192, 1_024, 8
_NO_ID = np.iinfo(np.int64).max
_LONG = np.iinfo(np.int64)
_PACKED = "block long, n long, dims long, ids binary, no_id binary, labels binary, cells binary"


def prepared(vectors: DataFrame, shift_every: int = 7, labels: int = 10, scale: float = 256.0) -> DataFrame:
    """`(vec_id, label, q)`: rows that take part, labels shifted, components as whole numbers in double."""
    v = F.col("embedding")
    sound = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.coalesce(F.col("vec_id") % shift_every == 0, F.lit(False)), (label + 1) % labels).otherwise(label)
    # FLOOR gives a long, which a huge component would leave; such a double is whole already.
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**52, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), whole.alias("q"))


def pack(rows: DataFrame, per_block: int, by_label: bool) -> DataFrame:
    """Blocks of at most `per_block` rows; the number of a block is unique."""
    schema = _PACKED
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def block(part: int, number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        ids = table.column("vec_id")
        none = ids.is_null().to_numpy()
        ids = ids.fill_null(_NO_ID).to_numpy()
        labels = table.column("label").to_numpy()
        lists = table.column("q").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        dims = int(sizes.max(initial=0))
        cells = np.zeros((len(ids), dims))
        cells[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
        order = np.lexsort((ids, labels)) if by_label else np.arange(len(ids))
        make = lambda x, kind: np.ascontiguousarray(x, dtype=kind).tobytes()
        wide = cells[order].T  # one run per dimension
        narrow = "<i2" if np.abs(wide).max(initial=0) < 2**15 else "<f8"
        packed = [(part << 32) + number, len(ids), dims, make(ids[order], "<i8"), make(none[order], "u1"), make(labels[order], "<i8"), narrow.encode() + make(wide, narrow)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(packed, fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, per_block - n)
                held, n, b = [*held, take], n + take.num_rows, b.slice(take.num_rows)
                if n == per_block:
                    yield block(part, number, held)
                    held, n, number = [], 0, number + 1
        if n:
            yield block(part, number, held)

    return rows.select("vec_id", "label", "q").mapInArrow(run, schema)


class Block:
    """One packed block as arrays; `cells[d]` is dimension d of all rows."""

    def __init__(self, n: int, dims: int, ids: bytes, no_id: bytes, labels: bytes, cells: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.no_id = np.frombuffer(no_id, "u1").astype(bool)
        self.whole = np.frombuffer(cells, cells[:3].decode(), offset=3).reshape(dims, n)
        self.n, self.dims = n, dims
        self.low, self.high = self.whole.min(1), self.whole.max(1)
        self.forms: dict[type, np.ndarray] = {}

    def columns(self, dims: int, kind: type) -> np.ndarray:
        """The first `dims` columns as numbers of one kind, absent ones zero."""
        if kind not in self.forms or len(self.forms[kind]) < dims:
            out = np.zeros((dims, self.n), dtype=kind)
            have = self.whole[:dims]
            if kind is object:
                have = np.array([[int(x) for x in row] for row in have.tolist()], dtype=object).reshape(have.shape)
            out[:len(have)] = have
            self.forms[kind] = out
        return self.forms[kind]

    def bounds(self, dims: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(dims), np.zeros(dims)
        k = min(dims, self.dims)
        low[:k], high[:k] = self.low[:k], self.high[:k]
        return low, high


class Scan:
    """Vertical scan of a block's rows `[start, stop)` for one anchor: a bitmap of candidates, partial scores, and what the rest can add.

    While half of the rows or more are candidates, whole stretches of columns are read; then the bitmap becomes a list of rows.
    """

    def __init__(self, block: Block, anchor: np.ndarray, start: int, stop: int):
        dims = max(block.dims, len(anchor))
        a = np.zeros(dims)
        a[:len(anchor)] = anchor
        low, high = block.bounds(dims)
        reach = float(np.abs(a) @ np.maximum(np.abs(low), np.abs(high)))
        self.kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
        self.order = np.argsort(-np.abs(a), kind="stable")
        self.order = self.order[:int(np.count_nonzero(a))]  # zero components add nothing
        exact = (lambda x: np.array([int(v) for v in x], dtype=object)) if self.kind is object else (lambda x: x)
        a, low, high = exact(a), exact(low), exact(high)
        self.anchor = a if self.kind is object else a.astype(self.kind)
        least, most = np.minimum(a * low, a * high)[self.order], np.maximum(a * low, a * high)[self.order]
        # What the dimensions from place k on can add.
        self.least = np.append(np.cumsum(least[::-1])[::-1], 0)
        self.most = np.append(np.cumsum(most[::-1])[::-1], 0)
        self.cells = block.columns(dims, self.kind)[:, start:stop]
        self.rows = np.arange(start, stop)
        self.listed = None  # places of the rows in `cells` once the bitmap is sparse
        self.bitmap = np.ones(stop - start, dtype=bool)
        self.partial = np.zeros(stop - start, dtype=self.kind)
        self.at = 0

    def step(self) -> None:
        """Read the next dimensions of the rows left."""
        d = self.order[self.at:self.at + STRIDE]
        part = self.cells[d] if self.listed is None else self.cells[d[:, None], self.listed[None, :]]
        self.partial = self.partial + self.anchor[d] @ part
        self.at += len(d)

    def keep(self, left: np.ndarray, whole: bool = False) -> None:
        self.bitmap &= left
        n = int(np.count_nonzero(self.bitmap))
        if n < len(self.bitmap) and (whole or 2 * n < len(self.bitmap)):
            places = np.flatnonzero(self.bitmap)
            self.listed = places if self.listed is None else self.listed[places]
            self.rows, self.partial, self.bitmap = self.rows[places], self.partial[places], self.bitmap[places]

    @property
    def done(self) -> bool:
        return self.at >= len(self.order) or not len(self.rows)

    def best(self, k: int) -> None:
        """Rows that may be among the k best; all scores are exact afterwards."""
        while not self.done:
            self.step()
            if len(self.rows) > k:
                sure = _kth(self.partial, k) + self.least[self.at]
                self.keep(self.partial + self.most[self.at] >= sure)
        self.keep(self.bitmap, whole=True)

    def windows(self, low: list, high: list, k: int) -> None:
        """Rows whose score lies in a window and may be among its k best; all scores are exact afterwards."""
        floor = list(low)
        while not self.done:
            self.step()
            less, more = self.least[self.at], self.most[self.at]
            left = self.bitmap & (self.partial >= min(floor) - more) & (self.partial <= max(high) - less)
            if 2 * np.count_nonzero(left) < len(left):
                # Few enough: look at each window, and at the k-th of the scores that surely lie in it.
                meets = np.zeros(len(left), dtype=bool)
                for i, (lo, hi) in enumerate(zip(low, high)):
                    sure = self.partial[left & (self.partial >= lo - less) & (self.partial <= hi - more)]
                    if len(sure) >= k:
                        floor[i] = max(floor[i], _kth(sure, k) + less)
                    meets |= (self.partial >= floor[i] - more) & (self.partial <= hi - less)
                left &= meets
            self.keep(left)
        self.keep(self.bitmap, whole=True)


def _kth(x: np.ndarray, k: int):
    """The k-th greatest value."""
    if x.dtype == object:
        return sorted(x)[-k]
    return np.partition(x, len(x) - k)[len(x) - k]


def _whole(x) -> int:
    return int(min(max(int(x), _LONG.min), _LONG.max))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _tiles(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every chunk of anchors next to every block of rows, one pair in a row.

    Blocks are dealt to a fixed number of places by their number, every chunk is copied to each place.
    """
    context = chunks.sparkSession
    n = max(int(context.conf.get("spark.sql.shuffle.partitions")), context.sparkContext.defaultParallelism)
    at = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(n))
    dealt = blocks.select(at.alias("place"), F.struct(*blocks.columns).alias("b"))
    asked = chunks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("place"), F.struct(*chunks.columns).alias("c"))
    return dealt.repartition(n, "place").join(asked.repartition(n, "place"), "place").select("c", "b")


def _each(tiles: DataFrame, schema: str, look) -> DataFrame:
    """`look(chunk, anchors, block)` yields result rows of one tile; the block's arrays are made once for tiles in a row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                c, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if b["block"] != number:
                    number, block = b["block"], Block(b["n"], b["dims"], b["ids"], b["no_id"], b["labels"], b["cells"])
                anchors = Block(c["n"], c["dims"], c["ids"], c["no_id"], c["labels"], c["cells"])
                rows = list(look(c, anchors, block))
                columns = list(zip(*rows)) if rows else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, fields)], schema=fields)

    return tiles.mapInArrow(run, schema)


_FOUND = "chunk long, anchor long, anchor_id long, own long, vec_id long, score long"


def positives(chunks: DataFrame, blocks: DataFrame, k: int = 5) -> DataFrame:
    """`(chunk, anchor, anchor_id, positives)`: the k best other rows of each anchor's label, as `(rank, vec_id, score)` in order."""

    def look(c, anchors, block):
        for i in range(anchors.n):
            a = np.asarray(anchors.whole[:, i], dtype=float)
            label = anchors.labels[i]
            start, stop = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, "right")
            if start == stop:
                continue
            scan = Scan(block, a, start, stop)
            scan.best(k + 1)
            own = sum(int(x) ** 2 for x in a.tolist())
            for j in top(scan.partial, block.ids[scan.rows], k + 1):
                at = scan.rows[j]
                yield c["block"], i, int(anchors.ids[i]), _whole(own), None if block.no_id[at] else int(block.ids[at]), _whole(scan.partial[j])

    found = _each(_tiles(chunks, blocks), _FOUND, look)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "anchor").orderBy(*order))).filter(F.col("rank") <= k + 1)
    best = ranked.groupBy("chunk", "anchor", "anchor_id", "own").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # k + 1 entries
    # The anchor itself: one row of its id and its own score.
    own = F.array_min(F.transform("p", lambda x: F.when((x["vec_id"] == F.col("anchor_id")) & (x["score"] == F.col("own")), x["rank"])))
    best = best.withColumn("_own", own).withColumn("p", F.filter("p", lambda x: F.col("_own").isNull() | (x["rank"] != F.col("_own"))))
    return best.select("chunk", "anchor", "anchor_id", F.slice("p", 1, k).alias("positives")).filter(F.size("positives") > 0)


def negatives(chunks: DataFrame, blocks: DataFrame, found: DataFrame, n: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """The n best rows of another label in the window of every positive: `low` to `high` per cent of its score."""
    asked = found.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "positives")).alias("asked"))  # one chunk of anchors
    both = chunks.join(asked, chunks["block"] == asked["chunk"]).drop("chunk")

    def look(c, anchors, block):
        for ask in c["asked"]:
            i = ask["anchor"]
            scores = [p["score"] for p in ask["positives"]]
            # low * s <= 100 * x <= high * s in whole numbers.
            lo, hi = [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]
            places = [w for w in range(len(scores)) if lo[w] <= hi[w]]
            if not places:
                continue
            label = anchors.labels[i]
            scan = Scan(block, np.asarray(anchors.whole[:, i], dtype=float), 0, block.n)
            scan.keep(block.labels != label)
            scan.windows([lo[w] for w in places], [hi[w] for w in places], n)
            ids = block.ids[scan.rows]
            for w in places:
                inside = np.flatnonzero((scan.partial >= lo[w]) & (scan.partial <= hi[w]))
                for j in inside[top(scan.partial[inside], ids[inside], n)]:
                    at = scan.rows[j]
                    yield c["block"], i, int(anchors.ids[i]), w, None if block.no_id[at] else int(block.ids[at]), _whole(scan.partial[j])

    cells = _each(_tiles(both, blocks), "chunk long, anchor long, anchor_id long, place long, negative_id long, negative_score long", look)
    order = [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last()]
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "anchor", "place").orderBy(*order))).filter(F.col("rank") <= n)
    sides = found.select("chunk", "anchor", F.posexplode("positives").alias("place", "p"))
    return ranked.join(sides, ["chunk", "anchor", "place"]).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), "negative_score")


def mine(rows: DataFrame, is_anchor: Column, k: int = 5, n: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives `(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)` of the anchors among `rows`."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Small files make small blocks; fewer partitions, at least one per core, fill them.
    rows = rows.coalesce(max(cores, -(-rows.count() // BLOCK_ROWS)))
    blocks = settle(pack(rows, BLOCK_ROWS, by_label=True))
    asked = rows.filter(F.coalesce(is_anchor, F.lit(False)))
    chunks = settle(pack(asked.coalesce(max(1, -(-asked.count() // CHUNK_ANCHORS))), CHUNK_ANCHORS, by_label=False))
    found = settle(positives(chunks, blocks, k))
    return negatives(chunks, blocks, found, n, low, high)
