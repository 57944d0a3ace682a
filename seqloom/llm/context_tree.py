"""Language-model scoring by context-tree weighting over bytes.

Every byte is decomposed into eight binary decisions. Each decision is predicted, at every context depth from none to
`DEPTH` bytes, by a Krichevsky-Trofimov estimate from the counts of the whole training corpus, and the depths are mixed by the
weights of the context tree. The result is a code length per byte; its negative sum is the log probability of a text.

Context bytes are folded to 32 classes (each letter its own), the coded byte is exact. The tree holds every context of the training
rows; none is left out. It lies in Spark: contexts that agree in the nearest `GROUP` bytes are weighed together, whole groups at a
time, and what they send up, at most 32,768 contexts per decision, is weighed per decision. The bytes in context that any row needs, those of
held-out rows with count zero, get their probability there. The most frequent of them, at most `HOT_GRAMS`, and of the words, at most
`HOT_WORDS`, go to the tasks as tables; all others meet their rows in a shuffle join. Words travel as 64-bit digests.

Defined results: a null text is the empty text, which is one end token; repeated rows are scored each; an empty table
gives no rows; with nothing to learn from every decision has probability one half and `base_score` falls back on an
even share; other columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER, crc_bucket, resting
from seqloom.session import place_by_rows, place_for_python, settle, spread

DEPTH, CLASSES = 6, 32
#: Nearest bytes in which the contexts of a group agree, so that a group has at most 32 ** 3 contexts and 256 times as many rows.
GROUP = 3
#: Rows of whole groups weighed at once.
GROUP_ROWS = 200_000
#: Bytes in context and words kept at hand in the tasks: 12 and 16 bytes each.
HOT_GRAMS, HOT_WORDS = 1 << 21, 1 << 18
#: Texts and bytes looked at together.
TEXTS, BYTES = 500, 2_000_000
#: The byte that ends a text and the filler in front of it; neither occurs in UTF-8.
_STOP, _FILL = 0xFF, 0xFE
END_WORD = xxhash.xxh64_intdigest(b"", 7)


def _class_of(byte: int) -> int:
    if byte >= 0xFE:
        return 0
    if 97 <= byte <= 122:
        return byte - 96
    if 48 <= byte <= 57:
        return 27
    if byte == 32 or 9 <= byte <= 13:
        return 28
    return 29 if byte < 128 else 30 if byte < 0xC0 else 31


_CLASS = np.array([_class_of(b) for b in range(256)], np.int32)


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with fillers, their classes, the places of coded bytes, and the end of each text among those."""
    fill = bytes([_FILL]) * DEPTH
    stream = np.frombuffer(b"".join(x for t in texts for x in (fill, t, b"\xff")), np.uint8)
    return stream, _CLASS[stream], np.flatnonzero(stream != _FILL), np.cumsum([len(t) + 1 for t in texts])


def _keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """`context * 256 + byte` of all coded bytes, nearest class in the lowest place, and the end of each text among them."""
    stream, classes, places, ends = _stream(texts)
    keys = stream.astype(np.int64)
    for back in range(1, DEPTH + 1):
        keys[back:] += classes[:-back].astype(np.int64) << (8 + 5 * (back - 1))
    return keys[places], ends


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts with their coded byte, nearest class in the lowest place, as `context * 256 + byte`, and their counts."""
    return np.unique(_keys(texts)[0], return_counts=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with their lower-cased texts, `TEXTS` rows or `BYTES` bytes and a text more."""
    for batch in batches:
        texts, start, size = batch.column("text").cast(pa.binary()), 0, 0
        for at, length in enumerate(pc.binary_length(texts).to_pylist(), 1):
            size += length
            if at == batch.num_rows or size >= BYTES or at - start >= TEXTS:
                yield batch.slice(start, at - start), [t.translate(LOWER) for t in texts.slice(start, at - start).to_pylist()]
                start, size = at, 0


class Tree:
    """Kept contexts: nodes in order of depth, the parent of each, and the child of each by class (`dead` where not kept)."""

    def __init__(self, depths: np.ndarray, contexts: np.ndarray):
        order = np.lexsort((contexts, depths))
        depths, contexts = depths[order], contexts[order]
        if not len(depths):
            depths, contexts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        n = len(depths)
        self.dead = n
        self.start = np.searchsorted(depths, np.arange(DEPTH + 2))
        self.parent = np.zeros(n, np.int64)
        self.child = np.full((n + 1, CLASSES), n, np.int32)
        for depth in range(1, DEPTH + 1):
            low, high = self.start[depth], self.start[depth + 1]
            above = contexts[self.start[depth - 1]:low]
            last = 5 * (depth - 1)
            self.parent[low:high] = self.start[depth - 1] + np.searchsorted(above, contexts[low:high] & ((1 << last) - 1))
            self.child[self.parent[low:high], contexts[low:high] >> last] = np.arange(low, high)

    def walk(self, classes: list[np.ndarray]) -> np.ndarray:
        """Deepest kept node of contexts given by their classes, the nearest first."""
        at = np.zeros(len(classes[0]), np.int32)
        best = at
        for one in classes:
            at = self.child[at, one]
            best = np.where(at == self.dead, best, at)
        return best


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _digest(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) - (1 << 63)


def _log_half(n: np.ndarray) -> np.ndarray:
    """log (1/2)(3/2)...(n-1/2), by table for small n and by Stirling's series above."""
    x = n + 0.5
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(0.5, 64.0)))))
    big = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3) - 0.5723649429247001
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], big)


def _log_fact(n: np.ndarray) -> np.ndarray:
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1.0, 64.0)))))
    x = n + 1.0
    big = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], big)


def _kt(n: np.ndarray) -> np.ndarray:
    return _log_half(n[..., 0]) + _log_half(n[..., 1]) - _log_fact(n.sum(axis=-1))


#: Decisions worked on at once; bounds the memory of the driver.
BLOCK = 8


def log_probabilities(tree: Tree, counts: np.ndarray) -> np.ndarray:
    """log10 probability of each byte after each kept context, `node * 256 + byte`.

    `counts[node, byte]` holds the bytes whose deepest kept context is the node.
    """
    n = tree.dead
    out = np.zeros((n, 256), np.float32)
    # Decisions of one depth of the byte (1, 2, 4, ... of them) are worked on together, `BLOCK` at a time.
    for bit in range(8):
        decisions = 1 << bit
        for low in range(0, decisions, BLOCK):
            high = min(decisions, low + BLOCK)
            one = _mixed_ones(tree, counts.reshape(n, decisions, 2, 128 >> bit)[:, low:high].sum(axis=3))
            view = out.reshape(n, decisions, 2, 128 >> bit)[:, low:high]
            for side, p in ((0, 1 - one), (1, one)):
                view[:, :, side, :] += np.log10(np.maximum(p, 1e-30))[..., None].astype(np.float32)
    return out.reshape(-1)


def _mixed_ones(tree: Tree, own: np.ndarray) -> np.ndarray:
    """Probability of a one after each node for `(nodes, decisions, 2)` counts, mixed over the node's path from the root."""
    total = own.copy()
    slices = [slice(tree.start[d], tree.start[d + 1]) for d in range(DEPTH + 1)]
    for here in slices[:0:-1]:
        np.add.at(total, tree.parent[here], total[here])
    inner = np.zeros(len(own), bool)
    inner[tree.parent[1:]] = True
    kt, rest = _kt(total), _kt(own)
    weight = np.ones(kt.shape)
    # Upward: a node's estimate against the product of those below it, the contexts not kept being one of them.
    for depth in range(DEPTH, -1, -1):
        here = slices[depth]
        mixed = np.logaddexp(kt[here], rest[here]) - np.log(2)
        mixed = np.where(inner[here, None], mixed, kt[here])
        weight[here] = np.where(inner[here, None], np.exp(kt[here] - np.log(2) - mixed), 1.0)
        if depth:
            np.add.at(rest, tree.parent[here], mixed)
    # Downward: the part of the estimate of each depth, and what is left for those below.
    guess = (total[..., 1] + 0.5) / (total.sum(axis=-1) + 1)
    one, left = weight * guess, 1 - weight
    for depth in range(1, DEPTH + 1):
        here = slices[depth]
        above = tree.parent[here]
        one[here] = one[above] + left[above] * one[here]
        left[here] *= left[above]
    return one + left * (own[..., 1] + 0.5) / (own.sum(axis=-1) + 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], np.concatenate([t for _, t in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(times, first)


def gather(docs: DataFrame) -> DataFrame:
    """`(kind, key, n)` per task and key: bytes in context (kind 0) and words (kind 1) of the `learn` rows of `docs`, and with n = 0 the
    bytes in context of the others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        texts = 0

        def send(kind: int, keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 200_000):
                yield _rows(kind, keys[at:at + 200_000], times[at:at + 200_000])

        for part, lowered in _chunks(batches):
            learn = part.column("learn").to_pylist()
            learned = [t for t, yes in zip(lowered, learn) if yes]
            asked = grams([t for t, yes in zip(lowered, learn) if not yes])[0]
            parts += [grams(learned), (asked, np.zeros(len(asked), np.int64))]
            for t in learned:
                words.update(t.split())
            texts += len(learned)
            if sum(len(k) for k, _ in parts) > 2_000_000:
                parts = [_merged(parts)]
                if len(parts[0][0]) > 1_500_000:
                    yield from send(0, *parts.pop())
            if len(words) > 600_000:
                yield from send(1, np.fromiter(map(_digest, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
                words = Counter()
        if parts:
            yield from send(0, *_merged(parts))
        if texts:
            yield _rows(1, np.array([END_WORD - (1 << 63)]), np.array([texts]))
        if words:
            yield from send(1, np.fromiter(map(_digest, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))

    return docs.select("text", "learn").mapInArrow(run, "kind int, key long, n long")


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of `GROUP_ROWS` rows or more that end where the value of the column changes, by which the rows are sorted."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= GROUP_ROWS:
            table = pa.Table.from_batches(held)
            values = table.column(column).to_numpy()
            cut = int(np.searchsorted(values, values[-1]))
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).to_batches(), len(table) - cut
    if held:
        yield pa.Table.from_batches(held)


def _turned(contexts: np.ndarray, depth: int) -> np.ndarray:
    """The classes of contexts in the opposite order."""
    out = np.zeros(len(contexts), np.int64)
    for place in range(depth):
        out = out << 5 | contexts >> 5 * place & 31
    return out


def _climbed(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray, mixed: np.ndarray, steps: int) -> list[dict]:
    """The nodes `x`, sorted `context * 256 + decision` with the nearest class in the highest place, and those of `steps` depths above."""
    levels = [{"x": x, "zeros": zeros, "ones": ones, "mixed": mixed}]
    for _ in range(steps):
        x, above = np.unique(x >> 13 << 8 | x & 255, return_inverse=True)
        zeros, ones, rest = (np.bincount(above, v, len(x)) for v in (zeros, ones, mixed))
        kt = _kt(np.stack([zeros, ones], axis=-1))
        mixed = np.logaddexp(kt, rest) - np.log(2)
        levels.append({"x": x, "zeros": zeros, "ones": ones, "mixed": mixed, "above": above,
                       "weight": np.exp(kt - np.log(2) - mixed), "left": np.exp(rest - np.log(2) - mixed)})
    return levels


def _descended(levels: list[dict], one: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of the probability of a one that the depths above the first level's nodes give, and what is left for those nodes."""
    for level in levels[:0:-1]:
        one = one + left * level["weight"] * (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        left = left * level["left"]
        one, left = one[level["above"]], left[level["above"]]
    return one, left


def _leaves(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[dict]]]:
    """For each of the eight decisions: the bit of every key, its place among the deepest nodes, and the nodes from there up to those of a group.

    `keys` are sorted, the nearest class in the highest place.
    """
    byte = keys & 255
    for place in range(8):
        bit = byte >> 7 - place & 1
        x = keys >> 8 << 8 | 1 << place | byte >> 8 - place
        first = np.concatenate(([True], x[1:] != x[:-1]))
        at = np.cumsum(first) - 1
        ones = np.bincount(at, n * bit)
        zeros = np.bincount(at, n * (1 - bit))
        yield bit, at, _climbed(x[first], zeros, ones, _kt(np.stack([zeros, ones], axis=-1)), DEPTH - GROUP)


def _by_context(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in the order of their contexts, nearest class first, their counts, and the keys as given."""
    given = table.column("key").to_numpy()
    keys = _turned(given >> 8, DEPTH) << 8 | given & 255
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order].astype(float), given[order]


def weigh(found: DataFrame) -> DataFrame:
    """`(key, n, p)`: log10 probability of every distinct byte in context `(key, n)`, n its count in training, by the whole tree."""
    rows = found.count()
    group = F.shiftright("key", 8).bitwiseAND((1 << 5 * GROUP) - 1).alias("g")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "g"):
            keys, n, _ = _by_context(table)
            for *_, levels in _leaves(keys, n):
                top = levels[-1]
                yield pa.RecordBatch.from_arrays([pa.array(_turned(top["x"] >> 8, GROUP)), pa.array(top["x"] & 255), *(pa.array(top[k]) for k in ("zeros", "ones", "mixed"))],
                                                 names=["g", "decision", "zeros", "ones", "mixed"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "decision"):
            g, decision, *counts = (table.column(c).to_numpy() for c in ("g", "decision", "zeros", "ones", "mixed"))
            x = _turned(g, GROUP) << 8 | decision
            order = np.argsort(x)
            levels = _climbed(x[order], *(v[order] for v in counts), GROUP)
            one, left = _descended(levels, np.zeros(len(levels[-1]["x"])), np.ones(len(levels[-1]["x"])))
            yield pa.RecordBatch.from_arrays([pa.array(g[order]), pa.array(decision[order]), pa.nulls(len(g), pa.int64()), pa.array(one), pa.array(left)],
                                             names=["g", "key", "n", "one", "left"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "g"):
            above = table.filter(pc.is_null(table.column("n")))
            x = _turned(above.column("g").to_numpy(), GROUP) << 8 | above.column("key").to_numpy()
            order = np.argsort(x)
            x, one, left = x[order], above.column("one").to_numpy()[order], above.column("left").to_numpy()[order]
            keys, n, given = _by_context(table.filter(pc.is_valid(table.column("n"))))
            p = np.zeros(len(keys))
            for bit, at, levels in _leaves(keys, n):
                place = np.searchsorted(x, levels[-1]["x"])
                here, rest = _descended(levels, one[place], left[place])
                leaf = levels[0]
                here = here + rest * (leaf["ones"] + 0.5) / (leaf["zeros"] + leaf["ones"] + 1)
                p += np.log10(np.where(bit == 1, here[at], 1 - here[at]))
            for start in range(0, len(given), 200_000):
                part = slice(start, start + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(given[part]), pa.array(n[part].astype(np.int64)), pa.array(p[part].astype(np.float32))], names=["key", "n", "p"])

    sent = place_by_rows(found.select(group, "key", "n"), rows, "g").sortWithinPartitions("g").mapInArrow(resting(up), "g long, decision long, zeros double, ones double, mixed double")
    tops = place_for_python(sent, "decision").sortWithinPartitions("decision").mapInArrow(resting(across), "g long, key long, n long, one double, left double")
    both = found.select(group, "key", "n", F.lit(None).cast("double").alias("one"), F.lit(None).cast("double").alias("left")).unionByName(tops)
    return place_by_rows(both, rows, "g").sortWithinPartitions("g").mapInArrow(resting(down), "key long, n long, p float")


def frequent(weighed: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys and log probabilities of the most frequent rows, whole classes of about equal counts, at most `HOT_GRAMS`; and whether these are all."""
    rank = F.floor(8 * F.log2(F.col("n") + 1)).alias("rank")
    sizes = sorted(weighed.groupBy(rank).agg(F.count("*").alias("rows")).collect(), reverse=True)
    reached = np.cumsum([r["rows"] for r in sizes])
    fit = int(np.searchsorted(reached, HOT_GRAMS, side="right"))
    hot = weighed.filter(rank >= F.lit(sizes[fit - 1]["rank"] if fit else 1 << 20)).select("key", "p").toArrow()
    keys = hot.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], hot.column("p").to_numpy()[order], fit == len(sizes)


def grow(found: DataFrame, nodes: int | None = None) -> tuple[Tree, np.ndarray]:
    """The tree of all contexts of a small table of `(key, n)` grams, or of the most frequent ones, and the log probabilities after them.

    In one process, to compare with: `score` weighs the whole tree by `weigh`.
    """
    contexts = found.groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum("n").alias("n"))
    each = contexts.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col("c").bitwiseAND((1 << (5 * d)) - 1).alias("c"), "n") for d in range(DEPTH + 1)])).alias("x"))
    kept = each.groupBy("x.d", "x.c").agg(F.sum("x.n").alias("n")).orderBy(F.desc("n"), "d", "c")
    kept = (kept if nodes is None else kept.limit(nodes)).toArrow()
    tree = Tree(kept.column("d").to_numpy().astype(np.int64), kept.column("c").to_numpy())
    given = found.toArrow()
    key, counts = given.column("key").to_numpy(), np.zeros((tree.dead, 256), np.int64)
    if len(key):
        np.add.at(counts, (tree.walk([key >> (8 + 5 * d) & 31 for d in range(DEPTH)]), key & 255), given.column("n").to_numpy())
    return tree, log_probabilities(tree, counts)


def _rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])


_TABLES: dict[str, tuple] = {}


def _unpacked(name: str, data: bytes) -> tuple:
    """The table of a run, unpacked once per worker."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = pickle.loads(zlib.decompress(data))
    return _TABLES[name]


def _looked_up(texts: list[bytes], gram: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, Iterator[list[dict]]]:
    """Per text the sum over its bytes in context that are at hand, and the others with their numbers."""
    keys, ends = _keys(texts)
    # Numbers of texts ride in the low bits, so that one plain sort serves both.
    bits = len(texts).bit_length()
    both = np.sort(keys << bits | np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)))
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    times = np.diff(first, append=len(both))
    key, text = both[first] >> bits, both[first] & (1 << bits) - 1
    new = np.concatenate(([True], key[1:] != key[:-1]))
    once, at = key[new], np.cumsum(new) - 1
    place = np.searchsorted(gram, once)
    place[place == len(gram)] = 0
    here = gram[place] == once if len(gram) else np.zeros(len(once), bool)
    p = np.zeros(len(once))
    p[here] = log_p[place[here]]
    sums = np.bincount(text, p[at] * times, len(texts))
    away = np.flatnonzero(~here[at])
    away = away[np.argsort(text[away], kind="stable")]
    cut = np.searchsorted(text[away], np.arange(len(texts) + 1))
    return sums, ([{"kind": 0, "key": k, "m": m} for k, m in zip(key[away[a:b]].tolist(), times[away[a:b]].tolist())] for a, b in zip(cut, cut[1:]))


def score(docs: DataFrame, modulus: int = 10, held: int = 0, smooth: float = 0.1) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)` for every row.

    Learns from the rows whose `crc32(doc_id)` modulo `modulus` is not `held`; a null id is held out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(crc_bucket("doc_id", modulus) != held, F.lit(False)))
    rows = spread(rows)
    totals = settle(gather(rows).groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = totals.filter("kind = 1").select("key", "n")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count("*").alias("distinct")).first()
    hot = words.orderBy(F.desc("n"), "key").limit(HOT_WORDS).toArrow()
    keys = hot.column("key").to_numpy()
    order = np.argsort(keys)
    everything = whole["distinct"] <= HOT_WORDS
    weighed = settle(weigh(totals.filter("kind = 0").select("key", "n")))
    gram, gram_p, complete = frequent(weighed)
    made = (np.diff(gram, prepend=0), gram_p, keys[order], hot.column("n").to_numpy()[order])
    # Differences of sorted keys pack well: the table is a fraction of its size on every disk it passes.
    table = spark.sparkContext.broadcast((uuid.uuid4().hex, zlib.compress(pickle.dumps(made), 1)))
    del made, gram, gram_p
    floor = np.log10(smooth / (whole["all"] + smooth * (whole["distinct"] + 1)))
    norm = np.log10(whole["all"] + smooth * (whole["distinct"] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, log_p, known_key, known_n = _unpacked(*table.value)
        gram = np.cumsum(steps)
        value = np.log10(known_n + smooth) - norm
        place = dict(zip(known_key.tolist(), range(len(known_key))))
        seen: dict[bytes, int] = {}
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        end = place.get(END_WORD - (1 << 63), -1)
        for part, texts in _chunks(batches):
            sums, cold_grams = _looked_up(texts, gram, log_p)
            base, known, tokens, cold = [], [], [], []
            for text in texts:
                found = text.split()
                places = np.fromiter(map(seen.get, found, repeat(-2)), np.int64, len(found))
                late: Counter = Counter()
                for i in np.flatnonzero(places == -2).tolist():
                    key = _digest(found[i])
                    at = place.get(key, -1)
                    if len(seen) < 400_000:
                        seen[found[i]] = at
                    places[i] = at
                for i in np.flatnonzero(places == -1).tolist():
                    late[_digest(found[i])] += 1
                good = places[places >= 0]
                b, k = float(value[good].sum()), len(good)
                if end >= 0:
                    b, k = b + float(value[end]), k + 1
                else:
                    late[END_WORD - (1 << 63)] += 1
                if everything:
                    b += floor * sum(late.values())
                    late.clear()
                base.append(b)
                known.append(k)
                tokens.append(len(found) + 1)
                cold.append([{"kind": 1, "key": x, "m": m} for x, m in late.items()] + next(cold_grams))
            n = len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + n)), part.column("doc_id"), part.column("learn"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                pa.array(base, pa.float64()), pa.array(sums, pa.float64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array(cold, pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("m", pa.int64())])))],
                names=["row", "doc_id", "learn", "n_tokens", "n_known", "base", "score", "bytes", "cold"])
            number += n

    schema = "row long, doc_id long, learn boolean, n_tokens long, n_known long, base double, score double, bytes long, cold array<struct<kind:int,key:long,m:long>>"
    scored = settle(rows.select("doc_id", "text", "learn").mapInArrow(run, schema))
    rare = words.select(F.lit(1).alias("kind"), "key", "n", F.lit(0.0).alias("p"))
    if not complete:
        rare = rare.union(weighed.select(F.lit(0), "key", "n", F.col("p").cast("double")))
    late = scored.select("row", F.explode("cold").alias("c")).select("row", "c.*")
    late = late.join(rare, ["kind", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    word = F.col("kind") == 1
    late = late.groupBy("row").agg(F.sum(F.when(word, F.col("m") * (F.log10(F.col("n") + smooth) - F.lit(float(norm))))).alias("late_base"),
                                   F.sum(F.when(word & (F.col("n") > 0), F.col("m")).otherwise(0)).alias("late_known"),
                                   F.sum(F.when(~word, F.col("m") * F.col("p"))).alias("late_score"))
    out = scored.drop("cold").join(late, "row", "left").withColumn("score", F.col("score") + F.coalesce("late_score", F.lit(0.0)))
    return out.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(int(whole["all"])).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("late_base", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("bytes") + 1)).alias("bits_per_byte"))
