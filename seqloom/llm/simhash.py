"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Fingerprints that differ in at most `distance` bits are linked and linked documents form components. With
`distance + 2` blocks of bits two blocks are equal in any such pair, so each fingerprint is routed once per pair of
blocks. Inside a route the fingerprints are sorted by Gray rank; runs of neighbours become nodes that keep the bits
their members share, nodes become nodes of a higher level, and a pair of nodes is given up as soon as the
differences in the bits both share exceed the distance.

The operator over similarity (`similar_classes`, `keep_first`) takes the linked fingerprints as its first candidates. 64 bits of all shingles
tell texts of similarity 0.8 from others only at distances that no index prunes, so the pairs further apart are found by joining
shingle sets by prefix filtering; every candidate is then checked.

Defined results: a null or empty text has no words and fingerprint zero, and is linked like any other; repeated
rows stay, each with the same component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import LOWER, id_text, join_heavy, map_texts, min_label, resting, union_all
from seqloom.session import settle, spread

FAN = 8
#: Node pairs looked at together; bounds the memory of the search.
PAIRS = 200_000
#: Members above which a route is dealt anew by pairs of smaller blocks.
HOT_ROUTE = 20_000


def fingerprint(text: bytes, width: int = 3, bits_at: int = 500_000) -> int:
    """64-bit fingerprint over the `width`-word shingles of the lower-cased text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, bits_at):
        stop = min(n, at + bits_at)
        pairs = zip(starts[at:stop].tolist(), ends[at + width - 1:stop + width - 1].tolist())
        h = np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, stop - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """`(doc_id, fp)`, the fingerprint as a signed long."""
    def each(ids, texts):
        found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
        return {"doc_id": ids, "fp": found}

    return map_texts(spread(id_text(docs)), "doc_id long, fp long", each)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _merge(labels: np.ndarray, u: np.ndarray, v: np.ndarray, used: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest label of each component after adding the edges u-v; labels point at smaller items.

    `used` receives the edges that joined two components, fewer than there are items.
    """
    while True:
        a, b = labels[u], labels[v]
        open_ = a != b
        if not open_.any():
            return labels
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(labels, high, low)
        took = np.flatnonzero(labels[high] == low)
        took = took[np.unique(high[took], return_index=True)[1]]
        used.append((u[took], v[took]))
        while True:
            hop = labels[labels]
            if np.array_equal(hop, labels):
                break
            labels = hop


def linked_items(route: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the items and, along it, the first item of each local component.

    `route` holds a group number per item; only items of one route are compared.
    """
    return linked_pairs(route, codes, distance)[:2]


def linked_pairs(route: np.ndarray, codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and pairs of items along the order that are themselves within the distance and join each component."""
    order = np.lexsort((gray_rank(codes), route))
    route, codes = route[order], codes[order]
    n = len(codes)
    labels = np.arange(n)
    used = [(labels[:0], labels[:0])]
    if n < 2:
        return order, labels, *used[0]
    # Levels from the fingerprints upward: bits that are one in all members, bits that are one in any, first member, owner.
    levels = [(codes, codes, np.arange(n + 1), route, np.arange(n + 1))]
    while True:
        all_, any_, first, own, _ = levels[-1]
        change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        if len(change) == len(own):
            break
        place = np.arange(len(own)) - np.repeat(change, np.diff(np.append(change, len(own))))
        heads = np.flatnonzero(place % FAN == 0)
        levels.append((np.bitwise_and.reduceat(all_, heads), np.bitwise_or.reduceat(any_, heads), np.append(first[heads], n),
                       own[heads], np.append(heads, len(own))))
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    sizes = np.diff(levels[top][2])
    roots = roots[sizes > 1]
    work = [(top, roots, roots)]
    while work:
        level, a, b = work.pop()
        if len(a) > PAIRS:
            work += [(level, a[i:i + PAIRS], b[i:i + PAIRS]) for i in range(0, len(a), PAIRS)]
            continue
        all_, any_, first, _, kids = levels[level]
        fixed = ~(all_[a] ^ any_[a]) & ~(all_[b] ^ any_[b])
        differ = (all_[a] ^ all_[b]) & fixed
        keep = np.bitwise_count(differ) <= distance
        a, b, fixed, differ = a[keep], b[keep], fixed[keep], differ[keep]
        if not len(a):
            continue
        if level == 0:
            real = a != b
            labels = _merge(labels, a[real], b[real], used)
            continue
        # All members of both nodes are near each other: one chain links them, no pair is looked at.
        near = np.bitwise_count(~fixed | differ) <= distance
        if near.any():
            low, high = first[a[near]], first[a[near] + 1]
            low2, high2 = first[b[near]], first[b[near] + 1]
            for s, e in ((low, high), (low2, high2)):
                size = e - s
                member = np.repeat(s, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                labels = _merge(labels, np.repeat(low, size), member, used)
            a, b = a[~near], b[~near]
        # Nodes whose members already share a component have nothing left to find.
        if len(a):
            least = np.minimum.reduceat(labels, first[:-1])
            most = np.maximum.reduceat(labels, first[:-1])
            done = (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])
            a, b = a[~done], b[~done]
        if not len(a):
            continue
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        count = na * nb
        pair = np.repeat(np.arange(len(a)), count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ka = kids[a][pair] + inner // nb[pair]
        kb = kids[b][pair] + inner % nb[pair]
        once = (a[pair] != b[pair]) | (ka <= kb)
        work.append((level - 1, ka[once], kb[once]))
    return order, labels, *(np.concatenate([x[k] for x in used]) for k in (0, 1))


def _block_masks(bits: list[int], blocks: int) -> list[int]:
    """Masks that cover every pair of `blocks` nearly equal runs of the given bit places."""
    runs = [run.tolist() for run in np.array_split(np.array(bits), blocks)]
    masks = [sum(1 << place for place in run) for run in runs]
    return [x | y for x, y in combinations(masks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(codes: DataFrame, distance: int = 3, direct: bool = False) -> DataFrame:
    """Edges `(a, b)` that join all distinct fingerprints `fp` reachable within `distance`, fewer per route than it has members.

    They point at the first member of a component or, if `direct`, join fingerprints that are themselves within the distance.
    """
    blocks = distance + 2
    masks = _block_masks(list(range(64)), blocks)
    routed = codes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("r")).select("fp", "r.*")
    counts = routed.groupBy("t", "k").agg(F.count("*").alias("members"))
    routed = settle(routed.join(counts.filter("members > 1"), ["t", "k"]))
    plain = routed.filter(F.col("members") <= HOT_ROUTE).select("fp", F.xxhash64("t", "k").alias("route"), F.lit(-1).alias("s"))
    frames = [plain]
    # Without a crowded route there is nothing to deal anew, and every branch would cost a task per partition.
    crowded = not routed.filter(F.col("members") > HOT_ROUTE).isEmpty()
    for i, mask in enumerate(masks if crowded else []):
        rest = [place for place in range(64) if not mask >> place & 1]
        subs = _block_masks(rest, blocks)
        frames.append(routed.filter((F.col("members") > HOT_ROUTE) & (F.col("t") == i)).select("fp", "t", "k", F.explode(F.array(*[
            F.struct(F.lit(j).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("j")) for j, m in enumerate(subs)])).alias("r"))
            .select("fp", F.xxhash64("t", "k", "r.s", "r.j").alias("route"), "r.s"))
    spark = codes.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        fp = table.column("fp").to_numpy().view(np.uint64)
        _, route = np.unique(table.column("route").to_numpy(), return_inverse=True)
        order, labels, u, v = linked_pairs(route, fp, distance)
        fp = fp[order].view(np.int64)
        if not direct:
            u = np.flatnonzero(labels != np.arange(len(labels)))
            v = labels[u]
        for start in range(0, len(u), 100_000):
            part = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(fp[u[part]]), pa.array(fp[v[part]])], names=["a", "b"])

    # Routes are compared by a 64-bit digest of their bits: two that share a digest only add comparisons.
    return union_all(frames).select("fp", "route").repartition(n, "route").mapInArrow(resting(run), "a long, b long")


def components(docs: DataFrame, width: int = 3, distance: int = 3) -> DataFrame:
    """`(doc_id, fp, component_id)` for every row; the component is named by its smallest document id."""
    stored = settle(fingerprints(docs, width))
    codes = settle(stored.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = min_label(links(codes, distance)).withColumnRenamed("node", "fp")
    named = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = settle(named.join(first, "root").select("fp", "copies", "component_id"))
    return join_heavy(stored, classes.select("fp", "component_id"), classes.select("fp", "copies"), "fp", "copies")


#: Texts of candidate pairs up to which their keys are sent to all tasks; more are joined, with the same result.
FEW_TEXTS = 500_000
#: Smallest digests kept of a text; a pair that shares under three eighths of those of its union is far from similar. Of pairs at 0.8 one in 10^12 does.
SKETCH = 64
#: One text in so many has its shingles counted, at every size of the table, and shingles taken for frequent. Both only set an order of the shingles.
COUNTED, FREQUENT = 2, 1_000_000
#: Members of a list compared with all others at once, and members of a block of a longer list.
SHORT_LIST, BLOCK = 8, 2_000
#: Before all pairs of a long list: at most so many times, its members outside the largest component meet so many others.
ROUNDS, PARTNERS = 3, 48
#: Bits that hold the parities of a set's digests. Sets differ in at least as many digests as their parities do in bits.
PARITIES = 1_024
_MIX = np.random.default_rng(8).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


def shingle_digests(text: bytes, width: int) -> tuple[int, np.ndarray]:
    """Digest of the whole word sequence, and the distinct digests of its shingles in order."""
    words = text.translate(LOWER).split()
    joined = b" ".join(words)
    whole = xxhash.xxh64_intdigest(joined, 7)
    if not words:
        return whole, np.zeros(0, np.uint64)
    if len(words) <= width:
        return whole, np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1:].tolist()))
    return whole, np.fromiter(found, np.uint64, len(starts))


def _least(x: np.ndarray) -> np.ndarray:
    """Smallest whole number not below x, safe against rounding."""
    return np.ceil(x - 1e-9).astype(np.int64)


def possible(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles can be similar if the first one they share is at places i and j of their orders."""
    return (np.minimum(n, m) >= _least(similarity * np.maximum(n, m))) & (np.minimum(n - i, m - j) >= _least(similarity / (1 + similarity) * (n + m)))


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """`(seq, shingles)` of rows `(key, text)`: digest of the word sequence and distinct shingle digests. Not stored: they outgrow the texts."""
    def each(ids, texts):
        found = [shingle_digests(t, width) for t in texts]
        return {"seq": np.array([w for w, _ in found], np.uint64).view(np.int64), "shingles": [np.unique(v).view(np.int64) for _, v in found]}

    return map_texts(spread(rows), "seq long, shingles array<long>", each)


def frequent(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in a sample of the texts, in order of their digests, and how often."""
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0)
    counts = shingle_sets(sample, width).select(F.explode("shingles").alias("k")).groupBy("k").count()
    table = counts.filter("count >= 8").orderBy(F.desc("count"), "k").limit(FREQUENT).toArrow()
    keys, times = (table.column(c).to_numpy() for c in ("k", "count"))
    order = np.argsort(keys)
    return keys[order], times[order]


def prefixes(rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """`(token, seq, n, place)`: the first shingles of each text, in an order common to all that puts frequent ones last.

    Of n shingles so many are taken that two texts of the given similarity have the first shingle they share among them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent(rows, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                _, once = np.unique(part.column("seq").to_numpy(), return_index=True)
                part = part.take(pa.array(once))
                seq, lists = part.column("seq").to_numpy(), part.column("shingles")
                flat, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                weight = np.zeros(len(flat), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
                    weight = np.where(keys[at] == flat, times[at], 0)
                order = np.lexsort((flat, weight, row))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                took = place < (n - _least(similarity * n) + 1)[row]
                columns = flat[order[took]], seq[row[took]], n[row[took]], place[took]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "seq", "n", "place"])

    return shingle_sets(rows, width).mapInArrow(resting(run), "token long, seq long, n long, place long")


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def first_pairs(tokens: DataFrame, similarity: float) -> DataFrame:
    """Rows `(token, a, b, n, place)` from the lists of texts that share a token.

    A short list gives all its pairs `(a, b)`, a longer one those with three representatives and, with a null b, its
    members, for the pairs left over.
    """
    spark = tokens.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        token, seq, n, place = (table.column(c).to_numpy() for c in ("token", "seq", "n", "place"))
        order = np.lexsort((seq, token))
        token, seq, n, place = token[order], seq[order], n[order], place[order]
        once = np.concatenate(([True], (token[1:] != token[:-1]) | (seq[1:] != seq[:-1])))
        token, seq, n, place = token[once], seq[once], n[once], place[once]
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(starts, len(token)))
        members = np.repeat(sizes, sizes)
        found = []
        for step in range(1, SHORT_LIST):
            at = np.flatnonzero((token[step:] == token[:-step]) & (members[step:] <= SHORT_LIST)) if len(token) > step else np.zeros(0, np.int64)
            found.append((at, at + step))
        long = np.flatnonzero(members > SHORT_LIST)
        for mix in (None, *_MIX):
            by = seq[long] if mix is None else seq[long].view(np.uint64) * mix
            heads = np.lexsort((by, token[long]))
            edge = np.flatnonzero(np.concatenate(([True], token[long][1:] != token[long][:-1]))) if len(long) else np.zeros(0, np.int64)
            head = np.repeat(long[heads[edge]], np.diff(np.append(edge, len(long))))
            found.append((long, head))
        x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        good = (x != y) & possible(n[x], place[x], n[y], place[y], similarity)
        a, b = _sorted_pairs(seq[x[good]], seq[y[good]])
        names = ["token", "a", "b", "n", "place"]
        for start in range(0, len(a), 100_000):
            part = slice(start, start + 100_000)
            k = len(a[part])
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(a[part]), pa.array(b[part]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        for start in range(0, len(long), 100_000):
            part = long[start:start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(seq[part]), pa.nulls(len(part), pa.int64()), pa.array(n[part]), pa.array(place[part])], names=names)

    return tokens.repartition(n_parts, "token").mapInArrow(resting(run), "token long, a long, b long, n long, place long")


def parities(shingles: np.ndarray) -> bytes:
    return np.packbits(np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def fingerprint_pairs(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs `(a, b)` of the classes `(seq, fp)`: equal fingerprints, each with the least class of its fingerprint, and the linked ones of the index."""
    heads = settle(classes.groupBy("fp").agg(F.min("seq").alias("head"), F.count("*").alias("members")))
    equal = classes.join(heads.filter("members > 1"), "fp").select(F.col("head").alias("a"), F.col("seq").alias("b"))
    found = links(heads.select("fp"), distance, direct=True).distinct()
    found = found.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    pairs = equal.union(found.select("x", "y")).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def more_pairs(lists: DataFrame, roots: DataFrame, similarity: float, round_: int) -> DataFrame:
    """Possible pairs `(a, b)` of different roots that members outside the largest component of a list make with `PARTNERS` others.

    Their number is that of the members. The others are the first of the list in an order of the round's, the same in all lists.
    """
    named = lists.join(roots.toDF("a", "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    open_lists = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    named = named.join(open_lists.select("token"), "token", "left_semi").select("token", "a", "n", "place", "root")
    mix = np.random.default_rng(80 + round_).integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        token, a, n, place, root = (table.column(c).to_numpy() for c in ("token", "a", "n", "place", "root"))
        order = np.lexsort((a.view(np.uint64) * mix, token))
        token, a, n, place, root = token[order], a[order], n[order], place[order], root[order]
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(edge, len(token)))
        number = np.repeat(np.arange(len(edge)), sizes)
        by = np.lexsort((root, number))
        heads = np.flatnonzero(np.concatenate(([True], (number[by][1:] != number[by][:-1]) | (root[by][1:] != root[by][:-1]))))
        held_by = np.diff(np.append(heads, len(by)))
        rank = np.lexsort((held_by, number[by][heads]))
        last = np.flatnonzero(np.concatenate((np.diff(number[by][heads][rank]) > 0, [True])))
        largest = root[by][heads][rank[last]]
        x = np.flatnonzero(root != largest[number])
        for step in range(PARTNERS):
            one = x[step < sizes[number[x]]]
            y = edge[number[one]] + step
            good = (root[one] != root[y]) & possible(n[one], place[one], n[y], place[y], similarity)
            if good.any():
                low, high = _sorted_pairs(a[one[good]], a[y[good]])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    spark = lists.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return named.repartition(n_parts, "token").mapInArrow(resting(run), "a long, b long").distinct()


def left_pairs(lists: DataFrame, roots: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """All possible pairs `(a, b)` of members of the long lists `(token, a, n, place)` that have different roots.

    Lists of one root are settled. Others are cut into blocks, and every pair of blocks is compared in a place of its own. Pairs whose
    parities, rows `(a, marks)`, differ in more bits than similar sets do in shingles go no further; their number alone grows with the square.
    """
    named = lists.join(roots.toDF("a", "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    open_lists = named.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    cut = named.join(open_lists.select("token", F.ceil(F.col("members") / BLOCK).alias("blocks")), "token").join(marks, "a")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("a"), "blocks"))
    cut = cut.select("token", "a", "n", "place", "root", "marks", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("token", "a", "n", "place", "root", "marks", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("token", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        token, a, n, place, root, own, lo, hi = (table.column(c).to_numpy() for c in ("token", "a", "n", "place", "root", "own", "lo", "hi"))
        bits = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint64).reshape(len(a), PARITIES // 64)
        edge = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        for start, stop in zip(edge.tolist(), [*edge[1:].tolist(), len(token)]):
            for at in range(start, stop, 256):
                x, y = np.arange(at, min(at + 256, stop))[:, None], np.arange(at + 1, stop)[None, :]
                good = (x < y) & (root[x] != root[y]) & ((lo[start] == hi[start]) | (own[x] != own[y]))
                i, j = np.nonzero(good)
                i, j = i + at, j + at + 1
                good = possible(n[i], place[i], n[j], place[j], similarity)
                i, j = i[good], j[good]
                most = ((1 - similarity) / (1 + similarity) * (n[i] + n[j]) + 1e-9).astype(np.int64)
                good = np.concatenate([np.zeros(0, bool), *(np.bitwise_count(bits[i[k:k + PAIRS]] ^ bits[j[k:k + PAIRS]]).sum(axis=1) <= most[k:k + PAIRS]
                                                            for k in range(0, len(i), PAIRS))])
                if good.any():
                    low, high = _sorted_pairs(a[i[good]], a[j[good]])
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    spark = lists.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cut.repartition(n_parts, "token", "lo", "hi").mapInArrow(resting(run), "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs `(a, b)` whose whole shingle sets have at least the given similarity; the sketches settle only those far from it."""
    sketches = classes.select("seq", "first.sketch")
    near = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    shared = F.size(F.array_intersect(union, F.array_intersect("x", "y")))
    pairs = settle(near.filter(8 * shared >= (3 if similarity >= 0.8 else 0) * F.size(union)).select("a", "b"))
    # Sets are wide: they are made for these pairs only, one row per text.
    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("seq")).distinct().join(classes, "seq").select(
        F.struct(F.col("first.doc_id").alias("_near_id"), F.col("first.digest").alias("_near_digest")).alias("key")))
    if needed.count() <= FEW_TEXTS:
        needed = F.broadcast(needed)
    sets = settle(shingle_sets(rows.join(needed, "key", "left_semi").dropDuplicates(["key"]), width).dropDuplicates(["seq"]))
    full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    # The smaller set over the larger bounds the similarity from above.
    full = full.filter(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")))
    both = F.size(F.array_intersect("x", "y"))
    return full.filter((F.size("x") == 0) | (both / (F.size("x") + F.size("y") - both) >= similarity)).select("a", "b")


def similar_classes(marked: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """`(doc_id, digest, seq, root)` of rows that carry `_near_id` and `_near_digest`: texts whose shingle sets have at least the given
    similarity, directly or through others, share a root.

    The first candidates are the fingerprints linked by the Gray-ordered index. Further ones share one of the first shingles of both in a
    common order (prefix filtering), so that no pair is missed. Members of a long list first meet three representatives, then, outside its
    largest component, some others; all those still in different components then meet each other.
    A sketch settles candidates far from the similarity, whole shingle sets all others.
    """
    def each(ids, texts):
        found = [shingle_digests(t, width) for t in texts]
        return {"doc_id": [i["_near_id"] for i in ids], "digest": [i["_near_digest"] for i in ids], "seq": np.array([w for w, _ in found], np.uint64).view(np.int64),
                "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64),
                "marks": [parities(np.unique(v)) for _, v in found],
                "sketch": [(np.unique(v)[:SKETCH] >> np.uint64(33)).astype(np.int32) for _, v in found]}

    rows = marked.select(F.struct("_near_id", "_near_digest").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    stored = settle(map_texts(spread(rows), "doc_id long, digest long, seq long, fp long, marks binary, sketch array<int>", each))
    classes = settle(stored.groupBy("seq").agg(F.min(F.struct("doc_id", "digest", "fp", "marks", "sketch")).alias("first")))
    first = settle(first_pairs(prefixes(rows, similarity, width), similarity))
    pairs = fingerprint_pairs(classes.select("seq", "first.fp")).union(first.filter("b is not null").select("a", "b"))
    edges = settle(verified(pairs.distinct(), classes, rows, similarity, width))
    roots = min_label(edges)
    lists = first.filter("b is null").select("token", "a", "n", "place")
    for round_ in range(ROUNDS):
        more = settle(verified(settle(more_pairs(lists, roots, similarity, round_)), classes, rows, similarity, width))
        if more.isEmpty():
            break
        edges = edges.union(more)
        roots = min_label(edges)
    left = settle(left_pairs(lists, roots, classes.select(F.col("seq").alias("a"), "first.marks"), similarity))
    if not left.isEmpty():
        roots = min_label(edges.union(verified(left, classes, rows, similarity, width)))
    roots = roots.withColumnRenamed("node", "seq")
    named = classes.select("seq").join(roots, "seq", "left").withColumn("root", F.coalesce("root", "seq"))
    sizes = stored.groupBy("seq").agg(F.count("*").alias("copies"))
    return join_heavy(stored.select("doc_id", "digest", "seq"), named, sizes, "seq", "copies")


def keep_first(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row, with all its columns, of each group of near duplicates: that of the smallest id, null ids last.

    A row is known by its id and the digest of its text, so texts that share an id are told apart; of equal rows one stays.
    """
    marked = docs.withColumns({"_near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_near_digest": F.xxhash64(F.coalesce("text", F.lit("")))})
    found = similar_classes(marked, similarity, width)
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_near_id"), F.col("first.digest").alias("_near_digest"))
    return marked.join(kept, ["_near_id", "_near_digest"], "left_semi").dropDuplicates(["_near_id", "_near_digest"]).select(*docs.columns)


def brute_components(texts: list[tuple[int, bytes]], width: int = 3, distance: int = 3) -> dict[int, tuple[int, int]]:
    """All pairs, for tests on small fixtures: fingerprint and component of each document."""
    codes = {i: fingerprint(t, width) for i, t in texts}
    near = {i: [j for j in codes if (codes[i] ^ codes[j]).bit_count() <= distance] for i in codes}
    label = {i: i for i in codes}
    changed = True
    while changed:
        changed = False
        for i in codes:
            low = reduce(min, (label[j] for j in near[i]), label[i])
            changed |= low != label[i]
            label[i] = low
    return {i: (codes[i], label[i]) for i in codes}
