"""Document retrieval: BM25, exact vector search, rank fusion, near-duplicate titles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import place_for_python, settle, spread

# The term map of the document library.
SYNONYMS = {
    "lag": "temporal", "lagged": "temporal", "persistent": "persistence", "scale": "calibration", "bias": "calibration",
    "magnitude": "nonlinear", "online": "incremental", "runtime": "inference",
}
K1, B, SECONDARY = 1.2, 0.75, 0.5  # Fixed values: ranking constants and the weight of secondary terms.
HOT_BUCKET = 1_000  # token sets of which all pairs are compared at one rare token at once
PAIR_BLOCK = 1_000_000  # pairs of token sets looked at together
FEW_SETS = 500_000  # keys up to which they are sent to all tasks; more are joined, with the same result
BINS = 1 << 20  # bins of token digests whose counts order the tokens
QUERY_BLOCK = 1_024  # query vectors held against one batch of rows at a time


def tokens(text: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Lower-case words and numbers longer than one character, mapped through the synonyms."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)
    if not synonyms:
        return words
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def bm25(docs: DataFrame, key: str, words: Column, queries: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Scores `(query, key, score)` of documents with any term of a query (primary, secondary terms).

    Only the document length and the occurrences of query terms leave the text; they are settled, so
    the texts are tokenized once for lengths, document frequencies and scores.
    """
    weights = [(q, t, w) for q, (first, second) in queries.items()
               for t, w in ({t: SECONDARY for t in second} | {t: 1.0 for t in first}).items()]
    terms = sorted({t for _, t, _ in weights})
    known = F.array(*[F.lit(t) for t in terms])
    narrow = settle(spread(docs).select(F.col(key), words.alias("_t")).select(
        key, F.size("_t").alias("_dl"), F.filter("_t", lambda t: F.array_contains(known, t)).alias("_hits")))
    totals = narrow.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"))
    hits = narrow.select(key, "_dl", F.explode("_hits").alias("term")).groupBy(key, "_dl", "term").agg(F.count("*").alias("_tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))  # one row per query term
    facts = df.crossJoin(F.broadcast(totals))
    wanted = docs.sparkSession.createDataFrame(weights, "query string, term string, _w double")
    idf = F.log1p((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    facts = wanted.join(facts, "term").select("query", "term", "_w", idf.alias("_idf"), "_avg")
    scored = hits.join(F.broadcast(facts), "term")  # at most queries x terms rows
    norm = F.col("_tf") + K1 * ((1.0 - B) + B * F.col("_dl") / F.col("_avg"))
    part = F.col("_w") * F.col("_idf") * F.col("_tf") * (K1 + 1.0) / norm
    return scored.groupBy("query", key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, by: str, key: str, k: int, score: str = "score", ascending: bool = False) -> DataFrame:
    """Best k per group with ranks from 1, ties by key."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def vector_knn(vectors: DataFrame, key: str, embedding: str, queries: dict[str, Sequence[float]], k: int) -> DataFrame:
    """Exact nearest neighbours `(query, key, distance2, rank)` by squared Euclidean distance.

    A task computes |x|^2 + |q|^2 - 2 x.q as one matrix product per batch and block of queries, takes every row within the
    k-th distance (with a margin for rounding), computes these exactly and keeps its own k nearest per query, so neither
    pairs nor vectors are shuffled. Any number of queries works; they go to the tasks as one broadcast array.
    """
    names = list(queries)
    shared = vectors.sparkSession.sparkContext.broadcast(np.array([queries[n] for n in names], dtype=float).reshape(len(names), -1))
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        q = shared.value
        length = (q**2).sum(1)
        best = [(np.zeros(0), np.zeros(0, object)) for _ in names]
        for pdf in batches:
            ids = pdf[key].to_numpy()
            x = np.concatenate(pdf[key + "_e"].to_numpy()).astype(float).reshape(len(ids), -1)
            square = (x**2).sum(1)
            for low in range(0, len(names), QUERY_BLOCK):
                block = q[low:low + QUERY_BLOCK]
                rough = square[:, None] + length[None, low:low + QUERY_BLOCK] - 2.0 * (x @ block.T)
                last = min(k, len(ids)) - 1
                bound = np.partition(rough, last, axis=0)[last] + 1e-9 * (square.max() + length[low:low + QUERY_BLOCK] + 1.0)
                for i in range(len(block)):
                    near = np.flatnonzero(rough[:, i] <= bound[i])
                    d = np.concatenate([best[low + i][0], ((x[near] - block[i]) ** 2).sum(1)])
                    owner = np.concatenate([best[low + i][1], ids[near]])
                    keep = np.lexsort((owner, d))[:k]
                    best[low + i] = d[keep], owner[keep]
        for name, (d, owner) in zip(names, best):
            if len(d):
                yield pd.DataFrame({"query": name, key: owner, "distance2": d})

    near = spread(vectors).select(key, F.col(embedding).alias(key + "_e")).mapInPandas(run, f"query string, `{key}` {kind}, distance2 double")
    return top_k(near, "query", key, k, "distance2", ascending=True)


def rrf_fusion(first: DataFrame, second: DataFrame, key: str, alpha: float = 0.5, k: int = 60, by: str = "query") -> DataFrame:
    """`alpha / (k + rank1) + (1 - alpha) / (k + rank2)`; a document missing from a list gets nothing from it."""
    a = first.select(by, key, F.col("rank").alias("_r1"))
    b = second.select(by, key, F.col("rank").alias("_r2"))
    both = a.join(b, [by, key], "full_outer")
    score = F.coalesce(F.lit(alpha) / (F.col("_r1") + k), F.lit(0.0)) + F.coalesce(F.lit(1.0 - alpha) / (F.col("_r2") + k), F.lit(0.0))
    return both.select(by, key, score.alias("score"))


def hybrid_search(text_scores: DataFrame, neighbours: DataFrame, key: str, k: int = 10, alpha: float = 0.5, depth: int = 50, rrf_k: int = 60) -> DataFrame:
    """Best k by fused ranks of the text and the vector search; alpha 1 or 0 uses one of them alone."""
    if alpha == 1.0:
        return top_k(text_scores, "query", key, k)
    if alpha == 0.0:
        return top_k(neighbours.withColumn("score", -F.col("distance2")).drop("rank", "distance2"), "query", key, k)
    fused = rrf_fusion(top_k(text_scores, "query", key, depth), neighbours.filter(F.col("rank") <= depth), key, alpha, rrf_k)
    return top_k(fused, "query", key, k)


def filtered_search(results: DataFrame, facts: DataFrame, key: str, condition: Column, k: int, dissimilar: bool = False, minimum: float = 0.0) -> DataFrame:
    """Results restricted by attributes: the k most similar above `minimum`, or the k least similar."""
    kept = results.drop("rank").join(facts.filter(condition).select(key), key, "left_semi")
    if not dissimilar:
        kept = kept.filter(F.col("score") >= minimum)
    return top_k(kept, "query", key, k, ascending=dissimilar)


def forbidden_terms(df: DataFrame, column: str, pattern: str, replacement: str | None = None) -> DataFrame:
    """Drop rows whose text matches, or replace the text."""
    hit = F.lower(column).rlike(pattern)
    return df.filter(~hit) if replacement is None else df.withColumn(column, F.when(hit, F.lit(replacement)).otherwise(F.col(column)))


def _rows_of(batches, names: Sequence[str]) -> list[np.ndarray]:
    """Columns of all batches of a task as arrays."""
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in held]) for n in names] if held else []


def _parities(row: np.ndarray, digests: np.ndarray, rows: int, power: int) -> np.ndarray:
    """Per row a sketch of 2^power bits as longs, each the parity of the row's digests that fall on it: two rows differ in at least as many digests as bits."""
    bits = np.zeros((rows, 1 << power), np.uint8)
    np.bitwise_xor.at(bits, (row, (digests.view(np.uint64) >> np.uint64(64 - power)).astype(np.int64)), 1)
    return np.packbits(bits, axis=1).view(np.int64)


def _near_pairs(group, n, place, sketch, threshold: float, wanted=None):
    """Chunks of places `(x, y, distance)` of rows of one group whose sets may reach the Jaccard similarity `threshold`.

    Rows are ordered by group and n. No pair of the threshold is lost whose first common token is that of the group: tokens in common
    are at most those from there on, and sets differ in at least as many tokens as their sketches in bits.
    """
    if len(n) < 2:
        return
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    owner = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(n))))
    code = owner * (int(n.max()) + 1) + n
    last = np.searchsorted(code, owner * (int(n.max()) + 1) + np.minimum(np.floor(n / threshold + 1e-9), n.max()).astype(np.int64), side="right")
    count = np.maximum(last - np.arange(len(n)) - 1, 0)
    total = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIR_BLOCK, side="right")) - 1)
        x = np.repeat(np.arange(at, stop), count[at:stop])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[at:stop] - total[at], count[at:stop])
        at = stop
        if wanted is not None:
            x, y = (v[wanted(x, y)] for v in (x, y))
        need = np.ceil((n[x] + n[y]) * (threshold / (1.0 + threshold)) - 1e-9).astype(np.int64)
        good = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
        x, y, most = x[good], y[good], (n[x] + n[y] - 2 * need)[good]
        distance = np.zeros(len(x), np.int64)
        for word in sketch:
            distance += np.bitwise_count((word[x] ^ word[y]).view(np.uint64))
        good = distance <= most
        yield x[good], y[good], distance[good]


def _title_prefixes(sets: DataFrame, order, threshold: float) -> DataFrame:
    """`(token, set, n, place, k0..k3)`: the tokens of a set of which two sets of the threshold share the first common one.

    Tokens are taken by the counts of their bins, then their digests: any order that all sets follow will do, rare ones first keep groups small.
    `k0..k3` is a sketch of 256 bits.
    """
    def run(batches):
        counts = order.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                _, once = np.unique(batch.column("set").to_numpy(), return_index=True)
                batch = batch.take(pa.array(once))
                key, lists = batch.column("set").to_numpy(), batch.column("tokens")
                flat, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                sketch = _parities(row, flat, len(n), 8)
                by = np.lexsort((flat, counts[flat & (BINS - 1)], row))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                took = place < (n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1)[row]
                columns = [flat[by[took]], key[row[took]], n[row[took]], place[took], *(sketch[row[took], i] for i in range(4))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "set", "n", "place", "k0", "k1", "k2", "k3"])

    return sets.select("set", "tokens").mapInArrow(run, "token long, set long, n long, place long, k0 long, k1 long, k2 long, k3 long")


def _first_pairs(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Candidates `(a, b)`, two or more of every set that has them in a group of a token; `(a, null)` where a set may have others."""
    hot = HOT_BUCKET

    def run(batches):
        columns = _rows_of(batches, ["token", "set", "n", "place", "k0", "k1", "k2", "k3"])
        if not columns:
            return
        by = np.lexsort((columns[1], columns[2], columns[0]))
        token, key, n, place, *sketch = (c[by] for c in columns)
        once = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])))
        token, key, n, place, *sketch = (c[once] for c in (token, key, n, place, *sketch))
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(edge, len(token)))
        long = np.repeat(size > hot, size)
        short = np.flatnonzero(~long)
        for x, y, distance in _near_pairs(token[short], n[short], place[short], [k[short] for k in sketch], threshold):
            a, b = key[short[np.concatenate((x, y))]], key[short[np.concatenate((y, x))]]
            order = np.lexsort((b, np.concatenate((distance, distance)), a))
            a, b = a[order], b[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
            a, b = a[fresh], b[fresh]
            head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
            many = np.diff(np.append(head, len(a)))
            best = np.arange(len(a)) - np.repeat(head, many) < 2
            more = a[head[many > 2]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a[best], more))), pa.concat_arrays([pa.array(b[best]), pa.nulls(len(more), pa.int64())])], names=["a", "b"])
        # A long group: each set with the least one of its size class; sets of a class are those within the threshold.
        rest = np.flatnonzero(long)
        if not len(rest):
            return
        step = np.floor(np.log(n[rest]) / (-math.log(threshold) * 1.0001)).astype(np.int64)
        order = np.lexsort((key[rest], step, token[rest]))
        rest, step = rest[order], step[order]
        head = np.flatnonzero(np.concatenate(([True], (token[rest[1:]] != token[rest[:-1]]) | (step[1:] != step[:-1]))))
        leader = np.repeat(rest[head], np.diff(np.append(head, len(rest))))
        other = rest != leader
        a, b = np.concatenate((key[rest[other]], key[leader[other]])), np.concatenate((key[leader[other]], key[rest[other]]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, np.unique(key[rest])))), pa.concat_arrays([pa.array(b), pa.nulls(len(np.unique(key[rest])), pa.int64())])], names=["a", "b"])

    return place_for_python(prefixes, "token").mapInArrow(run, "a long, b long")


def _long_sketches(sets: DataFrame) -> DataFrame:
    """`(set, n, sketch)` with 2,048 bits, for pairs of sets too large for 256."""
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                n = batch.column("tokens").value_lengths().to_numpy().astype(np.int64)
                sketch = _parities(np.repeat(np.arange(len(n)), n), batch.column("tokens").flatten().to_numpy(), len(n), 11)
                yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(n), pa.array(list(sketch), pa.list_(pa.int64()))], names=["set", "n", "sketch"])

    return sets.select("set", "tokens").mapInArrow(run, "set long, n long, sketch array<long>")


def _few(keys: DataFrame) -> DataFrame:
    """Stored keys, to be sent to all tasks if they are few."""
    keys = settle(keys)
    return F.broadcast(keys) if keys.count() <= FEW_SETS else keys


def _other_pairs(sets: DataFrame, seekers: DataFrame, order, threshold: float) -> DataFrame:
    """All candidates `(a, b)` of the seekers `(set)`: their groups, in blocks of which every pair is compared in a place of its own."""
    block = HOT_BUCKET
    tokens = _few(_title_prefixes(sets.join(_few(seekers), "set", "left_semi"), order, threshold).select("token").distinct())
    marked = _title_prefixes(sets, order, threshold).join(tokens, "token", "left_semi").dropDuplicates(["token", "set"]).join(seekers.withColumn("seeks", F.lit(True)), "set", "left")
    marked = settle(marked.withColumn("seeks", F.coalesce("seeks", F.lit(False))))
    sizes = marked.groupBy("token").agg(F.count("*").alias("_m"), F.max("seeks").alias("_any")).filter("_any and _m > 1")
    cut = marked.join(sizes.select("token", F.ceil(F.col("_m") / block).alias("_b")), "token").withColumn("own", F.pmod(F.xxhash64("set"), F.col("_b")))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    cut = cut.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("meet"), "token", "set", "n", "place", "k0", "k1", "k2", "k3", "seeks", "own",
                     (F.least("own", "other") == F.greatest("own", "other")).alias("alone"))

    def run(batches):
        columns = _rows_of(batches, ["meet", "set", "n", "place", "k0", "k1", "k2", "k3", "seeks", "own", "alone"])
        if not columns:
            return
        by = np.lexsort((columns[2], columns[0]))
        meet, key, n, place, *sketch, seeks, own, alone = (c[by] for c in columns)

        def wanted(x, y):
            return (seeks[x] | seeks[y]) & (alone[x] | (own[x] != own[y])) & (key[x] != key[y])

        for x, y, _ in _near_pairs(meet, n, place, sketch, threshold, wanted):
            found = np.unique(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return place_for_python(cut, "meet").mapInArrow(run, "a long, b long")


def near_duplicate_titles(df: DataFrame, key: str, words: Column, threshold: float = 0.85) -> DataFrame:
    """Token sets with a copy or a near-duplicate: `(id, copies, partner, jaccard)`, exact.

    `id` is the lowest key of all texts with the same token set, `copies` their number, `partner` one set
    with Jaccard >= threshold (NULL if there is none). One witness per set is reported, not all pairs: a
    group of n near-copies gives n rows. Tokens and sets are compared by 64-bit digests.

    Of two sets with Jaccard >= t one of the |x| - ceil(t|x|) + 1 rarest tokens of each must be shared. Sets meet at these tokens, each with a
    sketch of 256 bits that gives a lower bound of their difference, so that only pairs near the threshold leave a task. A set names its two best
    candidates of a group and tells whether it has others; in groups of more than `HOT_BUCKET` sets it meets the first set of its size class.
    Sets that find no partner so, but may have others, then meet all sets of their groups. The sets' digests are stored once; prefixes, which
    outgrow them, are made anew for the second search.
    """
    sets = spread(df).select(F.col(key).alias("_key"), F.array_sort(F.array_distinct(words)).alias("_s")).filter(F.size("_s") > 0)
    # Tokens are costly to find: their digests are stored, eight bytes each.
    sets = settle(sets.select("_key", F.xxhash64("_s").alias("set"), F.transform("_s", lambda t: F.xxhash64(t)).alias("tokens"))).filter(F.size("tokens") > 0)
    groups = settle(sets.groupBy("set").agg(F.min("_key").alias("id"), F.count("*").alias("copies")))
    bins = sets.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(BINS - 1).alias("bin")).count().toArrow()  # at most BINS rows
    counts = np.zeros(BINS, np.int64)
    counts[bins.column("bin").to_numpy()] = bins.column("count").to_numpy()
    order = df.sparkSession.sparkContext.broadcast(counts)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

        def named(pairs: DataFrame) -> DataFrame:
            needed = _few(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(groups, "set").select("set", F.col("id").alias("_key")))
            return sets.join(needed, ["set", "_key"], "left_semi")

        # Whole sets are wide, one copy per pair: they are joined only where a sketch of 2,048 bits leaves a pair possible.
        long = settle(_long_sketches(named(pairs)).dropDuplicates(["set"]))
        near = pairs.join(long.toDF("a", "na", "x"), "a").join(long.toDF("b", "nb", "y"), "b")
        differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, bits: total + bits)
        most = F.col("na") + F.col("nb") - 2 * F.ceil((F.col("na") + F.col("nb")) * (threshold / (1.0 + threshold)) - 1e-9)
        pairs = settle(near.filter(differ <= most).select("a", "b"))
        full = named(pairs).dropDuplicates(["set"])
        both = pairs.join(full.select(F.col("set").alias("a"), F.col("tokens").alias("_sa")), "a").join(full.select(F.col("set").alias("b"), F.col("tokens").alias("_sb")), "b")
        common = F.size(F.array_intersect("_sa", "_sb"))
        scored = both.select("a", "b", (common / (F.size("_sa") + F.size("_sb") - common)).alias("jaccard")).filter(F.col("jaccard") >= threshold)
        either = F.explode(F.array(F.struct(F.col("a").alias("set"), F.col("b").alias("other")), F.struct(F.col("b").alias("set"), F.col("a").alias("other"))))
        return settle(scored.select(either.alias("_p"), "jaccard").select("_p.*", "jaccard"))

    first = settle(_first_pairs(_title_prefixes(sets, order, threshold), threshold).distinct())
    found = verified(first.filter("b is not null"))
    seekers = settle(first.filter("b is null").select(F.col("a").alias("set")).distinct().join(found, "set", "left_anti"))
    if not seekers.isEmpty():
        found = found.unionByName(verified(_other_pairs(sets, seekers, order, threshold)))
    partner = found.join(groups.select(F.col("set").alias("other"), F.col("id").alias("partner")), "other")
    witness = partner.groupBy("set").agg(F.min_by(F.struct("partner", "jaccard"), "partner").alias("_w"))
    out = groups.join(witness, "set", "left").filter((F.col("copies") > 1) | F.col("_w").isNotNull())
    return out.select("id", "copies", F.col("_w.partner").alias("partner"), F.col("_w.jaccard").alias("jaccard"))
