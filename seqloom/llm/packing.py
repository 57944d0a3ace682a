"""Sequence packing by minimum bin slack.

Texts are tokenised and followed by an end id. Runs of a full window become windows of their own; what remains of
each document is a piece shorter than the window. Only the number of pieces of each length, at most `window - 1`
counts whatever the size of the corpus, decides the packing: a window takes the longest length still in stock, a bitset
subset-sum over the others finds the multiset that fills it closest to capacity, that content is used as often as the
stock allows, and so on.
Pieces are then numbered within their length by bucket counts and take their places from the plan by rank.

Defined results: a null or empty text is one end id; repeated rows are packed each; an empty table packs nothing; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import FORGET, id_text, map_texts
from seqloom.session import settle, spread

# The white space of the vocabulary's own pattern.
_SPACE = "\t\n\x0b\x0c\r\x85 \xa0  -     　"
#: One optional space and a run of anything else, or a run of white space: no token crosses these bounds.
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
# Fixed value: the vocabulary's own pattern.
_FINE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct runs that a worker remembers; further ones are encoded again where they occur.
_REMEMBER = 300_000
_BOOKS: dict[str, "_Book"] = {}
FORGET.append(_BOOKS.clear)
#: The vocabulary writes each byte as one printable character: itself where it is printable, else one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}


class _Book(dict):
    """Ids of text runs as little-endian 32-bit bytes; encodes runs not seen before.

    The vocabulary and its order of merges are those of the `tokenizers` file. The merges of a run are done by
    `tiktoken`, which gives the same ids in a fifth of the time (held against the file's own tokenizer in the tests). Added tokens of
    the file are found in the text first, as they stand, and what lies between them is encoded part by part.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        byte = {c: b for b, c in _BYTE_CHARS.items()}
        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values()):
            raise ValueError("added tokens that depend on what stands around them")
        self.added = {content: array("I", [i]).tobytes() for content, (i, _) in added.items()}
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "replace") not in added}
        self.encode = tiktoken.Encoding("runs", pat_str=_FINE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, run: str) -> bytes:
        coded = array("I", self.encode(run)).tobytes()
        if len(self) < _REMEMBER and len(run) <= 64:
            self[run] = coded
        return coded


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit bytes, equal to those of the whole text at once."""
    if path not in _BOOKS:
        _BOOKS[path] = _Book(path)
    book = _BOOKS[path]

    def plain(text: str) -> bytes:
        return b"".join(map(book.__getitem__, _PIECE.findall(text)))

    out = []
    for text in texts:
        if book.split is None or not any(c in text for c in book.added):
            out.append(plain(text))
        else:
            out.append(b"".join(book.added[part] if i % 2 else plain(part) for i, part in enumerate(book.split.split(text))))
    return out


def pieces(docs: DataFrame, path: str, window: int = 1024, end: int = 0) -> DataFrame:
    """`(doc_id, start, length, ids_crc32, doc_tokens)`: full windows of a document and what remains of it."""
    last = np.array([end], "<u4").tobytes()

    def each(ids, texts):
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, text in zip(ids, texts):
            coded = encode_texts([text.decode()], path)[0] + last
            total = len(coded) // 4
            for start in range(0, total, window):
                part = coded[4 * start:4 * (start + window)]
                for name, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), total)):
                    out[name].append(value)
        return out

    return map_texts(spread(id_text(docs)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", each)


def fill_window(stock: dict[int, int], window: int) -> Counter:
    """Multiset with the longest length in stock whose sum is the largest possible up to `window`.

    The longest piece is the hardest to place, so every window starts with one and the others fill what it leaves. They
    enter from the longest down; bit s of `reach[i]` tells that the first i lengths can make the sum s. The counts are
    found by walking back from the best sum.
    """
    seed = max(stock)
    room, stock = window - seed, stock | {seed: stock[seed] - 1}
    lengths = sorted((k for k, n in stock.items() if n and k <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length in lengths:
        bits, left, part = reach[-1], min(stock[length], room // length), 1
        # `left` copies in parts of 1, 2, 4, ... and the rest: every count up to `left` can be made.
        while left > 0:
            take = min(part, left)
            bits |= (bits << (take * length)) & mask
            left -= take
            part *= 2
        reach.append(bits)
        if bits >> room & 1:
            break
    best = reach[-1].bit_length() - 1
    used: Counter = Counter({seed: 1})
    for i in range(len(reach) - 1, 0, -1):
        length = lengths[i - 1]
        while not reach[i - 1] >> best & 1:
            best -= length
            used[length] += 1
    return used


def plan(stock: dict[int, int], window: int) -> list[tuple[Counter, int]]:
    """Window contents and how often each is used; every use empties at least one length of the stock."""
    stock = {k: v for k, v in stock.items() if v > 0}
    out = []
    while stock:
        used = fill_window(stock, window)
        times = min(stock[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            stock[k] -= n * times
            if not stock[k]:
                del stock[k]
    return out


def _places(patterns: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows `(length, first rank, end rank, copies per window, first sequence, offset)` of a plan."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken[length], taken[length] + n * times, n, sequence, offset))
            taken[length] += n * times
            offset += length * n
        sequence += times
    return rows


#: Pieces per numbering bucket, about.
BUCKET_ROWS = 50_000


def pack(docs: DataFrame, path: str, window: int = 1024, end: int = 0) -> DataFrame:
    """Pieces with their `sequence_id` and `offset`; offsets of a sequence are gapless from 0."""
    spark = docs.sparkSession
    stored = settle(pieces(docs, path, window, end).withColumn("row", F.monotonically_increasing_id()))
    stock = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = 1 + sum(stock.values()) // BUCKET_ROWS
    placed = stored.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = (placed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "row")) - 1)
              .join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")))
    rows = _places(plan(stock, window)) or [(0, 0, 0, 1, 0, 0)]
    layout = spark.createDataFrame(rows, "len long, low long, high long, copies long, first long, base long")
    # At most one row per length and window content: bounded by the window, not by the corpus.
    found = ranked.join(F.broadcast(layout), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                        (F.col("first") + F.floor(at / F.col("copies")).cast("long")).alias("sequence_id"),
                        (F.col("base") + F.pmod(at, F.col("copies")) * F.col("length")).alias("offset"))
