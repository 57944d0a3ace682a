"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items form one automaton. Training text is streamed through it word by word; the state and the
length of the longest match tell which words lie inside a window of an item, and which items hold that window.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. Items are searched in shards of at
most `SHARD_WORDS` words, one pass over the documents per shard, so that no automaton outgrows a task.

Defined results: a null or empty text has no words and no hits; a null or wordless item never matches; repeated rows
of documents count on their own, repeated items by their id; empty tables give no rows or no hits; further columns
are carried or ignored, never clashed with.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import map_texts, rewrite_texts, union_all, with_length
from seqloom.session import settle, spread

#: Words of test items that one automaton may hold; proven by counting before anything is sent out.
SHARD_WORDS = 1_000_000

#: Working columns of `clean`.
CUT, WORDS, ROW, STARTS, ENDS = "_decontam_cut", "_decontam_words", "_decontam_row", "_decontam_starts", "_decontam_ends"

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class ItemAutomaton:
    """Generalised suffix automaton over item words, with the items that hold each window."""

    window: int
    ids: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    holders: dict[int, frozenset] = field(default_factory=dict)
    whole: dict[int, list] = field(default_factory=dict)
    near_whole: list[int] = field(default_factory=list)
    shortest: int = 1

    @classmethod
    def build(cls, items: Iterable[tuple[int, bytes]], window: int) -> "ItemAutomaton":
        out = cls(window)
        owner: dict[int, set] = {}
        lengths = []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            lengths.append(min(len(words), window))
            last = 0
            for word in words:
                last = out._extend(last, out.ids.setdefault(word, len(out.ids)))
                owner.setdefault(last, set()).add(item)
            if len(words) < window:
                out.whole.setdefault(last, []).append(item)
        out.shortest = min(lengths, default=1)
        # A state stands for the windows that end it; the items of a state are those of all states that link to it.
        for state in sorted(range(1, len(out.size)), key=out.size.__getitem__, reverse=True):
            parent = out.link[state]
            if parent > 0 and state in owner and out.size[parent] >= window:
                owner.setdefault(parent, set()).update(owner[state])
            if out.size[state] >= window > out.size[parent]:
                out.holders[state] = frozenset(owner.get(state, ()))
        out.near_whole = [-1] * len(out.size)
        for state in sorted(range(1, len(out.size)), key=out.size.__getitem__):
            out.near_whole[state] = state if state in out.whole else out.near_whole[out.link[state]]
        return out

    def _add(self, size: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, state: int, target: int, symbol: int) -> int:
        copy = self._add(self.size[state] + 1)
        self.step[copy] = dict(self.step[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        """State of the string of `last` followed by `symbol`."""
        target = self.step[last].get(symbol)
        if target is not None:
            return target if self.size[target] == self.size[last] + 1 else self._split(last, target, symbol)
        new = self._add(self.size[last] + 1)
        state = last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.step[state][symbol]
            self.link[new] = target if self.size[target] == self.size[state] + 1 else self._split(state, target, symbol)
        return new

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans `[start, end)` inside any window, and the items whose windows occur."""
        known = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set = set()
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if stop - start >= self.shortest:
                self._walk(known[start:stop].tolist(), start, spans, found)
        return spans, found

    def _walk(self, symbols: list[int], offset: int, spans: list, found: set) -> None:
        step, link, size, window = self.step, self.link, self.size, self.window
        state = matched = 0
        for place, symbol in enumerate(symbols, offset + 1):
            while state and symbol not in step[state]:
                state = link[state]
                matched = size[state]
            if symbol in step[state]:
                state = step[state][symbol]
                matched += 1
            begin = place
            if matched >= window:
                at = state
                while size[link[at]] >= window:
                    at = link[at]
                found |= self.holders[at]
                begin = place - matched
            at = self.near_whole[state] if state else -1
            if at == state and size[at] > matched:
                at = self.near_whole[link[state]]
            while at > 0:
                found.update(self.whole[at])
                begin = min(begin, place - size[at])
                at = self.near_whole[link[at]]
            if begin < place:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, place))


def item_shards(items: DataFrame, shard_words: int = SHARD_WORDS) -> list[list[tuple[int, bytes]]]:
    """Items in lists of bounded size: they are dealt by digest into as many shards as their total length needs."""
    kept = items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).filter("text is not null and item_id is not null")
    total = kept.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0))).first()[0]
    n = max(1, -int(-total // shard_words))
    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    out = []
    for shard in range(n):
        out.append([(r["item_id"], r["text"].encode()) for r in dealt.filter(F.col("shard") == shard).orderBy("item_id", "text").toLocalIterator()])
    return out


def matches(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id") -> DataFrame:
    """`(doc_id, n_words, starts, ends, items)` per row: merged hit word spans and the items found, in order."""
    return _matches(docs, item_shards(items), window, key)


def _matches(docs: DataFrame, shards: list[list[tuple[int, bytes]]], window: int, key: str) -> DataFrame:
    stored = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    many = len(shards) > 1
    if many:
        stored = settle(stored.withColumn("row", F.monotonically_increasing_id())).select(F.struct("doc_id", "row").alias("doc_id"), "text")
    found = []
    for shard in shards:
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton.build(shard, window))

        def each(ids, texts, shared=shared):
            automaton = shared.value
            out: dict[str, list] = {"doc_id": ids, "n_words": [], "starts": [], "ends": [], "items": []}
            for text in texts:
                words = words_of(text)
                spans, hit = automaton.find(words)
                out["n_words"].append(len(words))
                out["starts"].append([a for a, _ in spans])
                out["ends"].append([b for _, b in spans])
                out["items"].append(sorted(hit))
            return out

        kind = "struct<doc_id:long,row:long>" if many else "long"
        found.append(map_texts(spread(stored), f"doc_id {kind}, n_words long, starts array<long>, ends array<long>, items array<long>", each))
    if not many:
        return found[0]
    # Spans of several shards may overlap; their covered words are merged after sorting by start.
    gathered = union_all(found).groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.aggregate(
        F.array_sort("spans"), F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["ends"] >= s["starts"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], s["ends"]).alias("ends")))))
        .otherwise(F.concat(acc, F.array(s))))
    return gathered.withColumn("m", merged).select("doc_id.doc_id", "n_words", F.col("m.starts").alias("starts"), F.col("m.ends").alias("ends"), "items")


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row: words, words hit, items found and the digest of their ids."""
    found = matches(docs, items, window)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word spans; one space stands for each."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    out.append(text[at:])
    return b" ".join(p.strip(b" ") for p in out).strip(b" ")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, least_words: int = 1, most_coverage: float = 0.5) -> DataFrame:
    """Documents with the hit spans of at least `least_words` words cut out of `text`; a document with more than
    `most_coverage` of its words hit is removed. All columns stay; `n_chars` follows the text where present.
    """
    shards = item_shards(items)
    if len(shards) == 1:
        current, reads = docs, ()
        shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton.build(shards[0], window))
    else:
        # The spans of all shards are merged on the original text, which is cut once.
        rows = settle(docs.withColumn(ROW, F.monotonically_increasing_id()))
        found = _matches(rows, shards, window, ROW)
        current, reads = rows.join(found.select(F.col("doc_id").alias(ROW), F.col("starts").alias(STARTS), F.col("ends").alias(ENDS)), ROW), (STARTS, ENDS)
        shared = None

    def each(texts, *spans_of):
        out: dict[str, list] = {"text": [], CUT: [], WORDS: []}
        for text, *given in zip(texts, *spans_of):
            words = words_of(text or b"")
            spans = zip(*given) if given else shared.value.find(words)[0]
            spans = [s for s in spans if s[1] - s[0] >= least_words]
            out["text"].append((cut_spans(text, spans) if spans else text).decode() if text is not None else None)
            out[WORDS].append(len(words))
            out[CUT].append(sum(b - a for a, b in spans))
        return out

    done = rewrite_texts(spread(current), f"{CUT} long, {WORDS} long", each, reads)
    return with_length(done.filter(F.col(CUT) <= most_coverage * F.col(WORDS)).select(*docs.columns))


def brute_report(texts: list[tuple[int, str]], items: list[tuple[int, str]], window: int = 10) -> list[tuple]:
    """Every window compared at every place, for tests."""
    def split(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows: dict[tuple, set] = {}
    for item, text in items:
        words = split(text)
        width = min(window, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            windows.setdefault(tuple(words[i:i + width]), set()).add(item)
    out = []
    for doc, text in texts:
        words, hit, found = split(text), set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(words) - width + 1):
                if (owners := windows.get(tuple(words[i:i + width]))):
                    hit.update(range(i, i + width))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out
