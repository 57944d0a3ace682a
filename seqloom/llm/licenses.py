"""License scans: winnowed template fingerprints find candidates, banded alignment measures the match.

Each template is cut into runs of `GRAM` words; of every `WINDOW` neighbouring runs the one with the smallest digest enters an
inverted index. A text is searched for these runs: any passage of `GRAM + WINDOW - 1` words shared with a template
holds one. Every candidate is aligned with its template, word by word, inside a band around the diagonal of the run, and reported
when the matched words cover enough of the template. The band is aligned again beside the words aligned before, until no run is left.

The templates are a parameter of bounded size (at most `MOST_TEMPLATE_WORDS` words, checked). Defined results: null, empty
and unmatched texts give no row; repeated rows are reported each; of overlapping matches of one text the one with more
matched words stays, then the one that starts first, then the template that sorts first; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from seqloom.llm.common import id_text, map_texts
from seqloom.session import spread

GRAM, WINDOW, BAND = 3, 3, 12
MOST_TEMPLATE_WORDS = 1_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 46 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

# Notices and license texts looked for.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
}


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits, points and non-ASCII bytes, without points at either end."""
    return [w for w in (x.strip(b".") for x in text.translate(_FOLD).split()) if w]


class TemplateIndex:
    """Word numbers of all templates and the inverted index of their winnowed runs."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.ids: dict[bytes, int] = {}
        self.words = [[self.ids.setdefault(w, len(self.ids)) for w in words_of(templates[n].encode())] for n in self.names]
        if sum(map(len, self.words)) > MOST_TEMPLATE_WORDS:
            raise ValueError("templates hold more words than a task should be sent")
        self.index: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            grams = [tuple(words[i:i + GRAM]) for i in range(max(0, len(words) - GRAM + 1))]
            digest = [xxhash.xxh64_intdigest(repr(g).encode()) for g in grams]
            chosen = set()
            for start in range(max(1, len(grams) - WINDOW + 1)):
                window = range(start, min(start + WINDOW, len(grams)))
                if window:
                    chosen.add(min(window, key=lambda i: (digest[i], -i)))
            for i in sorted(chosen):
                self.index[grams[i]].append((t, i))

    def find(self, words: list[bytes], least: float) -> list[tuple[int, int, int, int]]:
        """`(template, start word, end word, matched words)` of the matches that cover at least `least` of a template."""
        known = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        spots = defaultdict(list)
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
            run = known[start:stop].tolist() if stop - start >= GRAM else []
            for i in range(len(run) - GRAM + 1):
                for t, place in self.index.get(tuple(run[i:i + GRAM]), ()):
                    # Runs on nearby diagonals belong to one alignment.
                    spots[t, round((start + i - place) / BAND)].append(start + i)
        matches = set()
        for (t, diagonal), seeds in spots.items():
            # What was aligned is masked, until no run of this diagonal lies outside all alignments.
            low = max(0, diagonal * BAND - 2 * BAND)
            open_words = known[low:max(low, diagonal * BAND + 2 * BAND) + len(self.words[t])].copy()
            while any((open_words[i - low:i - low + GRAM] >= 0).all() for i in seeds):
                got = align(self.words[t], open_words, diagonal * BAND - low)
                if not got:
                    break
                open_words[got[0]:got[1]] = -1
                if got[2] >= least * len(self.words[t]):
                    matches.add((t, got[0] + low, got[1] + low, got[2]))
        found = sorted(matches)
        found.sort(key=lambda m: (-m[3], m[1], self.names[m[0]], m[2]))
        # Kept matches lie apart, so only the neighbours of a place can overlap it.
        starts: list[int] = []
        kept: list[tuple[int, int, int, int]] = []
        for m in found:
            at = bisect_left(starts, m[1])
            if (at == 0 or kept[at - 1][2] <= m[1]) and (at == len(kept) or kept[at][1] >= m[2]):
                starts.insert(at, m[1])
                kept.insert(at, m)
        return kept


def align(template: list[int], text: np.ndarray, diagonal: int, band: int = 2 * BAND) -> tuple[int, int, int] | None:
    """Best local alignment of the template with the text inside a band: `(start, end, matched words)` in the text.

    A match scores 2, a difference or a gap -1. Row by row over the template; cell b of a row stands for the text word
    at `row + diagonal - band + b`.
    """
    width = 2 * band + 1
    # Score, matched words and start of the best alignment that ends in each cell of the row before.
    old = [(0, 0, 0)] * (width + 1)
    best = (0, 0, 0, 0)
    size = len(text)
    for i, word in enumerate(template):
        new = []
        left = (0, 0, 0)
        for b in range(width):
            j = i + diagonal - band + b
            cell = (0, 0, 0)
            if 0 <= j < size:
                score, hits, start = old[b]
                if word == text[j]:
                    cell = (score + 2, hits + 1, start if score > 0 else j)
                elif score > 1:
                    cell = (score - 1, hits, start)
                if old[b + 1][0] - 1 > cell[0]:
                    cell = (old[b + 1][0] - 1, *old[b + 1][1:])
                if left[0] - 1 > cell[0]:
                    cell = (left[0] - 1, *left[1:])
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
            new.append(cell)
            left = cell
        old = [*new, (0, 0, 0)]
    return (best[2], best[3], best[1]) if best[0] else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """`(doc_id, license, coverage, matched_words, start, end)` per match; start and end in code points of the text."""
    index = TemplateIndex(TEMPLATES if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def each(ids, texts):
        ix = shared.value
        out: dict[str, list] = {n: [] for n in ("doc_id", "license", "coverage", "matched_words", "start", "end")}
        for doc, text in zip(ids, texts):
            matches = ix.find(words_of(text), least)
            if not matches:
                continue
            places = [m.span() for m in _WORD.finditer(text.translate(_FOLD)) if m[0].strip(b".")]
            for t, start, stop, hits in matches:
                a, b = places[start][0], places[stop - 1][1]
                row = (doc, ix.names[t], hits / len(ix.words[t]), hits, len(text[:a].decode()), len(text[:b].decode()))
                for name, value in zip(out, row):
                    out[name].append(value)
        return out

    return map_texts(spread(id_text(docs)), "doc_id long, license string, coverage double, matched_words long, start long, end long", each)
