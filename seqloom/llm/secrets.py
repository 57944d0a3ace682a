"""Secret scans: fixed credential patterns, and automata inferred from the credentials they find.

All strings that the base patterns match are the labelled credentials. They form a prefix tree over
character classes; states whose futures are statistically compatible (a Hoeffding bound on every outgoing probability,
checked along both subtrees) are merged into a probabilistic automaton. A second automaton is inferred alike from
all ordinary long strings, that is, without those that the first ones explain nearly as well as credentials. Every candidate string
of every text is then scored by its log likelihood ratio per character and reported above a threshold set on all ordinary strings, each
scored by an automaton of the half it is not in.

Every distinct string counts once, whole, in Spark; the driver gets the counts by prefix of classes and character, and histograms. A prefix that one
string alone reaches, or of `longest` characters, is no state of its own: what follows counts as from the start. A kind of less
than `KIND` strings is not learned. All texts are scanned whole.
Defined results: null and empty texts have no spans; repeated rows are reported each; an empty table gives no rows; base
matches are always kept; other columns are not read by `scan` and carried by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import id_text, map_texts, rewrite_texts, with_length
from seqloom.session import settle, spread

# The base patterns and their order.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: Length from which every string can be a credential of a format not listed; shorter ones do from the length of the shortest learned one.
CANDIDATE_LENGTH = 16
#: Ratios remembered by a task.
REMEMBERED = 100_000
_HINTS = (b"passw", b"secret", b"token", b"api")

#: Steps go by class, one for letters and digits and one for each mark; states emit the characters themselves.
_CLASS = bytes(ord("x") if chr(b).isalnum() and b < 128 else b for b in range(256))
END = 0

#: How often each character, or END, follows a prefix of classes.
Tree = dict[bytes, Counter]


def steps(string: bytes, longest: int, shared: set[bytes] | None = None) -> Iterator[tuple[bytes, int]]:
    """`(prefix, character)` of every character and END; after `longest` characters or a prefix that is not shared the next one is empty."""
    shape, start = string.translate(_CLASS), 0
    for i, letter in enumerate(string):
        yield shape[start:i], letter
        if i + 1 - start >= longest or shared is not None and shape[start:i + 1] not in shared:
            start = i + 1
    yield shape[start:], END


def base_matches(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """`(start, kind, end, credential)` in bytes, leftmost and not overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: steps over character classes, emissions of characters."""

    step: list[dict[int, int]]
    log_p: list[dict[int, float]]
    floor: list[float]

    @classmethod
    def infer(cls, tree: Tree, confidence: float = 0.05) -> "Automaton":
        """Merge compatible states of a prefix tree, smallest states first."""
        prefixes = sorted(tree.keys() | {b""}, key=lambda p: (len(p), p))
        at = {p: i for i, p in enumerate(prefixes)}
        step: list[dict[int, int]] = [{} for _ in prefixes]
        for p in prefixes[1:]:
            step[at[p[:-1]]][p[-1]] = at[p]
        count = [Counter(tree.get(p, {})) for p in prefixes]
        radius = math.sqrt(0.5 * math.log(2 / confidence))

        def compatible(a: int, b: int) -> bool:
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                n, m = sum(count[x].values()), sum(count[y].values())
                if not n or not m:
                    continue
                limit = radius * (n ** -0.5 + m ** -0.5)
                if any(abs(count[x][s] / n - count[y][s] / m) > limit for s in count[x].keys() | count[y].keys()):
                    return False
                todo += [(step[x][s], step[y][s]) for s in step[x].keys() & step[y].keys()]
            return True

        def fold(a: int, b: int) -> None:
            """Add the tree below b to a; every state of it is left behind."""
            todo = [(a, b)]
            while todo:
                x, y = todo.pop()
                count[x].update(count[y])
                for s, child in step[y].items():
                    if s in step[x]:
                        todo.append((step[x][s], child))
                    else:
                        step[x][s] = child

        kept, border = [0], [(0, s) for s in sorted(step[0])]
        while border:
            parent, symbol = border.pop(0)
            state = step[parent][symbol]
            if state in kept:
                continue
            for other in kept:
                if compatible(other, state):
                    step[parent][symbol] = other
                    fold(other, state)
                    break
            else:
                kept.append(state)
            border = [(p, s) for p in kept for s in sorted(step[p]) if step[p][s] not in kept]
        place = {state: i for i, state in enumerate(kept)}
        # Unseen symbols share one added count per state, so that every string has a likelihood.
        total = [sum(count[s].values()) + 1 for s in kept]
        return cls([{k: place[v] for k, v in step[s].items()} for s in kept],
                   [{k: math.log(v / t) for k, v in count[s].items()} for s, t in zip(kept, total)], [math.log(1 / t / 256) for t in total])

    def log_likelihood(self, string: bytes) -> float:
        at, out = 0, 0.0
        for letter, symbol in zip(string, string.translate(_CLASS)):
            out += self.log_p[at].get(letter, self.floor[at])
            at = self.step[at].get(symbol, 0)
        return out + self.log_p[at].get(END, self.floor[at])


@dataclass
class SecretModel:
    formats: list[Automaton]
    ordinary: Automaton
    threshold: float
    shortest: int = CANDIDATE_LENGTH
    seen: dict[bytes, bool] = field(default_factory=dict, repr=False)

    def reports(self, string: bytes) -> bool:
        found = self.seen.get(string)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[string] = self.ratio(string) > self.threshold
        return found

    def ratio(self, string: bytes, ordinary: Automaton | None = None) -> float:
        best = max((a.log_likelihood(string) for a in self.formats), default=-math.inf)
        return (best - (ordinary or self.ordinary).log_likelihood(string)) / (len(string) + 1)


#: Rate of ordinary strings above the threshold, and least threshold, which stands where there are too few strings for one to be that rate. Under
#: the ordinary automaton itself a string of n characters passes the least threshold with a probability of at most exp(-0.5 * (n + 1)).
RATE, LEAST_RATIO = 0.001, 0.5
#: Per character, how much worse than labelled credentials a string may be explained and still not count as ordinary.
SLACK = 1.5
#: Distinct strings that a kind needs to be learned.
KIND = 8
#: Steps of histograms per unit of a score.
GRID = 1_000

#: Numbered strings; the number is a kind, 0 for ordinary ones.
Strings = Iterable[tuple[int, bytes]]
#: Sums `count(strings) -> {(tree, prefix, number): n}` over all strings and keeps the keys that reach the given least sum.
Total = Callable[[Callable[[Strings], Counter], int], Counter]


def half(string: bytes) -> int:
    """0 or 1 by a digest."""
    return hashlib.sha256(string).digest()[0] & 1


def _automata(total: Total, longest: int) -> dict[int, list[Automaton]]:
    """Per number, the automata learned from all its strings but those of half 0, all but those of half 1, and all."""
    def reached(strings: Strings) -> Counter:
        return Counter((t, p, 0) for k, s in strings for p, _ in steps(s, longest) for t in (3 * k + 1 - half(s), 3 * k + 2))

    shared: dict[int, set[bytes]] = defaultdict(set)
    for t, p, _ in total(reached, 2):
        shared[t].add(p)
    shared = dict(shared)

    def followed(strings: Strings) -> Counter:
        return Counter((t, p, c) for k, s in strings for t in (3 * k + 1 - half(s), 3 * k + 2) for p, c in steps(s, longest, shared.get(t, set())))

    trees: dict[int, Tree] = defaultdict(lambda: defaultdict(Counter))
    for (t, p, c), n in total(followed, 1).items():
        trees[t][p][c] = n
    # Without strings of the other half there is only the automaton of all.
    return {t // 3: [Automaton.infer(trees[i if i in trees else t]) for i in (t - 2, t - 1, t)] for t in sorted(trees) if t % 3 == 2}


def _formats(credentials: Total, longest: int) -> tuple[list[Automaton], float]:
    """Automata of the kinds, and the score from which a string is nearly like the labelled credentials, all but the lowest hundredth."""
    kinds = _automata(credentials, longest)
    formats = {k: a[2] for k, a in kinds.items()}

    def scored(strings: Strings) -> Counter:
        return Counter((0, b"", math.floor(_score((formats | {k: kinds[k][half(s)]}).values(), s) * GRID)) for k, s in strings)

    bins = sorted((b, n) for (_, _, b), n in credentials(scored, 1).items())
    below = accumulate(n for _, n in bins)
    rank = sum(n for _, n in bins) // 100
    return list(formats.values()), next(b for (b, _), upto in zip(bins, below) if upto > rank) / GRID - SLACK


def _score(formats: Iterable[Automaton], string: bytes) -> float:
    return max(a.log_likelihood(string) for a in formats) / (len(string) + 1)


def _is_ordinary(string: bytes, formats: list[Automaton], least: float) -> bool:
    """Not so for a string that mixes letters and digits and scores nearly like a labelled credential."""
    return string.isdigit() or not any(48 <= b <= 57 for b in string) or _score(formats, string) < least


def _model(formats: list[Automaton], ordinary: Total, shortest: int, longest: int) -> SecretModel:
    """The ordinary automaton, of all strings, and the threshold: the least one, in steps of the grid, that at most `RATE` of all strings pass."""
    *others, known = _automata(ordinary, longest).get(0, [Automaton.infer({})] * 3)
    model = SecretModel(formats, known, LEAST_RATIO, shortest)

    def scored(strings: Strings) -> Counter:
        return Counter((0, b"", math.ceil(model.ratio(s, others[half(s)]) * GRID)) for _, s in strings)

    bins = sorted(((b, n) for (_, _, b), n in ordinary(scored, 1).items()), reverse=True)
    above = accumulate(n for _, n in bins)
    most = int(sum(n for _, n in bins) * RATE)
    if most:
        model.threshold = max(LEAST_RATIO, next(b / GRID for (b, _), upto in zip(bins, above) if upto > most))
    return model


def _here(strings: list[tuple[int, bytes]]) -> Total:
    return lambda count, least: Counter({k: n for k, n in count(strings).items() if n >= least})


def fit_strings(credentials: dict[int, Counter], strings: Counter, longest: int = 200) -> SecretModel | None:
    """Automata of each kind and of the ordinary ones of the other strings, each distinct string once; None without credentials."""
    known = [(k, s) for k, c in credentials.items() if len(c) >= KIND for s in c]
    if not known:
        return None
    formats, least = _formats(_here(known), longest)
    return _model(formats, _here([(0, s) for s in strings if _is_ordinary(s, formats, least)]), min(len(s) for _, s in known), longest)


def apart(base: list[tuple[int, int, int]], text: bytes, shortest: int) -> Iterator[re.Match]:
    """Candidates that touch none of the `(start, kind, end)` spans, which come in order of start."""
    starts = [a for a, _, _ in base]
    ends = list(accumulate((b for *_, b in base), max))
    for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{%d,}" % min(shortest, CANDIDATE_LENGTH), text):
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            yield m


def fit(docs: DataFrame, longest: int = 200) -> SecretModel | None:
    """Learn from every distinct string of the table, those that the patterns match and all others."""
    def listed(ids, texts):
        return _numbered({(k, c) for text in texts for _, k, _, c in base_matches(text)})

    found = settle(map_texts(spread(id_text(docs)), _STRINGS, listed).distinct())
    kinds = found.groupBy("number").agg(F.count("*").alias("n"), F.min(F.length("string")).alias("least")).filter(F.col("n") >= KIND).collect()
    if not kinds:
        return None
    shortest = min(r["least"] for r in kinds)
    known = found.filter(F.col("number").isin([r["number"] for r in kinds]))
    formats, least = _formats(_spread_out(known, sum(r["n"] for r in kinds)), longest)

    def unlisted(ids, texts):
        return _numbered({(0, m[0]) for text in texts for m in apart([(a, k, b) for a, k, b, _ in base_matches(text)], text, shortest)})

    def told(numbers, strings):
        return _numbered((k, s) for k, s in zip(numbers, strings) if _is_ordinary(s, formats, least))

    ordinary = settle(map_texts(map_texts(spread(id_text(docs)), _STRINGS, unlisted).distinct(), _STRINGS, told))
    return _model(formats, _spread_out(ordinary, ordinary.count()), shortest, longest)


_STRINGS = "number int, string string"
#: Distinct strings to a task.
TASK_STRINGS = 100_000


def _numbered(strings: Strings) -> dict[str, list]:
    once = sorted(strings)
    return {"number": [k for k, _ in once], "string": [s.decode("ascii") for _, s in once]}


def _spread_out(strings: DataFrame, n: int) -> Total:
    """Counts of the tasks, summed by key in Spark, over `n` stored strings."""
    few = strings.coalesce(max(8, -(-n // TASK_STRINGS)))

    def total(count: Callable[[Strings], Counter], least: int) -> Counter:
        def each(numbers, found):
            keys, sums = zip(*count(list(zip(numbers, found))).items())
            return {**dict(zip(("tree", "prefix", "number"), map(list, zip(*keys)))), "n": list(sums)}

        counts = map_texts(few, "tree int, prefix binary, number int, n long", each).groupBy("tree", "prefix", "number").agg(F.sum("n").alias("n"))
        return Counter({(r["tree"], bytes(r["prefix"]), r["number"]): r["n"] for r in counts.filter(F.col("n") >= least).collect()})

    return total


def spans_of(text: bytes, model: SecretModel | None) -> list[tuple[int, int, int]]:
    """`(start, kind, end)` in bytes: all base matches, and candidates apart from them that score as credentials."""
    base = [(a, k, b) for a, k, b, _ in base_matches(text)]
    if model is None:
        return base
    found = [(m.start(), 3, m.end()) for m in apart(base, text, model.shortest) if model.reports(m[0])]
    return sorted(base + found)


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    out, at, seen = [], 0, 0
    places: dict[int, int] = {}
    for edge in sorted({e for a, _, b in spans for e in (a, b)}):
        seen += len(text[at:edge].decode())
        places[edge], at = seen, edge
    for a, k, b in spans:
        out.append((places[a], k, places[b]))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans as `kind:start:end`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(ids, texts):
        out: dict[str, list] = {"doc_id": ids, "n_assign": [], "n_access": [], "n_hex": [], "n_format": [], "base_sha256": [], "spans": []}
        for text in texts:
            spans = _points(text, spans_of(text, shared.value))
            kinds = Counter(k for _, k, _ in spans)
            for i, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(kinds[i])
            out["base_sha256"].append(hashlib.sha256(_listed([s for s in spans if s[1] < 3]).encode()).hexdigest())
            out["spans"].append(_listed(spans))
        return out

    return map_texts(spread(id_text(docs)), "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string", each)


def mask(text: bytes, spans: list[tuple[int, int, int]], sign: bytes = b"[secret]") -> bytes:
    """The text with every span, or run of overlapping spans, replaced by the sign."""
    out, at = [], 0
    for start, _, stop in sorted(spans):
        if start >= at:
            out += [text[at:start], sign]
        at = max(at, stop)
    return b"".join([*out, text[at:]])


def redact(docs: DataFrame, model: SecretModel | None) -> DataFrame:
    """All rows and columns with the secrets of `text` masked; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts):
        return {"text": [None if t is None else mask(t, spans_of(t, shared.value)).decode() for t in texts]}

    return with_length(rewrite_texts(spread(docs), "", each))
