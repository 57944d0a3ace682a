"""URL filter by association rules: FP-growth mines token combinations that go with good or bad labels.

A URL becomes a set of tokens (scheme, every host label and its hyphen parts, top-level pair, path segments without
numbers, ending, query names, fragment). The labelled URLs, each with the token of its verdict, are transactions of Spark's FP-growth. A mined
itemset with a verdict is a rule `tokens -> verdict`. Rules are pruned by support, by confidence, by chance (the lower Wilson bound of the
confidence at `Z` must exceed the verdict's share; thousands of rules are tried at once), and by improvement: a rule stays only if it is more
confident than every more general rule of its verdict, the empty one (the verdict's share) included, by `IMPROVEMENT`. The rules left form an inverted index: each is filed under its rarest token, so a URL looks up
its own tokens and checks only the rules filed there. Of the matching rules the most confident decides; ties go to the higher lift, more
tokens, higher support, then the tokens in order. Without a matching rule a URL is allowed.

Listed rules (host and path prefix) come first: `judge` takes a rule for its host and all subdomains, the longest wins.

The number of rules follows from the support, not from the table: a URL has at most `MOST_TOKENS` distinct tokens that a rule may
use, of every rule at most `WIDEST` tokens are used, so at most sum(C(MOST_TOKENS, k), k <= WIDEST) / support rules exist.
URLs with more tokens are matched by all of them; only the mining leaves out the tokens beyond, the least frequent first.

Defined results: a null URL or one without `://` has an empty host and path, no tokens and no matching rule (allow); labels with a
null id or null quality and toxic marks count for nothing, of several labels of one id a bad one wins; repeated rows are judged
each; without labels nothing is mined; an empty table gives no rows; other columns are kept as they are where `judge` is called,
and host, path, rule and verdict replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import join_heavy
from seqloom.session import settle

#: Share of the labelled URLs that a rule must cover, its confidence, its lead over more general rules, and normal deviations of its lower bound.
SUPPORT, CONFIDENCE, IMPROVEMENT, Z = 0.002, 0.5, 0.02, 3.5
#: Tokens of a rule, and tokens of one URL that mining may combine.
WIDEST, MOST_TOKENS = 4, 24
ALLOW, BLOCK = "allow", "block"
_VERDICT = "="  # no token begins with it


@dataclass(frozen=True)
class Rule:
    tokens: frozenset[str]
    verdict: str
    count: int
    confidence: float
    lift: float

    def order(self) -> tuple:
        return (-self.confidence, -self.lift, -len(self.tokens), -self.count, sorted(self.tokens), self.verdict)


def host_of(url: Column) -> Column:
    """Text after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: Iterable[tuple[str, str]], give: str) -> Column:
    """The longest listed rule (`give` = "rule") that fits, or its verdict; null if none fits. A rule is `(verdict, host/path)`."""
    found = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(text if give == "rule" else verdict)).otherwise(found)
    return found


_NUMBER = re.compile(r"[0-9]+")
_PARTS = re.compile(r"([^:/?#]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL, in order of their place."""
    found = _PARTS.search(url) if url else None
    if found is None:
        return []
    scheme, host, path, query, fragment = found.groups()
    labels = [x for x in host.lower().split(".") if x]
    out = [f"scheme:{scheme.lower()}", *[f"host:{x}" for x in labels], f"zone:{'.'.join(labels[-2:])}"]
    out += [f"part:{p}" for x in labels if "-" in x for p in x.split("-") if p]
    segments = [s for s in path.lower().split("/") if s]
    if segments and "." in segments[-1]:
        segments[-1], _, ending = segments[-1].rpartition(".")
        out.append(f"ending:{ending}")
    out += [f"path:{t}" for s in segments if (t := _NUMBER.sub("", s))]
    if path.endswith("/") and len(path) > 1:
        out.append("ending:/")
    if query is not None:
        out += [f"query:{q.split('=', 1)[0].lower()}" for q in query.split("&") if q]
    if fragment is not None:
        out.append(f"fragment:{fragment.lower()}")
    return list(dict.fromkeys(out))


def with_tokens(rows: DataFrame) -> DataFrame:
    """`(tokens, bad)` of rows `(bad, url)`."""
    kind = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([url_tokens(u) for u in b.column(1).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([made, b.column(0)], names=["tokens", "bad"])

    return rows.select(F.col("bad").cast("int"), "url").mapInArrow(run, "tokens array<string>, bad int")


def labelled(pages: DataFrame, labels: DataFrame, number: Column) -> DataFrame:
    """`(tokens, bad)` of the URLs whose document number has a label; a label is bad if its quality is 0 or it is toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("_key"), bad.alias("bad")).filter("_key IS NOT NULL AND bad IS NOT NULL")
    marks = marks.groupBy("_key").agg(F.max("bad").alias("bad"))
    rows = pages.select(number.cast("long").alias("_key"), "url").filter("_key IS NOT NULL")
    # Pages of one document may be a third of all, so their labels come by `join_heavy`.
    joined = join_heavy(rows, marks, rows.groupBy("_key").agg(F.count("*").alias("n")), "_key", "n")
    return with_tokens(joined)


def mine(rows: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, improvement: float = IMPROVEMENT) -> list[Rule]:
    """Pruned rules of labelled rows `(tokens, bad)`."""
    from pyspark.ml.fpm import FPGrowth

    rows = settle(rows)
    n, n_bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n:
        return []
    least = max(1, int(-(-support * n // 1)))
    # Tokens below the support can be in no rule; they leave the transactions before mining. At most MOST_TOKENS / support remain.
    common = {r["t"]: r["n"] for r in rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()}
    kind = pa.list_(pa.string())

    def run(batches):
        for b in batches:
            made = []
            for tokens, bad in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = sorted((t for t in tokens if t in common), key=lambda t: (-common[t], t))[:MOST_TOKENS]
                made.append([*known, _VERDICT + (BLOCK if bad else ALLOW)])
            yield pa.RecordBatch.from_arrays([pa.array(made, kind)], names=["items"])

    items = rows.mapInArrow(run, "items array<string>")
    sets = FPGrowth(itemsCol="items", minSupport=least / n * (1 - 1e-9)).fit(items).freqItemsets
    sets = sets.filter(F.size("items") <= WIDEST + 1).select("items", "freq").collect()  # bounded by the support
    if len(sets) > sum(comb(MOST_TOKENS + 1, k) for k in range(WIDEST + 2)) / support:
        raise ValueError("more itemsets than the support allows")
    freq = {frozenset(r["items"]): r["freq"] for r in sets}
    return prune(freq, {BLOCK: n_bad / n, ALLOW: 1 - n_bad / n}, confidence, improvement)


def lower_bound(hits: int, n: int, z: float = Z) -> float:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def prune(freq: dict[frozenset[str], int], share: dict[str, float], confidence: float, improvement: float) -> list[Rule]:
    """Rules of the itemsets that are confident enough and lead every more general rule of their verdict."""
    sure: dict[tuple[frozenset[str], str], tuple[float, int]] = {}
    for items, count in freq.items():
        verdicts = [x[1:] for x in items if x.startswith(_VERDICT)]
        tokens = frozenset(x for x in items if not x.startswith(_VERDICT))
        if len(verdicts) == 1 and tokens:
            sure[tokens, verdicts[0]] = (count / freq[tokens], count)
    best: dict[tuple[frozenset[str], str], float] = {(frozenset(), v): p for v, p in share.items()}
    rules = []
    for (tokens, verdict), (value, count) in sorted(sure.items(), key=lambda x: len(x[0][0])):
        # The highest confidence below: over the sets with one token less, which carry that of all sets below them.
        below = max((best.get((tokens - {t}, verdict), share[verdict]) for t in tokens), default=share[verdict])
        best[tokens, verdict] = max(value, below)
        if value >= confidence and value >= below + improvement and lower_bound(count, freq[tokens]) > share[verdict]:
            rules.append(Rule(tokens, verdict, count, value, value / share[verdict]))
    return sorted(rules, key=Rule.order)


class Index:
    """Inverted index: every rule under its rarest token."""

    def __init__(self, rules: list[Rule]):
        seen: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                seen[t] = seen.get(t, 0) + 1
        self.filed: dict[str, list[tuple[int, Rule]]] = {}
        for rank, r in enumerate(sorted(rules, key=Rule.order)):
            self.filed.setdefault(min(r.tokens, key=lambda t: (seen[t], t)), []).append((rank, r))

    def best(self, tokens: list[str]) -> Rule | None:
        have, found = set(tokens), None
        for t in have:
            for rank, r in self.filed.get(t, ()):
                if found is not None and rank >= found[0]:
                    break
                if r.tokens <= have:
                    found = (rank, r)
                    break
        return found[1] if found else None


def judge(pages: DataFrame, rules: list[Rule], fixed: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """All rows with host, path, rule, verdict, and the mined rule and its confidence where no listed rule fits."""
    index = Index(rules)
    rows = pages.drop("host", "path", "rule", "verdict", "mined_rule", "mined_confidence", "_v")
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"rule": listed(F.col("host"), F.col("path"), fixed, "rule"), "_v": listed(F.col("host"), F.col("path"), fixed, "verdict")})
    from pyspark.sql.pandas.types import to_arrow_schema

    out = rows.withColumns({"mined_rule": F.lit(None).cast("string"), "mined_confidence": F.lit(None).cast("double"), "verdict": F.col("_v")}).drop("_v")
    fields = to_arrow_schema(out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, shares, verdicts = [], [], []
            for url, verdict in zip(b.column("url").to_pylist(), b.column("_v").to_pylist()):
                r = index.best(url_tokens(url)) if verdict is None else None
                names.append(" ".join(sorted(r.tokens)) if r else None)
                shares.append(r.confidence if r else None)
                verdicts.append(verdict or (r.verdict if r else ALLOW))
            made = {"mined_rule": names, "mined_confidence": shares, "verdict": verdicts}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else b.column(f.name).cast(f.type) for f in fields], schema=fields)

    return rows.mapInArrow(run, out.schema)
