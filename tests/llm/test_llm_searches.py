"""URL rules, conversation repair and hard negatives against plain versions, and on odd rows."""

import hashlib
import heapq
import math
from itertools import combinations

import numpy as np
import pytest
from check import compare
from conftest import SF_DIR
from pyspark.sql import functions as F
from seqloom.llm import bond, repair, suite, url_rules


# ---- URL rules ------------------------------------------------------------------------------

def _urls(n):
    hosts = ["a.shop.com", "b.shop.com", "news.net", "win-big.net"]
    return [(i, f"http{'s' if i % 3 else ''}://{hosts[i % 4]}/{['en', 'de', 'fr'][i % 5 % 3]}/{i}{['', '.html', '?utm=1', '#x'][i % 7 % 4]}") for i in range(n)]


def _bad(i, url):
    return int(("win-big" in url and "/en/" in url) or i % 11 == 0)


def test_rules_equal_counted_sets(spark):
    rows = [(url_rules.url_tokens(u), _bad(i, u)) for i, u in _urls(800)]
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad int"), support=0.02)
    n, n_bad = len(rows), sum(b for _, b in rows)
    freq = {}
    for tokens, bad in rows:
        for k in range(url_rules.WIDEST + 1):
            for c in combinations(tokens, k):
                for extra in ((), ("=block" if bad else "=allow",)):
                    freq[frozenset((*c, *extra))] = freq.get(frozenset((*c, *extra)), 0) + 1
    least = math.ceil(0.02 * n)
    share = {"block": n_bad / n, "allow": 1 - n_bad / n}
    want = {}
    conf = {(s - {f"={v}"}, v): c / freq[s - {f"={v}"}] for s, c in freq.items() for v in share if f"={v}" in s and len(s) > 1 and c >= least}
    for (tokens, v), value in conf.items():
        below = max([share[v]] + [conf[frozenset(c), v] for k in range(1, len(tokens)) for c in combinations(tokens, k)])
        if value >= 0.5 and value >= below + 0.02 and url_rules.lower_bound(freq[tokens | {f"={v}"}], freq[tokens]) > share[v]:
            want[tokens, v] = value
    assert want and {(r.tokens, r.verdict): r.confidence for r in got} == pytest.approx(want)
    assert any(r.verdict == "block" and "part:win" in r.tokens | {"part:win"} and "path:en" in r.tokens for r in got)
    index = url_rules.Index(got)
    for tokens, _ in rows[:100]:
        fits = [r for r in got if r.tokens <= set(tokens)]
        assert index.best(tokens) == min(fits, key=url_rules.Rule.order, default=None)


def test_mined_rules_judge_unseen_pages(spark):
    pages = spark.createDataFrame(_urls(4_000), "page_id long, url string")
    marks = spark.createDataFrame([(i, 1 - _bad(i, u), 0) for i, u in _urls(3_000)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine(url_rules.labelled(pages, marks, F.col("page_id")))
    got = url_rules.judge(pages.filter("page_id >= 3000"), rules).collect()
    wrong = [(r["url"], r["verdict"], r["mined_rule"]) for r in got if (r["verdict"] == "block") != ("win-big" in r["url"] and "/en/" in r["url"])]
    assert not wrong


def test_listed_rules(spark):
    urls = ["http://Sub.Example.ORG/es/1", "x://example.org/en/12", "x://example.org/en/2", "x://notexample.org/es/", "x://a.com/fr/", "x://a.com/de/", "x://a.com", "x://org?q=/es/", "a/b", "", None, "x://é.com/DE/", "://com/de/"]
    df = spark.createDataFrame([(i, u, 7) for i, u in enumerate(urls)], "page_id long, url string, host int").repartition(3)
    got = {r["page_id"]: r for r in url_rules.judge(df, [], suite.URL_RULES).collect()}
    assert [got[i]["rule"] for i in range(13)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, "com/de/"]
    assert [got[i]["verdict"] for i in range(13)] == ["block", "block", "allow", "allow", "allow", "block"] + ["allow"] * 6 + ["block"]
    assert (got[0]["host"], got[0]["path"], got[7]["host"], got[7]["path"], got[10]["host"], got[11]["path"]) == ("sub.example.org", "/es/1", "org", "", "", "/DE/")


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://a.b/c"), (2, "http://a.b/" + "x/" * 50_000), (2, "http://a.b/c"), (2, "http://a.b/c")], "page_id long, url string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, None), (2, None, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = url_rules.labelled(pages, marks, F.col("page_id"))
    assert sorted(r["bad"] for r in rows.collect()) == [0, 1, 1, 1]
    rules = url_rules.mine(rows)
    assert url_rules.judge(pages, rules).count() == 5
    for p, m in ((pages.limit(0), marks), (pages, marks.limit(0))):
        none = url_rules.mine(url_rules.labelled(p, m, F.col("page_id")))
        assert none == [] and url_rules.judge(p, none).count() == p.count()


# ---- conversation repair --------------------------------------------------------------------

def _search(codes):
    """Cheapest (cost, audit) by search over (cost, audit, place, state)."""
    heap, seen = [(0, "", 0, 0)], set()
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(codes) and q in (0, 3):
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        to = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 3, audit + "I", i, to))
        if i < len(codes):
            late = 3 * codes[i].isupper()
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q))
            heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, to))
            c = codes[i].lower()
            if c == "s" and q == 0:
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, 1))
            elif c == step[q]:
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, to))


def test_repair_equals_search():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 3] * 50 + [7, 12, 30, 100] * 20:
        codes = "".join(rng.choice(list("suaoSUAO"), n))
        cost, audits, tail = repair.repair(codes)
        assert (cost, "".join(audits) + tail) == _search(codes), codes


def test_chunks_meet(spark):
    """Small chunks and many partitions give the rows of large ones; one conversation holds most rows."""
    rng = np.random.default_rng(5)
    rows = [(None if rng.random() < 0.05 else int(rng.choice([1, 1, 1, 2, 3, 4])), None if rng.random() < 0.05 else int(rng.integers(0, 400)),
             [None, "", "system", "user", "assistant", "tool"][rng.integers(0, 6)], [None, "", "a.", "b", "c! \n", "same.", "é?"][rng.integers(0, 7)]) for _ in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for make in (repair.damage, repair.undamaged):
        want = {r["conv_id"]: r for r in repair.reconstruct(make(df)).collect()}
        got = {r["conv_id"]: r for r in repair.reconstruct(make(df.withColumn("key", F.lit(1)).withColumn("fault", F.lit("x"))), most_rows=3).collect()}
        assert want == got and set(want) == {r[0] for r in rows}


def test_repair_examples(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "user", "cut"), (2, 0, "assistant", " "), (3, None, "system", "S."), (3, 2, "user", "x" * 1_000_000 + ".")]
    got = {r["conv_id"]: r for r in repair.reconstruct(repair.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert got[1].asDict() == dict(conv_id=1, gaps=3, blank=0, duplicate=1, truncated=1, illegal=1, cost=8, audit="KKDD", repaired_sha256=sha("user:Hi.", "assistant:Yes."))
    assert (got[2]["cost"], got[2]["audit"], got[2]["blank"], got[2]["repaired_sha256"]) == (4, "D", 1, sha(""))
    assert (got[3]["cost"], got[3]["audit"], got[3]["gaps"], got[3]["repaired_sha256"]) == (3, "KKI", 0, sha("system:S.", "user:" + "x" * 1_000_000 + ".", "assistant:"))


def test_repair_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.reconstruct(repair.damage(empty)).count() == 0
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = repair.reconstruct(repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema))).first()
    assert one.asDict() == dict(conv_id=gone, gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=hashlib.sha256(b"").hexdigest())


# ---- hard negatives -------------------------------------------------------------------------

def _plain(rows, every, k=5, n=3):
    """All scores of all pairs."""
    out = []
    for i, (vid, label, q) in enumerate(rows):
        if vid is None or vid % every:
            continue
        dot = lambda o: max(min(sum(a * b for a, b in zip(q, o)), 2**63 - 1), -2**63)
        order = lambda x: (-x[0], x[1] is None, x[1] or 0)
        same = sorted(((dot(o), v) for j, (v, lb, o) in enumerate(rows) if j != i and lb == label), key=order)[:k]
        other = [(dot(o), v) for v, lb, o in rows if lb != label]
        for ps, pid in same:
            found = sorted((x for x in other if 50 * ps <= 100 * x[0] <= 95 * ps), key=order)[:n]
            out += [(vid, pid, r, nid, ps, ns) for r, (ns, nid) in enumerate(found, 1)]
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e12])
def test_negatives_equal_all_pairs(spark, monkeypatch, scale):
    rng = np.random.default_rng(int(scale) % 97)
    centres = rng.normal(0, 1, (4, 20))
    rows = []
    for i in range(420):
        label = int(rng.integers(0, 4))
        v = ((centres[label] + rng.normal(0, 0.7, 20)) * scale).tolist()
        rows.append((None if i % 60 == 13 else i, None if i % 31 == 30 else label, v[:20 - i % 3]))
    rows += [rows[5], rows[5], rows[0], rows[20], (20, 1, rows[77][2]), (21, None, [1.0]), (22, 1, None), (23, 2, [1.0, None]), (24, 2, [float("nan")]), (40, 2, [float("inf")]), (60, 3, []), (80, 0, [0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"q": F.lit(1), "block": F.lit(2), "n": F.lit(3)}).repartition(6)
    for name, size in (("BLOCK_ROWS", 64), ("CHUNK_ANCHORS", 8)):
        monkeypatch.setattr(bond, name, size)
    sound = [(v, (lb + 1) % 10 if v is not None and v % 7 == 0 else lb, [math.floor(256 * x) for x in e]) for v, lb, e in rows
             if lb is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    got = [tuple(r) for r in bond.mine(bond.prepared(df), F.col("vec_id") % 20 == 0).collect()]
    assert got and _sorted(got) == _sorted(_plain(sound, 20))


def test_negatives_no_rows(spark):
    df = spark.createDataFrame([(50, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert bond.mine(bond.prepared(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    assert bond.mine(bond.prepared(df), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_hard_negatives"])
def test_queries_equal_sql(spark, oracle, name):
    fn, sql = suite.QUERIES[name]
    assert compare(fn(spark, SF_DIR), oracle, sql) == ""
