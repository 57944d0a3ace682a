"""Each method against a brute-force version, a round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import zip_longest

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from seqloom.llm import compression, context_tree, decontam, language, licenses, packing, quality_rules, secrets, simhash, suite, warc
from seqloom.llm.common import min_label, read_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


# Quality rules

def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 40, 300, 2000) for k in range(0, min(n, 40), 3)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.03))
    for k, n, p in df.collect():
        want = math.fsum(math.comb(n, i) * 0.03 ** i * 0.97 ** (n - i) for i in range(k + 1)) if k < n * 0.03 else 1.0
        assert p == pytest.approx(want, rel=1e-9)


def test_cutoffs_respect_the_risk(spark):
    random.seed(3)
    rows = [(i, "en", ("w%d " % (i % 7)) + " ".join(f"x{j}" + "#" * (2 if i % 4 == 0 else 0) for j in range(30))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(4000)], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[1] >= 0.98 and kept[0] == 0.0


# Context tree

def _sequential(history, byte):
    """Weighted probability of one byte, from the definition, over a short history of (context, byte)."""
    def block(nodes):
        return math.lgamma(nodes[0] + .5) + math.lgamma(nodes[1] + .5) - 2 * math.lgamma(.5) - math.lgamma(sum(nodes) + 1)

    def weighted(depth, context, prefix, rows):
        here = [(c, b) for c, b in rows if c[:depth] == context]
        nodes = [0, 0]
        for _, b in here:
            bits = f"{b:08b}"
            if bits.startswith(prefix):
                nodes[int(bits[len(prefix)])] += 1
        if depth == context_tree.DEPTH:
            return block(nodes)
        below = sum(weighted(depth + 1, (*context, x), prefix, rows) for x in {c[depth] for c, _ in here})
        return np.logaddexp(block(nodes), below) - math.log(2)

    out = 0.0
    for i in range(8):
        prefix = f"{byte[1]:08b}"[:i]
        out += weighted(0, (), prefix, [*history, byte]) - weighted(0, (), prefix, history)
    return out / math.log(10)


def _split(key):
    context, byte = divmod(int(key), 256)
    return tuple(context >> 5 * i & 31 for i in range(context_tree.DEPTH)), byte


def test_tree_matches_sequential_weighting(spark):
    keys, times = context_tree.grams([b"abab abc", b"abba", b"cab"])
    rows = [(int(k), int(n)) for k, n in zip(keys, times)]
    history = [_split(k) for k, n in rows for _ in range(n)]
    tree, table = context_tree.grow(spark.createDataFrame(rows, "key long, n long"))
    assert np.abs((10.0 ** table.reshape(-1, 256).astype(float)).sum(1) - 1).max() < 1e-5
    for text in (b"ab", b"cc", b"z"):
        for key in context_tree.grams([text])[0]:
            context, byte = _split(key)
            node = tree.walk([np.array([c]) for c in context])[0]
            assert table[node * 256 + byte] == pytest.approx(_sequential(history, (context, byte)), abs=1e-4)


def test_pruned_tree_is_a_distribution(spark):
    rows = [(int(k), int(n)) for k, n in zip(*context_tree.grams([b"the cat and the hat and the bat " * 5, b"a cat"]))]
    tree, table = context_tree.grow(spark.createDataFrame(rows, "key long, n long"), nodes=12)
    assert tree.dead == 12 and np.abs((10.0 ** table.reshape(-1, 256).astype(float)).sum(1) - 1).max() < 1e-5


def test_whole_tree_matches_sequential_weighting(spark):
    learned = context_tree.grams([b"abab abc", b"abba", b"cab"])
    history = [_split(k) for k, n in zip(*learned) for _ in range(n)]
    asked = context_tree.grams([b"ab", b"cc", b"z abab"])[0]
    rows = {int(k): 0 for k in asked} | {int(k): int(n) for k, n in zip(*learned)}
    found = {r["key"]: r for r in context_tree.weigh(spark.createDataFrame(list(rows.items()), "key long, n long")).collect()}
    assert {k: r["n"] for k, r in found.items()} == rows
    for key, r in found.items():
        assert r["p"] == pytest.approx(_sequential(history, _split(key)), abs=1e-5)


def test_no_context_is_left_out_of_a_score(spark):
    # More contexts than the 65,536 that were once kept, so that rare ones lost their own estimates.
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(120)]
    texts += [t[:200] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    rows = [(int(k), int(n)) for k, n in zip(*context_tree.grams([t.encode() for t, h in zip(texts, held) if not h]))]
    tree, table = context_tree.grow(spark.createDataFrame(rows, "key long, n long"))
    assert tree.dead > 65_536
    want = []
    for t in texts:
        keys, times = context_tree.grams([t.encode()])
        want.append((table[tree.walk([keys >> (8 + 5 * d) & 31 for d in range(context_tree.DEPTH)]) * 256 + (keys & 255)] * times).sum())
    saved = context_tree.HOT_GRAMS
    for most in (saved, 500, 0):
        context_tree.HOT_GRAMS = most
        try:
            found = {r["doc_id"]: r["score"] for r in context_tree.score(docs).collect()}
        finally:
            context_tree.HOT_GRAMS = saved
        assert [found[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)


def test_tree_beats_words_on_held_out(spark):
    found = suite.op2_context_tree(spark, SF_DIR.replace("sf0.01", "sf0.1")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_base_score_by_counting(spark):
    import zlib

    rows = [(r["doc_id"], r["text"] or "") for r in read_table(spark, SF_DIR, "documents").limit(400).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def tokens(text):
        return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w] + [None]

    def held(doc):
        return zlib.crc32(str(doc).encode()) % 10 == 0

    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total = sum(counts.values())
    for small in (True, False):
        saved = context_tree.HOT_WORDS
        context_tree.HOT_WORDS = saved if small else 50
        try:
            found = {r["doc_id"]: r for r in context_tree.score(docs).collect()}
        finally:
            context_tree.HOT_WORDS = saved
        for doc, text in rows:
            words = tokens(text)
            want = sum(math.log10((counts[w] + .1) / (total + .1 * (len(counts) + 1))) for w in words)
            r = found[doc]
            assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["n_known"] == sum(counts[w] > 0 for w in words)
            assert (r["n_tokens"], r["train_tokens"], r["held_out"]) == (len(words), total, held(doc))


# Compression classifier and language network

def test_compression_held_out(spark):
    # The smaller table has eleven bad texts held out, too few to tell one share from another.
    folder = SF_DIR.replace("sf0.01", "sf0.1")
    found = suite.op3_compression_quality(spark, folder).filter("held_out").join(read_table(spark, folder, "labels"), "doc_id").toPandas()
    good, bad = found[found.quality == 1].score, found[found.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.9
    assert (good >= compression.THRESHOLD).mean() > 0.9


def test_gradients_by_differences():
    net = language.LanguageModel.start(["a", "b", "c"], 4, 0)
    for gru in (net.ahead, net.behind):
        gru.x, gru.h = gru.x.astype(float), gru.h.astype(float)
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    words, length = language._matrix([b"abc", b"de", b"fghij"])
    label = np.array([0, 1, 2])
    _, gradients = net.step(words, length, label)
    rng = np.random.default_rng(0)
    for weight, gradient in zip(net.weights(), gradients):
        for at in rng.choice(np.argwhere(gradient != 0), 5):
            at, old = tuple(at), weight[tuple(at)]
            sides = []
            for move in (1e-6, -1e-6):
                weight[at] = old + move
                sides.append(net.step(words, length, label)[0])
            weight[at] = old
            assert (sides[0] - sides[1]) / 2e-6 == pytest.approx(gradient[at], abs=1e-6)


def test_language_held_out(spark):
    found = suite.op10_language(spark, SF_DIR).filter("held_out").join(read_table(spark, SF_DIR, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95


def test_remembered_words_change_nothing(spark):
    docs = read_table(spark, SF_DIR, "documents").limit(60)
    net = language.fit_words({"x": Counter({b"abc": 2, b"cab": 1}), "y": Counter({b"xyz": 1, b"zyx": 3})}, rounds=50)
    saved = language.REMEMBER
    try:
        one = language.predict(docs, net).orderBy("doc_id").collect()
        language.REMEMBER = 100
        two = language.predict(docs, net).orderBy("doc_id").collect()
    finally:
        language.REMEMBER = saved
    assert [(r[0], r[1], r[3], r[4]) for r in one] == [(r[0], r[1], r[3], r[4]) for r in two]


# WARC

def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "ünï" * 1000, "<p>a</p>"]
    pages = spark.createDataFrame([(10 - i, f"http://x/{i} b\n", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    index = warc.write(pages, f"file://{tmp_path}")
    found = {r["page_id"]: r for r in warc.read(index, payloads=True).collect()}
    first = {}
    for i in range(len(html) - 1, -1, -1):
        first.setdefault(html[i] or "", 10 - i)
    for i, h in enumerate(html):
        data, r = (h or "").encode(), found[10 - i]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(data).digest()).decode()
        assert r["refers_to"] == (None if first[h or ""] == 10 - i else first[h or ""])
        assert bytes(r["payload"]) == (data if r["record_type"] == "response" else b"")
    chosen = warc.read(index.filter("page_id in (4, 9)")).collect()
    assert sorted(r["page_id"] for r in chosen) == [4, 9]
    assert warc.write(pages, f"file://{tmp_path}", least_bytes=5000).filter("record_type = 'revisit'").count() == 0


def test_ranges_and_damage():
    assert warc.ranges([(50, 5), (0, 10), (12, 8)], gap=5) == [(0, 20, [(0, 10), (12, 8)]), (50, 55, [(50, 5)])]
    good = warc.record(1, "u", b"abc", "A" * 32, None)
    with pytest.raises(ValueError):
        warc.parse(good)


# Decontamination

def test_automaton_by_brute_force():
    random.seed(1)
    for _ in range(200):
        items = [(i % 4, " ".join(random.choice("abc") for _ in range(random.randint(0, 7)))) for i in range(random.randint(1, 6))]
        docs = [(i, " ".join(random.choice("abcd") for _ in range(random.randint(0, 25)))) for i in range(5)]
        automaton = decontam.ItemAutomaton.build([(i, t.encode()) for i, t in items], 4)
        for (_, text), want in zip(docs, decontam.brute_report(docs, items, 4)):
            spans, found = automaton.find(decontam.words_of(text.encode()))
            assert (sum(b - a for a, b in spans), len(found)) == want[2:4]


def test_shards_agree(spark, monkeypatch):
    docs, items = read_table(spark, SF_DIR, "documents"), read_table(spark, SF_DIR, "benchmark")
    one = sorted(decontam.report(docs, items).collect())
    monkeypatch.setattr(decontam.item_shards, "__defaults__", (600,))
    assert len(decontam.item_shards(items)) > 1
    assert sorted(decontam.report(docs, items).collect()) == one


def test_clean_cuts_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    filler = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{filler}. {item.upper()}, {filler}", 0), (2, item, 0), (3, filler, 0), (4, None, None)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.clean(docs, items).collect()}
    assert set(out) == {1, 3, 4} and out[3]["text"] == filler and out[4]["text"] is None
    assert "BETA" not in out[1]["text"] and out[1]["text"].count("w39") == 2 and out[1]["n_chars"] == len(out[1]["text"])


def test_clean_cuts_once_over_all_shards(spark, monkeypatch):
    words = [f"b{i}" for i in range(600)]
    # Every second item is the start of the one after it, so that cutting the shorter first leaves part of the longer.
    pairs = [(20 * k, words[20 * k:20 * k + 14]) for k in range(30)]
    items = spark.createDataFrame([(2 * k + j, " ".join(w if j else w[:11])) for k, (_, w) in enumerate(pairs) for j in (0, 1)], "item_id long, text string")
    texts = [" ".join([f"d{k}x{i}" for i in range(20)] + w + [f"e{k}x{i}" for i in range(4 if k % 2 else 0)]) for k, (_, w) in enumerate(pairs)]
    docs = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (99, None), (98, ""), (0, texts[0])], "doc_id long, text string")
    one = sorted(map(tuple, decontam.clean(docs, items, most_coverage=0.4).collect()), key=repr)
    monkeypatch.setattr(decontam.item_shards, "__defaults__", (300,))
    assert len(decontam.item_shards(items)) > 1
    assert sorted(map(tuple, decontam.clean(docs, items, most_coverage=0.4).collect()), key=repr) == one
    assert not any(f"b{20 * k + 13}" in (t or "").split() for k, t in one)


# Licenses

def test_license_matches():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    words = licenses.words_of(licenses.TEMPLATES["mit"].encode())
    noise = [b"noise%d" % i for i in range(50)]
    changed = [w for i, w in enumerate(words) if i % 17] + []
    changed[20:20] = [b"inserted", b"words"]
    found = index.find(noise + changed + noise, 0.8)
    assert [index.names[m[0]] for m in found] == ["mit"]
    t, start, stop, hits = found[0]
    assert start >= 50 and stop <= 50 + len(changed) and hits >= 0.9 * len(changed)
    assert index.find(noise, 0.8) == [] and index.find(words[:30], 0.8) == []


@pytest.mark.parametrize("name", ["cc-by-nc-4.0-notice", "mit-notice", "apache-2.0-notice", "gpl-3.0-notice"])
def test_repeated_notices(name):
    index = licenses.TemplateIndex({name: licenses.TEMPLATES[name]})
    words = licenses.words_of(licenses.TEMPLATES[name].encode())
    for between in (0, 1, 2, 4, 10, 14, 20, 24, 30):
        text, want = [], []
        for copy in range(5):
            want.append((0, len(text), len(text) + len(words), len(words)))
            text += words + [b"noise%d" % i for i in range(between)]
        assert sorted(index.find(text, 0.8)) == want


def test_license_spans(spark):
    text = "Ünder this: RELEASED under\nthe MIT license!  More words."
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    assert [(r["doc_id"], r["license"], text[r["start"]:r["end"]]) for r in rows] == [(1, "mit-notice", "RELEASED under\nthe MIT license")]


# Packing

def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    random.seed(4)
    texts = ["", " ", "  a", "a  b\n\n c \t d\x1c\x1d e  ", "I'll it's\x85x 　y", "<|endoftext|> hi<|endoftext|>", "a <|endoftext|> b", "  <|endoftext|>  <|endoftext|", "<|endoftext|><|endoftext|>x \n<|endoftext|>\n", "a\x00b  ", "12 34  56?? !!",
             "naïve café — 日本語 テスト 😀 ok\r\n\r\nfoo"]
    texts += ["".join(random.choice("ab1 '\n\t.ñ\xa0\x1f日sl") for _ in range(random.randint(1, 60))) for _ in range(300)]
    texts += ["".join(random.choice(["a", " ", "\n", "<|endoftext|>", "<|", "endoftext", "|>"]) for _ in range(12)) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(texts, PATH)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_fill_window_is_best():
    random.seed(5)
    for _ in range(100):
        stock = {random.randint(1, 20): random.randint(1, 3) for _ in range(4)}
        used = packing.fill_window(dict(stock), 30)
        assert all(used[k] <= stock[k] for k in used)
        longest = max(stock)
        sums = {longest}
        for length, n in stock.items():
            sums = {s + length * i for s in sums for i in range(n + 1 - (length == longest)) if s + length * i <= 30}
        assert used[longest] >= 1 and sum(k * v for k, v in used.items()) == max(sums)


def test_pack_places_every_id_once(spark):
    docs = read_table(spark, SF_DIR, "documents")
    rows = packing.pack(docs, PATH).toPandas()
    for _, part in rows.sort_values("start").groupby("doc_id"):
        assert (part.start.values == np.concatenate([[0], part.length.cumsum().values[:-1]])).all() and part.length.sum() == part.doc_tokens.iloc[0]
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.values == np.concatenate([[0], part.length.cumsum().values[:-1]])).all() and part.length.sum() <= 1024
    assert rows.doc_id.nunique() == docs.count() and sorted(rows.sequence_id.unique()) == list(range(rows.sequence_id.nunique()))
    assert rows.sequence_id.nunique() <= rows.length.sum() / 1024 * 1.02 + 1


# SimHash

def test_gray_rank_orders_the_code():
    ranks = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


def test_linked_items_by_brute_force():
    rng = np.random.default_rng(2)
    for size in (2, 9, 70, 600):
        centre = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        codes = centre[rng.integers(0, 5, size)]
        for _ in range(4):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 14, size).astype(np.uint64))
        codes = np.unique(codes)
        route = rng.integers(0, 3, len(codes))
        order, labels = simhash.linked_items(route, codes, 3)
        route, codes = route[order], codes[order]
        want = np.arange(len(codes))
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3) & (route[:, None] == route[None, :])
        while True:
            new = np.array([want[n].min() for n in near])
            if (new == want).all():
                break
            want = new
        assert (labels == want).all()


@pytest.mark.parametrize("hot", [20_000, 3])
def test_components_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_ROUTE", hot)
    docs = read_table(spark, SF_DIR, "documents").limit(500)
    want = simhash.brute_components([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])
    for r in simhash.components(docs).collect():
        code, root = want[r["doc_id"]]
        assert (r["fp"] % (1 << 64), r["component_id"]) == (code, root)


def test_similar_texts_meet(spark):
    random.seed(6)
    rows = []
    for family in range(40):
        base = [f"f{family}w{i}" for i in range(300)]
        rows.append((10 * family, " ".join(base)))
        for copy in range(3):
            words = list(base)
            for i in random.sample(range(300), 5):
                words[i] = f"new{random.random()}"
            rows.append((10 * family + copy + 1, " ".join(words)))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [10 * f for f in range(40)]


def _kept_by_brute_force(rows, similarity=0.8, width=5):
    """Smallest id of every component of texts whose shingle sets are similar, all pairs compared."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))})
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return sorted({rows[top(i)][0] for i in range(len(rows))})


def test_similarity_of_long_texts_is_exact(spark):
    rows = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(600)]
        # The last words changed: similarities from 0.77 to 0.83, by whole shingle sets.
        changed = 54 + i
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:600 - changed] + [f"v{i}x{j}" for j in range(changed)]))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == _kept_by_brute_force(rows)


def test_families_that_share_a_template(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 60)
    template, rows = [f"t{j}" for j in range(168)], []
    for family in range(60):
        own = [f"f{family}x{j}" for j in range(20)]
        for member in range(4):
            # About 0.66 alike across families and 0.83 within one.
            rows.append((len(rows), " ".join(template + own + [f"m{len(rows)}x{j}" for j in range(14)])))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _kept_by_brute_force(rows)
    assert len(want) == 60 and sorted(r["doc_id"] for r in kept) == want


def test_prefix_pairs_by_brute_force(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(simhash, "BLOCK", 10)
    rows = []
    for group in range(12):
        shared = [f"g{group}w{j}" for j in range(random.randrange(5, 300))]
        for _ in range(15):
            # Words are added and changed at the end, up to a third.
            words = shared[:len(shared) - random.randrange(0, len(shared) // 5 + 1)]
            rows.append((len(rows), " ".join(words + [f"r{random.random()}" for _ in range(random.randrange(0, len(shared) // 6 + 2))])))
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == _kept_by_brute_force(rows)


def test_index_pairs_are_near_and_join_components():
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    codes = np.unique(np.concatenate([heads] + [heads ^ np.uint64((1 << int(i)) | (1 << int(j))) for i, j in rng.integers(0, 64, (20, 2))]))
    order, labels, u, v = simhash.linked_pairs(np.zeros(len(codes), np.int64), codes, 3)
    assert (np.bitwise_count(codes[order][u] ^ codes[order][v]) <= 3).all()
    assert len(u) == len(codes) - len(np.unique(labels))
    joined = np.arange(len(codes))
    for _ in range(len(codes)):
        np.minimum.at(joined, u, joined[v])
        np.minimum.at(joined, v, joined[u])
    assert (joined == labels).all()


def test_large_group_near_the_similarity_leaves_few_pairs(spark, monkeypatch):
    random.seed(4)
    base, rows = [f"b{j}" for j in range(104)], []
    for i in range(400):
        words = list(base)
        for j in random.sample(range(104), 2):
            words[j] = f"m{i}x{j}"
        rows.append((i, " ".join(words)))
    counted, linked, whole, index = [], [], simhash.left_pairs, simhash.links

    def counting(*args):
        counted.append(simhash.settle(whole(*args)))
        return counted[-1]

    def linking(*args, **kwargs):
        linked.append(simhash.settle(index(*args, **kwargs)))
        return linked[-1]

    monkeypatch.setattr(simhash, "left_pairs", counting)
    monkeypatch.setattr(simhash, "links", linking)
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == _kept_by_brute_force(rows)
    # The Gray-ordered index gives candidates, and few of the 79,800 pairs are left over for the last comparison.
    assert linked[0].count() > 0 and counted[0].count() < 10 * len(rows)


def test_min_label(spark):
    random.seed(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(random.randint(200, 300), random.randint(200, 300)) for _ in range(60)]
    found = {r["node"]: r["root"] for r in min_label(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


# Secrets

def test_base_spans_by_patterns(spark):
    text = 'é password = "abc123", PASSWD:short API_KEY=zz-99_8 AKIA' + "A1" * 9 + " " + "0123456789abcdef" * 2 + " token : x"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scan(docs, None).first()
    want = []
    for kind, pattern in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
                          ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if len(m[1] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                want.append((m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    assert row["spans"] == ",".join(s for *_, s in sorted(want)) and row["n_assign"] == 2
    assert row["base_sha256"] == hashlib.sha256(row["spans"].encode()).hexdigest()


def test_automata_know_formats():
    random.seed(8)

    def key(alphabet, n, head=""):
        return (head + "".join(random.choice(alphabet) for _ in range(n))).encode()

    upper, hexa, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    model = secrets.fit_strings({1: Counter(key(upper, 16, "AKIA") for _ in range(300)), 2: Counter(key(hexa, 40) for _ in range(300))},
                                Counter([key(low, random.randint(16, 24)) for _ in range(300)] + [key("0123456789", 16) for _ in range(100)]))
    assert all(1 < len(a.step) < 60 for a in model.formats)
    found = [model.ratio(key(upper, 16, "ASIA")) > model.threshold for _ in range(50)] + [model.ratio(key(hexa, 40)) > model.threshold for _ in range(50)]
    wrong = [model.ratio(key(low, 20)) > model.threshold for _ in range(200)]
    assert np.mean(found) > 0.95 and np.mean(wrong) < 0.01


def _planted(spark, n, token):
    """Texts with long words, listed keys and, in every twelfth, a token of no listed format; and the tokens and words."""
    draw = random.Random(n)
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"
    rows, tokens, words = [], {}, {}
    for i in range(n):
        words[i] = "".join(draw.choice(low) for _ in range(draw.randint(16, 24)))
        tokens[i] = token(draw) if i % 12 == 0 else ""
        key = "AKIA" + "".join(draw.choice(upper) for _ in range(16)) if i % 4 == 1 else ""
        rows.append((i, f"here is {words[i]} and {key} or {tokens[i]} there"))
    return spark.createDataFrame(rows, "doc_id long, text string"), tokens, words


def _reported(docs):
    model = secrets.fit(docs)
    return {r["doc_id"]: r["n_format"] for r in secrets.scan(docs, model).collect()}


@pytest.mark.parametrize("n", [240, 6000])
def test_unlisted_format_is_reported(spark, n):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs, tokens, _ = _planted(spark, n, lambda d: "ASIA" + "".join(d.choice(upper) + d.choice("0123456789") for _ in range(8)))
    found = _reported(docs)
    assert np.mean([found[i] == 1 for i in found if tokens[i]]) > 0.95
    assert np.mean([found[i] > 0 for i in found if not tokens[i]]) < 0.01


def test_every_candidate_is_scored(spark):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    docs, tokens, _ = _planted(spark, 480, lambda d: "ASIA" + "".join(d.choice(upper) for _ in range(15)) + d.choice("0123456789"))
    found = _reported(docs)
    assert np.mean([found[i] == 1 for i in found if tokens[i]]) > 0.95
    assert np.mean([found[i] > 0 for i in found if not tokens[i]]) < 0.01
    # Listed credentials of 13 characters teach that strings of 13 characters can be credentials.
    docs, tokens, _ = _planted(spark, 480, lambda d: "".join(d.choice("0123456789ABCDEF") for _ in range(13)))
    listed = docs.withColumn("text", F.concat("text", F.lit(" token="), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 13))))
    found = _reported(listed)
    assert np.mean([found[i] == 1 for i in found if tokens[i]]) > 0.9
    assert np.mean([found[i] > 0 for i in found if not tokens[i]]) < 0.01


def _token(draw, alphabet, n):
    return "".join(draw.choice(alphabet) for _ in range(n))


def test_every_listed_credential_is_learned(spark):
    # 2,500 credentials: 1,000 of a kind were learned from, and none above 200 characters.
    draw = random.Random(11)
    upper, hexa, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    keys = ["AKIA" + _token(draw, upper, 16) for _ in range(2_500)] + ["AKIA" + _token(draw, upper, 300) for _ in range(20)]
    hexes, words = [_token(draw, hexa, 40) for _ in range(1_500)], [_token(draw, low, draw.randint(20, 40)) for _ in range(3_000)]
    rows = [(i, " ".join(part)) for i, part in enumerate(zip_longest(keys, hexes, words, fillvalue=""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = secrets.fit(docs)
    whole = secrets.fit_strings({1: Counter(k.encode() for k in keys), 2: Counter(h.encode() for h in hexes)}, Counter(w.encode() for w in words))
    assert [a.log_p for a in model.formats] == [a.log_p for a in whole.formats]
    assert model.ordinary.log_p == whole.ordinary.log_p and (model.threshold, model.shortest) == (whole.threshold, whole.shortest)
    # The floor of a state is one added count: each credential starts there, and no string is left out.
    assert [1 / math.exp(a.floor[0]) / 256 - 1 >= n - 1e-6 for a, n in zip(model.formats, (2_520, 1_500))] == [True, True]


def test_every_ordinary_string_is_learned():
    draw = random.Random(12)
    keys = Counter(("AKIA" + _token(draw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16)).encode() for _ in range(300))
    words = [_token(draw, "abcdefghijklmnopqrstuvwxy", 20).encode() for _ in range(3_000)]
    # One string of 3,000 starts with Z, wherever its digest puts it; 1,000 were learned from.
    rare = [b"Z" + _token(draw, "abcdefgh", 19).encode() for _ in range(8)]
    for string in rare:
        model = secrets.fit_strings({1: keys}, Counter([*words, string]))
        assert ord("Z") in model.ordinary.log_p[0]


def test_redact_masks_all(spark):
    docs = read_table(spark, SF_DIR, "documents")
    clean = secrets.redact(docs, secrets.fit(docs))
    assert clean.count() == docs.count()
    left = secrets.scan(clean, None).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0]
    assert left == 0


def test_component_rounds_take_few_tasks(spark):
    # 3,000 edges in 211 partitions: every step of every round once ran a task for each partition.
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        context.setJobGroup("component rounds", "component rounds")
        found = {r["node"]: r["root"] for r in min_label(spark.range(3000).selectExpr("id a", "id - id % 30 + (id + 7) % 30 b")).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 30 for i in range(3000)}
    tracker = context.statusTracker()
    stages = {i for job in tracker.getJobIdsForGroup("component rounds") for i in tracker.getJobInfo(job).stageIds}
    assert sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s) < 4_000
