"""Odd rows for every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from seqloom.llm import compression, context_tree, decontam, language, licenses, packing, quality_rules, secrets, simhash, warc

# Names that the operators use inside.
CLASHES = "key n row t w h hot root words score learn stratum kind place part a b fp seq bucket rank label text_ member payload digest".split()
LONG = "very long text of many words " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t ", "one", LONG, "same text here for all of us", "same text here for all of us", "größer ñandú été 日本語", None]
    rows = [(i, t, [None, "en", "de"][i % 3], "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", "en", None, None), (5, "same text here for all of us", "de", "s", 28)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "very long text"), (3, "very long text"), (None, "one")], "item_id long, text string")


def _operators(docs, labels, items, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.lit(1).alias("digest"), F.lit(2).alias("path"))
    return {
        "rules": lambda: quality_rules.judge(docs, labels), "tree": lambda: context_tree.score(docs),
        "compression": lambda: compression.score(docs, compression.fit(docs, labels, compression.learn_ids(docs))),
        "warc": lambda: warc.read(warc.write(pages, folder), payloads=True), "decontam": lambda: decontam.report(docs, items),
        "pack": lambda: packing.pack(docs, path), "simhash": lambda: simhash.components(docs), "secrets": lambda: secrets.scan(docs, secrets.fit(docs)),
        "language": lambda: language.predict(docs, language.fit(docs, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))))}


def test_every_row_has_a_result(docs, labels, items, tmp_path):
    for name, make in _operators(docs, labels, items, f"file://{tmp_path}").items():
        rows = make().collect()
        if name == "pack":
            assert sum(r["length"] for r in rows if r["doc_id"] is None) == 3 and {r["doc_id"] for r in rows} == {None, *range(9)}
        else:
            assert len(rows) == 11, name
    assert licenses.scan(docs).count() == 0


def test_empty_tables(docs, labels, items, tmp_path):
    for name, make in _operators(docs.limit(0), labels.limit(0), items.limit(0), f"file://{tmp_path}").items():
        assert make().count() == 0, name


def test_stages_keep_columns(docs, labels, items):
    model = compression.fit(docs, labels, compression.learn_ids(docs))
    for out in (compression.keep(docs, model, threshold=0.0), decontam.clean(docs, items), secrets.redact(docs, None), simhash.keep_first(docs)):
        assert out.columns == docs.columns
        assert out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = simhash.keep_first(docs).collect()
    # Texts without words are one group, repeated texts one, all others alone.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 7), (True, 0)]


def test_long_text_is_whole(docs, items):
    row = decontam.report(docs, items).filter("doc_id = 4").first()
    assert row["n_words"] == 120_000 and row["n_hit"] == 60_000 and row["n_items"] == 1
    assert quality_rules.measures(docs).filter("doc_id = 4").first()["n_repeat_words"] == 120_000
