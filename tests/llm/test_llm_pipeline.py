"""The pipeline's stages on planted documents."""

import random

import corpus_pipeline
import pytest
from seqloom.llm import decontam, secrets, suite

WORDS = "the of and in that was for on are with his they at be this from have or by one had not but what all were when we there can an your which their said if do will".split()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    random.seed(9)
    folder = str(tmp_path_factory.mktemp("planted"))

    def prose(n):
        return " ".join(random.choice(WORDS) + random.choice(["", "ing", "er", "ly"]) for _ in range(n)) + "."

    item = prose(40)
    rows = [(i, prose(random.randint(60, 200))) for i in range(200)]
    rows += [(i, " ".join(["junk$$$", "###", "&&&%%%"] * 60)) for i in range(200, 300)]
    rows += [(300, rows[5][1]), (301, rows[6][1] + " end"), (302, prose(80) + " " + item + " " + prose(80)), (303, prose(90) + " AKIA" + "Z9" * 8 + " " + prose(20))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_stages_take_effect(spark, planted):
    folder, item = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        rows = docs.collect()
        ids = {r["doc_id"] for r in rows}
        if name != "packing":
            assert docs.columns == columns and len(rows) == len(ids)
        if name == "quality":
            assert len(ids & set(range(200))) >= 198 and not ids & set(range(200, 300))
        if name == "near_duplicates":
            assert not ids & {300, 301} and len(ids) >= 199
        if name == "decontamination":
            text = next(r["text"] for r in rows if r["doc_id"] == 302)
            assert item.split(".")[0] not in text and not decontam.ItemAutomaton.build([(1, item.encode())], 10).find(decontam.words_of(text.encode()))[0]
        if name == "secrets":
            text = next(r["text"] for r in rows if r["doc_id"] == 303)
            assert "AKIA" not in text and secrets.base_matches(text.encode()) == []
    assert docs.agg({"length": "sum"}).first()[0] == docs.select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]


def test_run_is_the_chain_of_stages(spark, planted):
    assert corpus_pipeline.run(spark, planted[0]).count() > 0
    assert set(suite.QUERIES) == {f"op{n}_{rest}" for n, rest in (q[2:].split("_", 1) for q in suite.QUERIES)} and len(suite.QUERIES) == 13
