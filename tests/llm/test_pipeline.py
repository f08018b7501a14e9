from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import near, removed
from tests.llm.texts import documents, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf_dir(spark, tmp_path):
    frame(spark, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = frame(spark)
    for name, run in corpus_pipeline.STAGES[:-1]:
        assert run(spark, docs, sf_dir).columns == docs.columns, name
        assert run(spark, frame(spark, []), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, frame(spark, []), sf_dir).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = frame(spark)
    assert stage("toxicity")(spark, docs, sf_dir).count() == docs.count()


def test_one_of_each_group_stays(spark, sf_dir):
    kept = stage("ngram_join")(spark, frame(spark), sf_dir).select("doc_id", "text", "row").collect()
    want = Counter(i for i, _, root in near(documents()) if root is None or i == root)
    assert Counter(r["doc_id"] for r in kept) == want
    assert all(r["row"] == 1 for r in kept)


def test_passages_go_and_other_texts_stay(spark, sf_dir):
    got = stage("substring_dedup")(spark, frame(spark), sf_dir).collect()
    want = {(i, n): (gone, kept) for i, n, gone, kept in removed(documents(), 50)}
    texts = {(d[0], len((d[1] or "").encode().split())): d for d in documents()}
    assert len(got) == len(documents())
    for key, (gone, kept) in want.items():
        same = [r for r in got if r["doc_id"] == key[0] and r["text"] == (kept if gone else texts[key][1])]
        assert same, key
        if gone:
            assert same[0]["n_chars"] == len(kept)


def test_mixing_repeats_and_drops(spark, sf_dir):
    docs = frame(spark, clash=False)
    mixed = stage("source_mix")(spark, docs, sf_dir).collect()
    copies = Counter(r["doc_id"] for r in mixed)
    assert all(n <= 6 for n in copies.values())
    assert set(copies) <= {d[0] for d in documents()}


def test_encoding_is_exact(spark, sf_dir):
    rows = stage("bpe_codec")(spark, frame(spark), sf_dir).collect()
    assert len(rows) == len(documents()) and all(r["exact"] for r in rows)


def test_run_applies_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.where(~F.col("exact")).count() == 0 and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
