"""Rows that share doc_id, text and source keep their own other columns in the mix."""

from collections import Counter

from worktide.llm import source_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,string>"


def test_materialised_rows_keep_their_own_columns(spark):
    rows = [(7, "one two", f"l{i}", "a", i % 5, {"k": str(i)}) for i in range(20)] + [(7, "one two", "l3", "a", None, None)] * 4 + [(None, "one two", None, "a", i % 2, None) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = source_mix.materialise(docs, source_mix.weighted_fair_mix(docs))
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(map(str, out.collect())) == Counter(map(str, docs.collect()))
