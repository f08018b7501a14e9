"""Texts of megabytes: runs of blanks, one unbroken word, and many words."""

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.texts import SCHEMA, word_list, words
from tests.llm.test_tokens import token_shards_ranks
from worktide.llm import bpe_codec, fingerprints, ngram_join, source_mix, substring_dedup, token_counts, token_shards, toxicity

LONG = {1: " " * 2_000_000, 2: "x" * 1_000_000, 3: words(1, 200_000, 5000), 4: "\n" * 500_000 + "end", 5: words(1, 200_000, 5000), 6: "short one"}
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in LONG.items()], SCHEMA).repartition(3)


def test_tokens(spark, docs):
    library = Tokenizer.from_file(PATH)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in LONG.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, PATH).select("doc_id", "n_tokens").collect()} == want
    coded = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).selectExpr("doc_id", "length(ids) div 4 AS n", "decoded = text AS same").collect()
    assert {r["doc_id"]: r["n"] for r in coded} == want and all(r["same"] for r in coded)


def test_shards(spark, docs, tmp_path):
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ordered, total = token_shards.training_order(docs, path, public_tokenizers.PATTERN)
    rows = token_shards.write_shards(ordered, str(tmp_path / "s")).groupBy("doc_id").count().collect()
    whole = tiktoken.Encoding("t", pat_str=r"\s+|\S+", mergeable_ranks=token_shards_ranks(path), special_tokens={}).encode_ordinary
    counts = {r["doc_id"]: r["count"] for r in rows}
    assert sum(counts.values()) == total
    assert counts[1] == len(whole(LONG[1])) // 256 + 1 and counts[2] == len(whole(LONG[2])) // 256 + 1


def test_documents(spark, docs):
    kept = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert kept == {1: (0, 0), 2: (1, 0), 3: (200_000, 0), 4: (1, 0), 5: (200_000, 200_000), 6: (2, 0)}
    near = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6}
    mix = {r["doc_id"]: r["size"] for r in source_mix.weighted_fair_mix(docs).collect()}
    assert mix == {i: len(word_list(t)) for i, t in LONG.items()}
    printed = {r["doc_id"]: (r["n_chars"], len(r["marks"])) for r in fingerprints.fingerprint_edits(docs).select("doc_id", "n_chars", "marks").collect()}
    assert {i: n for i, (n, _) in printed.items()} == {i: len(t) for i, t in LONG.items()}
    assert printed[3] == printed[5] and printed[1][1] == 0 and printed[3][1] > 50_000


def test_toxicity(spark, docs):
    scores = toxicity.Model(toxicity.Lexicon(())).score(docs).select("doc_id", "score").collect()
    assert all(0 <= r["score"] <= 1 for r in scores) and len(scores) == len(LONG)
