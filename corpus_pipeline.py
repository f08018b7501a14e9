"""The corpus pipeline: five stages, each an operator whose decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``; the last returns the encoded corpus. A stage's
result is written as Parquet and read again before the next one starts, so a lost
executor costs tasks of one stage at most. SQL cannot express the stages; tests
hold each against a brute-force version.

Odd rows, in every stage: null and empty texts are clean, have no duplicates,
lose nothing, mix with size 0 (taken while their source is) and encode to no
ids. Rows without a doc_id are never dropped as duplicates. Equal rows are
separate documents: duplicates of one doc_id stay together, the mix counts each.
Ties go to the smaller doc_id, and in the mix to the order of a seeded hash. No
rows give no rows. Extra columns pass through all stages but the last, whatever
they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from worktide.llm import bpe_codec, ngram_join, queries, source_mix, substring_dedup
from worktide.llm._common import folders, release, saved, table

ORACLE_SQL = None


def whole_rows(docs: DataFrame, *beside) -> DataFrame:
    """Each row as one struct, so no column's name can clash with an operator's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *beside)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxic threshold; null text is clean."""
    model = queries.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return model.score(whole_rows(docs, "text")).where(F.col("score") < queries.TOXIC).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id;
    rows without a doc_id or without words stay as they are."""
    found = ngram_join.near_duplicates(docs)
    goes = found.where("component_id <> doc_id").select("doc_id", "tie").distinct()
    keyed = whole_rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    return keyed.join(goes, ["doc_id", "tie"], "left_anti").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that an earlier document has; a text
    that loses nothing stays as it is, white space included."""
    rest = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("rest"), "doc_id", "text")
    done, shorter = substring_dedup.remove_repeats(rest), F.col("n_removed") > 0
    changed = {"text": F.when(shorter, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(shorter, F.length("kept")).otherwise(F.col("rest.n_chars")).cast("long")}
    return done.select(*(changed.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights, in training order; a document that the mix
    takes twice is there twice."""
    return source_mix.materialise(docs, source_mix.weighted_fair_mix(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, packed token ids, their number, and whether they
    decode to the very text."""
    path = queries.tokenizer_path()
    coded = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    return coded.select("doc_id", "lang", "source", "ids", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("bpe_codec", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes as soon as its
    result is there; only the result's folder stays."""
    docs, before = table(spark, sf_dir, "documents"), list(folders(spark))
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
        release(spark, docs, before)
    return docs
