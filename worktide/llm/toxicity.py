"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated.

``fit`` reads labelled texts only and at most ``max_rows`` of them (a bounded
sample by hash of the id), in the same way however many there are:

1. The lexicon. Words, and word beginnings of four to six letters (for inflected
   languages), that occur in significantly more toxic than clean documents
   (log-likelihood ratio), with their log odds, at most MAX_TERMS; to them come
   the common insults below. Counted by Spark.
2. The trees: Spark ML's gradient-boosted trees over dense features of the text
   alone: lexicon densities, lexicon hits close to a second person, capitals,
   punctuation and obfuscation rates.
3. The calibration: Spark ML's isotonic regression from the trees' probability
   to the label. It learns from FOLDS models, each row's probability from the one
   that has not seen it (its lexicon and trees come from the other folds); the
   lexicon and trees that stay learn from all rows.
4. The prior: where the fixed rule 1 - exp(-60 x the rate of the common insults)
   says more than the calibration, it counts as PRIOR labelled rows of the rarer
   class beside those that there are. Few labels lean on it, many outweigh it;
   without any it is all there is.

``score`` is one pass over the documents without a shuffle: features in Python
(an Aho-Corasick automaton finds lexicon hits), trees and calibration in Spark.
The fitted lexicon and trees are a few kilobytes whatever the corpus.

Null text counts as empty. Rows without a label (or with a null one) teach
nothing; without labelled texts there is nothing to learn from.
Repeated rows score alike. Extra columns pass through; the result's column is
replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from worktide.llm import _hashing as H
from worktide.llm._common import in_small_batches, saved

MAX_ROWS, MAX_TERMS, PRIOR = 30_000, 400, 30.0
LEAST_TEXTS, LEAST_RATIO, LEAST_ODDS = 3, 18.0, 1.5
#: Bytes of text whose terms are held at once.
TERM_BYTES = 1 << 17
FIT_PARTITIONS, FOLDS = 8, 3

# Common insults and second persons in English, German, French and Spanish.
INSULTS = "asshole bastard bitch clown cretin disgusting dumb dumbass fool freak garbage idiot imbecile jerk loser moron pathetic retard scum shit stupid trash worthless abschaum arschloch blödmann depp dummkopf idiotin schlampe versager abruti connard crétin débile imbécile minable ordure salaud basura cabrón escoria estúpido idiota imbécil patético".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

FEATURES = (
    "words", "hits", "hit_rate", "distinct_hits", "weight", "weight_rate", "weight_root", "insults", "insult_rate", "strongest", "close_hits", "close_rate",
    "second_person_rate", "capital_rate", "shouted_rate", "punctuation_rate", "emphasis_rate", "obfuscated_rate", "obfuscated_hits", "stretched_rate",
)
WORDS = re.compile(r"[^\W\d_]+")
SHOUTED = re.compile(r"\b[A-Z]{3,}\b")
EMPHASIS = re.compile(r"[!?]{2,}")
OBFUSCATED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W\d_][0-9@$!*._-]+[^\W\d_]\S*")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
NEAR = 40


@dataclass(frozen=True)
class Lexicon:
    """Term -> log odds; a term that ends in * stands for a word's beginning."""

    terms: tuple[tuple[str, float], ...]


@lru_cache(maxsize=2)
def automaton(terms: tuple[tuple[str, float], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for word in SECOND_PERSON:
        out.add_word(word, (word, True, -1.0))
    for word in INSULTS:
        out.add_word(word, (word, True, 0.0))
    for term, weight in terms:
        bare = term.rstrip("*")
        out.add_word(bare, (bare, not term.endswith("*"), weight))
    out.make_automaton()
    return out


def features_of(text: str, terms: tuple[tuple[str, float], ...]) -> list[float]:
    low = text.lower()
    insults = set(INSULTS)
    hits, second, last_end = [], [], -1
    for end, (term, whole, weight) in automaton(terms).iter(low):
        start = end - len(term) + 1
        if start and (low[start - 1].isalpha()):
            continue
        if whole and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        if weight < 0:
            second.append(start)
        elif hits and start == last_end:  # a longer term at the same place
            hits[-1] = (start, term, max(hits[-1][2], weight))
        else:
            hits.append((start, term, weight))
            last_end = start
    n = len(text.split())
    most, raw = max(n, 1), np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    punctuation = int((((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127))).sum())
    chars = max(len(raw), 1)
    hard = OBFUSCATED.findall(text)
    hidden = 0
    for word in hard:
        plain = word.lower().translate(LEET)
        hidden += plain in insults or any(plain.startswith(t.rstrip("*")) for t, _ in terms)
    places = np.array(second)
    close = sum(bool(len(places)) and int(np.abs(places - s).min()) <= NEAR for s, _, _ in hits)
    weight = sum(w for _, _, w in hits)
    named = sum(t in insults for _, t, _ in hits)
    return [
        math.log1p(n), len(hits), len(hits) / most, len({t for _, t, _ in hits}), weight, weight / most, weight / math.sqrt(most), named, named / most, max((w for _, _, w in hits), default=0.0), close, close / most,
        len(second) / most, capitals / chars, len(SHOUTED.findall(text)) / most, punctuation / chars, len(EMPHASIS.findall(text)) / most, len(hard) / most, hidden, len(STRETCHED.findall(low)) / most,
    ]


def feature_column(lexicon: Lexicon, text: Column) -> Column:
    terms = lexicon.terms

    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features_of(t or "", terms) for t in batch])

    dense.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(dense, "array<double>")(text)


def term_counts(labelled: DataFrame) -> DataFrame:
    """term, toxic, clean of (text, label, fold) rows: in how many toxic and clean texts
    of each fold a term is (arrays by fold). Terms of fewer than three toxic texts are
    left out."""

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in H.slices(batch["text"], TERM_BYTES):
                rows, terms = [], []
                for i, text in enumerate(texts, first):
                    words = set(WORDS.findall(text.decode().lower()))
                    found = words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}
                    rows += [i] * len(found)
                    terms += found
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["label"].take(at), batch["fold"].take(at), pa.array(terms, pa.string())], names=["label", "fold", "term"])

    each = labelled.select("text", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold")).mapInArrow(terms_of, "label double, fold int, term string")
    of = lambda value: F.array(*(F.sum(F.when(F.col("fold") == k, value).otherwise(0.0)) for k in range(FOLDS)))
    counts = each.groupBy("term").agg(of(F.col("label")).alias("toxic"), of(1 - F.col("label")).alias("clean"), F.sum("label").alias("all"))
    return counts.where(F.col("all") >= LEAST_TEXTS).drop("all")


def learn_lexicon(counts: DataFrame, sizes: list[tuple[float, float]], without: int | None = None, max_terms: int = MAX_TERMS) -> Lexicon:
    """The terms that mark label 1, by the counts of all folds but ``without``; sizes:
    how many toxic and clean texts each fold has."""
    used = [k for k in range(FOLDS) if k != without]
    toxic, clean = (sum(sizes[k][y] for k in used) for y in (0, 1))
    a, b = F.col("a"), F.col("b")
    total = lambda column: reduce(Column.__add__, (F.col(column)[k] for k in used))
    n = toxic + clean  # a >= 3: with no toxic text there is no term
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * toxic / n) + part(b, (a + b) * clean / n) + part(toxic - a, (n - a - b) * toxic / n) + part(clean - b, (n - a - b) * clean / n))
    odds = F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5))
    kept = counts.select("term", total("toxic").alias("a"), total("clean").alias("b")).where(a >= LEAST_TEXTS).withColumns({"ratio": ratio, "odds": odds})
    best = kept.where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("ratio"), "term").limit(max_terms)
    return Lexicon(tuple((r["term"], round(r["odds"], 6)) for r in best.select("term", "odds").collect()))


@dataclass
class Model:
    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    taught: float = 0.0
    fields: tuple[str, ...] = field(default=FEATURES)

    def score(self, docs: DataFrame, text: str = "text", result: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 for each whole text."""
        own = [c for c in docs.columns if c.lower() != result.lower()]
        held = in_small_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), feature_column(self.lexicon, F.col(text)).alias("dense"))
        rule = 1 - F.exp(-60.0 * F.element_at("dense", FEATURES.index("insult_rate") + 1))
        if self.trees is None:
            got = held.withColumn("value", rule)
        else:
            judged = self.trees.transform(held.withColumn("features", array_to_vector("dense")))
            chance = judged.select("row", F.element_at(vector_to_array("probability"), 2).alias("chance"), rule.alias("rule"))
            lifted = F.col("calibrated") + PRIOR / (self.taught + PRIOR) * F.greatest(F.lit(0.0), F.col("rule") - F.col("calibrated"))
            got = self.calibration.transform(chance).withColumn("value", F.least(F.greatest(lifted, F.lit(0.0)), F.lit(1.0)))
        return got.select(*(F.col("row").getField(c).alias(c) for c in own), F.col("value").alias(result))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 17) -> Model:
    """A model from texts (doc_id, text) and their labels (doc_id, label 0 or 1).

    The sample is drawn from the labels, so it may be broadcast: max_rows pairs
    of a long and a double. The texts are read once and not shuffled.
    """
    drawn = (
        labels.where(F.col("label").isin(0, 1))
        .select("doc_id", F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "label")
        .limit(max_rows)
    )
    sample = in_small_batches(docs).where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").repartition(FIT_PARTITIONS)
    fold = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("doc_id")), F.lit(FOLDS)).cast("int")
    sample = saved(sample.withColumn("fold", fold))
    found = {r["fold"]: (r["toxic"], r["clean"]) for r in sample.groupBy("fold").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).collect()}
    if len(found) < 2:  # nothing labelled, or no fold that others could judge
        return Model(Lexicon(()))
    sizes = [found.get(k, (0.0, 0.0)) for k in range(FOLDS)]
    counts, unseen = saved(term_counts(sample)), []
    for k in found:
        lexicon = learn_lexicon(counts, sizes, k)
        rows = dense_rows(sample, lexicon)
        unseen.append(saved(chances(grow(rows.where(F.col("fold") != k), seed), rows.where(F.col("fold") == k))))
    lexicon = learn_lexicon(counts, sizes)
    taught = min(sum(x) for x in zip(*sizes))
    return Model(lexicon, grow(dense_rows(sample, lexicon), seed), calibrate(reduce(DataFrame.union, unseen)), float(taught))


def dense_rows(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    return saved(sample.select("fold", "label", feature_column(lexicon, F.col("text")).alias("dense"))).withColumn("features", array_to_vector("dense"))


def grow(rows: DataFrame, seed: int):
    """At most max_rows rows of numbers, in many short jobs: few partitions."""
    return GBTClassifier(labelCol="label", featuresCol="features", maxDepth=3, maxIter=24, stepSize=0.2, maxBins=64, seed=seed, minInstancesPerNode=5).fit(rows.coalesce(FIT_PARTITIONS))


def chances(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).select(F.element_at(vector_to_array("probability"), 2).alias("chance"), "label")


def calibrate(judged: DataFrame):
    return IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="calibrated").fit(judged)
