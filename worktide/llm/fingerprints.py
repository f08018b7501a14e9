"""Document fingerprints by winnowing, with DataFrame functions only.

A gram is K consecutive words (runs of anything but ASCII white space); a text
of fewer words is one gram. Of every WINDOW consecutive grams the one with the
least hash is marked, the rightmost if several tie, so any run of
K + WINDOW - 1 words that two texts share puts an equal mark in both. A mark is
one long: the hash's low 32 bits, then the bits of MOST - place, so that a plain
minimum also settles ties; ``places`` and ``hashes`` take it apart. Grams and
window minima are built by doubling: each step combines an array with itself
shifted, a few passes over a text whatever K and WINDOW.

Likeness is the Jaccard index of two texts' sets of mark hashes. Null text
counts as empty and has no marks; two texts without marks are alike (1.0).

``with_next`` puts the next row in descending doc_id beside each row, as needed
to edit texts. Ids are cut into buckets at approximate quantiles, each bucket's
first row is also sent to the bucket in front of it (the first bucket's to the
last), and a lead() within buckets does the rest: one shuffle of the texts, no
global sort. Null ids come last; rows with equal ids go by the hash of their
text. A single row is its own successor. No rows give no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.llm._common import n_partitions

K, WINDOW = 3, 4
MOST = (1 << 31) - 1
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values), F.lit(1)))


def marks(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The winnowing marks of a text, in order of place (array of long)."""
    words = F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")

    def grams(hashes: Column, have: int) -> Column:
        if have == k:
            return F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(1)))
        more = min(have, k - have)
        return let(F.zip_with(hashes, shifted(hashes, more), lambda a, b: F.xxhash64(a, b)), lambda h: grams(h, have + more))

    def least(packed: Column, have: int) -> Column:
        if have == window:
            return F.array_distinct(F.slice(packed, 1, F.greatest(F.size(packed) - (window - 1), F.lit(1))))
        more = min(have, window - have)
        return let(F.zip_with(packed, shifted(packed, more), lambda a, b: F.least(a, b)), lambda p: least(p, have + more))

    def packed(gram: Column) -> Column:
        return F.transform(gram, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(F.lit(MOST) - i.cast("long")))

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(grams(h, 1), lambda g: let(packed(g), lambda p: least(p, 1))))
    empty = F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))) == 0
    return F.when(empty, F.array().cast("array<long>")).otherwise(found)


def hashes(marked: Column) -> Column:
    """The distinct hashes of marks."""
    return F.array_distinct(F.transform(marked, lambda m: F.shiftright(m, 31)))


def places(marked: Column) -> Column:
    """Where the marked grams begin, in words from 0."""
    return F.transform(marked, lambda m: F.lit(MOST) - m.bitwiseAND(F.lit(MOST)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of hashes."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(common, lambda c: c / (F.size(a) + F.size(b) - c)))


def with_next(docs: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """(doc_id, text, halo) in buckets, and next_of(column): that column's value
    in the next document. Drop the rows with halo when all is read."""
    from pyspark.ml.feature import Bucketizer

    n = 8 * n_partitions(docs.sparkSession)
    id_double = F.col("doc_id").cast("double")
    (cuts,) = docs.agg(F.percentile_approx(id_double, [i / n for i in range(1, n)], 20 * n)).first()
    splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), id_double.alias("id_double"))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="id_double", outputCol="bucket", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("bucket", F.lit(0.0))
    rows = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), -1.0).otherwise(F.col("bucket")).alias("bucket"), F.xxhash64("text").alias("tie"))
    first = F.max(F.struct("doc_id", (-F.col("tie")).alias("tie")))
    in_order = W.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))
    ends = (
        rows.groupBy("bucket")
        .agg(first.alias("first"))  # a row for each bucket, of which there are n at most, and one for null
        .select(
            "bucket",
            F.col("first.doc_id").alias("first_id"),
            (-F.col("first.tie")).alias("first_tie"),
            F.coalesce(F.lag("bucket").over(in_order), F.min("bucket").over(W.partitionBy(F.lit(0)))).alias("front"),
        )
        .withColumnRenamed("bucket", "of")
    )
    at_end = (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    own = F.struct("bucket", F.lit(False).alias("halo"))
    copy = F.struct(F.col("front").alias("bucket"), F.lit(True).alias("halo"))
    dealt = (
        rows.join(F.broadcast(ends), at_end, "left")
        .withColumn("to", F.explode(F.when(F.col("front").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("doc_id", "text", "tie", F.col("to.bucket").alias("bucket"), F.col("to.halo").alias("halo"))
    )
    along = W.partitionBy("bucket").orderBy("halo", F.desc_nulls_last("doc_id"), "tie")
    return dealt, lambda column: F.lead(column).over(along)


def fingerprint(docs: DataFrame, text: str = "text", result: str = "marks", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with the marks of each whole text."""
    return docs.withColumn(result, marks(F.col(text), k, window))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text and both texts' marks, with likenesses.

    The edited text keeps the first ceil(n / 2) code points and takes as many
    of the next document's first ones as went, or all if it has fewer.
    """
    rows, next_of = with_next(docs)
    rows = rows.withColumn("follower", next_of("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("follower", F.lit(1), half))
    both = fingerprint(fingerprint(rows.withColumn("edited", edited).drop("follower"), "text", "marks"), "edited", "edited_marks")
    both = both.withColumns({"set": hashes(F.col("marks")), "edited_set": hashes(F.col("edited_marks"))}).drop("text")
    both = both.withColumn("next_set", next_of("set"))
    return both.where(~F.col("halo")).select(
        "doc_id", "n_chars", "edited", "marks", "edited_marks", likeness(F.col("set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("set"), F.col("next_set")).alias("near_next")
    )
