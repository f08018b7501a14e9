"""Small documents with every odd case: nulls, empty and long texts, ties, repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'aeiou'[r.randrange(5)]}" for _ in range(n))


def documents():
    base, passage = words(1, 120), words(2, 70)
    edited = base.split()
    edited[60] = "other"
    out = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", None),
        (3, " ".join(edited), None, None, 3),
        (4, None, "en", "a", 4),
        (5, "", "en", "c", 5),
        (6, " \t\n ", "en", "c", 6),
        (7, "one", "en", "a", 7),
        (8, "One", "en", "a", 7),
        (9, words(3, 30) + " " + passage + " " + words(4, 30), "en", "a", 9),
        (10, words(5, 10) + "\n" + passage + "\n" + words(6, 55), "de", "b", 10),
        (11, passage, "de", "b", 10),
        (12, "é中\U0001f600 <|endoftext|> I'll  'tis\r\n\r\n x" * 3, "fr", "c", 12),
        (13, words(7, 4000), "en", "a", 13),
        (14, "a " * 300, "en", "a", 14),
        (14, "a " * 300, "en", "a", 14),
        (15, "x" * 20000, "en", "a", 15),
        (None, base, "en", "a", 16),
        (None, None, None, None, None),
    ]
    return out + [(100 + i, words(50 + i, 20 + 7 * i), "en", "abc"[i % 3], i) for i in range(24)]


CLASHING = {"row": 1, "tie": "t", "ids": "i", "decoded": "d", "n_tokens": "n", "score": "s", "kept": "k", "spans": 2, "marks": 3, "mix_id": 4, "bucket": 5, "part": 6, "key": "k", "shingles": 7, "rule": "r"}


def frame(spark, rows=None, clash=True):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return docs.select("*", *(F.lit(v).alias(c) for c, v in CLASHING.items())) if clash else docs


def word_list(text):
    return (text or "").encode().split()
