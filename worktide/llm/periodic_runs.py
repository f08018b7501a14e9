"""Periodic runs of words, by comparing a text with itself at every lag.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least max(LEAST, 3 * q) words that no neighbouring word extends
keeping period q. Words are runs of anything but ASCII white space, unchanged.

1. A batch's words become numbers, exactly (a table of the words themselves), never
   the same in two documents, so that no comparison runs over a text's end. The
   longest texts come first: those with 3 * q words or more are then a prefix of
   the batch, and one comparison serves them all.
2. Every lag q from 1 to n / 3 is compared. A run makes a stretch of
   s = max(LEAST - q, 2 * q) places that equal the place q further on, and s places
   hold four of every (s div 4)-th in a row: those are compared for the whole batch
   first. Where four in a row agree, the text is compared with its shift in full
   and the true stretches are measured.
3. A stretch that several lags give is one run; its smallest lag is its period. (At
   length 3 * q or more, a smaller period divides q, and both reach equally far.)

A text of more than LONG_BYTES is dealt out by ranges of lags over all machines;
the ranges' runs meet by document again. All other texts stay where they are read.

Null text has no words, no runs and keeps ''. Rows with null or equal doc_ids are
rows like all others: every row gives one row. Texts of any length are taken whole;
memory grows with one batch (``in_small_batches``) or one text. Equal runs of
different texts have nothing to do with each other. Extra columns pass through,
whatever they are called, but for n_words, runs and kept, which are replaced. No
rows give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from worktide.llm import _hashing as H
from worktide.llm._common import WORD, in_small_batches, saved

LEAST, EXPONENT = 24, 3
#: Bytes of texts whose lags are compared together, and of a text whose lags are dealt out.
BATCH_BYTES, LONG_BYTES = 4 << 20, 1 << 20
#: Lags of a range at least, and ranges of a text at most.
LAGS, RANGES = 1 << 14, 64
RUNS = "array<struct<start: long, length: long, period: long>>"


def stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of at least ``least`` true values start, and how long they are."""
    edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
    start, length = edge[::2], edge[1::2] - edge[::2]
    long = length >= least
    return start[long], length[long]


def scan(ids: np.ndarray, begins: np.ndarray, low: int = 1, high: int | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs with a period of low..high.

    ids: the words' numbers; begins: where each text begins, and the end. Texts come
    longest first and share no number."""
    sizes = np.diff(begins)
    found: list[tuple[np.ndarray, ...]] = []
    for q in range(low, min(int(sizes[0]) // EXPONENT, high or len(ids)) + 1 if len(sizes) else 0):
        least = max(LEAST, EXPONENT * q)
        texts = len(sizes) - int(np.searchsorted(sizes[::-1], least))
        if not texts:
            break
        need, end = least - q, int(begins[texts])
        step = max(1, need // 4)
        probe = ids[: end - q : step] == ids[q:end:step]
        near = np.flatnonzero(probe[3:] & probe[2:-1] & probe[1:-2] & probe[:-3]) * step
        for text in np.unique(np.searchsorted(begins, near, "right") - 1).tolist() if len(near) else ():
            a, b = int(begins[text]), int(begins[text + 1])
            start, length = stretches(ids[a : b - q] == ids[a + q : b], need)
            if len(start):
                found.append((np.full(len(start), text), start, length + q, np.full(len(start), q)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    text, start, length, period = (np.concatenate(c).astype(np.int64) for c in zip(*found))
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, period = text[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, none shared by two texts, and where the texts begin."""
    ids = np.empty(sum(map(len, texts)), np.int32)
    begins, base = [0], 0
    for words in texts:
        table: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
        at = begins[-1]
        ids[at : at + len(words)] = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
        ids[at : at + len(words)] += base
        base += len(table)
        begins.append(at + len(words))
    return ids, np.array(begins, np.int64)


def without_repeats(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if len(start):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def batch_runs(texts: list[bytes]) -> tuple[list[int], pa.Array, list[bytes]]:
    """Of each text: its number of words, its runs and the words kept."""
    split = [t.split() for t in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    ids, begins = numbered([split[i] for i in order])
    text, *runs = scan(ids, begins)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.searchsorted(text, np.arange(len(order) + 1))
    pick = [slice(at[r], at[r + 1]) for r in rank]
    kept = [without_repeats(words, *(c[p] for c in runs)) for words, p in zip(split, pick)]
    flat = np.concatenate([np.arange(p.start, p.stop) for p in pick]).astype(np.int64) if pick else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([p.stop - p.start for p in pick])]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c[flat]) for c in runs], ["start", "length", "period"])
    return [len(w) for w in split], pa.ListArray.from_arrays(pa.array(offsets), values), kept


def long_runs(long: DataFrame) -> DataFrame:
    """no, runs of texts (no, text) whose lags are dealt out by ranges."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                no, text, low, high = (batch[c][i].as_py() for c in ("no", "text", "low", "high"))
                ids, begins = numbered([text.encode().split()])
                _, *runs = scan(ids, begins, low, high)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs[0]), no)), *map(pa.array, runs)], names=["no", "start", "length", "period"])

    most = F.regexp_count("text", F.lit(WORD)) / EXPONENT
    step = F.greatest(F.lit(LAGS), F.ceil(most / RANGES).cast("int"))
    ranges = long.withColumns({"most": most.cast("int"), "step": step}).where("most > 0")
    low = F.explode(F.sequence(F.lit(1), "most", "step"))
    pieces = ranges.select("no", "text", "step", low.alias("low")).select("no", "text", "low", (F.col("low") + F.col("step") - 1).alias("high"))
    found = pieces.repartition("no", "low").mapInArrow(compare, "no long, start long, length long, period long")
    runs = found.groupBy("no", "start", "length").agg(F.min("period").alias("period"))
    return runs.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found")).select("no", F.expr(f"cast(transform(found, r -> struct(r.start, r.length, r.period)) as {RUNS})").alias("runs"))


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period, by start, then period) and
    kept, the text without what its runs repeat."""
    result = ("n_words", "runs", "kept")
    own = [c for c in docs.columns if c.lower() not in result]
    held = in_small_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    fields = T._parse_datatype_string(f"n_words long, runs {RUNS}, kept string").fields
    schema = T.StructType([held.schema["row"], *fields])
    is_long = F.octet_length("text") > long_bytes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in H.slices(batch["text"], BATCH_BYTES):
                n, runs, kept = batch_runs(texts)
                yield pa.RecordBatch.from_arrays([batch["row"].slice(first, len(texts)), pa.array(n, pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=["row", *result])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in H.slices(batch["text"]):
                some, n, kept = batch.slice(first, len(texts)), [], []
                for words, runs in zip((t.split() for t in texts), some["runs"].to_pylist()):
                    n.append(len(words))
                    kept.append(without_repeats(words, *(np.array([r[c] for r in runs or ()], np.int64) for c in ("start", "length", "period"))))
                yield pa.RecordBatch.from_arrays([some["row"], pa.array(n, pa.int64()), some["runs"], pa.array(kept, pa.binary()).cast(pa.string())], names=["row", *result])

    short = held.where(~is_long).mapInArrow(find, schema)
    long = saved(held.where(is_long).withColumn("no", F.monotonically_increasing_id()))
    met = long.join(long_runs(long), "no", "left").select("row", "text", F.coalesce("runs", F.expr(f"cast(array() as {RUNS})")).alias("runs"))
    done = short.union(met.mapInArrow(cut, schema))
    return done.select(*(F.col("row").getField(c).alias(c) for c in own), *result)
