"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond
ASCII. A window is WIDTH consecutive words of a benchmark item, or all words of an
item that has fewer.

1. Index. Each task cuts its documents into shards of bounded bytes and stores, for
   every word of a shard, the ascending places at which it occurs (as steps, so that
   they compress), with a directory of the shard's documents. Places count on over a
   shard's documents with a hole between two, so no phrase runs over a text's end.
   The index is a table; nothing is shuffled to build it.
2. Anchors. The lists of the benchmark's words are taken out of the index once. How
   often each word occurs in the corpus is one sum over them. Every window names its rarest word (the first of equals; a word
   that nowhere occurs rules the window out); windows of an item that name the same
   place are one anchor.
3. Intersection. Anchors meet the shards that hold their word, and the shard's lists
   of benchmark words come once (once for every BLOCK_WORDS words of the benchmark).
   The anchor's list, moved back by its offset, is intersected with the lists of the
   window's other words, each moved by its own offset, the rarest first, until no
   start is left. What remains are exact occurrences, for which no text is read.
4. Proximity (``near_matches``): the distinct words of a window within a stretch of
   so many document words, in any order, from the same lists.

Null texts have no words. Repeated rows are rows of their own; equal doc_ids are not
mixed up (a document is a shard and a place in it). An item without item_id hits, but
has no name to list; rows with equal item_ids are texts of one item. An empty
benchmark hits nothing, and no documents give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from worktide.llm import _hashing as H
from worktide.llm._common import in_small_batches, saved

WIDTH = 10
#: Bytes of text in a shard (and one more batch at most), and benchmark words that meet a shard at once.
SHARD_BYTES, BLOCK_WORDS = 32 << 20, 1_000_000
#: Bytes of benchmark words that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: What every byte counts as: letters in lower case, digits, bytes beyond ASCII; else a blank.
COUNTS_AS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "shard long, term string, n long, steps binary, doc_ids array<long>, begins array<int>, sizes array<int>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(COUNTS_AS).split()


def by_number(ids: np.ndarray) -> np.ndarray:
    """A stable order of ids, by halves of 16 bits, which numpy sorts by radix."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    high = (ids >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Shard:
    """Documents of one shard: their words as numbers, and the words so far."""

    def __init__(self):
        self.table: dict[bytes, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.ids, self.sizes, self.doc_ids, self.bytes = [], [], [], 0

    def add(self, doc_ids: list, texts: list[bytes]) -> None:
        for text in texts:
            words = words_of(text)
            self.sizes.append(len(words))
            self.ids.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))
        self.doc_ids += doc_ids
        self.bytes += sum(map(len, texts))

    def rows(self, shard: int) -> pa.RecordBatch:
        """The directory (term null) and the posting lists."""
        sizes, ids = np.array(self.sizes, np.int32), np.concatenate(self.ids)
        begins = np.cumsum(sizes + 1) - sizes - 1
        places = (np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)).astype(np.int32)[by_number(ids)]
        counts = np.bincount(ids, minlength=len(self.table))
        ends = np.cumsum(counts)
        steps = np.diff(places, prepend=np.int32(0)).astype(np.int32)
        steps[ends - counts] = places[ends - counts]
        n = len(self.table) + 1
        data = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0, 0], ends * 4]).astype(np.int32)), pa.py_buffer(steps)])
        only = lambda values, kind: pa.array([values] + [None] * (n - 1), pa.list_(kind))
        columns = [pa.array(np.full(n, shard)), pa.array([None, *self.table], pa.binary()).cast(pa.string()), pa.array(np.concatenate([[len(sizes)], counts]).astype(np.int64)), data]
        columns += [only(self.doc_ids, pa.int64()), only(begins.tolist(), pa.int32()), only(self.sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "n", "steps", "doc_ids", "begins", "sizes"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored index of docs (doc_id, text): see INDEX."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, Shard()

        def closed() -> Iterator[pa.RecordBatch]:
            rows = open_.rows(number)
            for at in range(0, len(rows), 4096):
                yield rows.slice(at, 4096)

        for batch in batches:
            for first, texts in H.slices(batch["text"], min(shard_bytes, H.SLICE_BYTES)):
                open_.add(batch["doc_id"].slice(first, len(texts)).to_pylist(), texts)
                if open_.bytes >= shard_bytes:
                    yield from closed()
                    number, open_ = number + 1, Shard()
        if open_.sizes:
            yield from closed()

    return saved(in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shards, INDEX))


def directory(index: DataFrame) -> DataFrame:
    """shard, begin, doc_id, n_words: a row for every document."""
    each = F.explode(F.arrays_zip("doc_ids", "begins", "sizes")).alias("d")
    return index.where("term IS NULL").select("shard", each).select("shard", F.col("d.begins").alias("begin"), F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words"))


def item_words(items: DataFrame) -> DataFrame:
    """no, item_id, words: an item a row, those without words left out."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return saved(items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0).withColumn("no", F.monotonically_increasing_id()))


def tested_lists(items: DataFrame, index: DataFrame) -> DataFrame:
    """The index's lists of words that items have: shard, term, n, steps. Few items'
    words are broadcast, their bytes being counted first; else both sides meet by word."""
    terms = saved(items.select(F.explode("words").alias("term")).distinct())
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    terms = F.broadcast(terms) if size <= BROADCAST_BYTES else terms
    return saved(index.where("term IS NOT NULL").select("shard", "term", "n", "steps").join(terms, "term"))


def anchors(items: DataFrame, lists: DataFrame, width: int = WIDTH) -> DataFrame:
    """no, term, at, low, words, counts: an anchor's word and its place in its item,
    where its first window starts, and the words (with their numbers in the corpus)
    from there to its last window's end. Windows with an absent word are gone."""
    each = items.select("no", F.posexplode("words").alias("at", "term"))
    counts = lists.groupBy("term").agg(F.sum("n").alias("count"))
    known = each.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    frame = W.partitionBy("no").orderBy("at").rowsBetween(0, width - 1)
    window = known.select("no", F.col("at").alias("start"), F.collect_list(F.struct("term", "count", "at")).over(frame).alias("window")).where((F.size("window") == width) | (F.col("start") == 0))
    named = window.withColumn("rarest", F.array_min(F.transform("window", lambda w: F.struct(w["count"], w["at"], w["term"])))).where("rarest.count > 0")
    spans = named.groupBy("no", F.col("rarest.at").alias("at")).agg(F.first("rarest.term").alias("term"), F.array_sort(F.collect_list(F.struct("start", "window"))).alias("windows"))
    further = F.expr("transform(slice(windows, 2, size(windows)), w -> element_at(w.window, -1))")
    return saved(spans.select("no", "term", "at", F.col("windows")[0]["start"].alias("low"), F.concat(F.col("windows")[0]["window"], further).alias("list")).select("no", "term", "at", "low", F.col("list.term").alias("words"), F.col("list.count").alias("counts"), F.size("list").alias("size")))


def member(sorted_places: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_places, values)
    return sorted_places[np.minimum(at, len(sorted_places) - 1)] == values if len(sorted_places) else np.zeros(len(values), bool)


def phrase_spans(lists: dict[str, np.ndarray], term: str, offset: int, words: list[str], counts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (of words[0] in the shard), and the first and last word beyond, of the
    stretches of at least ``width`` words around the anchor that occur as they stand."""
    width = min(width, len(words))
    starts = lists[term].astype(np.int64) - offset
    held = np.ones((len(starts), len(words)), bool)
    for k in sorted(range(len(words)), key=lambda k: (counts[k], k)):
        if k != offset:
            held[:, k] = member(lists.get(words[k], np.zeros(0, np.int32)), starts + k)
            before, after = held[:, :offset][:, ::-1], held[:, offset + 1 :]
            can = np.cumprod(before, axis=1).sum(axis=1) + np.cumprod(after, axis=1).sum(axis=1) + 1 >= width
            starts, held = starts[can], held[can]
            if not len(starts):
                break
    left = np.cumprod(held[:, :offset][:, ::-1], axis=1).sum(axis=1)
    right = np.cumprod(held[:, offset + 1 :], axis=1).sum(axis=1)
    return starts, offset - left, offset + right + 1


def near_spans(lists: dict[str, np.ndarray], term: str, words: list[str], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest stretches of at most ``reach`` document words that hold all of
    ``words``: first and last place beyond."""
    every = [lists.get(w, np.zeros(0, np.int32)).astype(np.int64) for w in dict.fromkeys(words)]
    if not all(map(len, every)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rare = lists[term].astype(np.int64)
    starts = np.unique(np.concatenate(every))
    after = np.searchsorted(rare, starts)
    starts = starts[(after < len(rare)) & (rare[np.minimum(after, len(rare) - 1)] - starts < reach)]
    ends = starts.copy()
    for places in every:
        at = np.searchsorted(places, starts)
        there = at < len(places)
        starts, ends, at = starts[there], ends[there], at[there]
        ends = np.maximum(ends, places[at])
    fits = ends - starts < reach
    starts, ends = starts[fits], ends[fits]
    last = np.append(ends[1:] != ends[:-1], True) if len(ends) else np.zeros(0, bool)
    return starts[last], ends[last] + 1


MATCH = "shard long, begin int, no long, start long, end long, item_start int"


def intersected(index: DataFrame, listed: DataFrame, found: DataFrame, spans) -> DataFrame:
    """MATCH rows: ``spans(lists, anchor)`` gives first, last place beyond and item
    place of an anchor's matches in one shard's posting lists."""
    total = found.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    block = F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("block")
    tested = found.select(block, F.explode("words").alias("term")).distinct()
    lists = listed.join(tested, "term").select("shard", "block", "term", "steps", F.lit(None).cast("array<int>").alias("begins"))
    heads = index.where("term IS NULL").select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("steps"), "begins")
    asked = found.withColumn("block", block).join(listed.select("shard", "term"), "term").select(F.col("shard").alias("of"), F.col("block").alias("part"), "no", "term", "at", "low", "words", "counts")

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        terms, steps = left["term"].to_pylist(), left["steps"].combine_chunks()
        lists, begins = {}, np.zeros(0, np.int64)
        for i, term in enumerate(terms):
            if term is None:
                begins = np.array(left["begins"][i].as_py(), np.int64)
            else:
                lists[term] = np.cumsum(np.frombuffer(steps[i].as_buffer(), np.int32), dtype=np.int32)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        for anchor in (right.to_pylist() if lists else ()):
            first, last, place = spans(lists, anchor)
            at = np.searchsorted(begins, first, "right") - 1
            one = np.searchsorted(begins, last - 1, "right") - 1 == at
            at, first, last, place = at[one], first[one], last[one], place[one]
            for column, values in zip(out, (begins[at], np.full(len(at), anchor["no"]), first - begins[at], last - begins[at], place)):
                column.append(values)
        begin, no, start, end, place = map(np.concatenate, out)
        columns = [pa.array(np.full(len(no), key[0].as_py(), np.int64)), pa.array(begin.astype(np.int32)), pa.array(no), pa.array(start), pa.array(end), pa.array(place.astype(np.int32))]
        return pa.Table.from_arrays(columns, names=["shard", "begin", "no", "start", "end", "item_start"])

    return lists.union(heads).groupBy("shard", "block").cogroup(asked.groupBy("of", "part")).applyInArrow(meet, MATCH)


def phrase_matches(index: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """shard, begin (which document), no (which item), start, end, item_start: where
    words start..end of the document are the item's words from item_start on. Matches
    of one item may overlap where two anchors meet; together they cover every word
    inside an occurrence of a window and no other."""

    def spans(lists, anchor):
        starts, left, right = phrase_spans(lists, anchor["term"], anchor["at"] - anchor["low"], anchor["words"], anchor["counts"], width)
        return starts + left, starts + right, anchor["low"] + left

    lists = tested_lists(items, index)
    return intersected(index, lists, anchors(items, lists, width), spans)


def near_matches(index: DataFrame, items: DataFrame, reach: int, width: int = WIDTH) -> DataFrame:
    """As phrase_matches, for stretches of at most ``reach`` document words that hold
    all words of one of the item's windows, in any order; item_start: the window's."""
    lists = tested_lists(items, index)
    narrow = anchors(items, lists, width)
    last = F.greatest(F.size("words") - width, F.lit(0))
    every = narrow.select("no", "term", "at", F.explode(F.sequence(F.lit(0), last)).alias("start"), "low", "words", "counts").select(
        "no", "term", "at", (F.col("low") + F.col("start")).alias("low"), F.slice("words", F.col("start") + 1, width).alias("words"), F.slice("counts", F.col("start") + 1, width).alias("counts")
    )

    def spans(lists, anchor):
        first, last = near_spans(lists, anchor["term"], anchor["words"], reach)
        return first, last, np.full(len(first), anchor["low"])

    return intersected(index, lists, saved(every.withColumn("size", F.size("words"))), spans).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item_ids, each once): a row a document."""
    index, items = build_index(docs), item_words(benchmark)
    found = saved(phrase_matches(index, items, width).join(items.select("no", "item_id"), "no", "left"))
    along = W.partitionBy("shard", "begin").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", reach), F.lit(0))
    spans = found.groupBy("shard", "begin", "start").agg(F.max("end").alias("end"))
    hits = spans.withColumn("fresh", fresh).groupBy("shard", "begin").agg(F.sum("fresh").alias("n_hit"))
    names = found.groupBy("shard", "begin").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    each = directory(index).join(hits.join(names, ["shard", "begin"]), ["shard", "begin"], "left")
    return each.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
