"""Substring dedup by compacting a de Bruijn graph of repeated word k-mers.

A window is WINDOW consecutive words of one document; a word goes if a window
that covers it also starts in a document with a smaller doc_id.

1. Edges. Every window names one k-mer, the one with the least hash inside it
   (leftmost on ties): about one word in twenty. Equal windows name equal k-mers,
   so nothing repeated is lost by keeping only those. A k-mer's occurrence also
   carries the hash of its context, all words that windows over it can reach, cut
   at the document's ends. K-mers in one document only are dropped; occurrences
   with equal k-mer and context are one edge, and its place in the document with
   the smallest doc_id (its first) is where all others are compared.
2. Compaction. Two edges that several documents share are linked where they
   follow and touch each other in a document. A link is nonbranching if it is the
   only one out of the one and into the other, and straight if both edges lie the
   same way in one first document. Paths of nonbranching straight links are
   compacted by pointer doubling, a join a round: every edge learns its path's
   head, its distance and its number. A document's consecutive edges on a path
   are then one span, however long.
3. Branches. Where a k-mer has several contexts, the first documents spell out
   the windows of that k-mer as 128-bit cryptographic digests of their words; the
   smallest doc_id for each is found by one more aggregate and join, and
   consecutive windows are one span again.
4. Verification. A path's span names its place in an earlier document. The words
   there and here are compared by a digest of both, taken from the texts at these
   source coordinates; only spans that agree are removed.

Aggregates are combined before the shuffle, and a k-mer, edge, window or span
that makes up an uncommon share of all rows is dealt into pieces for its joins,
so a passage that a third of all documents share is no single task.
Null text has no words; rows with a null doc_id keep all words and remove none.
Rows with equal doc_ids don't remove each other's words. Repeated rows get equal
results; other columns pass through. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from worktide.llm import _hashing as H
from worktide.llm._common import in_small_batches, join_hot, saved

WINDOW, K = 50, 10


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        more = min(have, width - have)
        out = np.minimum(out[:-more], out[more:])
        have += more
    return out


class Anchors:
    """The anchors of a batch of texts: global word places and window ranges."""

    def __init__(self, texts: list[bytes], window: int, k: int):
        words, offsets = H.word_hashes(texts)
        self.sums = H.prefix(words, H.RUN_BASE)
        self.offsets, self.window = offsets, window
        self.text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        n, self.empty = len(words), True
        if n < window:
            return
        every = np.arange(n - k + 1)
        kmers = H.between(self.sums, every, every + k, H.RUN_BASE)
        packed = (kmers >> np.uint64(32) << np.uint64(32)) | every.astype(np.uint64)
        least = (sliding_least(packed, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(self.text[: n - window + 1] == self.text[window - 1 :])
        if not len(starts):
            return
        self.empty = False
        least = least[starts]
        first = np.flatnonzero(np.diff(least, prepend=-1))
        self.place = least[first]
        self.lo, self.hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        self.anchor = kmers[self.place]
        self.of = self.text[self.place]
        left = np.maximum(self.place - (window - k), offsets[self.of])
        right = np.minimum(self.place + window, offsets[self.of + 1])
        self.context = H.mixed(H.between(self.sums, left, right, H.RUN_BASE) ^ (self.place - left).astype(np.uint64))
        self.left, self.right = left, right


def anchor_rows(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """An occurrence a row: anchor (the k-mer), context, doc_id, tie, its place, the
    words its context spans (left, right) and the starts of the windows that name
    it (lo..hi)."""
    names = ["anchor", "context", "doc_id", "tie", "place", "left", "right", "lo", "hi"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch["doc_id"].to_numpy(), batch["tie"].to_numpy()
            for first, texts in H.slices(batch["text"]):
                run = slice(first, first + len(texts))
                a = Anchors(texts, window, k)
                if a.empty:
                    continue
                base = a.offsets[a.of]
                columns = [a.anchor.view(np.int64), a.context.view(np.int64), ids[run][a.of], ties[run][a.of]]
                columns += [(x - base).astype(np.int32) for x in (a.place, a.left, a.right, a.lo, a.hi)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(find, "anchor long, context long, doc_id long, tie long, place int, left int, right int, lo int, hi int")


def digest(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest()


def read_back(texts: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """Digests of words at source coordinates. wanted: doc_id, tie, lo, hi, anchor
    and n; without an anchor the one range lo..hi, else each window that starts
    there. The result: anchor, doc_id, tie, start, end, n, digest."""
    names = ["anchor", "doc_id", "tie", "start", "end", "n", "digest"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch["doc_id"].to_pylist(), batch["tie"].to_pylist()
            for at, data in H.slices(batch["text"]):
                out = []
                for i, text in enumerate(data, at):
                    words = text.split()
                    for anchor, lo, hi, n in (r.values() for r in batch["places"][i].as_py()):
                        ranges = [(lo, hi)] if anchor is None else [(a, a + window) for a in range(lo, hi + 1)]
                        out += [(anchor, ids[i], ties[i], a, b, n, digest(words, a, b)) for a, b in ranges]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)

    listed = wanted.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("anchor", "lo", "hi", "n")).alias("places"))
    met = texts.select("doc_id", "tie", "text").join(listed, ["doc_id", "tie"])
    return met.mapInArrow(read, "anchor long, doc_id long, tie long, start int, end int, n long, digest binary")


EDGE = ["anchor", "context"]


def compacted(shared: DataFrame) -> DataFrame:
    """(anchor, context, head, offset, number) of the edges that follow another one
    on a nonbranching path; shared: the occurrences of edges in several documents."""
    along = W.partitionBy("doc_id", "tie").orderBy("place")
    once = shared.withColumn("before", F.lag("place").over(along)).where("before IS NULL OR before < place").drop("before")  # repeated rows
    after = F.lead(F.struct(*EDGE, "place", "left", "first")).over(along)
    steps = once.withColumn("after", after).where("after.left <= right").withColumn("hop", F.col("after.place") - F.col("place")).where("hop > 0")
    same = (F.col("after.first.doc_id") == F.col("first.doc_id")) & (F.col("after.first.tie") == F.col("first.tie")) & (F.col("after.first.place") - F.col("first.place") == F.col("hop"))
    links = saved(steps.select(F.struct(*EDGE).alias("a"), F.struct(*(f"after.{c}" for c in EDGE)).alias("b"), "hop", same.alias("straight")).distinct())
    only_out = links.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.first("b").alias("b"), F.first("hop").alias("hop"), F.first("straight").alias("straight")).where("degree = 1 and straight")
    only_in = links.groupBy("b").agg(F.count(F.lit(1)).alias("degree")).where("degree = 1").select("b")
    pointers = saved(only_out.join(only_in, "b").select(F.col("b").alias("edge"), F.col("a").alias("head"), F.col("hop").alias("offset"), F.lit(1).alias("number")))
    going = True
    while going:
        further = pointers.select(F.col("edge").alias("head"), F.col("head").alias("further"), F.col("offset").alias("more"), F.col("number").alias("steps"))
        joined = pointers.join(further, "head", "left")
        add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        pointers = saved(joined.select("edge", F.coalesce("further", "head").alias("head"), add("offset", "more"), add("number", "steps"), F.col("further").isNotNull().alias("moved")))
        going = bool(pointers.agg(F.max("moved")).first()[0])
        pointers = pointers.drop("moved")
    return pointers.select("edge.*", "head", "offset", "number")


def runs(rows: DataFrame, along: list[str], number: str) -> DataFrame:
    """Rows (doc_id, tie, from, to, first, shift, ...) whose ``number`` counts on
    without a gap, as one span each: first is where the span's words begin in the
    earlier document."""
    place = F.dense_rank().over(W.partitionBy("doc_id", "tie", *along).orderBy(number))
    keys = ["doc_id", "tie", "first_id", "first_tie", "shift"]
    joined = rows.withColumn("run", F.col(number) - place).groupBy(*keys, *(c for c in along if c not in keys), "run")
    return joined.agg(F.min("from").alias("from"), F.max("to").alias("to")).select(*keys[:4], "from", "to", (F.col("from") + F.col("shift")).alias("first_from"), (F.col("to") + F.col("shift")).alias("first_to"))


def repeated_spans(docs: DataFrame, texts: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, tie, from, to, digest): word places that an earlier document has
    if their words have that digest (null: compared already); spans may overlap."""
    own, most, n = ["doc_id", "tie"], F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")
    occurrences = anchor_rows(docs, window, k)
    kmers = occurrences.groupBy("anchor").agg(F.min("doc_id").alias("least"), most, F.min("context").alias("c0"), F.max("context").alias("c1"), n).where("least < most")
    repeated = saved(kmers.select("anchor", "n", (F.col("c0") != F.col("c1")).alias("branches")))
    rows = saved(join_hot(occurrences, repeated, ["anchor"], own))
    edges = saved(rows.groupBy(*EDGE).agg(F.min(F.struct("doc_id", "tie", "place")).alias("first"), most, n))
    placed = saved(join_hot(rows, edges, EDGE, own).withColumn("shared", F.col("first.doc_id") < F.col("most")).drop("most"))

    shared = placed.where("shared").select(*EDGE, *own, "place", "left", "right", "first")
    paths = saved(edges.where("first.doc_id < most").select(*EDGE, "n").join(compacted(shared), EDGE, "left").select(*EDGE, "n", F.coalesce("head", F.struct(*EDGE)).alias("head"), F.coalesce("offset", F.lit(0)).alias("offset"), F.coalesce("number", F.lit(0)).alias("number")))
    first = [F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie")]
    on_paths = join_hot(shared.where("first.doc_id < doc_id"), paths, EDGE, own).select(
        *own, *first, (F.col("first.place") - F.col("place")).alias("shift"), F.col("left").alias("from"), F.col("right").alias("to"), "head", (F.col("place") - F.col("offset")).alias("begin"), "number"
    )
    compact = saved(runs(on_paths, ["first_id", "first_tie", "shift", "head", "begin"], "number"))

    there = compact.groupBy("first_id", "first_tie", "first_from", "first_to").agg(n)
    sources = there.select(F.col("first_id").alias("doc_id"), F.col("first_tie").alias("tie"), F.lit(None).cast("long").alias("anchor"), F.col("first_from").alias("lo"), F.col("first_to").alias("hi"), "n")
    branches = placed.where("branches and first.doc_id = doc_id").select(*own, "anchor", "lo", "hi", F.lit(0).cast("long").alias("n"))
    read = saved(read_back(texts, sources.union(branches), window))
    digests = saved(read.where("anchor IS NULL").select(F.col("doc_id").alias("first_id"), F.col("tie").alias("first_tie"), F.col("start").alias("first_from"), F.col("end").alias("first_to"), "n", "digest").distinct())
    verified = join_hot(compact, digests, ["first_id", "first_tie", "first_from", "first_to"], own).select(*own, "from", "to", "digest")

    windows = read.where("anchor IS NOT NULL").drop("n")
    firsts = saved(windows.groupBy("anchor", "digest").agg(F.min(F.struct("doc_id", "tie", "start")).alias("first"), most, n).where("first.doc_id < most").drop("most"))
    spelled = join_hot(windows, firsts, ["anchor", "digest"], own).where("first.doc_id < doc_id").select(
        *own, *first, (F.col("first.start") - F.col("start")).alias("shift"), F.col("start").alias("from"), F.col("end").alias("to")
    )
    return verified.union(runs(spelled, ["first_id", "first_tie", "shift"], "from").select(*own, "from", "to", F.lit(None).cast("binary").alias("digest")))


def without_spans(text: bytes, spans: list | None) -> tuple[int, int, bytes]:
    """How many words a text has and loses to those spans whose words have the
    digest of the earlier document's, and the words left, joined by one space."""
    words = text.split()
    n = len(words)
    if spans:
        change = np.zeros(n + 1, np.int64)
        for a, b, want in (s.values() for s in spans):
            if want is None or digest(words, a, b) == want:
                change[a] += 1
                change[b] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
    return n, n - len(words), b" ".join(words)


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the kept words of each whole
    text joined by one space (columns of these names are replaced)."""
    result = ("n_words", "n_removed", "kept")
    own = [c for c in docs.columns if c.lower() not in result]
    rest = [c for c in own if c.lower() != "text"]  # a text crosses the shuffle once
    held = in_small_batches(docs).select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    spans = repeated_spans(docs, held, window, k)
    listed = saved(spans.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("from", "to", "digest")).alias("spans")))
    met = held.join(listed, ["doc_id", "tie"], "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in H.slices(batch["text"]):
                some = batch.slice(first, len(texts))
                done = zip(*map(without_spans, texts, some["spans"].to_pylist()))
                columns = [pa.array(list(x), kind) for x, kind in zip(done, (pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([some["row"], some["text"], *columns[:2], columns[2].cast(pa.string())], names=["row", "text", *result])

    fields = {f.name: f for f in met.schema.fields}
    schema = T.StructType([fields["row"], fields["text"], *(T.StructField(c, T.StringType() if c == "kept" else T.LongType()) for c in result)])
    done = met.mapInArrow(cut, schema)
    return done.select(*(F.col("text").alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in own), *result)
