"""N-gram Jaccard join as a blocked sparse product of documents by n-grams.

Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct
N-word shingles (all its words as one if fewer). Two documents link when the
Jaccard index of their sets is at least ``percent`` / 100. The result is each
document's component under links.

1. Documents with equal sets are one class from here on, so copies are never
   paired with each other.
2. Rows and columns of the product. Only the part of the incidence matrix that
   a link must touch is multiplied: a set of n shingles that links with another
   shares one of its first n - ceil(t n) + 1 shingles in any common order. The
   order puts shingles last that a bounded sample of documents shows to be
   frequent, so common passages hardly ever form a column. A column with one class
   only is dropped.
3. Blocks. A column's classes meet in the block of its hub, the least of their
   signatures. Columns of one family of near copies have few hubs, so a class
   is sent to few blocks. A block with more than TILE classes is cut by size into
   bands so wide that only classes of one band or of two next to each other can
   link, a band is dealt into tiles, and the product into pairs of tiles, each a
   task's small piece: nothing is capped and no block has to fit a task. Tiles of
   bands further apart never meet.
4. Size-derived bounds first. A class carries its size and a parity bitmap of
   its set, two bits or more for each shingle; two bitmaps differ in no more bits
   than the sets in shingles. Where size or that bound excludes every partner in
   a block, the class leaves it, before any whole set is moved.
5. The product. A block multiplies its full incidence matrix by its transpose.
   Columns with one member drop out and equal columns are added up before; pairs
   below the overlap that their sizes demand are discarded. The links found come
   back as a spanning forest, never as all pairs.
6. The forest's components, with the classes' members put back.

Null text or no words: an empty set, linked with nothing. A null doc_id gets a
null component and links nothing. Rows with one doc_id are one document and share
a component; repeated rows are allowed. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from worktide.llm import _hashing as H
from worktide.llm._common import in_small_batches, join_hot, n_partitions, saved
from worktide.llm.components import components

N, PERCENT = 5, 80
TILE = 256
SAMPLE_DOCS, MAX_FREQUENT, FREQUENT_SHARE = 8_192, 1 << 15, 500
SEEN = 100_000


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words, offsets = H.word_hashes(texts, lower=True)
    sums = H.prefix(words, H.RUN_BASE)
    start = np.arange(max(len(words) - n + 1, 0))
    runs = H.between(sums, start, start + n, H.RUN_BASE)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield H.between(sums, np.array([a]), np.array([b]), H.RUN_BASE)
        else:
            yield np.zeros(0, np.uint64)


def batches_of_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, texts in H.slices(batch["text"]):
        yield from enumerate(shingle_sets(texts, n), first)


def signature(own: np.ndarray) -> tuple[int, int]:
    return int(H.mixed(own).sum(dtype=np.uint64).view(np.int64)), int(H.mixed(~own).sum(dtype=np.uint64).view(np.int64))


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes, at most MAX_FREQUENT, that a sample of about SAMPLE_DOCS documents
    has often. They only set the order of the prefixes; links don't depend on it."""
    total = docs.count()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in batches_of_sets(batch, n):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["shingle"])

    step = max(1, total // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(step)) == 0).select("text")
    often = max(4, total // step // FREQUENT_SHARE)
    counted = sample.mapInArrow(explode, "shingle long").groupBy("shingle").count().where(F.col("count") >= often)
    found = counted.orderBy(F.desc("count"), "shingle").limit(MAX_FREQUENT).select("shingle").toArrow()
    return np.sort(found["shingle"].to_numpy().view(np.uint64))


def prefix_of(own: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    most = len(own) - -(-percent * len(own) // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        common = frequent[at] == own
        if common.any():
            own = np.concatenate([own[~common], own[common]])
    return own[:most]


def bitmap(own: np.ndarray) -> bytes:
    """Parities of the set's shingles over a power of two of bits, at least 256
    and at least twice the set's size."""
    bits = max(256, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(sizes: np.ndarray, bitmaps: list[bytes], percent: int) -> np.ndarray:
    """Which sets may link with another one, by sizes and bitmaps alone."""
    order = np.argsort(sizes, kind="stable")
    words = [np.frombuffer(bitmaps[i], np.uint64) for i in order.tolist()]
    n = sizes[order]
    out = np.zeros(len(n), bool)
    stop = np.searchsorted(n * percent, n * 100, "right")  # the last that is not too large
    for i in range(len(n)):
        own, a = words[i], i + 1
        while a < stop[i]:
            width = len(words[a])
            b = a
            while b < stop[i] and len(words[b]) == width:
                b += 1
            other = np.stack(words[a:b])
            while other.shape[1] > len(own):
                half = other.shape[1] // 2
                other = other[:, :half] ^ other[:, half:]
            differ = np.bitwise_count(other ^ own).sum(axis=1, dtype=np.int64)
            # overlap >= percent / (100 + percent) * (n + m), so the sets differ in at most the rest
            fits = (100 + percent) * differ <= (100 - percent) * (n[i] + n[a:b])
            if fits.any():
                out[i] = True
                out[a:b] |= fits
            a = b
    back = np.zeros(len(n), bool)
    back[order] = out
    return back


def signed(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, tie, n_shingles, the 128-bit signature and the bitmap of each set."""
    names = ["doc_id", "tie", "n_shingles", "s1", "s2", "bits"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(own), *signature(own), bitmap(own)) for _, own in batches_of_sets(batch, n)]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate([pa.int64()] * 3 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], *columns], names=names)

    return docs.select("doc_id", "tie", "text").mapInArrow(sign, "doc_id long, tie long, n_shingles long, s1 long, s2 long, bits binary")


def columns(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """(shingle, s1): the incidence of prefix shingles and classes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts: list[np.ndarray] = []
            owners: list[int] = []
            for _, own in batches_of_sets(batch, n):
                if not len(own):
                    continue
                key = signature(own)[0]
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                parts.append(prefix_of(own, frequent, percent))
                owners.append(key)
            if parts:
                of = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(of)], names=["shingle", "s1"])

    return docs.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(emit, "shingle long, s1 long")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets link: the block's product, as a boolean matrix."""
    sizes = np.array([len(s) for s in sets])
    shingles, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    members = np.bincount(at, minlength=len(shingles))
    pattern = np.zeros(len(shingles), np.uint64)
    np.add.at(pattern, at, H.mixed(row.astype(np.uint64) + np.uint64(1)))  # equal for columns with equal members
    _, first, of, weight = np.unique(pattern, return_index=True, return_inverse=True, return_counts=True)
    useful = members[first] > 1
    place = np.cumsum(useful) - 1
    chosen = np.zeros(len(shingles), bool)
    chosen[first[useful]] = True
    entry = chosen[at]
    rows, cols, weights = row[entry], place[of[at[entry]]], weight[useful]
    overlap = np.zeros((len(sets), len(sets)))
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for lo in range(0, len(weights), 4096):
        hi = min(lo + 4096, len(weights))
        a, b = np.searchsorted(cols, [lo, hi])
        block = np.zeros((len(sets), hi - lo))
        block[rows[a:b], cols[a:b] - lo] = 1
        overlap += (block * weights[lo:hi]) @ block.T
    return (100 + percent) * overlap >= percent * (sizes[:, None] + sizes[None, :])


def forest(ids: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, least id reached) that span the linked rows."""
    label = np.arange(len(ids))
    while True:
        new = np.where(link, label[None, :], len(ids)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def blocks_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each (hub, ti, tj) in turn, from sorted batches. A block has
    two tiles at most."""
    held, key = [], None
    for batch in batches:
        keys = zip(*(batch[c].to_pylist() for c in ("hub", "ti", "tj")))
        values = [batch[c] for c in columns]
        for i, k in enumerate(keys):
            if k != key:
                if len(held) > 1:
                    yield held
                held, key = [], k
            held.append(tuple(v[i].as_py() if not pa.types.is_list(v.type) else v[i].values.to_numpy() for v in values))
    if len(held) > 1:
        yield held


def bounded_members(blocks: DataFrame, percent: int) -> DataFrame:
    """(hub, s1) of the classes that sizes and bitmaps leave in their block."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs: list[int] = []
        classes: list[int] = []
        for rows in blocks_of(batches, ["hub", "s1", "n_shingles", "bits"]):
            stays = may_link(np.array([r[2] for r in rows]), [r[3] for r in rows], percent)
            for i in np.flatnonzero(stays).tolist():
                hubs.append(rows[i][0])
                classes.append(rows[i][1])
            if len(hubs) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(classes, pa.int64())], names=["hub", "s1"])
                hubs, classes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(classes, pa.int64())], names=["hub", "s1"])

    return blocks.mapInArrow(prune, "hub long, s1 long")


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges of the blocks' spanning forests."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks_of(batches, ["doc_id", "shingles"]):
            ids, first = np.unique(np.array([r[0] for r in rows]), return_index=True)
            if len(ids) > 1:
                a, b = forest(ids, linked([rows[i][1] for i in first.tolist()], percent))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return blocks.mapInArrow(product, "a long, b long")


def in_tiles(member: DataFrame, values: DataFrame, percent: int) -> DataFrame:
    """Members with their class's values, once for each pair of tiles of their
    block that may hold links, a block's rows together in one partition and sorted.
    member: hub, s1, n_shingles, saved."""
    hubs = saved(member.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("wide", F.col("n") > TILE))
    width = math.log(100 / percent) * (1 + 1e-9)  # sizes that may link are at most one band apart
    banded = saved(join_hot(member, hubs, ["hub"], ["s1"]).select("hub", "s1", F.when(F.col("wide"), F.floor(F.log("n_shingles") / width)).otherwise(0).cast("int").alias("band")))
    bands = banded.groupBy("hub", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    along = W.partitionBy("hub").orderBy("band")  # as many bands as sizes have orders
    beside = lambda f, step: F.coalesce(F.when(f("band").over(along) == F.col("band") + step, f("tiles").over(along)), F.lit(0))
    bands = saved(bands.withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)}))
    met = join_hot(banded, bands, ["hub", "band"], ["s1"]).withColumn("tile", F.pmod(F.xxhash64("s1"), "tiles").cast("int"))
    place = lambda band, tile: F.shiftleft(band.cast("long"), 32) + tile
    own, every = place(F.col("band"), F.col("tile")), lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("ti"), F.greatest(a, b).alias("tj"))
    with_tiles = lambda n, step: F.transform(every(n), lambda t: pair(own, place(F.col("band") + step, t)))
    pairs = F.concat(with_tiles("tiles", 0), with_tiles("below", -1), with_tiles("above", 1))
    dealt = met.select("hub", "s1", F.explode(pairs).alias("pair")).select("hub", "s1", "pair.ti", "pair.tj")
    n = n_partitions(member.sparkSession)
    return dealt.join(values, "s1").repartition(n, "hub", "ti", "tj").sortWithinPartitions("hub", "ti", "tj")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, tie (hash of the text), n_shingles and component_id of each row."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    own = saved(signed(docs, n))
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = saved(
        own.where(known).groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "tie")).alias("rep"), F.first("bits").alias("bits")).select("s1", "s2", "n_shingles", "rep.doc_id", "rep.tie", "bits")
    )
    incidence = saved(columns(docs, frequent_shingles(docs, n), n, percent))
    hubs = saved(incidence.groupBy("shingle").agg(F.min("s1").alias("hub"), F.max("s1").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last").drop("last"))
    sized = classes.groupBy("s1").agg(F.max("n_shingles").alias("n_shingles"))
    member = saved(join_hot(incidence, hubs, ["shingle"], ["s1"]).select("hub", "s1").distinct().join(sized, "s1"))
    left = saved(bounded_members(in_tiles(member, classes.select("s1", "n_shingles", "bits"), percent), percent).distinct().join(sized, "s1"))

    needed = left.select("s1").distinct().join(classes.select("s1", "doc_id", "tie"), "s1")
    sets = saved(sets_of(docs.join(needed, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie", "s1"]), n))
    links = block_links(in_tiles(left, sets, percent), percent)
    shared = own.where(known).join(classes.select("s1", "s2", "n_shingles", F.col("doc_id").alias("rep")), ["s1", "s2", "n_shingles"])
    twice = shared.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")  # one id, several texts
    roots = components(links.union(twice), "a", "b")
    found = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "tie", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
    rest = own.where(~known).select("doc_id", "tie", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(rest)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """s1, doc_id and the whole set of each row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, held = 0, [], 0
            for i, own in batches_of_sets(batch, n):
                found.append(own)
                held += len(own)
                if held > 500_000 or i == len(batch) - 1:
                    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch["s1"].slice(at, len(found)), batch["doc_id"].slice(at, len(found)), lists], names=["s1", "doc_id", "shingles"])
                    at, found, held = i + 1, [], 0

    return docs.select("s1", "doc_id", "text").mapInArrow(emit, "s1 long, doc_id long, shingles array<long>")
