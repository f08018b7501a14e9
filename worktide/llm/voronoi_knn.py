"""Exact top-k search by inner product: a Voronoi k-nearest-neighbour join.

1. A bounded, seeded sample of vectors are the pivots, about the square root of
   the rows. Queries and data are grouped by their nearest pivot, and a cell by
   distance from it into rings of about a block.
2. A ring's summary is its size and radius, a cell's the K + 1 vectors nearest to
   its pivot; all summaries together are bounded by the number of pivots. They
   give each query a floor: the K-th best exact score among summary vectors.
3. A ring can be ruled out for a query if even q.p + |q| * radius is below the
   floor (ties are kept). A query is replicated to the other rings only. Queries
   are the smaller side, so data are never replicated. ``copies`` tells how many
   rings a query goes to: few where vectors form clusters, all where they fill the
   space evenly in many dimensions, for no bound on distances excludes much there.
4. Rings of more than a block are dealt into blocks by hash, so a cell with a
   third of all vectors, or a third of equal ones, is many tasks. Each block solves
   its queries locally, streaming them past the block's matrix, and the local lists
   are merged.

A component x counts as floor(scale * x). Vectors that are null, empty or hold a
null or non-finite component take no part; vectors meet only vectors of their own
length. Rows with one vec_id are one vector: as data, that with the best score
counts; as a query, each asks and its best results count. A null vec_id takes no
part. Ties go to the smaller vec_id. Scores are exact while they
fit a long. Extra columns are not read. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from worktide.llm._common import in_small_batches, n_partitions, saved

PIVOTS_LEAST, PIVOTS_MOST, K, SCALE, SEED = 64, 512, 5, 256, 5
RINGS = 32
BLOCK_LEAST, BLOCK_MOST = 512, 1 << 15
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) and dim of the vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dim"))


def matrix(lists: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Rows of a list column with equal lengths as a matrix of long."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    dim = int(offsets[rows[0] + 1] - offsets[rows[0]])
    return flat[offsets[rows][:, None] + np.arange(dim)]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in floating point where every partial sum is exact."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def by_dim(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def in_cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the cell (nearest pivot of the same length, else -1) and
    the distance to its pivot (infinite without one)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.full(len(batch), -1, np.int32), np.full(len(batch), np.inf)
            for dim, rows in by_dim(batch["dim"].to_numpy()):
                if dim in pivots:
                    own, p = matrix(batch["v"], rows).astype(np.float64), pivots[dim].astype(np.float64)
                    square = (own**2).sum(1)[:, None] + (p**2).sum(1) - 2 * own @ p.T
                    cell[rows] = square.argmin(1)
                    far[rows] = np.linalg.norm(own - p[cell[rows]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return vectors.mapInArrow(assign, "vec_id long, v array<long>, dim int, cell int, far double")


def routed(queries: DataFrame, pivots: dict, cells: list, near: list, k: int) -> DataFrame:
    """Queries once for each ring that the bounds can't rule out."""
    shape = {}
    for d in {c["dim"] for c in cells}:
        own = [c for c in cells if c["dim"] == d]
        shape[d] = tuple(np.array([c[name] for c in own], kind) for name, kind in (("cell", np.int32), ("ring", np.int32), ("radius", np.float64)))
    known = {d: (np.array([r["vec_id"] for r in near if r["dim"] == d]), np.array([r["v"] for r in near if r["dim"] == d], np.int64)) for d in shape}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to = [], []
            ids = batch["vec_id"].to_numpy()
            for dim, rows in by_dim(batch["dim"].to_numpy()):
                numbers, rings, radius = shape[dim]
                q = matrix(batch["v"], rows)
                floor = np.full(len(rows), -np.inf)
                if len(known[dim][0]) > k:
                    scores = products(q, known[dim][1]).astype(np.float64)
                    scores[ids[rows][:, None] == known[dim][0]] = -np.inf
                    floor = np.sort(scores, axis=1)[:, -k]
                exact = q.astype(np.float64)
                length = np.linalg.norm(exact, axis=1)
                bound = np.full((len(rows), len(numbers)), np.inf)
                if dim in pivots:
                    inside = numbers >= 0
                    bound[:, inside] = (exact @ pivots[dim].astype(np.float64).T)[:, numbers[inside]] + length[:, None] * radius[inside]
                stays = bound + 1e-9 * np.abs(bound) + 1 >= floor[:, None]
                r, c = np.nonzero(stays)
                at.append(rows[r])
                to.append(np.stack([numbers[c], rings[c]]))
            taken = batch.select(["vec_id", "v", "dim"]).take(pa.array(np.concatenate(at) if at else [], pa.int64()))
            cell, ring = np.concatenate(to, axis=1) if to else np.zeros((2, 0), np.int32)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell), pa.array(ring)], names=["vec_id", "v", "dim", "cell", "ring"])

    return queries.mapInArrow(route, "vec_id long, v array<long>, dim int, cell int, ring int")


def best_of(q: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best data rows of each query; ids ascending and distinct groups."""
    scores = products(q, data)
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    if len(first) < len(ids):  # repeated vec_ids
        scores, ids = np.maximum.reduceat(scores, first, axis=1), ids[first]
    order = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
    r = np.repeat(np.arange(len(q)), order.shape[1])
    c = order.ravel()
    other = ids[c] != query_ids[r]
    return query_ids[r[other]], ids[c[other]], scores[r[other], c[other]]


def solved(dealt: DataFrame, k: int) -> DataFrame:
    """Local lists of (query_id, vec_id, score) from sorted blocks, data first."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, data = None, None, None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "cell", "ring", "block", "is_query")])
            edges = np.flatnonzero(np.any(marks[:, 1:] != marks[:, :-1], axis=0)) + 1
            own_ids = batch["vec_id"].to_numpy()
            out = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                rows = np.arange(a, b)
                if (own := tuple(marks[:4, a])) != key:
                    key, ids, data = own, np.zeros(0, np.int64), None
                if not marks[4, a]:
                    part = matrix(batch["v"], rows)
                    ids, data = np.concatenate([ids, own_ids[rows]]), part if data is None else np.concatenate([data, part])
                elif data is not None:
                    order = np.argsort(ids, kind="stable")
                    ids, data = ids[order], data[order]
                    out += [best_of(matrix(batch["v"], some), own_ids[some], data, ids, k) for some in np.array_split(rows, -(-len(rows) // 256))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[j] for o in out])) for j in range(3)], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(solve, "query_id long, vec_id long, score long")


def in_rings(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` with the ring of each vector in its cell: by RINGS - 1 approximate
    quantiles of the distances, as many rings as the cell has blocks, RINGS at most."""
    cuts = placed.groupBy("dim", "cell").agg(F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 4096).alias("cuts"), F.count(F.lit(1)).alias("n"))
    few = cuts.withColumn("rings", F.least(F.ceil(F.col("n") / block), F.lit(RINGS)).cast("int")).drop("n")  # a row for each pivot
    passed = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    return placed.join(F.broadcast(few), ["dim", "cell"]).withColumn("ring", F.floor(passed * F.col("rings") / RINGS).cast("int")).drop("cuts", "rings")


def dealt_rows(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, n_pivots: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The data rows and the routed queries: vec_id, v, dim, cell, ring and block."""
    n_pivots = n_pivots or min(max(PIVOTS_LEAST, math.isqrt(vectors.count())), PIVOTS_MOST)
    valid = quantised(in_small_batches(vectors), scale)
    drawn = valid.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n_pivots).select("dim", "v").collect()
    pivots = {d: np.unique(np.array([r["v"] for r in drawn if r["dim"] == d], np.int64), axis=0) for d in {r["dim"] for r in drawn}}
    celled = saved(in_cells(valid, pivots))
    block = min(max(BLOCK_LEAST, celled.count() // (8 * n_partitions(vectors.sparkSession))), BLOCK_MOST)
    placed = saved(in_rings(celled, block))
    rings = saved(placed.groupBy("dim", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")))
    nearest = W.partitionBy("dim", "cell").orderBy("far", "vec_id")
    near = placed.withColumn("place", F.row_number().over(nearest)).where((F.col("place") <= k + 1) & (F.col("cell") >= 0)).select("dim", "vec_id", "v")
    ring_rows, near_rows = rings.collect(), near.dropDuplicates(["vec_id"]).collect()  # bounded by the number of pivots and of vector lengths

    blocks = rings.select("dim", "cell", "ring", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    at = ["vec_id", "v", "dim", "cell", "ring"]
    data = placed.join(F.broadcast(blocks), at[2:]).select(*at, F.pmod(F.xxhash64(F.lit(seed), "vec_id"), "blocks").cast("int").alias("block"))
    asked = routed(placed.where(is_query).select("vec_id", "v", "dim"), pivots, ring_rows, near_rows, k)
    return data, asked.join(F.broadcast(blocks), at[2:]).select(*at, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))


def copies(vectors: DataFrame, is_query, **how) -> DataFrame:
    """vec_id and to how many blocks, of how many in all, each query is replicated."""
    data, asked = dealt_rows(vectors, is_query, **how)
    every = data.select("dim", "cell", "ring", "block").distinct().groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"))
    return asked.groupBy("dim", "vec_id").agg(F.count(F.lit(1)).alias("copies")).join(F.broadcast(every), "dim").select("vec_id", "copies", "blocks")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, n_pivots: int | None = None, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query."""
    data, asked = dealt_rows(vectors, is_query, k, scale, n_pivots, seed)
    width, where = n_partitions(vectors.sparkSession), ["dim", "cell", "ring", "block"]
    dealt = data.withColumn("is_query", F.lit(0)).union(asked.withColumn("is_query", F.lit(1))).repartition(width, *where).sortWithinPartitions(*where, "is_query")
    lists = solved(dealt, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
