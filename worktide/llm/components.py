"""Connected components of an edge table, by large and small stars.

Every round hangs all larger neighbours of a node on its smallest neighbour,
then all smaller ones, until each component is a star around its least node: a
number of rounds that grows with the logarithm of the longest path. A node with
very many neighbours is a plain join key, which Spark may split. The rounds end
when a table's size and two sums of 64-bit hashes stay the same. No edges give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from worktide.llm._common import saved


def _state(edges: DataFrame) -> tuple:
    whole = lambda h: F.sum(h.cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), whole(F.xxhash64("node", "root")), whole(F.xxhash64(F.lit(1), "root", "node"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge and is not its component's
    least node; root is that least node. Nulls and loops are dropped."""
    a, b = F.col(a), F.col(b)
    stars = saved(edges.where(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct())
    before = None
    while (state := _state(stars)) != before:
        before = state
        both = stars.select(F.col("node").alias("x"), F.col("root").alias("y")).union(stars.select(F.col("root").alias("x"), F.col("node").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("node"), F.col("m").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").where("root != m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        stars = saved(small.union(low.select("node", F.col("m").alias("root"))).distinct())
    return stars
