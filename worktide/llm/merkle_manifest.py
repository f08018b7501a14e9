"""Merkle dataset manifest: a tree over all rows, and every row's proof.

Each row is a leaf: the digest of its fields, each as its length in bytes, ':' and
its value ('-' if null). Leaves of a group ascend by key; while several nodes remain,
every ARITY consecutive ones (the last run may be shorter, even one) become the digest
of their digests. What remains is the group's subroot; the subroots, by group (null
first), likewise give the root. Digests are sha256 as lowercase hex text.

1. Leaves are digests of built-in functions, dealt by ranges of (group, key) and
   written once; a leaf's number in its group is its number in its range and the sum
   of the group's leaves in earlier ranges, so no group is ever in one task.
2. Blocks of ARITY**HEIGHT aligned leaves (4096) are subtrees of their own. One pass
   gives each block's root; block roots are leaves of the next tree, and so on until
   one is left a group: the logarithm of the rows to the base of 4096 rounds.
3. Fractal traversal. In a block, the existing subtrees (for each level the run that
   holds the current leaf's ancestor) are stacked; while they serve leaf after leaf,
   the desired subtree of each level, the next run, is grown by one leaf a step and
   is ready when the current one is used up. A leaf's path in its block is read off
   the stack; memory is a block's leaves and two runs of each level.
4. The proofs of the block roots, made in the same way, are appended to their leaves'.

Null groups are one group, before all others; null keys come first. Rows with equal
keys follow each other by leaf digest, and rows that are equal in all fields are
leaves with proofs of their own. No rows give no rows, and there is no root. Other
columns may be carried, under names other than the result's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.llm._common import n_partitions, saved

ARITY, HEIGHT = 16, 3
#: A path: of each level, the digests left and right of the node, each as one string.
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A field as part of a leaf: '-' or its length in bytes, ':' and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, fields)), "UTF-8"), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Builder:
    """Nodes of one level after another from leaves that come one by one: run(level)
    is the newest whole run of that level (at the end, what there is)."""

    def __init__(self, levels: int):
        self.open: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(self, node: str, done=None) -> None:
        """Add a leaf; ``done(level, run)`` hears of every run that fills up."""
        self.open[0].append(node)
        level = 0
        while level < len(self.open) - 1 and len(self.open[level]) == ARITY:
            level = self.close(level, done)

    def close(self, level: int, done=None) -> int:
        run, self.open[level] = self.open[level], []
        if done is not None:
            done(level, run)
        self.open[level + 1].append(digest(run))
        return level + 1

    def finish(self, done=None) -> str:
        """Close what is open; the root."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self.close(level, done)
        return self.open[-1][0]


def root_of(leaves: list[str], levels: int) -> str:
    builder = Builder(levels)
    for node in leaves:
        builder.add(node)
    return builder.finish()


class Desired:
    """The next run of one level, grown from the leaves below it, one a step."""

    def __init__(self, leaves: list[str], level: int):
        self.leaves, self.level = leaves, level
        self.span = ARITY ** (level + 1)
        self.at = self.span
        self.builder, self.run = Builder(level), []

    def step(self) -> None:
        if self.at >= len(self.leaves):
            return
        self.builder.add(self.leaves[self.at])
        self.at += 1
        if self.at == len(self.leaves):
            for below in range(self.level):
                if self.builder.open[below]:
                    self.builder.close(below)
        if self.at == len(self.leaves) or self.at % self.span == 0:
            self.run, self.builder = self.builder.open[self.level], Builder(self.level)


def paths_of(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in a block, in order."""
    existing: list[list[str]] = [[] for _ in range(levels)]

    def keep(level: int, run: list[str]) -> None:
        existing[level] = existing[level] or run

    first = Builder(levels)
    for node in leaves:
        first.add(node, keep)
    first.finish(keep)
    desired = [Desired(leaves, level) for level in range(levels)]
    path: list[tuple[str, str]] = [("", "")] * levels
    for i in range(len(leaves)):
        for level in range(levels):
            below = ARITY**level
            if i % below == 0:
                if i and i % desired[level].span == 0:
                    existing[level] = desired[level].run
                run, place = existing[level], i // below % ARITY
                path[level] = ("".join(run[:place]), "".join(run[place + 1 :]))
            desired[level].step()
        yield list(path)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, saved, with number (from 0, by ``order`` within the tree) and total,
    without a tree in one task: ranges of the order are counted first."""
    dealt = saved(rows.repartitionByRange(n_partitions(rows.sparkSession), "tree", *order).withColumn("range", F.spark_partition_id()))
    own = W.partitionBy("tree")
    counts = dealt.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("tree", "range", (F.sum("n").over(own.orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("total"))
    placed = dealt.withColumn("place", F.row_number().over(W.partitionBy("tree", "range").orderBy(*order))).join(offsets, ["tree", "range"])
    return saved(placed.withColumn("number", F.col("before") + F.col("place") - 1).drop("place", "before", "range"))


def levels_of(total: int) -> int:
    """How many levels the blocks of a tree of ``total`` nodes have."""
    levels = 0
    while levels < HEIGHT and ARITY**levels < total:
        levels += 1
    return levels


def in_blocks(nodes: DataFrame, *columns: str):
    return nodes.select("tree", F.expr(f"number div {ARITY**HEIGHT}").alias("block"), "number", "total", "node", *columns).groupBy("tree", "block")


def climbed(leaves: DataFrame) -> list[DataFrame]:
    """The leaves (tree, number, total, node), the roots of their blocks, those of the
    blocks of these, up to one node a tree."""

    def reduce(key, table):
        table = table.sort_by("number")
        total = table["total"][0].as_py()
        values = [key[0].as_py(), key[1].as_py(), -(-total // ARITY**HEIGHT), root_of(table["node"].to_pylist(), levels_of(total))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["tree", "number", "total", "node"])

    levels = [leaves]
    while len(levels) == 1 or (levels[-1].agg(F.max("total")).first()[0] or 1) > 1:
        levels.append(saved(in_blocks(levels[-1]).applyInArrow(reduce, "tree string, number long, total long, node string")))
    return levels


def descended(levels: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """tree, number, node, path and ``carried`` of the leaves of ``levels``; top: tree,
    number 0, the path of that tree's root and what else its leaves shall get."""
    known = [c for c in top.columns if c not in ("tree", "number", "path")]
    for nodes in levels[-2::-1]:
        last = nodes is levels[0]
        top = appended(nodes, top, carried if last else [], known)
        top = top if last else saved(top.drop("node"))
    return top


def appended(nodes: DataFrame, upper: DataFrame, carried: list[str], known: list[str]) -> DataFrame:
    """The nodes' paths in their blocks, with those of the blocks' roots behind them."""
    out = ["tree", "number", "node", *carried]

    def traverse(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("number")
        top = right.to_pylist()[0]
        above = [(step["left"], step["right"]) for step in top["path"]]
        steps, ends = [], [0]
        for path in paths_of(left["node"].to_pylist(), levels_of(left["total"][0].as_py())):
            steps += path + above
            ends.append(len(steps))
        sides = [pa.array([s[i] for s in steps], pa.string()) for i in (0, 1)]
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
        same = [pa.array([top[c]] * len(left), right.schema.field(c).type) for c in known]
        return pa.Table.from_arrays([*(left[c] for c in out), *same, path], names=[*out, *known, "path"])

    above = upper.select(F.col("tree").alias("of"), F.col("number").alias("part"), "path", *known)
    kinds = {f.name: f.dataType.simpleString() for f in [*nodes.schema.fields, *above.schema.fields]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*out, *known]), f"path {PATH}"])
    return in_blocks(nodes, *carried).cogroup(above.groupBy("of", "part")).applyInArrow(traverse, schema)


def manifest(rows: DataFrame, group: str, key: str, node: str, carried: list[str]) -> DataFrame:
    """number, node, subroot, root, path (level by level from the leaf to the root) and
    the ``carried`` columns of rows whose leaf digest is the column ``node``."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = numbered(rows.select(tree.alias("tree"), F.col(key).alias("key"), F.col(node).alias("node"), *(F.col(c).alias(f"carried_{c}") for c in carried)), ["key", "node"])
    levels = climbed(leaves)
    groups = climbed(numbered(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node"), ["key"]))
    no_path = F.expr(f"cast(array() as {PATH})").alias("path")
    above = descended(groups, groups[-1].select("tree", "number", no_path, F.col("node").alias("root")), ["key"])
    top = saved(above.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("number"), "path", F.col("node").alias("subroot"), "root"))
    done = descended(levels, top, [f"carried_{c}" for c in carried])
    return done.select("number", "node", "subroot", "root", "path", *(F.col(f"carried_{c}").alias(c) for c in carried))


def joined(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, node, lambda below, step: F.sha2(F.encode(F.concat(step["left"], below, step["right"]), "UTF-8"), 256))
