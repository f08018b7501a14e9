"""Pivots, trends, reviews and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top(rows: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each task's rows to k before the
    shuffle, so a group with most of all rows is no burden."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def top_with_rest(rows: DataFrame, group: list[str], name: str, value: str, k: int, rest: str = "(rest)") -> DataFrame:
    """The k largest names of each group and one row for all the others."""
    ranked = rows.groupBy(*group, name).agg(F.sum(value).alias(value)).withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(value), name)))
    label = F.when(F.col("_n") <= k, F.col(name)).otherwise(F.lit(rest))
    return ranked.withColumn(name, label).groupBy(*group, name).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("members"))


def two_way(rows: DataFrame, a: str, b: str, value: str, k: int) -> DataFrame:
    """Both directions of a pivot in long form: side, key, other, value, rank <= k.
    One aggregate by both keys feeds both sides."""
    cells = rows.groupBy(a, b).agg(F.sum(value).alias("value"))
    sides = F.explode(F.array(F.struct(F.lit(a).alias("side"), F.col(a).cast("string").alias("key"), F.col(b).cast("string").alias("other")), F.struct(F.lit(b).alias("side"), F.col(b).cast("string").alias("key"), F.col(a).cast("string").alias("other"))))
    long = cells.select(sides.alias("s"), "value").select("s.side", "s.key", "s.other", "value")
    return top(long, ["side", "key"], [F.desc("value"), "other"], k)


def common(rows: DataFrame, item: str, model: str, value: str, least: int, k: int, people: str | None = None) -> DataFrame:
    """Items of at least ``least`` models, by value, or by 10 x people + value."""
    aggs = [F.count_distinct(model).alias("models"), F.sum(value).alias("value")] + ([F.count_distinct(people).alias("people")] if people else [])
    found = rows.groupBy(item).agg(*aggs).where(F.col("models") >= least)
    score = F.col("people") * 10 + F.col("value") if people else F.col("value")
    return found.withColumn("score", score).orderBy(F.desc("score"), item).limit(k)


def trend(points: DataFrame, at: str, unit: str, keys: list[str]) -> DataFrame:
    """Counts by week or month with empty buckets filled in for every key that
    has any row (a key's own span of buckets)."""
    step = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}[unit]
    counts = points.groupBy(*keys, F.to_date(F.date_trunc(unit, at)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi")).select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias("bucket"))
    return spans.join(counts, [*keys, "bucket"], "left").na.fill(0, ["n"])


def review(rows: DataFrame, period: Column, group: str, kinds: dict[str, Column], k: int) -> DataFrame:
    """The top k entries of every kind for each period and group."""
    entries = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("entry")) for kind, value in kinds.items())))
    counts = rows.select(period.alias("period"), group, entries.alias("e")).where("e.entry is not null").groupBy("period", group, "e.kind", "e.entry").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, ["period", group, "kind"], [F.desc("n"), "entry"], k)


def matrix(rows: DataFrame, row: str, column: str, value: str, columns: list, prefix: str = "c_") -> DataFrame:
    """A wide matrix with named columns, and a total."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.sum(value))
    named = wide.select(row, *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"{prefix}{c}") for c in columns))
    return named.withColumn("total", sum((F.col(f"{prefix}{c}") for c in columns), F.lit(0)))


def usage(front: DataFrame, back: DataFrame, key: list[str]) -> DataFrame:
    """Foreground and background time of every program in either."""
    return front.join(back, key, "full").na.fill(0)


def mode_of(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """The commonest value; of equals the one with the largest weight, then the first."""
    best = [F.count(F.lit(1)).alias("n")] + ([F.max(weight).alias("w")] if weight else [])
    counts = rows.groupBy(*keys, value).agg(*best)
    order = F.struct((-F.col("n")).alias("n"), *([(-F.col("w")).alias("w")] if weight else []), F.col(value))
    return counts.groupBy(*keys).agg(F.min(order)[value].alias(value), F.max("n").alias("n"))
