"""Interval algebra on spans [a, b), as one sweep over their boundaries.

A span table has key columns (owner and day, usually), a kind, and numbers a < b.
``segments`` cuts the line at every boundary and tells for each elementary piece
how many spans of each kind cover it; union, intersection, difference and clipping
are then predicates over those counts, and one shuffle by the keys serves all.
Spans that end before they begin, or hold a null, are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEYS = ["owner", "day"]
ROWS_A_TASK = 150_000


def sane(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") < F.col("b")))


def segments(spans: DataFrame, kinds: list[str], keys: list[str] = KEYS) -> DataFrame:
    """keys, a, b and n_<kind> for every piece that some span covers."""
    edge = F.explode(F.array(F.struct(F.col("a").alias("m"), F.lit(1).alias("step")), F.struct(F.col("b").alias("m"), F.lit(-1).alias("step"))))
    edges = sane(spans).select(*keys, "kind", edge.alias("e")).select(*keys, "kind", "e.m", "e.step")
    change = [F.sum(F.when(F.col("kind") == k, F.col("step")).otherwise(0)).alias(f"d_{k}") for k in kinds]
    points = edges.groupBy(*keys, "m").agg(*change)
    along = W.partitionBy(*keys).orderBy("m")
    swept = points.select(*keys, F.col("m").alias("a"), F.lead("m").over(along).alias("b"), *(F.sum(f"d_{k}").over(along).alias(f"n_{k}") for k in kinds))
    return swept.where(F.col("b").isNotNull() & F.greatest(*(F.col(f"n_{k}") for k in kinds), F.lit(0)).__gt__(0))


def tiles(spans: DataFrame, kinds: list[str], tasks: int, keys: list[str] = KEYS) -> DataFrame:
    """A row for each key: ``pieces``, those of ``cuts`` in order."""
    return cuts(spans, kinds, tasks, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b", "on"))).alias("pieces"))


def cuts(spans: DataFrame, kinds: list[str], tasks: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, a, b, on for every piece that some span covers; bit i of ``on`` tells
    whether kinds[i] covers it (see ``on``).

    One shuffle by the keys into ``tasks`` parts serves all steps. Within a kind only
    the ends of its union remain, each of which turns its bit, so that a row holds one
    number for all kinds; what follows needs no further sort or window."""
    bits = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(1 << i).cast("long"))))
    edge = F.explode(F.array(F.struct(F.col("a").alias("m"), F.lit(1).alias("step")), F.struct(F.col("b").alias("m"), F.lit(-1).alias("step"))))
    edges = sane(spans).where(F.col("kind").isin(*kinds)).repartition(tasks, *keys).select(*keys, F.element_at(bits, F.col("kind")).alias("bit"), edge.alias("e")).select(*keys, "bit", "e.m", "e.step")
    ends = edges.groupBy(*keys, "bit", "m").agg(F.sum("step").alias("step")).where("step <> 0")
    held = ends.withColumn("n", F.sum("step").over(W.partitionBy(*keys, "bit").orderBy("m"))).where("n = 0 OR n = step")
    along = W.partitionBy(*keys).orderBy("m")
    turns = held.groupBy(*keys, "m").agg(F.bit_xor("bit").alias("turned"))
    return turns.select(*keys, F.col("m").alias("a"), F.lead("m").over(along).alias("b"), F.bit_xor("turned").over(along).alias("on")).where("b IS NOT NULL AND on <> 0")


def on(piece: Column, kinds: list[str], *any_of: str) -> Column:
    """Whether one of some kinds covers a piece of ``tiles``."""
    return piece["on"].bitwiseAND(F.lit(sum(1 << kinds.index(k) for k in any_of)).cast("long")) != 0


def minutes(pieces: Column | str, holds: Callable[[Column], Column]) -> Column:
    """Length of the pieces for which a predicate holds."""
    return F.aggregate(pieces, F.lit(0.0), lambda sum_, p: sum_ + F.when(holds(p), p["b"] - p["a"]).otherwise(0.0))


def tasks_for(rows: int) -> int:
    """How many tasks hold a sweep over so many spans, each a bounded part of them."""
    return max(1, -(-rows // ROWS_A_TASK))


def covered(segs: DataFrame, holds: Column, keys: list[str] = KEYS, name: str = "minutes") -> DataFrame:
    """Length of the pieces for which a predicate over the counts holds."""
    return segs.where(holds).groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias(name))


def union(spans: DataFrame, keys: list[str] = KEYS, gap: float = 0.0) -> DataFrame:
    """Maximal spans after joining those that touch, overlap or lie within gap."""
    along = W.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(along.rowsBetween(W.unboundedPreceding, -1))
    marked = sane(spans).withColumn("_new", F.when(F.col("a") <= reach + gap, 0).otherwise(1))
    island = F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def union_hours(spans: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    merged = union(spans, keys)
    return merged.groupBy(*keys).agg(F.round(F.sum(F.col("b") - F.col("a")) / 60, 2).alias("hours"), F.count(F.lit(1)).alias("islands"))


def subtract(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pieces of a outside b, joined where they touch."""
    both = a.withColumn("kind", F.lit("p")).select(*keys, "kind", "a", "b").union(b.withColumn("kind", F.lit("q")).select(*keys, "kind", "a", "b"))
    return union(segments(both, ["p", "q"], keys).where("n_p > 0 and n_q = 0").select(*keys, "a", "b"), keys)


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    both = a.withColumn("kind", F.lit("p")).select(*keys, "kind", "a", "b").union(b.withColumn("kind", F.lit("q")).select(*keys, "kind", "a", "b"))
    return union(segments(both, ["p", "q"], keys).where("n_p > 0 and n_q > 0").select(*keys, "a", "b"), keys)


def clip(spans: DataFrame, low: Column, high: Column) -> DataFrame:
    return sane(spans.withColumns({"a": F.greatest("a", low), "b": F.least("b", high)}))


def midnight_split(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Timestamped spans cut at midnights: day, a and b in minutes of that day."""
    days = F.explode(F.sequence(F.to_date(start), F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")), F.expr("INTERVAL 1 DAY")))
    cut = spans.where(F.col(start) < F.col(end)).withColumn("day", days)
    midnight = F.col("day").cast("timestamp_ntz")
    minutes = lambda t: F.timestamp_diff("MICROSECOND", midnight, F.col(t)) / 60e6
    return cut.withColumns({"a": F.greatest(minutes(start), F.lit(0.0)), "b": F.least(minutes(end), F.lit(1440.0))})


def trace_window(points: DataFrame, at: str, pad: float = 30.0, keys: list[str] = KEYS) -> DataFrame:
    """First trace - pad to last trace + pad, within the day."""
    return points.groupBy(*keys).agg(F.greatest(F.min(at) - pad, F.lit(0.0)).alias("a"), F.least(F.max(at) + pad, F.lit(1440.0)).alias("b"))


def trim_edges(windows: DataFrame, points: DataFrame, at: str, most: float, keys: list[str] = KEYS) -> DataFrame:
    """Windows whose ends without a trace are drawn in by at most ``most``
    minutes; an end at midnight stays. Windows without traces stay whole."""
    first = points.groupBy(*keys).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    low = F.when((F.col("a") > 0) & F.col("_first").isNotNull(), F.greatest("a", F.least(F.col("_first"), F.col("a") + most))).otherwise(F.col("a"))
    high = F.when((F.col("b") < 1440) & F.col("_last").isNotNull(), F.least("b", F.greatest(F.col("_last"), F.col("b") - most))).otherwise(F.col("b"))
    return sane(windows.join(first, keys, "left").withColumns({"a": low, "b": high}).drop("_first", "_last"))


def minute_clusters(points: DataFrame, at: str, keys: list[str] = KEYS, gap: int = 2) -> DataFrame:
    """Runs of distinct minutes no more than ``gap`` apart: first, last, n."""
    along = W.partitionBy(*keys).orderBy(at)
    marked = points.select(*keys, at).distinct().withColumn("_new", F.when(F.col(at) - F.lag(at).over(along) <= gap, 0).otherwise(1))
    return marked.withColumn("_run", F.sum("_new").over(along)).groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def bursts(points: DataFrame, at: str, keys: list[str], least: int, reach: int = 1) -> DataFrame:
    """Minutes whose neighbourhood holds at least ``least`` rows."""
    counts = points.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))
    near = F.sum("n").over(W.partitionBy(*keys).orderBy(at).rangeBetween(-reach, reach))
    return counts.withColumn("near", near).where(F.col("near") >= least)


def last_minutes(spans: DataFrame, most: float, keys: list[str] = KEYS) -> DataFrame:
    """The last ``most`` minutes of each key's spans (disjoint spans)."""
    after = W.partitionBy(*keys).orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    room = F.lit(float(most)) - F.coalesce(F.sum(F.col("b") - F.col("a")).over(after), F.lit(0.0))
    return sane(spans.withColumn("_room", room).where("_room > 0").withColumn("a", F.greatest("a", F.col("b") - F.col("_room"))).drop("_room"))


def scale_to_fit(spans: DataFrame, anchor: str, allowed: Column, keys: list[str] = KEYS) -> DataFrame:
    """Spans that grow out of an anchored end, all cut to one share of their
    length so that together they stay within ``allowed``: share = min(1,
    allowed / total). anchor holds "a" or "b", the end that stays."""
    total = F.sum(F.col("b") - F.col("a")).over(W.partitionBy(*keys))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), allowed / total))
    length = (F.col("b") - F.col("a")) * share
    grown = spans.withColumn("_length", length)
    return sane(grown.withColumns({"a": F.when(F.col(anchor) == "b", F.col("b") - F.col("_length")).otherwise(F.col("a")), "b": F.when(F.col(anchor) == "b", F.col("b")).otherwise(F.col("a") + F.col("_length"))}).drop("_length"))
