"""Deterministic samples and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def even_places(n: Column, k: Column) -> Column:
    """The k places of 0..n-1 that lie evenly, both ends included; halves go to
    the even place. All places if k covers them, the first if k is 1."""
    step = (n - 1) / (k - 1)
    spread = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.bround(i * step).cast("int"))
    return F.when(n <= k, F.sequence(F.lit(0), (n - 1).cast("int"))).when(k <= 1, F.array(F.lit(0))).otherwise(spread)


def even_spread(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows of each group, evenly spread over its order."""
    own = W.partitionBy(*keys)
    placed = rows.withColumns({"_i": F.row_number().over(own.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(own)})
    step = (F.col("_n") - 1) / max(k - 1, 1)
    # A place is chosen if it is the rounded multiple of the step for some number.
    near = F.round(F.col("_i") / F.when(step > 0, step))
    chosen = F.exists(F.array(near - 1, near, near + 1), lambda j: (j >= 0) & (j <= k - 1) & (F.bround(j * step) == F.col("_i")))
    keep = (F.col("_n") <= k) | (F.lit(k <= 1) & (F.col("_i") == 0)) | (F.lit(k > 1) & chosen)
    return placed.where(keep).drop("_i", "_n")


def two_level_cap(rows: DataFrame, group: list[str], outer: list[str], order: list[str], per_group: int, per_outer: int) -> DataFrame:
    """Evenly at most per_group rows of each group and, smaller groups first,
    about per_outer of each outer key: a group that finds less room is spread
    over the room, one that finds none goes."""
    kept = even_spread(rows, group, order, per_group)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_all")).withColumn("_take", F.least("_all", F.lit(per_group)))
    before = F.sum("_take").over(W.partitionBy(*outer).orderBy("_all", *group).rowsBetween(W.unboundedPreceding, -1))
    room = sizes.withColumn("_room", F.lit(per_outer) - F.coalesce(before, F.lit(0))).where("_room > 0").select(*group, "_take", "_room")
    own = W.partitionBy(*group)
    placed = kept.join(room, group).withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1)
    step = (F.col("_take") - 1) / F.greatest(F.col("_room") - 1, F.lit(1))
    near = F.round(F.col("_i") / F.when(step > 0, step))
    chosen = F.exists(F.array(near - 1, near, near + 1), lambda j: (j >= 0) & (j <= F.col("_room") - 1) & (F.bround(j * step) == F.col("_i")))
    keep = (F.col("_take") <= F.col("_room")) | ((F.col("_room") == 1) & (F.col("_i") == 0)) | ((F.col("_room") > 1) & chosen)
    return placed.where(keep).drop("_i", "_take", "_room")


def clumps(points: DataFrame, minute: Column, keys: list[str], least_total: int, least_n: int, least_share: float, k: int) -> DataFrame:
    """Minutes that hold a large share of all of a key's rows: minute, n, share."""
    counts = points.groupBy(*keys, minute.alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy(*keys)
    rated = counts.withColumns({"total": F.sum("n").over(own), "rank": F.row_number().over(own.orderBy(F.desc("n"), "minute"))})
    share = F.round(F.col("n") / F.col("total"), 4)
    return rated.where((F.col("total") >= least_total) & (F.col("n") >= least_n) & (F.col("rank") <= k)).withColumn("share", share).where(F.col("share") >= least_share).select(*keys, "minute", "n", "share")


def utc_suspects(sent: DataFrame, keys: list[str], hour: Column, before: int = 8, least: int = 5, share: float = 0.6) -> DataFrame:
    """Keys most of whose messages lie before a workday's hours."""
    early = F.avg(F.when(hour < before, 1.0).otherwise(0.0))
    return sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(early, 4).alias("share")).where((F.col("n") >= least) & (F.col("share") >= share))
