"""Man-months of tasks that were matched to work by name, many to many.

A model's answer names the work that a task would take over; rows are what was
measured. A row that several tasks claim is split evenly, so that no man-month counts
twice, and what no task claims is a residue of its own: the parts sum to the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from worktide.operators import grouping
from worktide.sources.sinks import stored


def claims(matches: DataFrame, rows: DataFrame, keys: list[Column], owner: str = "owner") -> DataFrame:
    """owner, match, task, row, mm, claimed: each row once for each match that claims
    it by any of its work names. matches: owner, match, task, works (array), fit; rows:
    owner, row, mm and what ``keys`` read. Names are looked up within the owner: the
    owner is part of both sides' keys."""
    tag = lambda text: F.concat(F.col(owner).cast("string"), F.lit("\x01"), text)
    works = matches.where("fit").select(owner, "match", "task", F.explode(F.array_distinct("works")).alias("work"))
    found = grouping.evidence(works.withColumn("asked", F.col("work")), "asked", rows.withColumn("id", tag(F.col("row").cast("string"))), "id", keys, within=owner)
    met = works.join(found.select(owner, F.col("asked").alias("work"), "id"), [owner, "work"]).select(owner, "match", "task", "id").distinct()
    sizes = met.groupBy("id").agg(F.count(F.lit(1)).alias("claimed"))
    held = rows.select(tag(F.col("row").cast("string")).alias("id"), "row", "mm")
    return met.join(sizes, "id").join(held, "id").select(owner, "match", "task", "row", "mm", "claimed")


def recalculated(matches: DataFrame, rows: DataFrame, keys: list[Column], owner: str = "owner") -> DataFrame:
    """owner, match, task, load_mm (all claimed rows), split_mm (each row's share), rows,
    shared (other tasks that claim a row of it, sorted, eight at most in a report): a
    row for each match, without evidence 0; and for each owner one with match null, the
    residue that no match claims. split_mm sums to the owner's man-months."""
    claimed = stored(claims(matches, rows, keys, owner))
    sums = claimed.groupBy(owner, "match").agg(F.sum("mm").alias("load_mm"), F.sum(F.col("mm") / F.col("claimed")).alias("split_mm"), F.count(F.lit(1)).alias("rows"))
    many = claimed.where("claimed > 1")
    shared = many.select(owner, "row", "match", "task").join(many.select(owner, "row", F.col("task").alias("other")), [owner, "row"]).where("other <> task").groupBy(owner, "match").agg(F.array_sort(F.collect_set("other")).alias("shared"))
    each = matches.select(owner, "match", "task").join(sums, [owner, "match"], "left").join(shared, [owner, "match"], "left")
    each = each.na.fill(0, ["load_mm", "split_mm", "rows"]).withColumn("shared", F.coalesce("shared", F.expr("cast(array() as array<string>)")))
    free = rows.join(claimed.select(owner, "row").distinct(), [owner, "row"], "left_anti").groupBy(owner).agg(F.sum("mm").alias("split_mm"), F.count(F.lit(1)).alias("rows"))
    residue = free.select(owner, F.lit(None).cast(matches.schema["match"].dataType).alias("match"), F.lit(None).cast("string").alias("task"), F.lit(0.0).alias("load_mm"), "split_mm", "rows", F.expr("cast(array() as array<string>)").alias("shared"))
    return each.select(owner, "match", "task", "load_mm", "split_mm", "rows", "shared").unionByName(residue)
