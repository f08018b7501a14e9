"""Team views: matrices, configuration majority, timelines, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.functions import text as T

LEAST_VOTES = 3

def config_mismatch(members: DataFrame, owner: str, signature: Column, group: list[str]) -> DataFrame:
    """Members whose configuration differs from a strict majority of their group."""
    signed = members.select(*group, owner, signature.alias("signature"))
    counted = signed.withColumns({"n": F.count(F.lit(1)).over(W.partitionBy(*group, "signature")), "total": F.count(F.lit(1)).over(W.partitionBy(*group))})
    majority = F.max(F.when(F.col("n") * 2 > F.col("total"), F.col("signature"))).over(W.partitionBy(*group))
    return counted.withColumn("majority", majority).where(F.col("majority").isNotNull() & (F.col("signature") != F.col("majority"))).select(*group, owner, "signature", "majority")


def months_active(rows: DataFrame, keys: list[str], day: str, last: int) -> DataFrame:
    """keys, month, n over the last months up to the latest active one, months
    without rows included."""
    counts = rows.groupBy(*keys, F.trunc(day, "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    top = F.lit(rows.agg(F.trunc(F.max(day), "MM")).first()[0]).cast("date")  # one date
    window = counts.where(F.col("month") > F.add_months(top, -last))
    spans = window.groupBy(*keys).agg(F.min("month").alias("_lo"), F.first(top).alias("_hi")).select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spans.join(counts, [*keys, "month"], "left").na.fill(0, ["n"])


def head_counts(rows: DataFrame, keys: list[str], holds: Column) -> DataFrame:
    """1/n for the rows of a key that satisfy a condition, 0 for the others."""
    n = F.count(F.when(holds, 1)).over(W.partitionBy(*keys))
    return rows.withColumn("heads", F.when(holds, F.lit(1.0) / n).otherwise(0.0))


def merge_candidates(rows: DataFrame, name: str, value: str, person: str, text: str) -> DataFrame:
    return rows.groupBy(name).agg(F.sum(value).alias(value), F.count_distinct(person).alias("people"), F.max_by(text, F.struct(F.length(text), text)).alias(text))


def self_names(files: DataFrame, known: DataFrame) -> DataFrame:
    """owner, name, votes, of: the names under which an owner works.

    known: owner, name as configured; files: owner, author, folder, at. Configured
    names count as they are (votes and of null). An owner without one takes the
    author of most (folder, day) groups, not of most files, so a folder full of a
    colleague's output is one vote: with LEAST_VOTES groups or more, and half of
    all. Names are compared as persons and hold two letters or more; of equals the
    first by alphabet. A file without a time votes for its folder's undated group.
    """
    person = lambda c: T.person(F.col(c))
    given = known.select("owner", person("name").alias("name")).where(F.length("name") >= 2).distinct()
    groups = files.select("owner", person("author").alias("name"), "folder", F.to_date("at").alias("day")).where("name <> ''").distinct()
    votes = groups.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy("owner").agg(F.sum("votes").alias("of"), F.min(F.struct((-F.col("votes")).alias("n"), "name")).alias("top"))
    chosen = most.select("owner", "top.name", (-F.col("top.n")).alias("votes"), "of").where((F.col("votes") >= LEAST_VOTES) & (F.col("votes") * 2 >= F.col("of")) & (F.length("name") >= 2))
    voted = chosen.join(given.select("owner").distinct(), "owner", "left_anti")
    return given.select("owner", "name", F.lit(None).cast("long").alias("votes"), F.lit(None).cast("long").alias("of")).union(voted)
