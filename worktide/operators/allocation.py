"""From weighted signals to shares and man-months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def grid(signals: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """keys, weight, signals, families, days of each cell; cells below ``least`` go
    unless that would leave none at all."""
    cells = signals.groupBy(*keys).agg(F.round(F.sum("weight"), 4).alias("weight"), F.count(F.lit(1)).alias("signals"), F.count_distinct("family").alias("families"), F.count_distinct("day").alias("days"))
    if least <= 0:
        return cells
    strong = F.max(F.when(F.col("weight") >= least, 1).otherwise(0)).over(W.partitionBy(keys[0]))
    return cells.withColumn("_any", strong).where((F.col("weight") >= least) | (F.col("_any") == 0)).drop("_any")


def confidence(families: Column, days: Column) -> Column:
    return F.when((families >= 2) & (days >= 3), "high").when((families >= 2) | (days >= 3), "mid").otherwise("low")


def allocate(cells: DataFrame, group: list[str], order: list[str], total: Column, weight: str = "weight") -> DataFrame:
    """share (4 digits) and mm (3 digits) of a group's total; what rounding leaves
    goes to the largest row, so that rows add up to the total."""
    own = W.partitionBy(*group)
    raw = F.col(weight) / F.sum(weight).over(own)
    shared = cells.withColumns({"_raw": raw, "total": total}).withColumns({"share": F.round("_raw", 4), "mm": F.round(F.col("_raw") * F.col("total"), 3)})
    first = F.row_number().over(own.orderBy(F.desc(weight), *order)) == 1
    rest = F.round(F.col("total") - F.sum("mm").over(own), 3)
    return shared.withColumn("mm", F.when(first & (F.abs(rest) >= 0.0005), F.greatest(F.lit(0.0), F.round(F.col("mm") + rest, 3))).otherwise(F.col("mm"))).drop("_raw")


def discover_projects(signals: DataFrame, key: str, words: Column, unassigned: str = "unassigned") -> DataFrame:
    """Each signal's project by document frequency: of its tokens of 3 to 20
    letters that 2 to max(3, N // 3) signals share, the most frequent, then first.

    Tokens are exploded once, counted with map-side combining, and joined back.
    """
    ids = signals.select(key, words.alias("_words"))
    n = ids.count()
    tokens = ids.select(key, F.explode("_words").alias("token")).where(F.length("token").between(3, 20))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, max(3, n // 3)))
    best = tokens.join(counts, "token").groupBy(key).agg(F.min(F.struct((-F.col("df")).alias("d"), "token"))["token"].alias("project"))
    return signals.join(best, key, "left").withColumn("project", F.coalesce("project", F.lit(unassigned)))


def match_projects(signals: DataFrame, text: str, needles: DataFrame, key: str, unassigned: str = "unassigned") -> DataFrame:
    """The first project (by priority) with a needle in the text. needles:
    (project, needle, priority); empty needles fit nothing.

    A needle's first letters, three at most, are looked up among the text's runs of as
    many letters, an equal join; the whole needle is compared where they meet."""
    low = signals.select(key, F.lower(text).alias("_t"))
    runs = lambda n: F.when(F.length("_t") >= n, F.transform(F.sequence(F.lit(1), F.length("_t") - n + 1), lambda i: F.substr("_t", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = low.withColumn("_g", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))))
    known = needles.select("project", "priority", F.lower("needle").alias("_n")).withColumn("_g", F.substring("_n", 1, 3)).where("_n <> ''")
    hits = grams.join(known, "_g").where(F.contains("_t", F.col("_n")))
    best = hits.groupBy(key).agg(F.min(F.struct("priority", "project"))["project"].alias("project"))
    return signals.join(best, key, "left").withColumn("project", F.coalesce("project", F.lit(unassigned)))


def rescale(rows: DataFrame, owner: str, value: str, official: Column) -> DataFrame:
    """Rows scaled so that an owner's sum meets the official total; unscaled where
    either is missing or not positive."""
    total = F.sum(value).over(W.partitionBy(owner))
    factor = F.when((total > 0) & (official > 0), official / total).otherwise(1.0)
    return rows.withColumn("factor", factor).withColumn("scaled", F.col(value) * F.col("factor"))


def prorata(rows: DataFrame, owner: str, value: str, is_loose: Column) -> DataFrame:
    """Loose amounts spread over the owner's other rows by value; an owner with
    nothing else keeps them as left over."""
    own = W.partitionBy(owner)
    loose = F.sum(F.when(is_loose, F.col(value)).otherwise(0)).over(own)
    firm = F.sum(F.when(is_loose, 0).otherwise(F.col(value))).over(own)
    spread = F.when(is_loose, F.when(firm > 0, 0.0).otherwise(F.col(value))).otherwise(F.col(value) + loose * F.col(value) / firm)
    return rows.withColumn("spread", spread)


def coverage_grade(*missing: Column) -> Column:
    """0 reasons reliable, 1 caution, more unreliable."""
    reasons = sum((m.cast("int") for m in missing), F.lit(0))
    return F.when(reasons == 0, "reliable").when(reasons == 1, "caution").otherwise("unreliable")


def remeasured(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What leaving signals out changes: before, after and difference."""
    joined = before.select(*keys, F.col(value).alias("before")).join(after.select(*keys, F.col(value).alias("after")), keys, "full")
    return joined.na.fill(0.0, ["before", "after"]).withColumn("dropped", F.round(F.col("before") - F.col("after"), 2))
