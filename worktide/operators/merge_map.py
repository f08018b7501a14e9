"""Merge maps of project names: which names of an owner mean one project.

Candidates are pairs with evidence of any kind: like letters, shared details, a shared
product, or a common refinement; each kind meets on its own keys within the owner,
rare ones first, so that what all names share makes no pairs. Scores and vetoes are
``resolve.evidence_score``'s; positive scores link names into scopes, each clustered
under its constraints. Directions chosen before are kept: what was merged before
starts together and stays, representatives chosen before stay apart, and no alias is
turned round; so a second run on the same rows changes nothing that the first said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.functions import text as T
from worktide.operators import resolve
from worktide.sources.sinks import stored

LETTERS, DETAILS, LEAST_DAYS, CAP = 0.45, 0.175, 14, 5
SEPARATOR = "\x01"


def profiles(rows: DataFrame, owner: str, name: str, mm: str, detail: str, product: str, traces: DataFrame, pinned: DataFrame) -> DataFrame:
    """owner, name, mm, details, products, first_day, last_day, signals, pinned.

    rows: judged rows; traces: (owner, name, day) of signals; pinned: (name) given by
    settings, compared by key."""
    own = rows.where(F.trim(name) != "").groupBy(F.col(owner).alias("owner"), F.trim(name).alias("name"))
    sums = own.agg(F.sum(mm).alias("mm"), F.array_sort(F.collect_set(T.identity_key(F.col(detail)))).alias("details"), F.array_sort(F.collect_set(F.when(F.col(product) != "", T.fold(F.col(product))))).alias("products"))
    days = traces.groupBy("owner", "name").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("signals"))
    marked = pinned.select(T.identity_key(F.col("name")).alias("pin")).distinct().withColumn("pinned", F.lit(True))
    met = sums.join(days, ["owner", "name"], "left").withColumn("pin", T.identity_key(F.col("name"))).join(marked, "pin", "left").drop("pin")
    return met.na.fill(False, ["pinned"]).na.fill(0, ["signals"])


def sharing(known: DataFrame, items: Column, least: float, dice: bool) -> DataFrame:
    """owner, a, b of names whose sets may be alike by ``least``: those that share one
    of the rarest items that such sets cannot all miss."""
    each = known.select("owner", "name", F.size(items).alias("size"), F.explode(items).alias("item"))
    held = each.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("owner", "item")))
    place = F.row_number().over(W.partitionBy("owner", "name").orderBy("df", "item"))
    overlap = F.ceil(F.col("size") * (least / (2 - least) if dice else least) - 1e-9)
    rare = held.withColumn("place", place).where(F.col("place") <= F.col("size") - overlap + 1).select("owner", "name", "item")
    return rare.withColumnRenamed("name", "a").join(rare.withColumnRenamed("name", "b"), ["owner", "item"]).where("a < b").select("owner", "a", "b").distinct()


def pairs(known: DataFrame, never: DataFrame, refined: DataFrame) -> DataFrame:
    """owner, a, b, score, band of pairs with evidence. never: (a, b) that were marked
    as different, compared by key; refined: (owner, a, b) once refined together."""
    p = stored(known.withColumns({"key": T.identity_key(F.col("name")), "note": T.note(F.col("name")), "nums": T.numbers(F.col("name")), "grams": T.bigrams(F.col("name")), "toks": T.tokens(F.col("name"))}))
    together = refined.select("owner", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    same = p.withColumn("item", F.col("key")).where(F.length("key") < 2)
    short = same.select("owner", "item", F.col("name").alias("a")).join(same.select("owner", "item", F.col("name").alias("b")), ["owner", "item"]).where("a < b").select("owner", "a", "b")
    found = sharing(p, F.col("grams"), LETTERS, True).union(sharing(p, F.col("details"), DETAILS, False)).union(sharing(p, F.col("products"), 1e-9, False)).union(together).union(short).distinct()
    one, two = (p.select("owner", F.col("name").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in p.columns if c != "owner")) for s in "ab")
    marked = never.select(F.least(*(T.identity_key(F.col(c)) for c in "ab")).alias("k1"), F.greatest(*(T.identity_key(F.col(c)) for c in "ab")).alias("k2"), F.lit(True).alias("_never")).distinct()
    rows = found.join(one, ["owner", "a"]).join(two, ["owner", "b"]).withColumns({"k1": F.least("a_key", "b_key"), "k2": F.greatest("a_key", "b_key")}).join(marked, ["k1", "k2"], "left")
    rows = rows.join(together.withColumn("_refined", F.lit(True)), ["owner", "a", "b"], "left").na.fill(False, ["_never", "_refined"])
    all_days = p.groupBy("owner").agg(F.date_diff(F.max("last_day"), F.min("first_day")).alias("all_days"))
    rows = rows.join(all_days, "owner", "left").withColumn("half_days", F.greatest(F.lit(LEAST_DAYS), F.floor(F.coalesce("all_days", F.lit(0)) / 2)))
    product = F.arrays_overlap("a_products", "b_products")
    seen = (T.dice(F.col("a_grams"), F.col("b_grams")) > LETTERS) | (T.jaccard(F.col("a_details"), F.col("b_details")) >= DETAILS) | product | F.col("_refined") | (F.col("a_key") == F.col("b_key"))
    scored = rows.where(seen).withColumn("score", resolve.evidence_score(product, F.col("half_days")))
    return scored.select("owner", "a", "b", "score", resolve.band().alias("band"))


def merge_map(scored: DataFrame, known: DataFrame, old: DataFrame, cap: int = CAP) -> DataFrame:
    """owner, alias, canon, kind: the map after this run. scored: from ``pairs``; old:
    owner, alias, canon of earlier runs. kind: kept (from the old map), rule (the same
    but for case and separators) or evidence."""
    before = stored(resolve.close_aliases(old, scope=["owner"]))
    heads = before.select("owner", F.col("canon").alias("name")).distinct().withColumn("head", F.lit(True))
    names = stored(known.join(heads, ["owner", "name"], "left").na.fill(False, ["head"]).withColumn("id", F.concat_ws(SEPARATOR, F.col("owner").cast("string"), "name")))
    ids = names.select("owner", "name", "id")
    linked = stored(scored.join(ids.select("owner", F.col("name").alias("a"), F.col("id").alias("x")), ["owner", "a"]).join(ids.select("owner", F.col("name").alias("b"), F.col("id").alias("y")), ["owner", "b"]).select("x", "y", "score"))
    kept = before.select("owner", F.col("alias").alias("name"), F.concat_ws(SEPARATOR, F.col("owner").cast("string"), "canon").alias("seed"))
    seeded = stored(names.join(kept, ["owner", "name"], "left").withColumn("seed", F.coalesce("seed", F.when(F.col("head"), F.col("id")))))
    bonds = seeded.where("seed <> id").select(F.col("id").alias("a"), F.col("seed").alias("b"), F.lit(1.0).alias("score"))
    scope = stored(resolve.scopes(linked.select(F.col("x").alias("a"), F.col("y").alias("b"), "score").union(bonds), ids.select(F.col("id").alias("name"))))
    inner = linked.join(scope.select(F.col("name").alias("x"), "scope"), "x").join(scope.select(F.col("name").alias("y"), F.col("scope").alias("s2")), "y").where("scope = s2").select("scope", F.col("x").alias("a"), F.col("y").alias("b"), "score")
    # representatives first, then man-months; clusters() orders by one weight
    weight = F.when(F.col("head"), 1e12).otherwise(0.0) + F.col("mm")
    weighed = seeded.join(scope.withColumnRenamed("name", "id"), "id").select("scope", F.col("id").alias("name"), weight.alias("weight"), "seed")
    grouped = stored(resolve.clusters(stored(inner), weighed, cap).select(F.col("name").alias("id"), F.col("canon").alias("cluster")))
    pick = F.struct("head", "mm", F.length(F.trim(F.regexp_replace("name", r"\s+", " "))).alias("l"), (-F.length("name")).alias("s"), "name")
    placed = names.join(grouped, "id").withColumn("rep", F.max(pick).over(W.partitionBy("cluster"))["name"])
    ends = before.select("owner", F.col("alias").alias("rep"), F.col("canon").alias("end"))
    fresh = placed.where("name <> rep").join(before.select("owner", F.col("alias").alias("name")), ["owner", "name"], "left_anti").join(ends, ["owner", "rep"], "left").withColumn("end", F.coalesce("end", "rep")).where(F.col("end") != F.col("name"))
    kind = F.when(T.identity_key(F.col("name")) == T.identity_key(F.col("rep")), "rule").otherwise("evidence")
    added = stored(fresh.select("owner", F.col("name").alias("alias"), F.col("end").alias("canon"), kind.alias("kind")))
    whole = resolve.close_aliases(before.unionByName(added.drop("kind")), scope=["owner"])
    return whole.join(added.select("owner", "alias", "kind"), ["owner", "alias"], "left").na.fill("kept", ["kind"])
