"""Judged signals rolled up: rows, projects, flows, reports, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.functions import text as T
from worktide.operators.allocation import confidence

COMMON = "common"


def counted(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and ``name``: "value n" of the values, the most frequent first, then by
    value. Two aggregates: what is collected is distinct values, not rows."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"))))
    return n.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["v"], F.lit(" "), (-x["o"]).cast("string"))), ", ").alias(name))


def product_axis(model: Column, detail: Column, product: Column) -> Column:
    """The product, for common work the detail beside it, else the model itself."""
    common = (model == COMMON) | F.coalesce(product == COMMON, F.lit(False))
    return F.when(common, F.concat(F.lit(COMMON), F.coalesce(F.concat(F.lit(": "), T.blank_to_null(detail)), F.lit("")))).otherwise(F.coalesce(T.blank_to_null(product), model))


def judged_rows(signals: DataFrame, total_mm: Column, products: DataFrame | None = None, default_worktype: str = "office") -> DataFrame:
    """owner, model, detail, product, worktype, share, mm, evidence, confidence, days.

    signals: owner, model, detail, day, source, weight, worktype. Weights are shared
    within the owner; an owner's total of nothing gives shares and man-months of 0.
    The work type is the most frequent, of equals the first by name; total_mm is a
    column over owner. products: model, product."""
    keys = ["owner", "model", "detail"]
    rows = signals.withColumns({"worktype": F.coalesce(T.blank_to_null(F.col("worktype")), F.lit(default_worktype)), "weight": F.coalesce("weight", F.lit(0.0))})
    cells = rows.groupBy(*keys).agg(F.sum("weight").alias("w"), F.count_distinct("day").alias("days"), F.count_distinct("source").alias("sources"))
    kinds = rows.groupBy(*keys, "worktype").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.min_by("worktype", F.struct((-F.col("n")).alias("o"), "worktype")).alias("worktype"))
    share = F.coalesce(F.try_divide("w", F.sum("w").over(W.partitionBy("owner"))), F.lit(0.0))
    out = cells.withColumn("share", share).join(kinds, keys).join(counted(rows, keys, "source", "evidence"), keys)
    named = out.withColumn("product", F.lit(None).cast("string")) if products is None else out.join(products.groupBy("model").agg(F.min("product").alias("product")), "model", "left")
    product = product_axis(F.col("model"), F.col("detail"), F.col("product"))
    return named.select(*keys, product.alias("product"), "worktype", F.round("share", 4).alias("share"), F.round(F.col("share") * total_mm, 3).alias("mm"), "evidence", confidence(F.col("sources"), F.col("days")).alias("confidence"), "days")


def signal_stats(signals: DataFrame, weak: list[str]) -> DataFrame:
    """model, detail (folded), total and passive: how many signals, how many from
    weak sources."""
    model = F.coalesce(T.blank_to_null(F.col("model")), F.lit(COMMON))
    folded = signals.select(T.fold(model).alias("model"), T.fold(F.col("detail")).alias("detail"), F.col("source").isin(*weak).alias("weak"))
    return folded.groupBy("model", "detail").agg(F.count(F.lit(1)).alias("total"), F.count_if("weak").alias("passive"))


def report_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for equal keys: mm and share added up, descriptions and evidence once
    each, in order. rows: keys, mm, share, description, evidence."""
    once = lambda c: F.array_join(F.array_sort(F.collect_set(T.blank_to_null(F.col(c)))), "; ").alias(c)
    trimmed = rows.withColumns({k: F.trim(F.coalesce(k, F.lit(""))) for k in keys})
    return trimmed.groupBy(*keys).agg(F.round(F.sum("mm"), 3).alias("mm"), F.round(F.sum("share"), 4).alias("share"), once("description"), once("evidence"))


def by_project(clusters: DataFrame, people: DataFrame) -> DataFrame:
    """Workflow clusters rolled up to projects, whose names are the same but for case
    and separators (the longest is shown): mm, ax_mm, flows, types, people, shared
    (clusters of more than one person). clusters: cluster, project, mm, ax_mm, flows;
    people: cluster, who."""
    key = T.identity_key(F.col("project")).alias("key")
    heads = people.groupBy("cluster").agg(F.count_distinct("who").alias("n_who"))
    total = lambda c, places: F.round(F.sum(c), places).alias(c)
    rolled = clusters.join(heads, "cluster", "left").groupBy(key).agg(
        F.min_by("project", F.struct((-F.length("project")).alias("l"), "project")).alias("project"), total("mm", 2), total("ax_mm", 2), F.sum("flows").alias("flows"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("n_who") > 1).alias("shared")
    )
    who = people.join(clusters.select("cluster", key), "cluster").groupBy("key").agg(F.count_distinct("who").alias("people"))
    return rolled.join(who, "key", "left").drop("key").na.fill(0, ["people"])


def automation_ratio(steps: DataFrame, keys: list[str], grade: str) -> DataFrame:
    """keys, steps, ax: the share of steps that an agent can take, high as one and
    mid as a half."""
    value = F.when(F.col(grade) == "high", 1.0).when(F.col(grade) == "mid", 0.5).otherwise(0.0)
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.round(F.avg(value), 4).alias("ax"))


def worktype_sums(rows: DataFrame, keys: list[str] = ["owner", "worktype"]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(F.sum("mm"), 3).alias("mm"))


def flow_mm(flows: DataFrame, details: DataFrame, rows: DataFrame) -> DataFrame:
    """flow, mm: a flow's own value, else the sum of its details, else the measured
    rows of its unit. flows: flow, owner, project, detail, mm; details: flow, mm;
    rows: owner, project, detail, mm. A flow without a detail takes its whole project,
    one without a project every project's rows of that detail."""
    key = lambda c: T.identity_key(F.col(c))
    unit = flows.select("flow", "owner", key("project").alias("p"), key("detail").alias("d"), F.nullif("mm", F.lit(0.0)).alias("own"))
    listed = details.groupBy("flow").agg(F.sum("mm").alias("listed"))
    base = rows.select("owner", key("project").alias("p"), key("detail").alias("d"), "mm")
    sums = [base.groupBy("owner", *on).agg(F.sum("mm").alias(name)) for on, name in ((["p", "d"], "both"), (["p"], "of_project"), (["d"], "of_detail"))]
    met = unit.join(listed, "flow", "left").join(sums[0], ["owner", "p", "d"], "left").join(sums[1], ["owner", "p"], "left").join(sums[2], ["owner", "d"], "left")
    measured = F.when((F.col("d") != "") & (F.col("p") != ""), F.col("both")).when(F.col("d") != "", F.col("of_detail")).when(F.col("p") != "", F.col("of_project"))
    return met.select("flow", F.round(F.coalesce("own", F.nullif("listed", F.lit(0.0)), measured, F.lit(0.0)), 3).alias("mm"))


def fold_small(rows: DataFrame, keys: list[str], project: str, least: float = 0.3, rest: str = "others") -> DataFrame:
    """Projects below ``least`` man-months as one row, unless a key has none above it."""
    totals = rows.groupBy(*keys, project).agg(F.sum("mm").alias("mm"))
    small = (F.col("mm") < least) & F.max(F.col("mm") >= least).over(W.partitionBy(*keys))
    return totals.withColumn(project, F.when(small, F.lit(rest)).otherwise(F.col(project))).groupBy(*keys, project).agg(F.round(F.sum("mm"), 3).alias("mm"))


def priorities(units: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """``units`` with their place in order: the level-1 names of ``first`` in that
    order and then others, the project with most man-months, the heaviest unit, then
    by name. units: keys, level1, project, unit, mm, weight."""
    level = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col("level1")), F.lit(0).cast("long")), F.lit(len(first) + 1).cast("long"))
    project_mm = F.sum("mm").over(W.partitionBy(*keys, "project"))
    ordered = units.withColumns({"_level": level, "_mm": project_mm})
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_level", F.desc("_mm"), "project", F.desc("weight"), "unit"))
    return ordered.withColumn("place", place).drop("_level", "_mm")


def best_matches(answers: DataFrame, keys: list[str], most_work: int = 8) -> DataFrame:
    """keys, fit, reason, work: of several answers the best fit (held to 0 to 100, 0 is
    none) with its reason, of equals the first by batch, and the union of work, the
    first ``most_work`` by batch and name. answers: keys, batch, fit, reason, work
    (array)."""
    fit = F.least(F.greatest(F.coalesce(F.col("fit").try_cast("int"), F.lit(0)), F.lit(0)), F.lit(100))
    good = answers.withColumn("fit", fit).where("fit > 0")
    best = good.groupBy(*keys).agg(F.max("fit").alias("fit"), F.min_by("reason", F.struct((-F.col("fit")).alias("o"), "batch")).alias("reason"))
    works = good.select(*keys, "batch", F.explode("work").alias("w")).where(T.blank_to_null(F.col("w")).isNotNull()).groupBy(*keys, "w").agg(F.min("batch").alias("b"))
    placed = works.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("b", "w"))).where(F.col("n") <= most_work)
    listed = placed.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]), "; ").alias("work"))
    return best.join(listed, keys, "left")


def source_inventory(rows: DataFrame, expected: DataFrame, as_of: Column, stale_days: int = 14, few: int = 10) -> DataFrame:
    """source, n, newest, age_days, status: ok, off (optional and empty), bad (empty),
    warn (few rows, or stale). rows: source, at; expected: source, optional."""
    facts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("newest"))
    met = expected.join(facts, "source", "left").na.fill(0, ["n"]).withColumn("age_days", F.date_diff(as_of, F.to_date("newest")))
    status = F.when(F.col("n") == 0, F.when(F.col("optional"), "off").otherwise("bad")).when((F.col("n") < few) | (F.col("age_days") > stale_days), "warn").otherwise("ok")
    return met.select("source", "n", "newest", "age_days", status.alias("status"))


def month_coverage(rows: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """keys, month, covered: every month of the period for every key that has rows."""
    months = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH")))
    seen = rows.select(*keys, F.trunc(F.to_date(at), "MM").alias("m")).distinct().withColumn("covered", F.lit(True))
    spine = seen.select(*keys).distinct().withColumn("m", months)
    return spine.join(seen, [*keys, "m"], "left").select(*keys, F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("covered", F.lit(False)).alias("covered"))


def compared(members: DataFrame, team: list[str], grade: str, value: Column, name: str) -> DataFrame:
    """``members`` with the difference from their team's average over its reliable
    members; unreliable ones stay listed, but neither count nor get a difference."""
    reliable = F.coalesce(F.col(grade) != "unreliable", F.lit(True))
    mean = F.avg(F.when(reliable, value)).over(W.partitionBy(*team))
    return members.withColumns({"reliable": reliable, name: F.when(reliable, F.round(value - mean, 4))})
