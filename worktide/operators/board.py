"""The allocation board: derived columns, aggregates by code, integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def by_code(rows: DataFrame, codes: Column, value: Column, high: Column) -> DataFrame:
    """Plan, high-confidence and split sums for each code; a row's value is split
    evenly over its codes."""
    each = rows.select(F.explode(codes).alias("code"), value.alias("v"), F.size(codes).alias("n"), high.alias("high"))
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("v"), 2).alias("plan"), F.round(F.sum(F.when(F.col("high"), F.col("v")).otherwise(0)), 2).alias("high"), F.round(F.sum(F.col("v") / F.col("n")), 2).alias("split"))


def issues(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, issue for every rule a row breaks: one pass, not one for each rule."""
    broken = F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in rules.items())))
    return rows.select(key, F.explode(broken).alias("issue"))


def differences(stored: DataFrame, computed: DataFrame, keys: list[str], value: str, least: float = 0.0005) -> DataFrame:
    joined = stored.select(*keys, F.col(value).alias("stored")).join(computed.select(*keys, F.col(value).alias("computed")), keys, "full")
    return joined.where(F.col("stored").isNull() | F.col("computed").isNull() | (F.abs(F.col("stored") - F.col("computed")) > least))


def subtotals(rows: DataFrame, a: str, b: str, value: Column) -> DataFrame:
    """Cells, row totals and the grand total in one pass (level 0, 1, 3)."""
    return rows.rollup(a, b).agg(F.sum(value).alias("total"), F.grouping_id().cast("int").alias("level"))
