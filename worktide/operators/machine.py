"""Machine-on records: days from spans, days merged over machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from worktide.functions.config import Settings
from worktide.operators import intervals

MOST_H = 24.0


def daily_from_spans(spans: DataFrame, settings: Settings = Settings(), keys: list[str] = ["owner", "day"]) -> DataFrame:
    """keys, on_h, night_h, first_min, last_min, weekend of the union of spans (day, a, b)."""
    low, high = map(float, settings.day_window)
    merged = intervals.union(spans, keys)
    inside = F.greatest(F.lit(0.0), F.least("b", F.lit(high)) - F.greatest("a", F.lit(low)))
    days = merged.groupBy(*keys).agg(
        F.round(F.sum(F.col("b") - F.col("a")) / 60, 2).alias("on_h"), F.round(F.sum(F.col("b") - F.col("a") - inside) / 60, 2).alias("night_h"), F.min("a").alias("first_min"), F.max("b").alias("last_min")
    )
    return days.withColumn("weekend", ~((F.dayofweek("day") + 5) % 7 + 1).isin(*settings.workdays))


def merged_days(days: DataFrame, hints: DataFrame, keys: list[str] = ["owner", "day"]) -> DataFrame:
    """Recorded days with hinted ones: a hint replaces a whole row where its machine
    was on for longer, and stands where there is none."""
    rest = [c for c in days.columns if c not in keys]
    own, other = (f.select(*keys, F.struct(*rest).alias(n)) for f, n in ((days, "own"), (hints, "hint")))
    longer = F.col("own").isNull() | (F.col("hint.on_h") > F.col("own.on_h"))
    row = F.when(F.coalesce(longer, F.lit(False)) & F.col("hint").isNotNull(), F.col("hint")).otherwise(F.col("own"))
    return own.join(other, keys, "full").select(*keys, row.alias("row")).select(*keys, *(F.col("row").getField(c).alias(c) for c in rest))


def power_days(rows: DataFrame, spans: DataFrame, settings: Settings = Settings(), slack_min: float = 15.0) -> DataFrame:
    """owner, day, on_h, night_h, first_min, last_min over all machines of an owner.

    rows: owner, root, day, on_h, night_h, first_min, last_min (a machine's record of
    a day); spans: owner, root, day, a, b (its measured times). Records are held to 0
    to 24 hours, night within on. On a day of one machine its record counts, or what
    its spans give. With several machines their measured spans, and the windows of
    machines without spans that were on without a break, are one union: two machines
    at different hours add up, at the same hours count once; never less than the
    larger record.
    """
    keys = ["owner", "day"]
    on = F.least(F.greatest(F.coalesce("on_h", F.lit(0.0)), F.lit(0.0)), F.lit(MOST_H))
    night = F.least(F.greatest(F.coalesce("night_h", F.lit(0.0)), F.lit(0.0)), F.col("on_h"))
    whole = F.col("first_min") <= F.col("last_min")
    held = rows.withColumn("on_h", on).withColumn("night_h", night).withColumns({c: F.when(whole, F.col(c)) for c in ("first_min", "last_min")})
    record = held.groupBy(*keys).agg(F.max(F.col("on_h") - F.col("night_h")).alias("r_day"), F.max("night_h").alias("r_night"), F.min("first_min").alias("r_first"), F.max("last_min").alias("r_last"))

    measured = intervals.sane(spans).select("owner", "root", "day", "a", "b")
    by_root = measured.select("owner", "root", "day").distinct()
    unbroken = held.where((F.col("last_min") > F.col("first_min")) & (F.abs(F.col("last_min") - F.col("first_min") - F.col("on_h") * 60) <= slack_min))
    windows = unbroken.join(by_root, ["owner", "root", "day"], "left_anti").select("owner", "root", "day", F.col("first_min").cast("double").alias("a"), F.col("last_min").cast("double").alias("b"))
    roots = by_root.union(held.select("owner", "root", "day")).groupBy(*keys).agg(F.count_distinct("root").alias("roots"))
    union = daily_from_spans(measured.union(windows), settings).select(*keys, (F.col("on_h") - F.col("night_h")).alias("u_day"), F.col("night_h").alias("u_night"), F.col("first_min").alias("u_first"), F.col("last_min").alias("u_last"))

    both = roots.join(record, keys, "left").join(union, keys, "left")
    alone = (F.col("roots") < 2) & F.col("r_day").isNotNull()
    pick = lambda f, c: F.when(alone, F.col(f"r_{c}")).otherwise(f(f"r_{c}", f"u_{c}"))  # noqa: E731 (greatest and least pass over nulls)
    day, night = pick(F.greatest, "day"), pick(F.greatest, "night")
    return both.select(*keys, F.round(F.least(F.lit(MOST_H), day + night), 2).alias("on_h"), F.round(night, 2).alias("night_h"), pick(F.least, "first").cast("double").alias("first_min"), pick(F.greatest, "last").cast("double").alias("last_min"))
