"""Night runs of solvers as working time, on a time line that crosses midnight.

A night reaches from the end of the day window to the beginning of the next day's.
What solvers wrote at night, machines wrote; someone had started them. The credit of
a night runs from the last human trace before the first output to the last output.
It is held to a cap, which trims the front and keeps the end with the outputs, unless
someone came back during the night: a trace after the first output lifts the cap. A
date that two nights share is held to the cap once more, unless one is lifted.

All rows of an owner's night meet in one group by (owner, night), whichever date they
are of; a night never reaches past its two dates, so no owner's history is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.functions.config import Settings
from worktide.operators import intervals

CAP_H, ANCHOR_MIN, DAY_MIN = 4.0, 30.0, 1440
EPOCH = "1970-01-01"
NIGHT = ["owner", "night"]


def on_line(day: str, minute: Column | str) -> Column:
    """Minutes since the epoch of a minute of a day."""
    return F.date_diff(F.col(day), F.lit(EPOCH).cast("date")) * float(DAY_MIN) + (F.col(minute) if isinstance(minute, str) else minute)


def in_nights(rows: DataFrame, kind: str, settings: Settings) -> DataFrame:
    """owner, night, kind, a, b: rows (owner, day, a, b; a = b for a point) once for
    each night that they touch, in minutes since the epoch and not cut."""
    low, high = map(float, settings.day_window)
    line = rows.select("owner", on_line("day", "a").alias("a"), on_line("day", "b").alias("b"))
    first, last = F.floor((F.col("a") - low) / DAY_MIN), F.floor((F.col("b") - high) / DAY_MIN)
    at_end = F.when((F.col("a") - low) % DAY_MIN == 0, 1).otherwise(0)  # the night that ends there is touched by its end
    touched = line.withColumns({"from": first - at_end, "to": last}).where(F.col("from") <= F.col("to"))
    return touched.select("owner", F.explode(F.sequence("from", "to")).alias("night"), F.lit(kind).alias("kind"), "a", "b")


def solver_nights(outputs: DataFrame, people: DataFrame, views: DataFrame, spans: DataFrame, settings: Settings = Settings(), cap_h: float = CAP_H, unlock: bool = True, machine: DataFrame | None = None, mode: str = "span") -> DataFrame:
    """owner, night, a, b, opened, capped: a night's credited pieces in minutes since the
    epoch, cut at midnights and held to the cap by night and by date.

    outputs: (owner, day, a, b) runs of solver outputs, of any length; people: (owner,
    day, a, b) active traces as points; views: the same of what was only looked at,
    which may lift the cap but submits nothing; spans: (owner, day, a, b) meetings and
    sampled activity, whose end counts as the trace. machine: only time in these spans
    counts, if given. mode "anchor" credits ANCHOR_MIN from each run's begin instead.
    """
    low, high = map(float, settings.day_window)
    rows = in_nights(outputs, "out", settings)
    for frame, kind in ((people, "point"), (views, "view"), (spans, "span")):
        rows = rows.unionByName(in_nights(frame, kind, settings))
    begin, end = F.col("night") * float(DAY_MIN) + high, (F.col("night") + 1) * float(DAY_MIN) + low
    of = lambda kind: F.col("kind") == kind
    night = W.partitionBy(*NIGHT)
    output = of("out") & (F.col("a") < end) & (F.col("b") >= begin)
    rows = rows.withColumn("first", F.min(F.when(output, F.greatest("a", begin))).over(night)).where("first IS NOT NULL")
    submitted = F.max(F.when(of("point") & (F.col("a") >= begin) & (F.col("a") <= F.col("first")), F.col("a")).when(of("span") & (F.col("b") > begin) & (F.col("a") <= F.col("first")), F.least("b", "first")))
    came_back = F.max(F.when(of("point") | of("view"), (F.col("a") > F.col("first")) & (F.col("a") <= end)).when(of("span"), (F.col("b") > F.col("first")) & (F.col("a") < end)))
    lifted = F.coalesce(came_back, F.lit(False)) if unlock else F.lit(False)
    nights = rows.groupBy(*NIGHT).agg(F.coalesce(submitted, F.first("first")).alias("a"), F.max(F.when(output, F.least("b", end))).alias("b"), lifted.alias("opened"))
    if mode == "anchor":
        runs = rows.where(output).select(*NIGHT, F.greatest("a", begin).alias("a"), F.least(F.greatest("a", begin) + ANCHOR_MIN, end).alias("b"))
        pieces = intervals.union(runs, NIGHT).join(nights.select(*NIGHT, "opened"), NIGHT)
    else:
        pieces = intervals.sane(nights)
    if machine is not None:
        on = in_nights(machine, "on", settings).select(*NIGHT, F.greatest("a", begin).alias("a"), F.least("b", end).alias("b"))
        pieces = intervals.intersect(pieces.select(*NIGHT, "a", "b"), on, NIGHT).join(nights.select(*NIGHT, "opened"), NIGHT)
    limit = cap_h * 60
    whole = F.sum(F.col("b") - F.col("a")).over(night)
    judged = pieces.withColumn("capped", ~F.col("opened") & F.lit(cap_h > 0) & (whole > limit + 1e-9))
    held = kept_end(judged, NIGHT, F.when(F.col("capped"), F.lit(limit)))
    day = F.explode(F.sequence(F.floor(F.col("a") / DAY_MIN), F.ceil(F.col("b") / DAY_MIN) - 1)).alias("date")
    dated = held.select(*NIGHT, "opened", "capped", "a", "b", day).withColumns({"a": F.greatest("a", F.col("date") * float(DAY_MIN)), "b": F.least("b", (F.col("date") + 1) * float(DAY_MIN))})
    shared = W.partitionBy("owner", "date")
    free, total = F.max("opened").over(shared), F.sum(F.col("b") - F.col("a")).over(shared)
    return kept_end(dated, ["owner", "date"], F.when(F.lit(cap_h > 0) & ~free & (total > limit + 1e-9), F.lit(limit))).select(*NIGHT, "a", "b", "opened", "capped")


def kept_end(pieces: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """The last ``limit`` minutes of each key's disjoint pieces (null: all)."""
    after = W.partitionBy(*keys).orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    behind = F.coalesce(F.sum(F.col("b") - F.col("a")).over(after), F.lit(0.0))
    cut = pieces.withColumns({"_behind": behind, "_limit": limit})
    start = F.when(F.col("_limit").isNull(), F.col("a")).otherwise(F.greatest("a", F.col("b") - (F.col("_limit") - F.col("_behind"))))
    return intervals.sane(cut.withColumn("a", start).drop("_behind", "_limit"))


def by_day(nights: DataFrame) -> DataFrame:
    """owner, day, a, b of credited pieces, in minutes of the day."""
    date = F.floor(F.col("a") / DAY_MIN)
    day = F.date_add(F.lit(EPOCH).cast("date"), date.cast("int"))
    return nights.select("owner", day.alias("day"), (F.col("a") - date * float(DAY_MIN)).alias("a"), (F.col("b") - date * float(DAY_MIN)).alias("b"))
