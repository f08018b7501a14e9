"""Worked hours a day and load a month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from worktide.functions.config import Settings
from worktide.functions.numbers import half_up
from worktide.operators import intervals, sessions
from worktide.sources.sinks import stored


def calendar(spark: SparkSession, first: str, last: str, settings: Settings = Settings()) -> DataFrame:
    """day, month, workday and n (running number of workdays), one row a day.

    A calendar is a few hundred rows a year, whatever the data."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    return with_workdays(days, settings)


def with_workdays(days: DataFrame, settings: Settings = Settings()) -> DataFrame:
    weekday = (F.dayofweek("day") + 5) % 7 + 1
    workday = weekday.isin(*settings.workdays)
    if settings.holidays:
        workday &= ~F.col("day").isin(*(F.lit(h).cast("date") for h in settings.holidays))
    return days.select("day", F.date_format("day", "yyyy-MM").alias("month"), workday.alias("workday"))


def work_spans(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Signal sessions with the passive cap applied: owner, day, a, b."""
    return sessions.cap_passive(sessions.signal_sessions(signals, settings), settings.passive_day_max_min).select("owner", "day", "a", "b")


def day_hours(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """owner, day, hours worked by signal sessions alone."""
    return intervals.union_hours(work_spans(signals, settings)).select("owner", "day", "hours")


def month_workdays(first: Column, last: Column, settings: Settings = Settings()) -> Column:
    """How many workdays lie between two dates, both included."""
    holidays = [F.lit(h).cast("date") for h in settings.holidays]

    def works(d: Column) -> Column:
        ok = ((F.dayofweek(d) + 5) % 7 + 1).isin(*settings.workdays)
        return ok & ~d.isin(*holidays) if holidays else ok

    return F.size(F.filter(F.sequence(first, last), works))


def monthly_load(hours: DataFrame, first: str, last: str, settings: Settings = Settings(), absence: DataFrame | None = None) -> DataFrame:
    """owner, month, worked_h, workdays, avail_mm, mm, load_pct.

    One man-month is the standard day times the workdays of the whole calendar
    month; absences leave what is available, not what one man-month is. hours:
    owner, day, hours; absence: owner, day, frac.
    """
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    inside = hours.where(F.col("day").between(low, high)).withColumn("month", F.trunc("day", "MM"))
    worked = inside.groupBy("owner", "month").agg(F.round(F.sum("hours"), 4).alias("worked"))
    if absence is None:
        away = None
    else:
        weekday = ((F.dayofweek("day") + 5) % 7 + 1).isin(*settings.workdays)
        away = absence.where(F.col("day").between(low, high) & weekday).groupBy("owner", F.trunc("day", "MM").alias("month")).agg(F.sum(F.least(F.col("frac"), F.lit(1.0))).alias("absent"))
    joined = worked.withColumn("absent", F.lit(0.0)) if away is None else worked.join(away, ["owner", "month"], "left").na.fill(0.0, ["absent"])
    full = F.greatest(month_workdays(F.col("month"), F.last_day("month"), settings), F.lit(1))
    here = month_workdays(F.greatest("month", low), F.least(F.last_day("month"), high), settings)
    sized = joined.withColumns({"workdays": full, "covered": here})
    out = sized.withColumns(
        {
            "mm": half_up(F.col("worked") / (F.col("workdays") * settings.std_day_h), 3),
            "avail_mm": half_up(F.greatest(F.col("covered") - F.col("absent"), F.lit(0.0)) / F.col("workdays"), 3),
        }
    )
    load = F.when(F.col("avail_mm") > 0, half_up(F.col("mm") / F.col("avail_mm") * 100, 1))
    return out.select("owner", F.date_format("month", "yyyy-MM").alias("month"), F.round("worked", 1).alias("worked_h"), "workdays", "avail_mm", "mm", load.alias("load_pct"))


def split_day_night(spans: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """owner, day, day_min and night_min of the union of spans."""
    low, high = settings.day_window
    merged = intervals.union(spans)
    inside = F.greatest(F.lit(0.0), F.least(F.col("b"), F.lit(float(high))) - F.greatest(F.col("a"), F.lit(float(low))))
    return merged.groupBy("owner", "day").agg(F.sum(inside).alias("day_min"), F.sum(F.col("b") - F.col("a") - inside).alias("night_min"))


def worked_hours(traces: DataFrame, machine: DataFrame, productive: DataFrame, settings: Settings = Settings(), offsite: DataFrame | None = None, manual: DataFrame | None = None, absence: DataFrame | None = None) -> DataFrame:
    """The day rules in one sweep: owner, day, hours, day_h, night_h, floor_h, long_day.

    traces: (owner, day, kind, a, b) with kind session, meeting, carried (a meeting's
    piece behind midnight) or sampler; machine: (owner, day, a, b) machine-on spans;
    productive: (owner, day, minute) active traces; offsite: (owner, day); manual:
    (owner, day, hours); absence: (owner, day, frac).

    1. Worked pieces are those a trace covers, and gaps of at most the bridge length
       between sampler pieces, lunch and dinner excepted. A day is open if it has a
       productive trace, a meeting, a sampler, off-site work or manual hours; a closed
       day off keeps only what meetings carry over midnight.
    2. Evening and dawn credit: machine time outside the day window within the night
       pad of the first and last productive trace, as much as the machine was on at
       night beyond the night minutes that traces cover.
    3. Floor, on open days: machine time inside the day window that no sampler covers,
       minus lunch or dinner that no trace touches, minus the share of an absence; on a
       day off only within the pad of the productive traces. It is compared with the
       worked minutes in the same pieces; worked minutes elsewhere are added to either.
    4. Flex edge, on open days: machine time up to an hour outside the day window each
       side, as much as the machine's night time leaves.
    5. An off-site day counts at least the standard day less the absence; manual
       hours are a lower bound; nothing passes 24 hours; long days are flagged.
    """
    low, high = map(float, settings.day_window)
    keys = ["owner", "day"]
    win = intervals.trace_window(productive, "minute", settings.night_pad_min).select(*keys, F.lit("near").alias("kind"), "a", "b")
    touch = productive.select(*keys, F.lit("touch").alias("kind"), (F.col("minute") - settings.trace_pad_min).alias("a"), (F.col("minute") + settings.trace_pad_min).alias("b"))
    gaps = sampler_bridges(traces.where("kind = 'sampler'"), settings).withColumn("kind", F.lit("bridge"))
    on = machine.select(*keys, F.lit("on").alias("kind"), "a", "b")
    known = stored(traces.select(*keys, "kind", "a", "b").union(on).union(win).union(touch).union(gaps.select(*keys, "kind", "a", "b")))  # each input is read once
    fixed = known.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in {"dayw": (low, high), "flex": (low - 60 * settings.flex_edge_h, high + 60 * settings.flex_edge_h), "lunch": settings.lunch, "dinner": settings.dinner}.items()))).alias("s")).select(*keys, "s.kind", "s.a", "s.b")
    kinds = ["session", "meeting", "carried", "sampler", "bridge", "on", "near", "touch", "dayw", "flex", "lunch", "dinner"]
    segs = intervals.tiles(known.union(fixed), kinds, intervals.tasks_for(known.count()))
    has = lambda p, *k: intervals.on(p, kinds, *k)
    some = lambda holds: F.exists("pieces", holds)
    holiday = F.col("day").isin(*(F.lit(h).cast("date") for h in settings.holidays)) if settings.holidays else F.lit(False)
    off_day = ~((F.dayofweek("day") + 5) % 7 + 1).isin(*settings.workdays) | holiday
    segs = segs.withColumns({"off_day": off_day, "opens": some(lambda p: has(p, "near", "meeting", "sampler")), "lunch_touched": some(lambda p: has(p, "lunch") & has(p, "touch", "meeting")), "dinner_touched": some(lambda p: has(p, "dinner") & has(p, "touch", "meeting"))})
    opened, off = ~F.col("off_day") | F.col("opens"), F.col("off_day")

    def marked(p: Column) -> Column:
        night = ~has(p, "dayw")
        meal = (has(p, "lunch") & ~F.col("lunch_touched")) | (has(p, "dinner") & ~F.col("dinner_touched"))
        counted = has(p, "carried") | (opened & has(p, "session", "meeting", "sampler")) | (has(p, "bridge") & ~has(p, "lunch", "dinner"))
        floored = has(p, "on") & ~night & ~meal & ~has(p, "sampler", "bridge") & (~off | has(p, "near"))
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), p["on"].alias("on"), night.alias("night"), counted.alias("counted"), floored.alias("floored"))

    credit = lambda p: has(p, "on") & has(p, "near") & p["night"] & ~p["counted"]
    sums = {
        "rest_min": lambda p: p["counted"] & ~p["night"] & ~p["floored"], "inside_min": lambda p: p["counted"] & p["floored"], "floor_min": lambda p: p["floored"], "traced_night": lambda p: p["counted"] & p["night"],
        "night_on": lambda p: has(p, "on") & p["night"], "credit_min": credit, "flex_min": lambda p: has(p, "on") & has(p, "flex") & p["night"] & ~p["counted"] & ~credit(p),
    }
    days = segs.withColumn("pieces", F.transform("pieces", marked)).select(*keys, *(intervals.minutes("pieces", holds).alias(name) for name, holds in sums.items()), F.col("opens").cast("int").alias("gated"))
    for extra, column in ((offsite, F.lit(1).alias("off")), (manual, F.col("hours").alias("manual_h")), (absence, F.col("frac").alias("absent"))):
        if extra is not None:
            days = days.join(extra.select(*keys, column), keys, "full")
    for name, default in {"off": 0, "manual_h": 0.0, "absent": 0.0, "gated": 0, **dict.fromkeys(sums, 0.0)}.items():
        days = days.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in days.columns else F.lit(default))
    gate = (F.col("gated") == 1) | (F.col("off") == 1) | (F.col("manual_h") > 0)
    floor = F.when(gate, F.col("floor_min") * (1 - F.least(F.col("absent"), F.lit(1.0)))).otherwise(0.0)
    day_min = F.col("rest_min") + F.greatest(F.col("inside_min"), floor)
    room = lambda used: F.greatest(F.lit(0.0), F.col("night_on") - used)
    credited = F.col("traced_night") + F.least("credit_min", room(F.col("traced_night")))
    night_min = credited + F.when(gate, F.least("flex_min", room(credited))).otherwise(0.0)
    least = F.greatest(F.when(F.col("off") == 1, settings.std_day_h * (1 - F.col("absent"))).otherwise(0.0), F.col("manual_h"))
    hours = F.least(F.lit(24.0), F.greatest((day_min + night_min) / 60, least))
    return days.select(*keys, F.round(hours, 2).alias("hours"), F.round(day_min / 60, 2).alias("day_h"), F.round(night_min / 60, 2).alias("night_h"), F.round(floor / 60, 2).alias("floor_h"), (hours > settings.long_day_h).alias("long_day"))


def sampler_spans(samples: DataFrame, step_min: float, idle_s: float = 300.0, bridge_min: float = 10.0, stuck_h: float = 14.0, stuck_share: float = 0.02) -> DataFrame:
    """owner, day, kind (active, cover), a, b: what a window sampler saw.

    samples: owner, day, minute, idle (seconds), title; one a time counts. An active
    sample lasts a step; it reaches back to the end of the active sample before it
    where that is at most the bridge length ago and the same title stayed in front all
    the while, idle samples included (reading). Every sample covers three steps. A day
    that looks stuck, covered for hours on end with hardly ever an idle second, is
    dropped whole."""
    keys = ["owner", "day"]
    one = samples.groupBy(*keys, "minute").agg(F.min(F.struct("idle", "title")).alias("s")).select(*keys, "minute", "s.*")
    along = W.partitionBy(*keys).orderBy("minute")
    changed = F.when(F.col("title").eqNullSafe(F.lag("title").over(along)), 0).otherwise(1)
    seen = one.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(along))
    end = F.least(F.lit(1440.0), F.col("minute") + step_min)
    before = F.lag("_end").over(W.partitionBy(*keys, "_run").orderBy("minute"))
    active = seen.where(F.col("idle") <= idle_s).withColumn("_end", end).withColumn("_before", before)
    back = F.col("minute") - F.col("_before")
    spans = active.select(*keys, F.when((back >= 0) & (back <= bridge_min), F.col("_before")).otherwise(F.col("minute")).alias("a"), F.col("_end").alias("b"))
    cover = intervals.union(one.select(*keys, F.col("minute").alias("a"), F.least(F.lit(1440.0), F.col("minute") + 3 * step_min).alias("b")))
    length = cover.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("_covered"))
    stuck = one.groupBy(*keys).agg(F.avg((F.col("idle") > 0).cast("int")).alias("_share")).join(length, keys).where((F.col("_covered") >= 60 * stuck_h) & (F.col("_share") < stuck_share)).select(*keys)
    both = intervals.union(spans).withColumn("kind", F.lit("active")).unionByName(cover.withColumn("kind", F.lit("cover")))
    return both.join(stuck, keys, "left_anti").select(*keys, "kind", "a", "b")


def sampler_bridges(sampler: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The gaps of at most the bridge length between merged sampler spans."""
    merged = intervals.union(sampler.select("owner", "day", "a", "b"))
    after = F.lead("a").over(W.partitionBy("owner", "day").orderBy("a"))
    return merged.select("owner", "day", F.col("b").alias("a"), after.alias("b")).where((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= settings.gap_bridge_min))


def inferred_absences(hours: DataFrame, owners: DataFrame, first: str, last: str, machine: DataFrame, settings: Settings = Settings(), most_h: float = 0.25, most_on_h: float = 0.5, least_share: float = 0.4) -> DataFrame:
    """Workdays that look like leave: hardly any work, hardly any machine time, in
    a month in which the owner has machine records on enough workdays.

    machine: owner, day, on_h.
    """
    every = owners.select("owner", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    weekday = ((F.dayofweek("day") + 5) % 7 + 1).isin(*settings.workdays)
    off = F.col("day").isin(*(F.lit(h).cast("date") for h in settings.holidays)) if settings.holidays else F.lit(False)
    spine = every.where(weekday & ~off).withColumn("month", F.trunc("day", "MM"))
    facts = spine.join(hours.select("owner", "day", "hours"), ["owner", "day"], "left").join(machine.select("owner", "day", "on_h"), ["owner", "day"], "left")
    share = F.avg(F.when(F.col("on_h").isNotNull(), 1.0).otherwise(0.0)).over(W.partitionBy("owner", "month"))
    judged = facts.withColumn("share", share).na.fill(0.0, ["hours", "on_h"])
    return judged.where((F.col("hours") <= most_h) & (F.col("on_h") <= most_on_h) & (F.col("share") >= least_share)).select("owner", "day")


def sampling_step(samples: DataFrame, keys: list[str], at: str, low: float = 60.0, high: float = 300.0, most_gap: float = 600.0) -> DataFrame:
    """The sampler's step in seconds: the median gap, within bounds."""
    gap = F.timestamp_diff("SECOND", F.lag(at).over(W.partitionBy(*keys).orderBy(at)), F.col(at))
    gaps = samples.withColumn("_gap", gap).where((F.col("_gap") > 0) & (F.col("_gap") <= most_gap))
    return gaps.groupBy(*keys).agg(F.least(F.lit(high), F.greatest(F.lit(low), F.median("_gap"))).alias("step_s"))
