"""Worked hours of a day from every input at once, with the ledger of what looked odd.

All spans of an owner's day are cut at all their boundaries into pieces that tile the
day (``intervals.cuts``); every rule is then a predicate over the kinds that cover a
piece. Two sweeps, each one shuffle by owner and day: the first tells where traces lie,
so that machine windows can be trimmed; the second holds all windows that follow from
it. What the rules need of a day are sums over its pieces, all taken in one aggregate;
only days whose evening or dawn grows, or whose gaps may close, keep pieces as an array.

Order of the rules:
1. Worked: sampled activity, meetings, sessions and blocks of off-site work. A day off
   without an active trace keeps only meetings carried over midnight.
2. A day off with machine time: the time between the first and the last product, half
   an hour more each side, without an untouched lunch.
3. Solver nights, set apart: they use up no allowance of the machine's night.
4. Evening and dawn: machine time up to half an hour past the last (before the first)
   product at night, both shrunk by one share until they fit what the machine was on
   at night and no trace covers. A night shift across midnight has no end there.
5. Gaps of at most the bridge length that the sampler covers, but lunch and dinner.
6. The floor, if something active opens the day: time inside the day window that the
   machine was on (measured spans; a window less its unexplained sleep; hours without
   a window; for a machine that is always on, the traces' window; without records, the
   traces' window up to a standard day), less timed absence, untouched lunch and
   dinner, where no sampler covers it. It replaces the traces inside, if it is more.
7. Machine time up to an hour outside the day window, within the night's allowance.
8. Off-site days count a standard day less the absence, manual hours what they say, as
   lower bounds; no day has more than 24 hours; long days are flagged, not cut. A day of
   just 16 (or 24) hours is not over them, whatever the last bits of its sum are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from worktide.functions.config import Settings
from worktide.operators import intervals
from worktide.sources.sinks import stored

KEYS = ["owner", "day"]
MACHINE_DAY_H, ALWAYS_ON_H, SAMPLER_MOST_H, MEAL_MIN, WHOLE_BLOCK_MIN = 11.0, 20.0, 20.0, 30.0, 360.0
KINDS = ["act", "meet", "sess", "blk", "blkl", "cov", "touch", "win", "leave", "solver", "weekend", "eve", "dawn", "tw", "tm", "dayw", "lunch", "dinner", "flex", "all"]


def day_off(settings: Settings) -> Column:
    off = ~((F.dayofweek("day") + 5) % 7 + 1).isin(*settings.workdays)
    return off | F.col("day").isin(*(F.lit(h).cast("date") for h in settings.holidays)) if settings.holidays else off


def kind_of(frame: DataFrame, kind: str | Column) -> DataFrame:
    return frame.select(*KEYS, (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))


SEEN = ["act", "meet", "blk", "blkl", "touch", "win", "lunch"]
#: Bits of a piece beside its kinds: counted by rules 1 to 3; ground that the floor may count.
DONE, OPEN = (1 << len(KINDS) + i for i in range(2))


def mask(*kinds: str) -> int:
    return sum(1 << KINDS.index(k) for k in kinds)


def has(*any_of: str, kinds: list[str] = KINDS) -> Column:
    """Whether one of some kinds covers a piece (a row of ``intervals.cuts``)."""
    return intervals.on({"on": F.col("on")}, kinds, *any_of)


def over(p: Column, *any_of: str) -> Column:
    """The same for a piece in an array."""
    return intervals.on(p, KINDS, *any_of)


def marked(p: Column, mark: int) -> Column:
    return p["on"].bitwiseAND(F.lit(mark).cast("long")) != 0


def hundredths(value: Column) -> Column:
    """Rounded to two places, half up, whatever the last bits of a sum are."""
    return F.floor(value * 100 + 0.5 + 1e-7) / 100


def traced(kinds: list[str] = KINDS) -> tuple[Column, Column]:
    """off-site blocks without an untouched lunch, and all traces."""
    direct = has("touch", "meet", "act", kinds=kinds)
    block = has("blk", kinds=kinds) | (has("blkl", kinds=kinds) & ~(has("lunch", kinds=kinds) & ~direct))
    return block, direct | block


def grown_by(pieces: Column, share: Column) -> Column:
    """Minutes that growing pieces {lo, hi, n} add at a share."""
    return F.aggregate(pieces, F.lit(0.0), lambda sum_, p: sum_ + p["n"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - p["lo"]) / (p["hi"] - p["lo"]))))


def growth(pieces: Column) -> Column:
    """What growing pieces add in all at each share where that bends.

    A piece {lo, hi, n} adds its n minutes evenly as the share grows from lo to hi.
    What is added is linear between those points."""
    added = lambda at: grown_by(pieces, at)
    points = F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), pieces["lo"], pieces["hi"]))
    return F.transform(points, lambda x: F.struct(x.alias("at"), added(x).alias("sum")))


def fitted_share(last: Column, after: Column, allowed: Column) -> Column:
    """The largest share at which no more than ``allowed`` is added, from the last point
    of ``growth`` that still fits and the next one."""
    return F.when(after.isNull(), 1.0).otherwise(F.coalesce(last["at"] + (allowed - last["sum"]) * (after["at"] - last["at"]) / (after["sum"] - last["sum"]), F.lit(0.0)))


def point_facts(points: DataFrame, settings: Settings) -> DataFrame:
    low, high = settings.day_window
    inside = F.col("minute").between(low, high - 1)
    product = F.col("productive") & (~F.col("solver") | inside)
    at = lambda holds: F.when(holds, F.col("minute").cast("double"))
    return points.groupBy(*KEYS).agg(
        F.min(at(product)).alias("prod_min"), F.max(at(product)).alias("prod_max"), F.max(at(product & (F.col("minute") >= high))).alias("ev_last"),
        F.min(at(product & (F.col("minute") < low))).alias("ev_first"), F.max("solver").alias("has_solver"),
    )


def whole_days(sessions: DataFrame, meetings: DataFrame, sampler: DataFrame, machine: DataFrame, machine_days: DataFrame, points: DataFrame, solver: DataFrame, offsite: DataFrame, manual: DataFrame, absence: DataFrame, leave: DataFrame, settings: Settings = Settings(), weekend: str = "window") -> DataFrame:
    """owner, day, hours, day_h, night_h, what each rule added (weekend_h, solver_h,
    credit_h, bridge_h, floor_h, flex_h, least_h), basis of the floor, active, long_day
    and anomalies (the day's ledger, or ''), a row for each day of any input.

    sessions: (owner, day, a, b); meetings: the same with block, away (a block for
    off-site work), accepted, carried; sampler: kind active or cover; machine: on spans,
    measured or a record's window; machine_days: on_h, night_h, first_min, last_min;
    points: minute, productive, solver (written by a solver); solver: credited spans of
    solver nights; offsite: days; manual: hours; absence: frac; leave: spans of timed
    half days. weekend: window, pc (a day off with an active trace has a floor as well)
    or none.
    """
    s = settings
    low, high = map(float, s.day_window)
    (l0, l1), (d0, d1), trim, pad = map(float, s.lunch), map(float, s.dinner), s.trim_edges_min, s.night_pad_min
    direct = meetings.where("NOT block")
    whole = (F.col("b") - F.col("a") >= WHOLE_BLOCK_MIN) & (F.col("a") <= l0) & (F.col("b") >= l1)
    inside = F.col("minute").between(low, high - 1)
    touch = points.where(~F.col("solver") | inside).select(*KEYS, (F.col("minute") - s.trace_pad_min).alias("a"), (F.col("minute") + s.trace_pad_min).alias("b"))
    rows = [kind_of(sampler, F.when(F.col("kind") == "active", "act").otherwise("cov")), kind_of(meetings, F.when(~F.col("block"), "meet").when(~F.col("away"), "other").when(whole, "blkl").otherwise("blk")), kind_of(touch, "touch")]
    rows += [kind_of(sessions, "sess"), kind_of(machine, "win"), kind_of(leave, "leave"), kind_of(solver, "solver")]
    spans = stored(reduce(DataFrame.union, rows))  # each input is read once, and all rules read this
    known = reduce(DataFrame.union, (f.select(*KEYS) for f in (spans, machine_days, points, offsite, manual, absence))).distinct()
    rows = spans.count()
    lunches = kind_of(known.withColumns({"a": F.lit(l0), "b": F.lit(l1)}), "lunch")
    pieces = intervals.cuts(spans.where(F.col("kind").isin(*SEEN)).union(lunches), SEEN, intervals.tasks_for(rows))
    block, trace = traced(SEEN)
    is_win, is_act, meets = has("win", kinds=SEEN), has("act", kinds=SEEN), has("meet", kinds=SEEN) | block
    begins = lambda holds: F.min(F.when(holds, F.col("a")))
    ends = lambda holds: F.max(F.when(holds, F.col("b")))
    listed = lambda holds: F.collect_list(F.when(holds, F.struct("a", "b")))
    near = lambda a, b: F.exists("traces", lambda p: (p["b"] > a) & (p["a"] < b))
    shape = pieces.groupBy(*KEYS).agg(
        begins(is_win).alias("w0"), ends(is_win).alias("w1"), F.max(block).alias("has_block"), F.max(is_act).alias("has_act"), begins(meets).alias("m0"), ends(meets).alias("m1"), begins(meets | is_act).alias("t0"), ends(meets | is_act).alias("t1"),
        F.sum(F.when(is_act, F.col("b") - F.col("a")).otherwise(0.0)).alias("act_min"), listed(is_win).alias("wins"), listed(trace).alias("traces"),
    ).withColumns({"near0": near(F.col("w0"), F.col("w0") + trim), "near1": near(F.col("w1") - trim, F.col("w1"))}).drop("traces")

    said = direct.groupBy(*KEYS).agg(F.max("accepted").alias("accepted"), F.max("carried").alias("carried"))
    measured = machine.groupBy(*KEYS).agg(F.max("measured").alias("measured"))
    frames = [shape, point_facts(points, s), said, measured, machine_days.select(*KEYS, "on_h", "night_h", "first_min", "last_min"), offsite.select(*KEYS, F.lit(True).alias("is_offsite")), manual.select(*KEYS, F.col("hours").alias("manual_h")), absence.select(*KEYS, F.col("frac").alias("absent"))]
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [known, *frames])  # each fact comes from one frame, a row a day
    facts = every.groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in every.columns if c not in KEYS))
    facts = facts.na.fill(0.0, ["on_h", "night_h", "absent", "act_min", "manual_h"]).na.fill(False, ["near0", "near1", "has_block", "has_act", "has_solver", "accepted", "carried", "measured", "is_offsite"])
    facts = facts.withColumns({"off": day_off(s), "is_manual": F.col("manual_h") > 0, "is_offsite": F.col("is_offsite") & (F.col("absent") < 1)})
    has_prod = F.col("prod_min").isNotNull()
    along = W.partitionBy("owner").orderBy("day")
    through = lambda n: F.struct("day", "night_h", "first_min", (F.col("ev_first").isNotNull()).alias("dawn")) if n else F.struct("day", "night_h", "last_min", (F.col("ev_last").isNotNull()).alias("eve"))
    facts = facts.withColumns({"after": F.lead(through(1)).over(along), "before": F.lag(through(0)).over(along)})
    fills = lambda x: F.coalesce(x, F.lit(False))
    onward = (F.date_diff(F.col("after.day"), F.col("day")) == 1) & (F.col("night_h") > 0) & (F.col("after.night_h") > 0) & (F.col("last_min") >= 1440) & (F.col("after.first_min") <= 0) & F.col("ev_last").isNotNull() & F.col("after.dawn")
    back = (F.date_diff(F.col("day"), F.col("before.day")) == 1) & (F.col("night_h") > 0) & (F.col("before.night_h") > 0) & (F.col("before.last_min") >= 1440) & (F.col("first_min") <= 0) & F.col("before.eve") & F.col("ev_first").isNotNull()
    facts = facts.withColumns(
        {
            "onward": fills(onward), "back": fills(back), "always": fills((F.col("on_h") >= ALWAYS_ON_H) | ((F.col("first_min") <= 0) & (F.col("last_min") >= 1440))),
            "active": has_prod | F.col("has_solver") | F.col("accepted") | F.col("has_act") | F.col("has_block") | F.col("is_offsite") | F.col("is_manual"),
        }
    ).drop("after", "before")
    trims = F.lit(trim > 0) & ~F.col("always")
    facts = facts.withColumns({"w0": F.when(trims & (F.col("w0") > 0) & ~F.col("near0"), F.col("w0") + trim).otherwise(F.col("w0")), "w1": F.when(trims & (F.col("w1") < 1440) & ~F.col("near1"), F.col("w1") - trim).otherwise(F.col("w1"))})

    clip = lambda p: F.struct(F.greatest(p["a"], F.col("w0")).alias("a"), F.least(p["b"], F.col("w1")).alias("b"))
    facts = facts.withColumn("wins", F.filter(F.transform(F.coalesce("wins", F.array().cast("array<struct<a: double, b: double>>")), clip), lambda p: p["a"] < p["b"]))
    facts = stored(facts.withColumns({"first_on": F.array_min(F.col("wins")["a"]), "last_on": F.array_max(F.col("wins")["b"])}))
    facts = facts.withColumns({"has_win": F.col("first_on").isNotNull(), "t_first": F.coalesce("first_on", "first_min"), "t_last": F.coalesce("last_on", "last_min")})
    floors = ~F.col("off") | (F.lit(weekend == "pc") & F.col("active") & F.col("has_win"))
    facts = facts.withColumn("floors", floors)
    timed = F.col("t_first").isNotNull() & F.col("t_last").isNotNull()
    wide = F.lit(weekend != "none") & ~F.col("floors") & F.col("off") & has_prod & (F.col("on_h") > 0) & timed & ~F.col("has_act")
    lit = lambda a, b, when: F.struct(F.when(when, a).cast("double").alias("a"), F.when(when, b).cast("double").alias("b"))
    credits = ~F.col("off") & (F.col("night_h") > 0) & has_prod & F.col("t_last").isNotNull()
    yes = F.lit(True)
    windows = {
        "weekend": lit(F.when(F.col("back"), F.col("t_first")).otherwise(F.greatest("t_first", F.col("prod_min") - pad)), F.when(F.col("onward"), F.col("t_last")).otherwise(F.least("t_last", F.col("prod_max") + pad)), wide),
        "eve": lit(F.greatest(F.lit(high), F.coalesce("t_first", F.lit(high))), F.least("t_last", F.when(F.col("onward"), 1440.0).otherwise(F.col("ev_last") + pad)), credits & F.col("ev_last").isNotNull()),
        "dawn": lit(F.greatest("t_first", F.when(F.col("back"), 0.0).otherwise(F.col("ev_first") - pad)), F.least(F.lit(low), F.col("t_last")), credits & F.col("ev_first").isNotNull() & F.col("t_first").isNotNull()),
        "tw": lit(F.greatest(F.lit(0.0), F.least("prod_min", "t0") - pad), F.least(F.lit(1440.0), F.greatest("prod_max", "t1") + pad), F.coalesce("prod_min", "t0").isNotNull()),
        "tm": lit(F.greatest(F.lit(0.0), F.least("prod_min", "m0") - pad), F.least(F.lit(1440.0), F.greatest("prod_max", "m1") + pad), F.coalesce("prod_min", "m0").isNotNull()),
        "dayw": lit(F.lit(low), F.lit(high), yes), "lunch": lit(F.lit(l0), F.lit(l1), yes), "dinner": lit(F.lit(d0), F.lit(d1), yes),
        "flex": lit(F.lit(max(0.0, low - 60 * s.flex_edge_h)), F.lit(min(1440.0, high + 60 * s.flex_edge_h)), yes), "all": lit(F.lit(0.0), F.lit(1440.0), yes),
    }
    facts = facts.withColumns({f"w_{k}": w for k, w in windows.items()})
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"w_{k}.a").alias("a"), F.col(f"w_{k}.b").alias("b")) for k in windows))).alias("w")
    fixed = intervals.sane(facts.select(*KEYS, named).select(*KEYS, "w.*"))
    on = kind_of(facts.select(*KEYS, F.explode("wins").alias("w")).select(*KEYS, "w.*"), "win")
    clipped = intervals.clip(reduce(DataFrame.union, [spans.where("kind NOT IN ('win', 'other')"), on, fixed]), F.lit(0.0), F.lit(1440.0))

    most = min(MACHINE_DAY_H, (high - low) / 60)
    facts = facts.withColumn("on_day", F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("on_h") - F.col("night_h"))))
    facts = facts.withColumn("clock", F.when(F.col("measured"), "spans").when((F.col("on_day") > 0) & F.col("has_win"), "window").when(F.col("on_day") > 0, "hours"))
    by_hours = fills(F.col("clock") == "hours")
    in_day = lambda a, b: F.greatest(a, F.lit(low)) < F.least(b, F.lit(high))
    owns = F.col("clock").isNotNull() & (by_hours | F.exists("wins", lambda w: in_day(w["a"], w["b"])))  # the machine's record has time inside the day window
    tw, wide_w = F.col("w_tw"), F.col("w_weekend")
    owns_traced = tw["a"].isNotNull() & F.when(by_hours, in_day(tw["a"], tw["b"])).otherwise(F.exists("wins", lambda w: in_day(F.greatest(w["a"], tw["a"]), F.least(w["b"], tw["b"]))))
    facts = facts.withColumn("always", F.col("always") & owns)
    keeps = owns & (~F.col("always") | fills(owns_traced))
    facts = facts.withColumn("bare", ~keeps & ~F.col("has_act") & ~F.col("is_offsite") & ~F.col("is_manual") & (has_prod | F.col("accepted") | F.col("has_block")))
    facts = facts.withColumn("basis", F.when(F.col("bare"), "trace").when(F.col("always"), "always_on").otherwise(F.col("clock")))
    bits = lambda *kinds: F.lit(mask(*kinds)).cast("long")
    none = F.lit(0).cast("long")
    idle = F.col("off") & ~F.col("active")
    facts = facts.withColumns(
        {
            "ground_bits": F.when(F.col("bare"), bits("tm", "dayw")).when(F.col("clock").isNotNull(), bits("dayw") + F.when(by_hours, none).otherwise(bits("win")) + F.when(F.col("always"), bits("tw")).otherwise(none)),
            "base_bits": F.when(~idle, bits("act", "meet", "sess")).when(F.col("carried"), bits("meet")).otherwise(none), "blocks": ~idle, "closed_bits": bits("leave") + F.when(F.col("has_act"), bits("cov")).otherwise(none),
            "no_lunch": fills((wide_w["a"] < wide_w["b"]) & (F.least(wide_w["b"], F.lit(l1)) - F.greatest(wide_w["a"], F.lit(l0)) >= MEAL_MIN)),
            "grows": F.col("w_eve.a").isNotNull() | F.col("w_dawn.a").isNotNull(), "bridges": F.lit(s.gap_bridge_min > 0) & F.col("has_act") & F.col("floors"),
        }
    )

    block, trace = traced()
    anyof = lambda bits: F.col("on").bitwiseAND(F.col(bits)) != 0
    tiled = intervals.cuts(clipped, KINDS, intervals.tasks_for(rows + len(windows) * facts.count()))
    tiled = tiled.join(facts.select(*KEYS, "ground_bits", "base_bits", "blocks", "closed_bits", "no_lunch", "grows", "bridges"), KEYS)
    tiled = tiled.withColumns({"n": F.col("b") - F.col("a"), "block": block, "trace": trace, "ground": fills(F.col("on").bitwiseAND(F.col("ground_bits")) == F.col("ground_bits"))})
    tiled = tiled.withColumns({"base": anyof("base_bits") | (F.col("blocks") & F.col("block")), "open": F.col("ground") & ~anyof("closed_bits"), "left": F.col("ground") & ~has("leave")})
    base, unc, done, eats = F.col("base"), F.col("open"), F.col("base") | has("solver"), F.col("open") & ~F.col("trace")
    wide = has("weekend") & ~(F.col("no_lunch") & has("lunch") & ~F.col("trace")) & ~base
    is_day = has("dayw")
    # A weekend's window opens on days without a floor alone, so that rules 4 to 7 never meet what it adds.
    measures = {
        "base_min": base, "wide_min": wide, "wide_day": wide & is_day & ~has("solver"), "wide_night": wide & ~is_day & ~has("solver"), "wide_solver": wide & has("solver"),
        "done_day": done & is_day, "done_night": done & ~is_day, "base_night": base & ~is_day, "solved": has("solver") & ~base,
        "ground_min": F.col("ground"), "left_min": F.col("left"), "left_lunch": F.col("left") & has("lunch"), "open_min": unc, "noon": eats & has("lunch"), "supper": eats & has("dinner"), "both": eats & has("lunch") & has("dinner"),
        "met_min": unc & (has("meet") | F.col("block")), "done_inside": done & is_day & unc, "flex_left": has("win") & has("flex") & ~is_day & ~done,
    }
    held = F.col("bridges") | (F.col("grows") & ~done & has("eve", "dawn"))
    told = F.col("on") + F.when(done, F.lit(DONE)).otherwise(0) + F.when(unc, F.lit(OPEN)).otherwise(0)
    days = tiled.groupBy(*KEYS).agg(*(F.sum(F.when(holds, F.col("n")).otherwise(0.0)).alias(name) for name, holds in measures.items()), F.collect_list(F.when(held, F.struct("a", "b", told.alias("on")))).alias("pieces"))
    needed = ["off", "active", "floors", "grows", "bridges", "is_offsite", "is_manual", "has_win", "on_h", "night_h", "on_day", "basis", "absent", "manual_h", "act_min", "last_min", "t_last", "w_eve", "w_dawn"]
    days = days.join(facts.select(*KEYS, *needed), KEYS)
    days = days.withColumns({"widens": (F.col("wide_min") > 1e-9) & (F.col("on_h") * 60 > F.col("base_min") + 1e-9), "allowed": F.col("night_h") * 60 - F.col("base_night")})

    span = lambda k: F.col(f"w_{k}.b") - F.col(f"w_{k}.a")
    part = lambda lo, hi, k, p: F.struct((lo / span(k)).alias("lo"), (hi / span(k)).alias("hi"), (p["b"] - p["a"]).alias("n"), (over(p, "win") & over(p, "flex")).alias("flex"))
    eve = lambda p: part(F.col("w_eve.b") - p["b"], F.col("w_eve.b") - p["a"], "eve", p)
    dawn = lambda p: part(p["a"] - F.col("w_dawn.a"), p["b"] - F.col("w_dawn.a"), "dawn", p)
    growing = F.transform(F.filter("pieces", lambda p: ~marked(p, DONE) & over(p, "eve", "dawn")), lambda p: F.when(over(p, "eve"), eve(p)).otherwise(dawn(p)))
    days = days.withColumn("grown", F.when(F.col("grows") & (F.col("allowed") > 1e-9), growing))
    days = days.withColumn("steps", growth(F.col("grown")))
    days = days.withColumns({"last": F.array_max(F.filter("steps", lambda x: x["sum"] <= F.col("allowed") + 1e-9)), "after": F.array_min(F.filter("steps", lambda x: x["sum"] > F.col("allowed") + 1e-9))})
    days = days.withColumn("share", F.when(F.col("steps").isNotNull(), fitted_share(F.col("last"), F.col("after"), F.col("allowed"))).otherwise(0.0)).drop("steps", "last", "after")
    credit = lambda pieces: F.coalesce(grown_by(pieces, F.col("share")), F.lit(0.0))
    days = days.withColumns({"credit_min": credit(F.col("grown")), "credit_flex": credit(F.filter("grown", lambda p: p["flex"])), "eve_cut": F.col("w_eve.b") - span("eve") * F.col("share"), "dawn_cut": F.col("w_dawn.a") + span("dawn") * F.col("share")}).drop("grown")

    def halves(p: Column) -> Column:
        cut = F.when(over(p, "eve"), F.col("eve_cut")).when(over(p, "dawn"), F.col("dawn_cut"))
        made = lambda a, b: F.struct(a.alias("a"), b.alias("b"), p["on"].alias("on"))
        return F.when((cut > p["a"] + 1e-9) & (cut < p["b"] - 1e-9), F.array(made(p["a"], cut), made(cut, p["b"]))).otherwise(F.array(made(p["a"], p["b"])))

    bridging = F.when(F.col("bridges"), F.array_sort("pieces"))
    days = days.withColumn("pieces", bridging).withColumn("pieces", F.when(F.col("grows") & (F.col("share") > 0), F.flatten(F.transform("pieces", halves))).otherwise(F.col("pieces")))
    fits = lambda p: fills((over(p, "eve") & (p["a"] >= F.col("eve_cut") - 1e-9)) | (over(p, "dawn") & (p["b"] <= F.col("dawn_cut") + 1e-9)))
    counted = lambda p: marked(p, DONE) | fits(p)
    ahead = F.greatest(F.size("ins") - 1, F.lit(0))
    between = F.zip_with(F.slice("ins", F.lit(1), ahead), F.slice("ins", F.lit(2), ahead), lambda x, y: F.struct(x["b"].alias("a"), y["a"].alias("b")))
    days = days.withColumn("ins", F.filter("pieces", counted)).withColumn("late", (F.col("night_h") > 0) | fills(F.col("t_last") >= d1) | fills(F.array_max(F.col("ins")["b"]) >= d1))
    meal = lambda p: over(p, "lunch") | (over(p, "dinner") & F.col("late"))
    days = days.withColumn("gaps", F.filter(between, lambda g: g["b"] > g["a"])).drop("ins")
    within = lambda p, g: (p["a"] >= g["a"]) & (p["b"] <= g["b"])
    spent = lambda holds: intervals.minutes("pieces", holds)
    gaps = F.transform("gaps", lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), spent(lambda p: within(p, g) & over(p, "cov")).alias("cov"), spent(lambda p: within(p, g) & ~meal(p)).alias("work")))
    bridged = lambda g: (g["cov"] >= g["b"] - g["a"] - 1e-6) & (g["work"] > 1e-9) & (g["work"] <= s.gap_bridge_min + 1e-9)
    days = days.withColumn("gaps", gaps).withColumn("gaps", F.filter("gaps", bridged))
    filled = F.filter("pieces", lambda p: ~meal(p) & F.exists("gaps", lambda g: within(p, g)))
    days = days.withColumn("pieces", F.when(F.size("gaps") > 0, filled)).drop("gaps")
    flexed = lambda p: over(p, "win") & over(p, "flex") & ~over(p, "dayw")
    added = {"bridge_min": lambda p: F.lit(True), "bridge_day": lambda p: over(p, "dayw"), "bridge_inside": lambda p: over(p, "dayw") & marked(p, OPEN), "bridge_flex": flexed}
    days = days.withColumns({name: F.coalesce(spent(holds), F.lit(0.0)) for name, holds in added.items()})

    hours_on = F.when(F.col("basis").isin("window", "hours"), F.col("on_day")).otherwise(F.col("ground_min") / 60)
    lunches_cut = (F.col("left_lunch") >= MEAL_MIN) & (~F.col("basis").eqNullSafe("window") | (F.col("left_lunch") / 60 <= hours_on + 1e-9))
    dinners_cut = (F.col("night_h") > 0) & (hours_on >= 6) & fills(F.col("last_min") >= d1)
    days = days.withColumns({"lunch_min": F.when(lunches_cut, F.col("noon")).otherwise(0.0), "dinner_min": F.when(dinners_cut, F.col("supper")).otherwise(0.0), "both": F.when(lunches_cut & dinners_cut, F.col("both")).otherwise(0.0)})
    widened = lambda c: F.when(F.col("widens"), F.col(c)).otherwise(0.0)
    late_min = F.col("credit_min") + F.col("bridge_min") - F.col("bridge_day")
    sums = {
        "day_min": F.col("done_day") + widened("wide_day") + F.col("bridge_day"), "night_min": F.col("done_night") + widened("wide_night") + late_min, "night_ex": F.col("base_night") + late_min, "floor_raw": F.col("open_min") - F.col("lunch_min") - F.col("dinner_min") + F.col("both"),
        "inside_min": F.col("done_inside") + F.col("bridge_inside"), "flex_min": F.col("flex_left") - F.col("credit_flex") - F.col("bridge_flex"), "wide_add": widened("wide_min"), "solver_min": F.col("solved") - widened("wide_solver"),
    }
    carried = ["lunch_min", "dinner_min", "met_min", "credit_min", "bridge_min", "off", "absent", "on_h", "night_h", "on_day", "basis", "active", "floors", "is_offsite", "is_manual", "manual_h", "act_min", "ground_min", "left_min", "has_win"]
    sizes = days.select(*KEYS, *(c.alias(name) for name, c in sums.items()), *carried)

    hour = lambda c: F.col(c) / 60
    gate = F.col("floors") & (F.col("absent") < 1) & (F.col("day_min") + F.col("night_ex") > 0) & F.col("active")
    share_left = F.when(F.col("ground_min") > 0, F.col("left_min") / F.col("ground_min")).otherwise(1.0)
    asleep = F.greatest(F.lit(0.0), hour("ground_min") - F.col("on_day")) * share_left
    floor = (
        F.when(F.col("basis") == "window", F.greatest(F.lit(0.0), hour("floor_raw") - F.greatest(F.lit(0.0), asleep - hour("lunch_min") - hour("met_min"))))
        .when(F.col("basis") == "hours", F.greatest(F.lit(0.0), F.least(hour("floor_raw"), F.col("on_day") - hour("lunch_min") - hour("dinner_min") + hour("met_min"))))
        .when(F.col("basis") == "trace", F.least(hour("floor_raw"), F.lit(s.std_day_h)))
        .otherwise(hour("floor_raw"))
    )
    rest = F.col("day_min") - F.col("inside_min")
    half = (F.col("absent") > 0) & (F.col("absent") < 1)
    held = F.when(half, F.least(floor, F.greatest(F.lit(0.0), s.std_day_h * (1 - F.col("absent")) - rest / 60))).otherwise(floor)
    done = sizes.withColumns({"gate": fills(gate), "floor": held})
    lifts = F.col("gate") & F.col("basis").isNotNull() & (F.col("left_min") > 0) & (F.col("floor") * 60 > F.col("inside_min") + 1e-9)
    done = done.withColumn("floor_add", F.when(lifts, F.col("floor") * 60 - F.col("inside_min")).otherwise(0.0))
    room = F.col("night_h") * 60 - F.col("night_ex")
    flexes = F.col("gate") & F.col("basis").isin("window", "spans") & F.col("has_win") & ~F.col("off") & (room > 1e-9)
    done = done.withColumn("flex_add", F.when(fills(flexes), F.least("flex_min", room)).otherwise(0.0))
    traced_h = (F.col("day_min") + F.col("floor_add") + F.col("night_min") + F.col("flex_add")) / 60
    least = F.greatest(F.when(F.col("is_offsite") & ~F.col("off"), s.std_day_h * (1 - F.col("absent"))).otherwise(0.0), F.when(F.col("is_manual"), F.col("manual_h")).otherwise(0.0))
    done = done.withColumns({"traced_h": traced_h, "worked": F.greatest(traced_h, least)})
    odd = {
        "machine day over 11 h": F.col("on_h") - F.col("night_h") > MACHINE_DAY_H + 1e-9, "sampler active for 20 h or more": F.col("act_min") >= 60 * SAMPLER_MOST_H,
        "work on a day of absence": (F.col("absent") >= 1) & (F.col("worked") > 0), "more than 24 h": F.col("worked") > 24 + 1e-9,
    }
    ledger = F.concat_ws("; ", *(F.when(holds, name) for name, holds in odd.items()))
    added = {"weekend_h": "wide_add", "solver_h": "solver_min", "credit_h": "credit_min", "bridge_h": "bridge_min", "floor_h": "floor_add", "flex_h": "flex_add"}
    whole_h = {"hours": F.least("worked", F.lit(24.0)), "day_h": (F.col("day_min") + F.col("floor_add")) / 60, "night_h": (F.col("night_min") + F.col("flex_add")) / 60, **{n: hour(c) for n, c in added.items()}, "least_h": F.col("worked") - F.col("traced_h")}
    return done.select(
        *KEYS, *(hundredths(c).alias(name) for name, c in whole_h.items()), F.when(F.col("gate") & (F.col("left_min") > 0), F.col("basis")).alias("basis"), "active",
        (F.least("worked", F.lit(24.0)) > s.long_day_h + 1e-9).alias("long_day"), ledger.alias("anomalies"),
    )


def anomaly_ledger(days: DataFrame) -> DataFrame:
    """owner, day, kind, hours: a row for each thing that a day's ledger names.

    The days are written first: a filter on what the rules give would be pushed down
    through them and copy all of them into itself, more than the planner gets done."""
    days = stored(days.select(*KEYS, "hours", "anomalies"))
    return days.where("anomalies <> ''").select(*KEYS, F.explode(F.split("anomalies", "; ")).alias("kind"), "hours")
