"""Calendar entries and worklogs as days: meetings, blocks, leave, off-site work.

Entries: owner, start, end (timestamps), all_day, busy (0 free, 1 tentative, 2 busy,
3 out of office, 4 elsewhere; null counts as busy), response (1 and 3 accepted, 4
declined, 5 none), status (0 appointment, 1 own meeting, 3 received, 5 and 7
cancelled; null unknown) and subject. Words are settings. Every rule is a column,
so an entry is read once; an entry that ends before it begins gives nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from worktide.functions import predicates as P
from worktide.functions.config import Settings
from worktide.operators import intervals

MOST_DAYS = 62


@dataclass(frozen=True)
class Words:
    """Lower-case words that decide about entries."""

    leave: tuple[str, ...] = ("leave", "vacation", "day off")
    guard: tuple[str, ...] = ("notice", "statistics", "survey")
    half: tuple[str, ...] = ("half day", "am off", "pm off")
    training: tuple[str, ...] = ("training", "seminar")
    offsite: tuple[str, ...] = ("site visit", "business trip", "on site")
    private: tuple[str, ...] = ()


def has(subject: Column, words) -> Column:
    return F.coalesce(P.keyword_hit(subject, list(words)).isNotNull(), F.lit(False)) if words else F.lit(False)


def known(column: str, default: int = -1) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def not_my_absence() -> Column:
    """An invitation that says nothing about the owner's own leave: cancelled,
    declined, unanswered, received without being out of office, or for information."""
    status, response, busy = known("status"), known("response"), known("busy")
    return status.isin(5, 7) | response.isin(4, 5) | ((status == 3) & (busy != 3)) | ((busy == 0) & (status != 0))


def unaccepted_training(words: Words = Words()) -> Column:
    return has(F.col("subject"), words.training) & ~known("busy", 2).isin(2, 3) & ~known("response").isin(1, 3)


def length_min() -> Column:
    return F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")) / 60e6


def is_appointment(words: Words = Words()) -> Column:
    """A block rather than a meeting: an appointment without others, or, where the
    status is unknown, more than five hours without a word for off-site work."""
    long = (length_min() > 300) & ~has(F.col("subject"), words.offsite + words.training)
    return (known("status") == 0) | (F.col("status").isNull() & F.coalesce(long, F.lit(False)))


def is_leave(words: Words = Words()) -> Column:
    return has(F.col("subject"), words.leave) & ~has(F.col("subject"), words.guard)


def last_day() -> Column:
    """An end at midnight belongs to the day before; no end: the first day."""
    end = F.coalesce(F.col("end"), F.col("start"))
    at_midnight = (end == F.date_trunc("day", end)) & (F.to_date(end) > F.to_date("start"))
    return F.date_sub(F.to_date(end), F.when(at_midnight, 1).otherwise(0))


def dates(entries: DataFrame, most: int | None = None) -> DataFrame:
    """Entries once for each date they touch, at most ``most``."""
    last = F.least(last_day(), F.date_add(F.to_date("start"), most - 1)) if most else last_day()
    return entries.where(F.to_date("start") <= last_day()).withColumn("day", F.explode(F.sequence(F.to_date("start"), last)))


def skipped(tentative: str = "skip") -> Column:
    """Cancelled, declined, free or undecided: no meeting and no off-site work."""
    return P.meeting_skip(F.coalesce("subject", F.lit("")), known("response"), known("busy", 2), tentative).isNotNull()


def meeting_spans(entries: DataFrame, first: str, last: str, now: Column | None = None, words: Words = Words(), settings: Settings = Settings(), tentative: str = "skip") -> DataFrame:
    """owner, day, a, b (minutes), block, away, accepted, carried: timed entries cut at
    midnights. A piece longer than its cap (eight hours of an entry of several days,
    else the day window's length if that is more) keeps what lies in the day window,
    or its beginning. accepted: a real meeting by status or response, or by busy where
    neither is known; carried: a piece behind the first day; block: an appointment,
    no working time by itself; away: with a word for off-site work or training. What lies behind ``now`` and its slack has not happened."""
    low, high = map(float, settings.day_window)
    gone = has(F.col("subject"), words.private) | is_leave(words) | unaccepted_training(words) | skipped(tentative) | F.coalesce("all_day", F.lit(False))
    held = entries.where(~gone & (F.col("start") < F.col("end"))).select(
        "owner", "start", "end", is_appointment(words).alias("block"), has(F.col("subject"), words.offsite + words.training).alias("away"), length_min().alias("length"),
        F.when(F.col("status").isNull() & F.col("response").isNull(), known("busy", 2).isin(2, 3)).otherwise(known("status").isin(1, 3) | known("response").isin(1, 3)).alias("accepted"),
    )
    if now is not None:
        held = held.withColumn("end", F.least("end", now + F.expr(f"INTERVAL {int(settings.future_slack_min * 60)} SECONDS")))
    pieces = intervals.midnight_split(held, "start", "end").where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    cap = F.when(F.col("length") > 1440, 480.0).otherwise(max(480.0, high - low))
    inside = (F.least("b", F.lit(high)) > F.greatest("a", F.lit(low))) & (F.col("b") - F.col("a") > cap)
    long = F.col("b") - F.col("a") > cap
    a = F.when(long & inside, F.greatest("a", F.lit(low))).otherwise(F.col("a"))
    b = F.when(long & inside, F.least("b", F.lit(high))).otherwise(F.col("b"))
    return pieces.withColumns({"from": a, "to": F.least(b, a + cap)}).select("owner", "day", F.col("from").alias("a"), F.col("to").alias("b"), "block", "away", "accepted", (F.col("day") > F.to_date("start")).alias("carried"))


def leave_share(words: Words = Words()) -> Column:
    """What share of a day a leave entry takes: a whole day, or half where the subject
    says so; timed out-of-office up to five hours is half a day; other timed leave
    counts by its length (3 h half, 6 h whole)."""
    half = has(F.col("subject"), words.half)
    hours = length_min() / 60
    timed = F.when(known("busy") == 3, F.when(half | (hours <= 5), 0.5).otherwise(1.0)).when(hours >= 6, F.when(half, 0.5).otherwise(1.0)).when(hours >= 3, 0.5)
    return F.when(F.coalesce("all_day", F.lit(False)), F.when(half, 0.5).otherwise(1.0)).when(F.col("start") < F.col("end"), timed)


def own_leave(entries: DataFrame, words: Words = Words()) -> DataFrame:
    rows = entries.where(~not_my_absence() & is_leave(words) & F.col("start").isNotNull())
    return rows.withColumn("frac", leave_share(words)).where("frac IS NOT NULL")


def absence_days(entries: DataFrame, first: str, last: str, words: Words = Words()) -> DataFrame:
    """owner, day, frac: the largest share of a day that leave entries take."""
    inside = dates(own_leave(entries, words)).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.groupBy("owner", "day").agg(F.max("frac").alias("frac"))


def leave_spans(entries: DataFrame, first: str, last: str, words: Words = Words()) -> DataFrame:
    """owner, day, a, b: when timed half days of leave are, cut at midnights."""
    timed = own_leave(entries, words).where("frac < 1 AND NOT coalesce(all_day, false)")
    return intervals.midnight_split(timed, "start", "end").where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select("owner", "day", "a", "b")


def offsite_days(entries: DataFrame, first: str, last: str, words: Words = Words(), tentative: str = "skip") -> DataFrame:
    """owner, day, subject (of the earliest entry): all-day entries, and blocks of six
    hours or more, that are out of office or elsewhere, or busy with a word for it. A
    timed block's last day counts from six in the morning on."""
    busy, whole = known("busy", 2), F.coalesce("all_day", F.lit(False))
    timed = (length_min() >= 360) & is_appointment(words)
    foreign = (known("status") == 3) & ~busy.isin(3, 4) & ~known("response").isin(1, 3)
    fits = (whole | F.coalesce(timed, F.lit(False))) & ~is_leave(words) & ~has(F.col("subject"), words.private) & ~skipped(tentative) & ~foreign
    fits &= busy.isin(3, 4) | ((busy == 2) & has(F.col("subject"), words.offsite + words.training))
    end = F.coalesce(F.col("end"), F.col("start"))
    stays = whole | (F.col("day") == F.to_date("start")) | (F.col("day") < F.to_date(end)) | (F.hour(end) * 60 + F.minute(end) >= 360)
    rows = dates(entries.where(fits & F.col("start").isNotNull()), MOST_DAYS).where(stays & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return rows.groupBy("owner", "day").agg(F.min_by("subject", F.struct("start", "subject")).alias("subject"))


def manual_hours(worklog: DataFrame, first: str, last: str) -> DataFrame:
    """owner, day, hours, entries of hand-written worklogs: the same five values count
    once, hours outside (0, 24] are errors, a day holds 24 at most."""
    five = [F.col("owner"), F.col("day"), *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("category", "entity", "note")), F.col("hours")]
    rows = worklog.where((F.col("hours") > 0) & (F.col("hours") <= 24) & F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(*five).distinct()
    return rows.groupBy("owner", "day").agg(F.least(F.lit(24.0), F.sum("hours")).alias("hours"), F.count(F.lit(1)).alias("entries"))
