"""Known cases of calendar and machine days."""

import datetime as dt

from worktide.operators import calendar_days as C, machine

ENTRY = "owner int, start timestamp_ntz, end timestamp_ntz, all_day boolean, busy int, response int, status int, subject string"


def at(day, hour, minute=0):
    return dt.datetime(2024, 3, day, hour, minute)


def spans(spark, rows, **how):
    found = C.meeting_spans(spark.createDataFrame(rows, ENTRY), "2024-01-01", "2024-12-31", **how).collect()
    return sorted((r["day"].day, r["a"], r["b"], r["block"], r["accepted"], r["carried"]) for r in found)


def test_four_meetings_are_four_hours(spark):
    rows = [(1, at(4, h), at(4, h + 1), False, 2, 1, 1, "m") for h in (9, 11, 13, 15)]
    assert sum(b - a for _, a, b, *_ in spans(spark, rows)) == 240


def test_a_meeting_over_midnight_keeps_its_saturday(spark):
    assert spans(spark, [(1, at(1, 22), at(2, 2), False, 2, 1, 1, "launch")]) == [(1, 1320.0, 1440.0, False, True, False), (2, 0.0, 120.0, False, True, True)]


def test_days_of_a_long_entry_hold_eight_hours(spark):
    got = spans(spark, [(1, at(4, 9), at(6, 18), False, 2, 1, 1, "fair")])
    assert [d for d, *_ in got] == [4, 5, 6] and all(b - a <= 480 for _, a, b, *_ in got)


def test_declined_private_and_future_entries_are_none(spark):
    rows = [(1, at(4, 9), at(4, 10), False, 2, 4, 3, "m"), (1, at(4, 11), at(4, 12), False, 2, 1, 1, "salary talk"), (1, at(4, 13), at(4, 15), False, 2, 1, 1, "m"), (1, at(4, 17), at(4, 16), False, 2, 1, 1, "m")]
    from pyspark.sql import functions as F

    assert spans(spark, rows, words=C.Words(private=("salary",)), now=F.lit("2024-03-04 14:00:00").cast("timestamp_ntz")) == [(4, 780.0, 845.0, False, True, False)]


def test_a_colleagues_leave_is_not_mine_and_notices_are_none(spark):
    rows = [(1, at(4, 0), at(6, 0), True, 3, None, 0, "day off"), (1, at(7, 0), at(8, 0), True, 2, 1, 3, "day off Ann"), (1, at(9, 0), at(10, 0), True, 3, None, 0, "vacation statistics"), (1, at(11, 9), at(11, 13), False, 3, None, 0, "day off")]
    got = C.absence_days(spark.createDataFrame(rows, ENTRY), "2024-01-01", "2024-12-31").collect()
    assert sorted((r["day"].day, r["frac"]) for r in got) == [(4, 1.0), (5, 1.0), (11, 0.5)]


def test_two_machines_at_different_hours_add_up(spark):
    day = dt.date(2024, 3, 4)
    rows = spark.createDataFrame([(1, "pc", day, 4.0, 0.0, 480.0, 720.0), (1, "laptop", day, 5.0, 0.0, 780.0, 1080.0)], "owner int, root string, day date, on_h double, night_h double, first_min double, last_min double")
    none = spark.createDataFrame([], "owner int, root string, day date, a double, b double")
    got = machine.power_days(rows, none).collect()[0]
    assert (got["on_h"], got["first_min"], got["last_min"]) == (9.0, 480.0, 1080.0)
    same = spark.createDataFrame([(1, "pc", day, 480.0, 720.0), (1, "laptop", day, 480.0, 720.0)], "owner int, root string, day date, a double, b double")
    assert machine.power_days(rows.limit(0), same).collect()[0]["on_h"] == 4.0
