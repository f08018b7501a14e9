"""Sweeps over days: a task holds a bounded part of the spans, whatever their number."""

import datetime as dt

from tests.test_whole_days import SCHEMAS
from worktide.operators import hours, intervals, whole_days as D

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(20)]


def test_tiles_tell_what_covers_each_piece(spark):
    rows = [("o", DAYS[0], k, a, b) for k, a, b in (("x", 0.0, 60.0), ("x", 30.0, 90.0), ("x", 30.0, 90.0), ("y", 60.0, 120.0), ("y", 120.0, 130.0), ("z", 0.0, 500.0), ("x", 200.0, 210.0), ("y", 9.0, 9.0))]
    found = intervals.tiles(spark.createDataFrame(rows, "owner string, day date, kind string, a double, b double"), ["x", "y"], 3).first()["pieces"]
    assert [tuple(p) for p in found] == [(0.0, 60.0, 1), (60.0, 90.0, 3), (90.0, 130.0, 2), (200.0, 210.0, 1)]


def test_cuts_are_rows_of_the_same_pieces(spark):
    rows = [("o", DAYS[0], k, a, b) for k, a, b in (("x", 0.0, 60.0), ("y", 30.0, 90.0), ("x", 200.0, 210.0))] + [("p", DAYS[0], "y", 1.0, 2.0)]
    found = intervals.cuts(spark.createDataFrame(rows, "owner string, day date, kind string, a double, b double"), ["x", "y"], 3).orderBy("owner", "a")
    assert [(r["owner"], r["a"], r["b"], r["on"]) for r in found.collect()] == [("o", 0.0, 30.0, 1), ("o", 30.0, 60.0, 3), ("o", 60.0, 90.0, 2), ("o", 200.0, 210.0, 1), ("p", 1.0, 2.0, 2)]


def test_worked_hours_deal_spans_to_more_tasks_as_they_grow(spark, monkeypatch):
    frame = lambda rows, schema: spark.createDataFrame(rows, f"owner string, day date, {schema}")
    traces = frame([("o", d, "session", 540.0 + i, 600.0 + i) for i, d in enumerate(DAYS)], "kind string, a double, b double")
    machine, points = frame([("o", d, 480.0, 1200.0) for d in DAYS], "a double, b double"), frame([("o", d, 570.0) for d in DAYS], "minute double")
    found = hours.worked_hours(traces, machine, points)
    monkeypatch.setattr(intervals, "ROWS_A_TASK", 8)
    more = hours.worked_hours(traces, machine, points)
    assert more.rdd.getNumPartitions() == 10 and found.rdd.getNumPartitions() == 1  # 80 spans
    assert sorted(more.collect()) == sorted(found.collect()) and found.count() == len(DAYS)


def test_whole_days_deal_spans_to_more_tasks_as_they_grow(spark, monkeypatch):
    rows = dict.fromkeys(SCHEMAS, []) | {"sessions": [("o", d, 590.0, 610.0) for d in DAYS], "points": [("o", d, 600, True, False) for d in DAYS]}
    monkeypatch.setattr(intervals, "ROWS_A_TASK", 20)
    found = D.whole_days(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()})
    assert found.rdd.getNumPartitions() == 12  # 40 spans and 10 windows for each of 20 days


def test_a_ledger_does_not_unfold_the_rules(spark):
    days = D.whole_days(**{k: spark.createDataFrame([], schema) for k, schema in SCHEMAS.items()})
    assert len(D.anomaly_ledger(days)._jdf.queryExecution().analyzed().toString()) < 5000  # a filter that meets the rules copies all of them
